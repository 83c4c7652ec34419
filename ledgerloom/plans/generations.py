"""Generation runs: candidates with their observations and evidence, written once; a run that comes again is checked, not written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.merge import KeyedTable

PAIR = ["lec_id", "author_id"]
#: What tells one piece of evidence from another.
PIECE = ["kind", "rule_id", "rule_version", "fingerprint"]
EVIDENCE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in (*PIECE, "payload")]))
RUN = T.StructType([T.StructField(n, T.StringType()) for n in ("run_id", "rule_set_id", "rule_set_version", "source_state", "status")] + [T.StructField("changed", T.LongType())])
ROOT = T.StructType([T.StructField(n, T.LongType()) for n in PAIR] + [T.StructField("first_run", T.StringType())])
OBSERVATION = T.StructType([T.StructField("run_id", T.StringType()), *(T.StructField(n, T.LongType()) for n in PAIR), T.StructField("snapshot", T.StringType()), T.StructField("observation_hash", T.StringType()), T.StructField("evidence", EVIDENCE)])


class GenerationConflict(Exception):
    """A run that was written with other metadata or content; problems: some of the rows that differ."""

    def __init__(self, message: str, problems: list = ()):
        super().__init__(message + (": " + "; ".join(map(str, problems)) if problems else ""))
        self.problems = list(problems)


@dataclass(frozen=True)
class Persisted:
    run_id: str
    candidate_roots: int
    observations: int
    evidence: int
    idempotent_replay: bool


def prepared(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """(lec_id, author_id, snapshot, observation_hash, evidence) of candidates (lec_id, author_id, snapshot) and evidence (lec_id,
    author_id, kind, rule_id, rule_version, payload): a piece's fingerprint is the digest of what it says, an observation's that of
    its snapshot and its pieces' digests, in order, so equal content has equal digests however it came."""
    piece = evidence.select(*PAIR, "kind", "rule_id", "rule_version", "payload").withColumn("fingerprint", F.sha2(F.to_json(F.struct("kind", "payload", "rule_id", "rule_version")), 256))
    pieces = piece.groupBy(*PAIR).agg(F.array_sort(F.collect_set(F.struct(*PIECE, "payload"))).alias("evidence"))
    x = candidates.select(*PAIR, "snapshot").join(pieces, PAIR, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(EVIDENCE)))
    digest = F.sha2(F.concat_ws("|", "snapshot", F.array_join(F.transform("evidence", lambda e: e["fingerprint"]), "|")), 256)
    return x.select(*PAIR, "snapshot", digest.alias("observation_hash"), "evidence")


def differences(wanted: DataFrame, stored: DataFrame, whole: bool) -> DataFrame:
    """(lec_id, author_id, problem, detail) where a run's stored observations aren't what is wanted. whole: pairs on one side only are
    problems too, as in a run that is complete; else the stored ones are a part that is to be gone on from."""
    piece = lambda c: F.transform(F.coalesce(c, F.array().cast(EVIDENCE)), lambda e: F.concat_ws("/", *[e[k] for k in PIECE]))
    w = wanted.select(*PAIR, F.struct("observation_hash", "evidence").alias("w"))
    s = stored.select(*PAIR, F.struct("observation_hash", "evidence").alias("s"))
    x = s.join(w, PAIR, "full" if whole else "left")
    missing, added = F.array_except(piece("s.evidence"), piece("w.evidence")), F.array_except(piece("w.evidence"), piece("s.evidence"))
    problem = (
        F.when(F.col("s").isNull(), "PAIR_NOT_IN_RUN").when(F.col("w").isNull(), "PAIR_NOT_REQUESTED")
        .when((F.size(missing) > 0) | (F.size(added) > 0), "EVIDENCE_DIFFERS").when(F.col("s.observation_hash") != F.col("w.observation_hash"), "OBSERVATION_DIFFERS")
    )
    detail = F.when(problem == "EVIDENCE_DIFFERS", F.concat(F.lit("-"), F.array_join(missing, ",-"), F.lit(" +"), F.array_join(added, ",+")))
    return x.select(*PAIR, problem.alias("problem"), detail.alias("detail")).where("problem is not null")


class GenerationStore:
    """Runs, roots (pairs ever seen) and observations with their evidence, under one folder.

    An observation holds its evidence, so both are written in one merge. A run is RUNNING from before its first row to after its last;
    one that stopped halfway is gone on with, one that differs from what it holds is FAILED, and a COMPLETED one is only compared.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.runs = KeyedTable(spark, f"{path}/runs", RUN, ["run_id"], 1)
        self.roots = KeyedTable(spark, f"{path}/roots", ROOT, PAIR, buckets)
        self.observations = KeyedTable(spark, f"{path}/observations", OBSERVATION, ["run_id", *PAIR], buckets)
        self.spark = spark

    def run(self, run_id: str):
        return self.runs.read().where(F.col("run_id") == run_id).first()

    def _set(self, run: tuple, status: str) -> None:
        before = self.run(run[0])
        self.runs.merge(self.spark.createDataFrame([(*run, status, (before["changed"] if before else 0) + 1)], RUN), when=F.col("n.changed") > F.col("o.changed"))

    def of_run(self, run_id: str) -> DataFrame:
        return self.observations.read().where(F.col("run_id") == run_id)

    def persist(self, run_id: str, rule_set_id: str, rule_set_version: str, source_state: str, candidates: DataFrame, evidence: DataFrame) -> Persisted:
        run, wanted = (run_id, rule_set_id, rule_set_version, source_state), prepared(candidates, evidence)
        before = self.run(run_id)
        if before is not None and tuple(before)[:4] != run:
            raise GenerationConflict(f"generation run {run_id} was created with different metadata")
        stored = self.of_run(run_id)
        if before is not None and before["status"] == "COMPLETED":
            if found := differences(wanted, stored, whole=True).limit(20).collect():
                raise GenerationConflict(f"completed run {run_id} has different content", found)
            return self._result(run_id, True)
        self._set(run, "RUNNING")
        try:
            if found := differences(wanted, stored, whole=False).limit(20).collect():
                raise GenerationConflict(f"run {run_id} holds different content", found)
            self.roots.merge(wanted.select(*PAIR, F.lit(run_id).alias("first_run")))
            self.observations.merge(wanted.withColumn("run_id", F.lit(run_id)))
        except Exception:
            self._set(run, "FAILED")
            raise
        self._set(run, "COMPLETED")
        return self._result(run_id, False)

    def _result(self, run_id: str, replay: bool) -> Persisted:
        n = self.of_run(run_id).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("evidence")), F.lit(0)).alias("e")).first()
        return Persisted(run_id, n["n"], n["n"], n["e"], replay)
