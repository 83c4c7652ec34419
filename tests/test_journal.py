"""Journals against a plain loop, across batches and restarts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import journal as J


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def sha(*parts):
    return hashlib.sha256("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()


def key_of(kind, snapshot):
    return sha(J.POLICY, kind, snapshot)


def command(cand, seq, kind, snapshot, branch=J.STANDARD, actor="u1", principal="p1", second=None, second_principal=None, target=None, replacement=None, reason=None, risk=None):
    return (cand, seq, kind, branch, actor, principal, second, second_principal, target, replacement, reason, snapshot, branch == J.EXCEPTION if risk is None else risk)


class Plain:
    """Lists and scans."""

    def __init__(self):
        self.events = []

    def run(self, rows):
        return [self.step(dict(zip(J.COMMAND.names, r))) for r in sorted(rows, key=lambda r: r[1])]

    def step(self, c):
        mine = [e for e in self.events if e["cand_id"] == c["cand_id"]]
        of = lambda k: next((e for e in mine if e["op_key"] == k), None)
        gone = {e["target"] for e in mine if e["kind"] in ("REVOKE", "SUPERSEDE")}
        key = key_of(c["kind"], c["snapshot_hash"])
        error = self.fault(c, of, gone, mine, of(key) is not None)
        if error:
            return c["seq"], "REFUSED", error, None
        if of(key):
            return c["seq"], "ALREADY_RECORDED", None, of(key)["own"]
        previous = mine[-1]["own"] if mine else None
        own = sha(c["cand_id"], len(mine) + 1, previous, c["kind"], key, c["snapshot_hash"], c["actor"], c["second"])
        self.events.append(c | {"op_key": key, "own": own, "n": len(mine) + 1})
        return c["seq"], "RECORDED", None, own

    def fault(self, c, of, gone, mine, recorded):
        kind = c["kind"]
        if kind == "PROPOSE":
            if c["branch"] not in (J.STANDARD, J.EXCEPTION):
                return "HYBRID_BRANCH_PRECEDENCE"
            if c["risk_acknowledged"] != (c["branch"] == J.EXCEPTION):
                return "HYBRID_PERSISTENCE_SNAPSHOT_INVALID"
            if not c["actor"] or not c["principal"]:
                return "HYBRID_HUMAN_AUTHORIZATION_REQUIRED"
            live = [e for e in mine if e["kind"] == "PROPOSE" and e["op_key"] not in gone]
            return "HYBRID_ACTIVE_PROPOSAL_EXISTS" if live and not recorded else None
        target = of(c["target"])
        if kind != "APPROVE_EXCEPTION":
            if bool(c["replacement"]) != (kind == "SUPERSEDE"):
                return "HYBRID_REVOCATION_INVALID"
            if not (c["reason"] or "").strip():
                return "HYBRID_REASON_INVALID"
            if not target:
                return "HYBRID_REVOCATION_TARGET_NOT_FOUND"
            if target["kind"] not in J.COMPENSABLE:
                return "HYBRID_REVOCATION_TARGET_INVALID"
            by = of(c["replacement"])
            if kind == "SUPERSEDE" and (not by or by is target or by["kind"] not in J.COMPENSABLE or by["n"] <= target["n"]):
                return "HYBRID_REVOCATION_INVALID"
        if not all((c["actor"], c["principal"], c["second"], c["second_principal"])):
            return "HYBRID_HUMAN_AUTHORIZATION_REQUIRED"
        if c["actor"] == c["second"] or c["principal"] == c["second_principal"]:
            return "HYBRID_SELF_APPROVAL_FORBIDDEN"
        if kind == "APPROVE_EXCEPTION":
            if not target or target["kind"] != "PROPOSE":
                return "HYBRID_PROPOSAL_NOT_FOUND"
            if recorded:
                return None
            if target["branch"] != J.EXCEPTION or c["branch"] != J.EXCEPTION or (target["actor"], target["principal"]) != (c["actor"], c["principal"]):
                return "HYBRID_APPROVAL_NOT_APPLICABLE"
            return "HYBRID_PROPOSAL_NOT_EFFECTIVE" if c["target"] in gone else None
        if recorded:
            return None
        if c["target"] in gone:
            return "HYBRID_EVENT_ALREADY_REVOKED"
        return "HYBRID_REVOCATION_INVALID" if kind == "SUPERSEDE" and c["replacement"] in gone else None


def made_up(seed, n=300):
    rng = random.Random(seed)
    rows, keys = [], {c: ["nothing"] for c in range(8)}
    for seq in range(n):
        cand = rng.choice([0, 0, 0, *range(8)])
        kind = rng.choice([J.PROPOSE] * 3 + [J.APPROVE, J.APPROVE, J.REVOKE, J.REVOKE, J.SUPERSEDE])
        snapshot = f"s{cand}-{rng.randrange(30)}"
        pick = lambda: rng.choice(keys[cand][-6:])
        people = rng.choice([("u1", "p1", "u2", "p2")] * 6 + [("u1", "p1", "u1", "p2"), ("u1", "p1", "u2", "p1"), ("u3", "p3", "u2", "p2"), ("u1", None, "u2", "p2"), ("u1", "p1", None, None)])
        branch = rng.choice([J.EXCEPTION] * 3 + [J.STANDARD, J.STANDARD] + ["OTHER"] * (kind == J.PROPOSE and rng.random() < 0.3))
        rows.append(command(cand, seq, kind, snapshot, branch, people[0], people[1], None if kind == J.PROPOSE else people[2], None if kind == J.PROPOSE else people[3], None if kind == J.PROPOSE else pick(), pick() if (kind == J.SUPERSEDE) != (rng.random() < 0.1) else None, rng.choice(["why", "why", "why", " "]), None if rng.random() < 0.9 else rng.random() < 0.5))
        keys[cand].append(key_of(kind, snapshot))
    return rows


def shown(frame):
    return sorted(((r.seq, r.outcome, r.error, r.own) for r in frame.collect()), key=lambda x: x[0])


@pytest.mark.parametrize("seed", [1])
def test_table_against_a_loop(spark, seed):
    rows = made_up(seed)
    plain = Plain()
    want = plain.run(rows)
    decided = J.decide(spark.createDataFrame(rows, J.COMMAND))
    assert shown(decided) == sorted(want)
    assert {x[1] for x in want} == {"RECORDED", "ALREADY_RECORDED", "REFUSED"}
    events = J.journal(decided)
    assert J.broken(events).count() == 0
    live = {(r.cand_id, r.op_key) for r in J.effective_proposals(events).collect()}
    gone = {e["target"] for e in plain.events if e["kind"] in ("REVOKE", "SUPERSEDE")}
    assert live == {(e["cand_id"], e["op_key"]) for e in plain.events if e["kind"] == "PROPOSE" and e["op_key"] not in gone}


def run_stream(spark, folder):
    """All files that came since the last run."""
    stream = spark.readStream.schema(J.COMMAND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    J.decide(stream).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(J.EVENT).parquet(f"{folder}/out")


def test_stream_goes_on_after_restart(rocks, tmp_path):
    spark, rows, plain = rocks, made_up(3, 120), Plain()
    want = []
    for k in range(3):
        part = rows[40 * k : 40 * k + 40]
        want += plain.run(part)
        spark.createDataFrame(part, J.COMMAND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = run_stream(spark, tmp_path)
        assert shown(got.select("seq", "outcome", "error", "own")) == sorted(want)
        assert J.broken(J.journal(got)).count() == 0
    # the same commands again append nothing
    before = J.journal(run_stream(spark, tmp_path)).count()
    spark.createDataFrame([(r[0], r[1] + 1000, *r[2:]) for r in rows], J.COMMAND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    again = run_stream(spark, tmp_path).where("seq >= 1000")
    recorded = {key_of(e["kind"], e["snapshot_hash"]) for e in plain.events}
    assert again.where("outcome = 'RECORDED'").select("op_key").distinct().where(F.col("op_key").isin(*recorded)).count() == 0
    assert again.where("outcome = 'ALREADY_RECORDED'").count() > 0 and before > 0


def test_changes_are_found(spark):
    events = J.journal(J.decide(spark.createDataFrame([command(1, 1, J.PROPOSE, "a", J.EXCEPTION), command(1, 2, J.APPROVE, "b", J.EXCEPTION, second="u2", second_principal="p2", target=key_of(J.PROPOSE, "a")), command(1, 3, J.REVOKE, "c", second="u2", second_principal="p2", target=key_of(J.PROPOSE, "a"), reason="x")], J.COMMAND)))
    assert events.count() == 3
    problems = lambda df: {(r.stream_seq, r.problem) for r in J.broken(df).collect()}
    assert problems(events.withColumn("actor", F.when(F.col("stream_seq") == 2, "other").otherwise(F.col("actor")))) == {(2, "CHANGED_CONTENT")}
    assert problems(events.where("stream_seq <> 2")) == {(3, "GAP")}
    assert J.effective_proposals(events).count() == 0


def test_query(spark, sf_dir):
    from ledgerloom.plans.q_reviews import journal_commands
    from ledgerloom.plans.standins import Relations
    from ledgerloom.registry import QUERIES

    rows = [tuple(r) for r in journal_commands(Relations(spark, sf_dir)).collect()]
    got = QUERIES["journal_decisions"](spark, sf_dir)
    assert shown(got) == sorted(Plain().run(rows), key=lambda x: x[0])
    assert {r.outcome for r in got.select("outcome").distinct().collect()} >= {"RECORDED", "REFUSED"}
