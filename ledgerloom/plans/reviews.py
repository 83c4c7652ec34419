"""Batches of review commands as an ordered fold over state: accept, reject, revoke, reopen, and groups accepted as a whole.

Commands change what later ones are checked against. An author's commands are folded in order by one stream; what an author's fold
needs from elsewhere (whether a group's other members pass, how many of a lecturer's candidates are in force by then) is taken from the
round before, until nothing changes. As each command depends on earlier ones only, what is stable is what a plain loop would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

# Roles that may review, states in which candidates compete, and least and greatest sizes of a group.
REVIEWERS, ACTIVE, GROUP_SIZES = ("ADMIN", "REVIEWER"), ("PENDING", "ACCEPTED"), (2, 10)

DECIDED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("seq", "item", "cand_id")]
    + [T.StructField("error", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("from_status", T.StringType()), T.StructField("to_status", T.StringType())]
    + [T.StructField("version", T.LongType()), T.StructField("delta", T.LongType())]
)


class Candidate:
    """A candidate as it stands in the fold of its author."""

    def __init__(self, r: dict):
        self.status, self.version = r["status"], r["now_version"]
        self.identity, self.mine = r["identity"], r["mine"]  # the pair's identity, and whether a review of this candidate made it
        self.accepted: set = set()
        self.rejected: set = set()
        self.ever_rejected = r["ever_rejected"]


class Author:
    """What an author's commands share."""

    def __init__(self, r: dict):
        self.owners, self.active = set(r["owners"] or ()), r["author_active"]  # one owner, where the data keep to the rule
        self.candidates: dict[int, Candidate] = {}

    def step(self, r: dict) -> tuple:
        """(error, outcome, from, to, version, change of the lecturer's candidates in force) of one command, which it applies."""
        c = self.candidates.setdefault(r["cand_id"], Candidate(r)) if r["found"] else None
        error = self.check(r, c)
        if error in (None, "IDEMPOTENT"):
            if error or r["grp"] is not None and not r["group_ok"]:
                return (None, error or "GROUP_FAILED", None, None, c.version, 0)
            return (None, "APPLIED", *self.apply(r, c))
        return (error, None, None, None, c.version if c else None, 0)

    def check(self, r: dict, c: Candidate | None) -> str | None:
        action, reviewer = r["action"], r["user_known"]
        if r["grp_fault"]:
            return r["grp_fault"]
        if not reviewer:
            return "REVIEWER_NOT_FOUND"
        if not r["may_revoke" if action == "REVOKE" else "may_review"]:
            return "REVIEWER_NOT_AUTHORIZED"
        if not r["reasoned"] and action != "ACCEPT":
            return "REVOCATION_REASON_REQUIRED" if action == "REVOKE" else "INVALID_REVIEW_REASON"
        if c is None:
            return "CANDIDATE_NOT_FOUND"
        if r["grp"] is not None and self.active - (c.status in ACTIVE) > 0:
            return "GROUP_SHARED_SCOPUS_AUTHOR"
        if action == "ACCEPT" and (r["accepted_before"] or r["obs_id"] in c.accepted):
            return "IDEMPOTENT" if c.identity == "APPROVED" and c.mine else "CANDIDATE_ALREADY_DECIDED_CONFLICT"
        if action == "REJECT" and (r["rejected_before"] or r["obs_id"] in c.rejected):
            return "IDEMPOTENT"
        wanted, unmet = {"REVOKE": ("ACCEPTED", "CANDIDATE_NOT_ACCEPTED"), "REOPEN": ("REJECTED", "CANDIDATE_NOT_REJECTED")}.get(action, ("PENDING", "CANDIDATE_ALREADY_DECIDED_CONFLICT"))
        if c.status != wanted:
            return unmet
        if c.version != r["version"]:
            return "STALE_CANDIDATE_VERSION"
        if action == "REVOKE":
            return None if c.identity == "APPROVED" and c.mine else unmet
        if action == "REOPEN":
            return None if c.ever_rejected else unmet
        if not r["obs_known"]:
            return "OBSERVATION_NOT_FOUND"
        if not r["obs_own"]:
            return "OBSERVATION_CANDIDATE_MISMATCH"
        if not r["obs_current"]:
            return "STALE_CANDIDATE_OBSERVATION"
        return self.check_accept(r, c) if action == "ACCEPT" else None

    def check_accept(self, r: dict, c: Candidate) -> str | None:
        if self.owners - {r["lec_id"]}:
            return "SCOPUS_AUTHOR_ALREADY_APPROVED_FOR_OTHER_LECTURER"
        if c.identity == "REVOKED":
            return "IDENTITY_REVOKED_REACCEPT_UNSUPPORTED"
        if c.identity is not None and not c.mine:
            return "PREEXISTING_IDENTITY_PROVENANCE_CONFLICT"
        weak = not r["has_pub"] or self.active > 1 or r["lec_active"] + r["lec_change"] > 1
        return "REVIEW_REASON_REQUIRED_FOR_WEAK_EVIDENCE" if weak and not r["reasoned"] else None

    def apply(self, r: dict, c: Candidate) -> tuple:
        before, action = c.status, r["action"]
        c.version += 1
        if action == "ACCEPT":
            c.status, c.identity, c.mine = "ACCEPTED", "APPROVED", True
            self.owners.add(r["lec_id"])
            c.accepted.add(r["obs_id"])
        elif action == "REJECT":
            c.status, c.ever_rejected = "REJECTED", True
            c.rejected.add(r["obs_id"])
        else:
            c.status = "PENDING"
            if action == "REVOKE":
                c.identity = "REVOKED"
                self.owners.discard(r["lec_id"])
        delta = (c.status in ACTIVE) - (before in ACTIVE)
        self.active += delta
        return before, c.status, c.version, delta


def fold(commands: DataFrame) -> DataFrame:
    """Rows DECIDED of prepared commands. Each author's are one sorted stream; a task holds that author's candidates, not its commands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, author = object(), None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["author_id"] != now or r["author_id"] is None:
                    now, author = r["author_id"], Author(r)
                out.append((r["seq"], r["item"], r["cand_id"], *author.step(r)))
            if out:
                kinds = [pa.int64()] * 3 + [pa.string()] * 4 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=DECIDED.names)

    spread = F.when(F.col("author_id").isNull(), F.col("seq"))  # commands on candidates that don't exist
    return commands.repartition("author_id", spread).sortWithinPartitions("author_id", "seq", "item").mapInArrow(run, DECIDED)


def prepare(commands: DataFrame, candidates: DataFrame, observations: DataFrame, users: DataFrame, identities: DataFrame, history: DataFrame) -> DataFrame:
    """Each command with what was true before the batch."""
    x = commands.select("seq", "item", "grp", "action", "cand_id", "obs_id", "version", "user_id", "reason", "lecturer", "is_main")
    x = x.withColumn("reasoned", F.coalesce(F.trim("reason") != "", F.lit(False))).withColumn("grp_main", F.coalesce("is_main", F.lit(False)))
    groups = x.where("grp is not null").groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cand_id").alias("n_cands"), F.bool_and("reasoned").alias("all_reasoned"),
        F.count_if(F.col("grp_main") & F.col("cand_id").isNull()).alias("loose"),
    )
    pairs = identities.groupBy("lec_id", "author_id").agg(F.min("status").alias("identity"))
    owners = identities.where("status = 'APPROVED'").groupBy("author_id").agg(F.array_sort(F.collect_set("lec_id")).alias("owners"))
    active = candidates.where(F.col("status").isin(*ACTIVE))
    count = lambda key, name: active.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    ever = history.groupBy("cand_id").agg(F.bool_or(F.col("action") == "REJECT").alias("ever_rejected"), F.bool_or(F.col("action") == "ACCEPT").alias("ever_accepted"))
    # what holds of a candidate meets it before the commands do: those on unknown ones have no author or lecturer to join by
    known = candidates.select("cand_id", F.lit(True).alias("found"), "lec_id", "author_id", "status", F.col("version").cast("long").alias("now_version"))
    known = known.join(pairs, ["lec_id", "author_id"], "left").join(owners, "author_id", "left").join(count("author_id", "author_active"), "author_id", "left").join(count("lec_id", "lec_active"), "lec_id", "left").join(ever, "cand_id", "left")
    x = x.where("cand_id is not null").join(groups, "grp", "left").join(known, "cand_id", "left")
    size = F.col("n") - F.col("loose")
    x = x.withColumn("grp_fault", F.when(F.col("grp").isNotNull(),
        F.when(~size.between(*GROUP_SIZES), "GROUP_NEEDS_TWO_TO_TEN_CANDIDATES").when(F.col("n_cands") < size, "GROUP_DUPLICATE_CANDIDATE")
        .when(~F.col("all_reasoned"), "GROUP_REASON_REQUIRED").when(F.col("loose") > 0, "GROUP_PRIMARY_NOT_IN_GROUP")
        .when(F.col("found").isNull(), "CANDIDATE_NOT_FOUND").when(~F.col("lec_id").eqNullSafe(F.col("lecturer")), "GROUP_CANDIDATE_LECTURER_MISMATCH")))
    roles = users.select("user_id", F.lit(True).alias("user_known"), (F.col("active") & F.col("role").isin(*REVIEWERS)).alias("may_review"), (F.col("active") & (F.col("role") == "ADMIN")).alias("may_revoke"))
    x = x.join(roles, "user_id", "left")
    of = observations.select("obs_id", F.lit(True).alias("obs_known"), F.col("cand_id").alias("of_cand"), F.col("is_current").alias("obs_current"), "has_pub")
    x = x.join(of, "obs_id", "left").withColumn("obs_own", F.col("of_cand").eqNullSafe(F.col("cand_id")))
    done = history.groupBy("cand_id", "obs_id").agg(F.bool_or(F.col("action") == "ACCEPT").alias("accepted_before"), F.bool_or(F.col("action") == "REJECT").alias("rejected_before"))
    x = x.join(done, ["cand_id", "obs_id"], "left")
    false = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    flags = ["found", "user_known", "may_review", "may_revoke", "obs_known", "obs_own", "obs_current", "has_pub", "accepted_before", "rejected_before", "ever_rejected"]
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return x.select("seq", "item", "grp", "action", "cand_id", "obs_id", "version", "reasoned", "grp_fault", "lec_id", "author_id", "status", "now_version", "identity", F.coalesce("ever_accepted", F.lit(False)).alias("mine"), "owners", zero("author_active"), zero("lec_active"), *map(false, flags))


def _digest(decided: DataFrame) -> tuple:
    return tuple(decided.agg(F.sum(F.xxhash64(*decided.columns).cast("decimal(38,0)")), F.count(F.lit(1))).first())


def review_batch(commands: DataFrame, candidates: DataFrame, observations: DataFrame, users: DataFrame, identities: DataFrame, history: DataFrame) -> DataFrame:
    """(seq, item, cand_id, action, error, outcome, from_status, to_status, version): what each command does, as a loop by (seq, item) would.

    commands: seq (a group's members share one and no other command has it), item (place in a group), grp (the group, or null), action
    (ACCEPT, REJECT, REVOKE, REOPEN), cand_id, obs_id, version, user_id, reason, and for groups lecturer and is_main (whose ID becomes
    the main one; a row with it and a null cand_id names one outside the group). candidates: cand_id, lec_id, author_id, status,
    version, one for a pair of lecturer and author. observations: obs_id, cand_id, is_current, has_pub. users: user_id, role, active. identities: lec_id, author_id, status.
    history: cand_id, obs_id, action of earlier reviews. Ids are longs.

    outcome is APPLIED, IDEMPOTENT (decided so before), or GROUP_FAILED: a member that would pass, in a group of which another doesn't;
    such a group writes nothing. Rounds are as many as the longest chain of commands that depend on each other across authors. Commands
    on unknown candidates always fail and change nothing, so they are decided once, apart: they have no author or lecturer to be ordered by.
    """
    x = cut(prepare(commands, candidates, observations, users, identities, history))
    x = x.withColumn("group_ok", F.lit(True)).withColumn("lec_change", F.lit(0).cast("long"))
    unknown, x = x.where("not found"), x.where("found")
    failed = unknown.where("grp is not null").select("grp").distinct().withColumn("group_fails", F.lit(True))
    x = cut(x.join(failed, "grp", "left"))
    by_lecturer = Window.partitionBy("lec_id").orderBy("seq", "item").rowsBetween(Window.unboundedPreceding, -1)
    assumed, before = x, None
    while True:
        decided = cut(fold(assumed))
        now = _digest(decided)
        if now == before:
            break
        before = now
        told = x.join(decided.select("seq", "item", "error", "delta"), ["seq", "item"])
        change = told.withColumn("lec_change", F.coalesce(F.sum("delta").over(by_lecturer), F.lit(0))).select("seq", "item", "lec_change")
        whole = told.where("grp is not null").groupBy("grp").agg(F.bool_and(F.col("error").isNull() & F.col("group_fails").isNull()).alias("group_ok"))
        assumed = x.drop("lec_change", "group_ok").join(change, ["seq", "item"]).join(whole, "grp", "left")
    decided = decided.join(x.select("seq", "item", "action"), ["seq", "item"]).unionByName(fold(unknown).join(unknown.select("seq", "item", "action"), ["seq", "item"]))
    return decided.select("seq", "item", "cand_id", "action", "error", "outcome", "from_status", "to_status", "version")


def group_errors(decided: DataFrame, commands: DataFrame) -> DataFrame:
    """(grp, error): the error of each group's first member that has one, or null."""
    of = decided.join(commands.where("grp is not null").select("seq", "item", "grp"), ["seq", "item"])
    return of.groupBy("grp").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("item", "error"))).alias("first")).select("grp", F.col("first.error").alias("error"))


def review_rows(decided: DataFrame, commands: DataFrame) -> DataFrame:
    """What is appended to the history: a revocation is a reopening that compensates an acceptance, so both are written as REOPEN."""
    written = F.when(F.col("action") == "REVOKE", "REOPEN").otherwise(F.col("action"))
    made = decided.where("outcome = 'APPLIED'").join(commands.select("seq", "item", "obs_id", "user_id", F.trim("reason").alias("reason")), ["seq", "item"])
    compensates = F.when(F.col("action") == "REVOKE", "REVOKE").when(F.col("action") == "REOPEN", "REOPEN_REJECTED")
    return made.select("seq", "item", "cand_id", "obs_id", "user_id", written.alias("action"), "from_status", "to_status", (F.col("version") - 1).alias("version"), "reason", compensates.alias("compensation"))


def identity_rows(decided: DataFrame, candidates: DataFrame) -> DataFrame:
    """(lec_id, author_id, status): identities that a batch approves or revokes, after its last such command."""
    made = decided.where("outcome = 'APPLIED' and action in ('ACCEPT', 'REVOKE')").groupBy("cand_id").agg(F.max_by("action", F.struct("seq", "item")).alias("action"))
    return made.join(candidates.select("cand_id", "lec_id", "author_id"), "cand_id").select("lec_id", "author_id", F.when(F.col("action") == "ACCEPT", "APPROVED").otherwise("REVOKED").alias("status"))


def main_ids(decided: DataFrame, commands: DataFrame, candidates: DataFrame) -> DataFrame:
    """(seq, lec_id, author_id): main IDs that accepted groups set."""
    main = commands.where("is_main and grp is not null and cand_id is not null").select("seq", "item")
    done = decided.where("outcome in ('APPLIED', 'IDEMPOTENT')").join(main, ["seq", "item"], "left_semi")
    return done.join(candidates.select("cand_id", "lec_id", "author_id"), "cand_id").select("seq", "lec_id", "author_id")


def audit_rows(decided: DataFrame) -> DataFrame:
    """(seq, item, entity, action): one event for the candidate, and one for the identity that an acceptance makes or a revocation ends."""
    names = {"ACCEPT": ("CANDIDATE_ACCEPTED", "IDENTITY_CREATED"), "REJECT": ("CANDIDATE_REJECTED", None), "REVOKE": ("CANDIDATE_REOPENED", "IDENTITY_REVOKED"), "REOPEN": ("CANDIDATE_REOPENED_FROM_REJECT", None)}

    def of(k: int) -> Column:
        return F.create_map(*[F.lit(x) for a, n in names.items() for x in (a, n[k])])[F.col("action")]

    pairs = F.array(F.struct(F.lit("lecturer_scopus_candidate").alias("entity"), of(0).alias("action")), F.struct(F.lit("lecturer_scopus_identity").alias("entity"), of(1).alias("action")))
    return decided.where("outcome = 'APPLIED'").select("seq", "item", F.explode(pairs).alias("e")).select("seq", "item", "e.entity", "e.action").where("action is not null")
