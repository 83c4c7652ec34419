"""Append-only decision journals: proposals, a second person's approval, revocations; one hash chain a candidate, across batches."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import cut

# Kinds of events, those that can be compensated, and branches.
PROPOSE, APPROVE, REVOKE, SUPERSEDE = "PROPOSE", "APPROVE_EXCEPTION", "REVOKE", "SUPERSEDE"
COMPENSABLE = (PROPOSE, APPROVE)
STANDARD, EXCEPTION = "STANDARD", "INSTITUTIONAL_EXCEPTION"
POLICY = "HYBRID_SOURCE_CLAIM/1"

#: What a command has: who acts and, for approvals and revocations, the second person; the event it is about and, for SUPERSEDE, its
#: replacement; the digest of the snapshot it was prepared from.
COMMAND = T.StructType(
    [T.StructField("cand_id", T.LongType()), T.StructField("seq", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("kind", "branch", "actor", "principal", "second", "second_principal", "target", "replacement", "reason", "snapshot_hash")]
    + [T.StructField("risk_acknowledged", T.BooleanType())]
)
EVENT = T.StructType(
    [T.StructField("cand_id", T.LongType()), T.StructField("seq", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("kind", "op_key", "snapshot_hash", "outcome", "error")]
    + [T.StructField("stream_seq", T.LongType()), T.StructField("previous", T.StringType()), T.StructField("own", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("actor", "second", "target", "replacement")]
)
STATE = "seq long, kind string, branch string, actor string, principal string, compensated boolean, own string"


def op_key(kind: Column, snapshot_hash: Column) -> Column:
    """An event's id: the action and the exact snapshot, so that the same command again is the same event, and no caller chooses it."""
    return F.sha2(F.concat_ws("|", F.lit(POLICY), kind, snapshot_hash), 256)


def envelope(cand_id: Column, stream_seq: Column, previous: Column, kind: Column, key: Column, snapshot_hash: Column, actor: Column, second: Column) -> Column:
    """The digest that an event and the next one in its stream carry."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", *map(blank, (cand_id, stream_seq, previous, kind, key, snapshot_hash, actor, second))), 256)


def keyed(commands: DataFrame) -> DataFrame:
    return commands.select(*COMMAND.names).withColumn("op_key", op_key(F.col("kind"), F.col("snapshot_hash")))


def refusal(c, get) -> str | None:
    """What is wrong with a command in itself and with what it refers to; get() gives an event of the stream by its key."""
    kind, text = c.kind, lambda v: isinstance(v, str) and v.strip() != ""
    if kind == PROPOSE:
        if c.branch not in (STANDARD, EXCEPTION):
            return "HYBRID_BRANCH_PRECEDENCE"
        if bool(c.risk_acknowledged) != (c.branch == EXCEPTION):
            return "HYBRID_PERSISTENCE_SNAPSHOT_INVALID"
        return None if text(c.actor) and text(c.principal) else "HYBRID_HUMAN_AUTHORIZATION_REQUIRED"
    if kind not in (APPROVE, REVOKE, SUPERSEDE):
        return "HYBRID_REVOCATION_INVALID"
    if kind != APPROVE and text(c.replacement) != (kind == SUPERSEDE):
        return "HYBRID_REVOCATION_INVALID"
    if kind != APPROVE and (not text(c.reason) or len(c.reason) > 4000 or any(ord(x) < 32 or ord(x) == 127 for x in c.reason)):
        return "HYBRID_REASON_INVALID"
    target = get(c.target) if text(c.target) else None
    if kind != APPROVE:
        if target is None:
            return "HYBRID_REVOCATION_TARGET_NOT_FOUND"
        if target["kind"] not in COMPENSABLE:
            return "HYBRID_REVOCATION_TARGET_INVALID"
        if kind == SUPERSEDE:
            by = get(c.replacement)
            if by is None or c.replacement == c.target or by["kind"] not in COMPENSABLE or by["seq"] <= target["seq"]:
                return "HYBRID_REVOCATION_INVALID"
    if not all(map(text, (c.actor, c.principal, c.second, c.second_principal))):
        return "HYBRID_HUMAN_AUTHORIZATION_REQUIRED"
    if c.actor == c.second or c.principal == c.second_principal:
        return "HYBRID_SELF_APPROVAL_FORBIDDEN"
    if kind == APPROVE and (target is None or target["kind"] != PROPOSE):
        return "HYBRID_PROPOSAL_NOT_FOUND"
    return None


def conflict(c, get, effective) -> str | None:
    """What the stream's state forbids to a command that hasn't been recorded."""
    if c.kind == PROPOSE:
        return "HYBRID_ACTIVE_PROPOSAL_EXISTS" if effective is not None else None
    target = get(c.target)
    if c.kind == APPROVE:
        if (target["branch"], target["actor"], target["principal"]) != (EXCEPTION, c.actor, c.principal) or c.branch != EXCEPTION:
            return "HYBRID_APPROVAL_NOT_APPLICABLE"
        return "HYBRID_PROPOSAL_NOT_EFFECTIVE" if target["compensated"] else None
    if target["compensated"]:
        return "HYBRID_EVENT_ALREADY_REVOKED"
    return "HYBRID_REVOCATION_INVALID" if c.kind == SUPERSEDE and get(c.replacement)["compensated"] else None


class Stream:
    """A candidate's stream: its last sequence number and digest, its effective proposal, and its events, which get() and put() keep by key."""

    def __init__(self, cand_id, head, get, put):
        self.cand_id, self.get, self.put = cand_id, get, put
        self.seq, self.own, self.effective = head

    def step(self, c) -> tuple:
        """The row EVENT of one command, which is recorded if nothing speaks against it."""
        import hashlib

        get, put = self.get, self.put
        error, old, previous, place, digest = refusal(c, get), get(c.op_key), None, None, None
        if error is None and old is not None:
            outcome, place, digest = "ALREADY_RECORDED", old["seq"], old["own"]
        elif error is None and (error := conflict(c, get, self.effective)) is None:
            outcome, previous, place = "RECORDED", self.own, self.seq + 1
            whole = "|".join("" if v is None else str(v) for v in (self.cand_id, place, previous, c.kind, c.op_key, c.snapshot_hash, c.actor, c.second))
            self.seq, self.own = place, hashlib.sha256(whole.encode()).hexdigest()
            digest = self.own
            put(c.op_key, {"seq": place, "kind": c.kind, "branch": c.branch, "actor": c.actor, "principal": c.principal, "compensated": False, "own": digest})
            if c.kind == PROPOSE:
                self.effective = c.op_key
            elif c.kind in (REVOKE, SUPERSEDE):
                put(c.target, get(c.target) | {"compensated": True})
                self.effective = None if self.effective == c.target else self.effective
        if error is not None:
            outcome = "REFUSED"
        return (self.cand_id, c.seq, c.kind, c.op_key, c.snapshot_hash, outcome, error, place, previous, digest, c.actor, c.second, c.target, c.replacement)


class Journal(StatefulProcessor):
    """A candidate's Stream in keyed state.

    Events are read by key when a command names one, so a long stream isn't loaded. Within a micro-batch a candidate's commands are
    taken in order of seq; a micro-batch is bounded by its source's limits.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq long, own string, effective string")
        self.events = handle.getMapState("events", "key string", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fields = STATE.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", ")
        get = lambda k: dict(zip(fields, self.events.getValue((k,)))) if k and self.events.containsKey((k,)) else None
        put = lambda k, e: self.events.updateValue((k,), tuple(e[f] for f in fields))
        stream = Stream(key[0], self.head.get() if self.head.exists() else (0, None, None), get, put)
        frame = pd.concat(rows).sort_values("seq", kind="stable")
        out = [stream.step(c) for c in frame.astype(object).where(frame.notna(), None).itertuples(index=False)]
        self.head.update((stream.seq, stream.own, stream.effective))
        yield pd.DataFrame(out, columns=EVENT.names).astype({"stream_seq": "Int64"})

    def close(self) -> None:
        pass


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows EVENT of commands sorted by cand_id and seq; a task holds the events of one candidate at a time."""
    stream = None
    for batch in batches:
        row = namedtuple("Command", batch.schema.names)
        out = []
        for c in map(row._make, zip(*(x.to_pylist() for x in batch.columns))):
            if stream is None or c.cand_id != stream.cand_id:
                events: dict = {}
                stream = Stream(c.cand_id, (0, None, None), events.get, events.__setitem__)
            out.append(stream.step(c))
        if out:
            kinds = [pa.int64()] * 2 + [pa.string()] * 5 + [pa.int64()] + [pa.string()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=EVENT.names)


def decide(commands: DataFrame) -> DataFrame:
    """Rows EVENT, one a command: RECORDED with its place in the chain, ALREADY_RECORDED, or REFUSED with why.

    commands: rows COMMAND, a stream, whose state is kept under its query's checkpoint and goes on after a restart, or a table, which
    is one batch from nothing: each candidate's commands are one sorted stream, and no state is stored.
    """
    if not commands.isStreaming:
        return cut(keyed(commands).repartition("cand_id").sortWithinPartitions("cand_id", "seq").mapInArrow(_at_once, EVENT))
    commands.sparkSession.streams  # noqa: B018  (a session without streams yet has no coordinator of state)
    return keyed(commands).groupBy("cand_id").transformWithStateInPandas(Journal(), EVENT, "append", "none")


def journal(decided: DataFrame) -> DataFrame:
    return decided.where("outcome = 'RECORDED'").drop("outcome", "error")


def broken(events: DataFrame) -> DataFrame:
    """(cand_id, stream_seq, problem) of a journal's events whose digest isn't that of their content, that don't carry the one of the
    event before, or that leave a gap."""
    from pyspark.sql import Window

    w = Window.partitionBy("cand_id").orderBy("stream_seq")
    x = events.withColumn("at", F.row_number().over(w)).withColumn("before", F.lag("own").over(w))
    right = envelope(*[F.col(c) for c in ("cand_id", "stream_seq", "previous", "kind", "op_key", "snapshot_hash", "actor", "second")])
    problem = F.when(F.col("at") != F.col("stream_seq"), "GAP").when(~F.col("previous").eqNullSafe(F.col("before")), "BROKEN_LINK").when(F.col("own") != right, "CHANGED_CONTENT")
    return x.select("cand_id", "stream_seq", problem.alias("problem")).where("problem is not null")


def effective_proposals(events: DataFrame) -> DataFrame:
    """(cand_id, op_key, branch-free state): proposals that no revocation or replacement compensates, and whether they are approved."""
    gone = events.where(F.col("kind").isin(REVOKE, SUPERSEDE)).select("cand_id", F.col("target").alias("op_key"))
    live = events.where(F.col("kind").isin(*COMPENSABLE)).join(gone, ["cand_id", "op_key"], "left_anti")
    approved = live.where(F.col("kind") == APPROVE).select("cand_id", F.col("target").alias("op_key"), F.lit(True).alias("approved")).distinct()
    return live.where(F.col("kind") == PROPOSE).join(approved, ["cand_id", "op_key"], "left").select("cand_id", "op_key", F.coalesce("approved", F.lit(False)).alias("approved"))
