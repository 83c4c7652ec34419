"""Queries: streams run over the tables' files until what is there has been read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..session import shared_dir
from ..streaming import jobs
from ..streaming import presence as SP
from .base import query
from .q_composites import PRESENCE
from .q_groups import n_rows


def scratch(r, kind):
    """A folder that driver and executors share."""
    return f"{shared_dir(r.spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def drained(r, stream, mode):
    return jobs.drain(stream, mode, scratch(r, "drained"), scratch(r, "offsets"))


@query("stream_latest_state", "", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_latest_state(r):
    log = jobs.parquet_stream(r.spark, r.sf_dir, "events")
    return drained(r, jobs.latest_state(log, ["user_id"], "event_id", "event_type"), "complete")


def imported(r, rounds=1):
    """The raw rows of orders, imported in batches; a second round over the same files adds nothing."""
    target = scratch(r, "imports")
    for _ in range(rounds):
        stream = jobs.parquet_stream(r.spark, r.sf_dir, "orders").selectExpr("o_orderkey % 4000 AS pub_id", "o_orderkey AS raw_id", "concat(' 2-s2.0-', cast(o_orderkey % 4000 as string)) AS eid_raw")
        jobs.import_batches(stream, jobs.append_new(target, ["raw_id"], 8), scratch(r, "offsets")).awaitTermination()
    return jobs.imported(r.spark, target, stream.schema, ["raw_id"], 8)


@query("stream_import_batches", "", "SELECT o_orderkey AS raw_id, o_orderkey % 4000 AS pub_id FROM orders")
def stream_import_batches(r):
    return imported(r).select("raw_id", "pub_id")


@query("stream_normalize_batches", "", "SELECT concat('2-s2.0-', CAST(o_orderkey % 4000 AS VARCHAR)) AS eid, count(*) AS n FROM orders GROUP BY 1")
def stream_normalize_batches(r):
    return imported(r).groupBy(X.normalize_eid(F.col("eid_raw")).alias("eid")).agg(n_rows())


@query("stream_recover", "", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_distinct FROM orders")
def stream_recover(r):
    """After a lost checkpoint the whole input is read again; what the target has is left out."""
    return imported(r, rounds=2).agg(n_rows(), F.countDistinct("raw_id").alias("n_distinct"))


@query("stream_resume", "pub", " SELECT pub_id FROM (SELECT pub_id, row_number() OVER (ORDER BY eid) AS k FROM pub) WHERE k > 120")
def stream_resume(r):
    """The rest of an ordered work list after `processed` entries: the list's order is its key, so the rest is a comparison."""
    todo = r.pub.select("pub_id", "eid")
    done = todo.orderBy("eid").limit(120).agg(F.max("eid").alias("last"))
    return todo.where(F.col("eid") > done.scalar()).select("pub_id")


@query("stream_dedup_content", "", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def stream_dedup_content(r):
    log = jobs.parquet_stream(r.spark, r.sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return drained(r, jobs.dedup_content(log, "key", "at", "3650 days").select("key"), "append").agg(n_rows())


@query("stream_unread", "", "SELECT e.user_id AS \"user\", event_id % 20 AS report, event_id FROM events e JOIN (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'view' GROUP BY user_id) s ON s.user_id = e.user_id AND event_id > last")
def stream_unread(r):
    seen = r.table("events").where("event_type = 'view'").groupBy(F.col("user_id").alias("user")).agg(F.max("event_id").alias("last_seen"))
    seen = seen.select("user", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("report"), "last_seen")
    activity = jobs.parquet_stream(r.spark, r.sf_dir, "events").selectExpr("user_id AS user", "event_id % 20 AS report", "event_id AS at")
    return drained(r, jobs.unread(activity, seen), "append").select("user", "report", F.col("at").alias("event_id"))


@query("stream_presence", "doc", PRESENCE.replace(" SELECT scope, claim, CASE", " , z AS (SELECT scope, claim, CASE").rstrip() + ") SELECT presence, count(*) AS n FROM z GROUP BY presence")
def stream_presence(r):
    """Captures as a stream, with state for each scope and each claim; what stands is a join of the two states."""
    caps = jobs.parquet_stream(r.spark, r.sf_dir, "events").selectExpr("user_id % 5 AS scope", "event_id AS cap", "unix_micros(date_trunc('day', ts)) AS instant", "event_id % 3 <> 0 AS complete")
    seen = caps.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("claim")).where("(cap * 31 + claim * 17) % 9 < 4").withColumn("weak", F.col("claim") % 7 == 0)
    with jobs.keyed_state(r.spark):
        claims, scopes = drained(r, SP.claim_updates(seen), "append"), drained(r, SP.scope_updates(caps), "append")
    return SP.presence(claims, scopes).groupBy("presence").agg(n_rows())
