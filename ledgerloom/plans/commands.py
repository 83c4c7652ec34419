"""Batches of commands against the state that event logs give: checked, then appended as events; history is never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.latest import ranked


def review(commands: DataFrame, candidates: DataFrame, latest: DataFrame, owners: DataFrame) -> DataFrame:
    """(seq, cand_id, action, error): at most one command for a candidate succeeds in a batch; checks stand in a fixed order.

    commands: seq, cand_id, action, version, obs_id; candidates: cand_id, lec_id, author_id, status, version; latest: cand_id,
    obs_id (its current observation); owners: author_id, owner (lecturer with an approved identity).
    """
    now = candidates.select("cand_id", "lec_id", "author_id", F.col("status").alias("now_status"), F.col("version").alias("now_version"))
    held = owners.groupBy("author_id").agg(F.min("owner").alias("least"), F.max("owner").alias("most"))
    x = ranked(commands, ["cand_id"], [F.asc("seq")], "k").join(now, "cand_id", "left")
    x = x.join(latest.select("cand_id", F.col("obs_id").alias("now_obs")), "cand_id", "left").join(held, "author_id", "left")
    other = (F.col("least") != F.col("lec_id")) | (F.col("most") != F.col("lec_id"))
    error = (
        F.when(F.col("now_status").isNull(), "NOT_FOUND").when(F.col("k") > 1, "STALE_IN_BATCH").when(F.col("now_status") != "PENDING", "ALREADY_DECIDED")
        .when(F.col("version") != F.col("now_version"), "STALE_VERSION").when(~F.col("obs_id").eqNullSafe(F.col("now_obs")), "STALE_OBSERVATION")
        .when((F.col("action") == "ACCEPT") & F.coalesce(other, F.lit(False)), "OWNED_BY_OTHER")
    )
    return x.select("seq", "cand_id", "action", error.alias("error"))


def events(checked: DataFrame) -> DataFrame:
    """What a batch appends."""
    done = F.when(F.col("action") == "ACCEPT", "ACCEPTED").otherwise("REJECTED")
    return checked.where("error is null").select("seq", "cand_id", done.alias("status"))


def chain(log: DataFrame, stream: str, seq: str, payload: str) -> DataFrame:
    """Each event's digest and that of the event before in its stream."""
    from pyspark.sql import Window

    own = log.withColumn("own", F.sha2(F.concat_ws("|", F.col(stream).cast("string"), F.col(seq).cast("string"), F.col(payload)), 256))
    return own.withColumn("previous", F.lag("own").over(Window.partitionBy(stream).orderBy(seq)))
