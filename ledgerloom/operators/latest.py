"""Latest-per-key, first-wins and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order, which is to be total. Spark limits each partition's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def current(log: DataFrame, keys: list[str], seq: str, *columns: str) -> DataFrame:
    """State of each key after its last event: an aggregate with partial sums, so a hot key's events don't meet in one task."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct(seq, *columns), seq).alias("__last"))
    return last.select(*keys, f"__last.{seq}", *[f"__last.{c}" for c in columns])


def excluded(log: DataFrame) -> DataFrame:
    """(lec_id, pub_id) pairs whose last event excludes."""
    return current(log, ["lec_id", "pub_id"], "seq", "action").where("action = 'EXCLUDE'")


def chain_breaks(log: DataFrame, stream: str, seq: str, own: str, previous: str) -> DataFrame:
    """Events whose sequence has a gap before them or whose link to the event before is wrong."""
    w = Window.partitionBy(stream).orderBy(seq)
    x = log.withColumn("before", F.lag(seq).over(w)).withColumn("linked", F.lag(own).over(w))
    gap = F.col("before").isNotNull() & (F.col(seq) != F.col("before") + 1)
    wrong = ~F.col(previous).eqNullSafe(F.col("linked"))
    return x.where(gap | wrong).withColumn("problem", F.when(gap, "GAP").otherwise("BROKEN_LINK"))
