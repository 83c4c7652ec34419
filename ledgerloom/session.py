"""Session settings that the engine's results rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: UTC and ANSI are part of the results' definition; the rest lets Spark re-plan at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Whether a query's shuffle files are deleted at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ledgerloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one in local mode where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    return sc.getCheckpointDir()


def cut(df):
    """df checkpointed in the shared folder: later steps read what is written there, whatever becomes of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def kept(df):
    """df written as a table in the shared folder and read again, as cut() but compressed by column: for wide rows, whose partitions and
    order don't matter afterwards. What was shuffled for it is deleted once it is written, not when the driver happens to collect garbage."""
    conf, path = df.sparkSession.conf, f"{shared_dir(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df):
    """df for joins in which both sides are dealt out by the key and sorted. Spark takes rows that are exploded, or kept in files that
    compress well, for fewer bytes than they are; it would gather them in the driver to broadcast them."""
    return df.hint("merge")


def spread_join(many, few, keys, by, parts=16):
    """many joined with few by keys; rows of many with one key are dealt to so many parts by column `by`, as each may meet many rows."""
    many = many.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    few = few.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt(many).join(few, [*keys, "__part"]).drop("__part")
