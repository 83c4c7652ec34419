"""Streams: imports in batches that can be run again, current state of event logs, unread activity, presence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.merge import KeyedTable


def import_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to write() once all that is there has come; a restart goes on where the checkpoint stands."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_new(target: str, keys: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A writer that leaves out rows whose keys the target has, so that a batch that is run again adds nothing; read with imported().

    Each batch is merged into a keyed table: it reads and rewrites the buckets that its keys fall into, and is seen as a whole or not at all.
    """

    def write(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, target, batch.schema, keys, buckets).merge(batch)

    return write


def imported(spark: SparkSession, target: str, schema: T.StructType, keys: list[str], buckets: int = 64) -> DataFrame:
    """What append_new() has written."""
    return KeyedTable(spark, target, schema, keys, buckets).read()


def latest_state(log: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """Each key's value after its last event; for update or complete mode."""
    return log.groupBy(*keys).agg(F.max(F.struct(seq, value)).alias("last")).select(*keys, f"last.{seq}", f"last.{value}")


def unread(activity: DataFrame, seen: DataFrame) -> DataFrame:
    """Activity (user, report, at) after the user last saw the report; seen is a table."""
    x = activity.join(seen, ["user", "report"], "left")
    return x.where("last_seen is null or at > last_seen").select("user", "report", "at")


def dedup_content(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first of equal contents within the watermark; state for older ones is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, width: str, delay: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def drain(df: DataFrame, mode: str, target: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there into Parquet under target, written by the executors, and read it.

    In append mode each batch has a folder of its own, which a second attempt overwrites; in complete mode the last batch holds all.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number if mode == 'append' else 0}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).option("basePath", target).parquet(target).select(*df.columns)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep keyed state in a store that holds more than memory does, as processors with state need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def parquet_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a data folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet").parquet(folder)
