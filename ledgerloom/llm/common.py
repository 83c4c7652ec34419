"""What several operators share: Arrow maps, lineage cuts, label merging, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, table  # noqa: F401  (table is for the operators' modules)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own, so that no other column of docs can clash."""
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder; a lost executor takes nothing with it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, and the folder."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that written_at() made."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType, rows: int | None = None) -> DataFrame:
    """mapInArrow; make() runs once a task and returns what is applied to each batch, or to each `rows` rows of it. Workers outlive
    their tasks, so a task gives back the memory that Arrow would keep for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows or max(batch.num_rows, 1)):
                yield step(batch.slice(at, rows))
        del step
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_of(raw: bytes) -> str:
    """A text's characters; bytes that aren't UTF-8, which a string column may hold, become U+FFFD."""
    return raw.decode("utf-8", "replace")


def merge_labels(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; parent[x] <= x, and in the result every entry is its set's smallest member."""
    while len(a):
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        a, b = a[(keep := parent[a] != parent[b])], b[keep]
    return parent


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): root is the smallest node that node reaches. edges: columns a and b of one type, without nulls.

    Alternating large-star and small-star steps, which need a number of rounds that is logarithmic in the longest path. Nodes
    without edges and roots themselves are left out. Labels stay in tables; each round's edges are checkpointed. The joins read
    tables on both sides, so adaptive execution splits the rows of a hub.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = cut(ordered)
    while True:
        up = cut(e.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n")))
        many = up.where("n > 1").limit(1).count()
        chained = many or e.join(up.select(F.col("hi").alias("lo")), "lo", "left_semi").limit(1).count()
        if not chained:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        to = up.select(F.col("hi").alias("lo"), "m")
        large = e.join(to, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        large = cut(large.where("hi <> lo").distinct())
        # small star: u and its smaller neighbours go to the smallest of them
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
        below = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = cut(below.union(least.select("hi", F.col("m").alias("lo"))).distinct())
