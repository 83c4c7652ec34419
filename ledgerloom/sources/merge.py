"""Tables with keys, kept as Parquet in buckets: a merge rewrites the buckets that its batch touches and is seen as a whole or not at all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("written", T.LongType()), T.StructField("batch", T.StringType()), T.StructField("version", T.LongType())])


@dataclass(frozen=True)
class Merged:
    """What a merge did: the table's version, rows put in and changed, buckets rewritten; nothing for a batch that was merged before."""

    version: int
    inserted: int
    updated: int
    buckets: int


class KeyedTable:
    """A table under `path` with one row a key.

    data/written=V/bucket=B holds a bucket as version V wrote it; manifest/version=V names, for each bucket, the version that wrote
    what counts. A version is there once its manifest, one file, is: readers take the last, so a merge that fails leaves the table as
    it was, and the next attempt overwrites its files. One writer at a time. Folders that no manifest names any more are left to whoever
    owns the path.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets

    def manifest(self) -> DataFrame | None:
        """The rows (bucket, written, batch, version) of the last version: at most as many as there are buckets and one."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
            last = rows.agg(F.max("version").alias("v")).first()["v"]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return None if last is None else rows.where(F.col("version") == last)

    def _places(self) -> tuple[int, dict[int, int], str | None]:
        at = self.manifest()
        rows = at.collect() if at is not None else []
        batch = next((r["batch"] for r in rows if r["batch"] is not None), None)
        return max((r["version"] for r in rows), default=0), {r["bucket"]: r["written"] for r in rows if r["bucket"] is not None}, batch

    def _read(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/written={v}/bucket={b}" for b, v in sorted(places.items())])

    def read(self) -> DataFrame:
        return self._read(self._places()[1])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def winners(self, batch: DataFrame, order: list[str]) -> DataFrame:
        """One row a key: the least by `order`, then by all other columns, so that the same batch always has the same winners."""
        rest = [c for c in self.schema.names if c not in self.keys]
        first = batch.groupBy(*self.keys).agg(F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])).alias("w")) if rest else batch.select(*self.keys).distinct()
        return first.select(*[F.col(c) if c in self.keys else F.col(f"w.{c}") for c in self.schema.names])

    def merge(self, batch: DataFrame, order: list[str] = (), when: Column | None = None, name: str | None = None) -> Merged:
        """Put batch's rows in. A key that the table has keeps its row, unless `when` holds, a condition on columns n.* (batch) and o.* (table).

        Rows without a whole key are refused. name: if the last merge had it, nothing is done, so a stream may repeat a batch. Work is
        in proportion to the buckets that batch touches; of these alone the old rows are read.
        """
        version, places, last = self._places()
        if name is not None and name == last:
            return Merged(version, 0, 0, 0)
        new = self.winners(batch.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]), list(order)).withColumn("bucket", self._bucket())
        stage = f"{self.path}/data/written={version + 1}"
        incoming = f"{self.path}/incoming"
        new.write.mode("overwrite").parquet(incoming)  # so that what is counted, joined and written are the same rows
        new = self.spark.read.schema(new.schema).parquet(incoming)
        told = new.agg(F.collect_set("bucket").alias("touched"), F.count_if(F.expr(" or ".join(f"{k} is null" for k in self.keys))).alias("keyless")).first()
        if told["keyless"]:
            raise ValueError(f"{told['keyless']} rows have no whole key")
        touched = set(told["touched"])  # as many as there are buckets at most
        if not touched:
            return Merged(version, 0, 0, 0)
        old = self._read({b: v for b, v in places.items() if b in touched})
        o, n = old.select(*self.keys, F.struct(*self.schema.names).alias("o")), new.select(*self.keys, F.struct(*self.schema.names).alias("n"))
        both = o.join(n, self.keys, "full")
        fresh, change = F.col("o").isNull(), F.col("o").isNotNull() & F.col("n").isNotNull() & (when if when is not None else F.lit(False))
        kept = F.when(fresh | F.coalesce(change, F.lit(False)), F.col("n")).otherwise(F.col("o"))
        counted = both.agg(F.count_if(fresh).alias("i"), F.count_if(change).alias("u")).first()
        out = both.select(kept.alias("r")).select("r.*").withColumn("bucket", self._bucket())
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(stage)
        rows = [(b, v, None, version + 1) for b, v in ({**places, **dict.fromkeys(touched, version + 1)}).items()] + [(None, None, name, version + 1)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return Merged(version + 1, counted["i"], counted["u"], len(touched))
