"""Shards cut from a Hilbert curve through several metadata dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

SHARDS = 24
#: Bits of each dimension; the curve has 2 ** (BITS * dimensions) cells, a fixed number.
BITS = 4


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a grid point on the Hilbert curve, by the transposed form of the index (Skilling, 2004)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            flip ^= q - 1
        q >>= 1
    index = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] ^ flip) >> b & 1
    return index


def curve(spark, dims: int, bits: int = BITS) -> DataFrame:
    """Rows (cell, h) of the whole grid; cell holds the coordinates, `bits` each, first dimension highest."""
    top = (1 << bits) - 1
    rows = [(c, hilbert_index(tuple(c >> bits * (dims - 1 - d) & top for d in range(dims)), bits)) for c in range(1 << bits * dims)]
    return spark.createDataFrame(rows, "cell int, h int")


def by_hash(col: Column, bits: int = BITS) -> Column:
    """A category's coordinate; null has one of its own kind."""
    return F.pmod(F.xxhash64(F.coalesce(col.cast("string"), F.lit("\0"))), F.lit(1 << bits)).cast("int")


def by_quantile(docs: DataFrame, col: Column, bits: int = BITS) -> Column:
    """A number's coordinate: how many of 2 ** bits - 1 quantiles of docs are below it, so that the grid's rows are about even
    however large the numbers are. Null counts as nothing. The quantiles are taken in Spark; only they come to the driver."""
    n = 1 << bits
    value = F.coalesce(col, F.lit(0)).cast("double")
    cuts = docs.agg(F.percentile_approx(value, [k / n for k in range(1, n)], 10_000).alias("c")).first()["c"] or []
    return sum((F.when(value > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def assign_shards(docs: DataFrame, dims: dict[str, Column], shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, carry: str | None = None) -> DataFrame:
    """Rows (id_col, size, text_crc32, *dims, h, shard, slot) for every row of docs; carry: name of a further column that holds the
    whole row as a struct.

    dims: coordinates by name, each from 0 to 2 ** bits - 1. Rows are sorted by curve index, then text, then id, so that equal
    texts of a cell are neighbours, and cut into runs whose row counts differ by one at most; with fewer rows than shards some
    shards are empty. slot: a row's place in its shard, from 0. Null texts have no bytes and the checksum of nothing. Rows that
    are alike in all of these are placed in any order.

    Sorting is by range over all executors and only ids, sizes and keys move. Ranks come from each sorted partition's row
    count, of which the driver sees one number a partition, so a cell that holds any part of the rows stays distributed.
    """
    spark = docs.sparkSession
    if not dims:
        raise ValueError("give at least one dimension")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    cell = F.lit(0)
    for c in dims.values():
        cell = F.shiftleft(cell, bits).bitwiseOR(c)
    names = [f"dim{i}" for i in range(len(dims))]
    rows = docs.select(
        docs[id_col].alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.xxhash64(text).alias("text_hash"), *[c.alias(n) for n, c in zip(names, dims.values(), strict=True)], cell.alias("cell"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("whole")] if carry else []),
    )
    keyed = cut(rows.join(F.broadcast(curve(spark, len(dims), bits)), "cell"))  # the curve's table has 2 ** (bits * dims) rows
    key = ["h", "text_hash", "id"]
    placed = cut(keyed.repartitionByRange(*key).sortWithinPartitions(*key))
    numbered = placed.withColumn("at", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("at", 33)
    counts = sorted((r["part"], r["n"]) for r in numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    first = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "part long, first long"))  # a row a partition
    ranked = numbered.withColumn("part", part).join(first, "part").withColumn("rank", F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1))
    ranked = ranked.withColumn("shard", F.expr(f"cast(((rank + 1) * {shards} + {max(total, 1)} - 1) div {max(total, 1)} - 1 as int)"))
    slot = F.col("rank") - F.expr(f"(shard * cast({max(total, 1)} as bigint)) div {shards}")
    return ranked.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), *[F.col(a).alias(b) for a, b in zip(names, dims, strict=True)], "h", "shard", slot.alias("slot"), *([F.col("whole").alias(carry)] if carry else []))


def manifest(assigned: DataFrame, dims: list[str]) -> DataFrame:
    """Rows, bytes and the least and greatest coordinates of each shard: what a reader needs to skip shards by several dimensions."""
    bounds = [f(d).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))]
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"), *bounds)


def write_shards(docs: DataFrame, dims: dict[str, Column], path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 1_000_000) -> None:
    """Write docs as Parquet under path/shard=K, each row once, in slot order; a shard may be written by many tasks.

    Whole rows are carried through the sort, as ids may repeat; ranked rows are in order already and aren't shuffled again.
    """
    placed = assign_shards(docs, dims, shards, id_col, text_col, carry="__row")
    out = placed.select(F.col("shard").alias("__shard"), "__row").select("__shard", *[F.col("__row")[c].alias(c) for c in docs.columns])
    name = "shard" if "shard" not in docs.columns else "__shard"
    out.withColumnRenamed("__shard", name).write.option("maxRecordsPerFile", rows_per_file).partitionBy(name).parquet(path)


def dims_of(docs: DataFrame) -> dict[str, Column]:
    return {"source": by_hash(docs["source"]), "lang": by_hash(docs["lang"]), "length": by_quantile(docs, F.octet_length(docs["text"]))}


def op9_hilbert(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = assign_shards(docs, dims_of(docs))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "h")
