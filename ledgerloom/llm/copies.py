"""Near copies: texts whose five-word shingles are alike by 0.8. SimHash trees give most links, min-hash bands those that a radius
of a few bits doesn't reach, and all are confirmed by exact similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, connected_components, cut, id_and_text, utf8, written
from .simhash import RADIUS, SEED, fingerprint_of, links, only_rows, shingle_hashes

SHINGLE = 5
#: Least Jaccard similarity of two texts' shingle sets, as a fraction.
ALIKE, OF = 4, 5
#: Texts that agree on all ROWS min-hashes of one of BANDS bands are compared: of pairs of similarity 0.8 all but 3 in 100,000.
BANDS, ROWS = 20, 4
_RNG = np.random.default_rng(SEED)
FACTORS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
#: Bytes of a band's texts that one task compares with as many others.
PIECE_BYTES = 16_000_000
#: Shingles hashed at a time, texts whose shingles a task remembers, and texts taken from a batch at a time.
SLAB, REMEMBERED, TEXTS = 4096, 64, 1000


def shingle_set(raw: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(raw, SHINGLE))


def simhash_pairs(classes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of classes (cls, fp) to confirm: those of one fingerprint with its least, and the least of linked fingerprints."""
    least = cut(classes.groupBy("fp").agg(F.min("cls").alias("least")))
    equal = classes.join(least, "fp").where("cls <> least").select(F.col("least").alias("a"), F.col("cls").alias("b"))
    found = links(least.select("fp"), radius).select(F.col("a").alias("fp"), F.col("b").alias("fp_b"))
    found = found.join(least, "fp").select(F.col("least").alias("x"), F.col("fp_b").alias("fp")).join(least, "fp")
    return equal.union(found.select(F.least("x", "least").alias("a"), F.greatest("x", "least").alias("b")))


def bands(h: np.ndarray) -> list[int]:
    """Signed 64-bit keys of a shingle set's bands; an empty set has none."""
    if not len(h):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(h), SLAB):
        np.minimum(low, (h[k : k + SLAB, None] * FACTORS + ADDENDS).min(axis=0), out=low)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), band) for band, x in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return OF * both >= ALIKE * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those rows (a, b) of pairs whose texts are alike; texts: (cls, text), each cls once."""
    with_a = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}

        def of(key: bytes, raw: bytes) -> np.ndarray:
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = shingle_set(raw)
            return known[key]

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                same = [alike(of(i, x), of(j, y)) for i, j, x, y in zip(a, b, utf8(part.column(2)), utf8(part.column(3)), strict=True)]
                yield part.select([0, 1]).filter(pa.array(same, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def hub_pairs(rooted: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class with its bands' hubs: a band's hub is chosen by a hash of band and class, so that a class meets
    as many different hubs as it has bands."""
    hubs = rooted.groupBy("band").agg(F.min_by("cls", F.xxhash64("cls", "band")).alias("hub"))
    x = rooted.join(hubs, "band").where("cls <> hub")
    return x.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()


def edges_between(cls: np.ndarray, root: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a left and a right class that are alike, enough to connect all that are; those in one group are passed over."""
    if not sets:
        return []
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order])
    left, right, group = left[order], right[order], np.unique(root, return_inverse=True)[1][order]
    # shingles as numbers, set after set from the smallest: those of sizes that can be alike lie side by side
    names = np.unique(np.concatenate(sets))
    ends = np.cumsum(sizes)
    starts, flat = ends - sizes, np.empty(ends[-1], dtype=np.int32)
    for k, a, b in zip(order, starts, ends, strict=True):
        flat[a:b] = np.searchsorted(names, sets[k])
    held, out = np.zeros(len(names), dtype=bool), []
    del names
    for i in np.flatnonzero(left):
        low, high = np.searchsorted(sizes, -(-ALIKE * sizes[i] // OF)), np.searchsorted(sizes, OF * sizes[i] // ALIKE, side="right")
        ask = right[low:high] & (group[low:high] != group[i])
        if not ask.any():
            continue
        own = flat[starts[i] : ends[i]]
        held[own] = True
        both = np.add.reduceat(held[flat[starts[low] : ends[high - 1]]], starts[low:high] - starts[low], dtype=np.int64)
        held[own] = False
        for j in low + np.flatnonzero(ask & (OF * both >= ALIKE * (sizes[low:high] + sizes[i] - both))):
            if group[j] != group[i]:
                out.append((order[i], order[j]))
                group[group == group[j]] = group[i]
    return out


def compared_in_bands(rest: DataFrame, texts: DataFrame, piece_bytes: int) -> DataFrame:
    """Edges (a, b) between classes (band, cls, root) of a band that are alike and in different groups, enough to connect them.

    A band's texts are cut into pieces of bounded size by hash, and each pair of pieces is a task that compares its shingle sets. So
    tasks are bounded, but of a band of B bytes B ** 2 / piece_bytes are moved.
    """
    x = rest.select("band", "cls", "root").join(texts, "cls")
    sizes = x.groupBy("band").agg(F.ceil(F.sum(F.octet_length("text")) / piece_bytes).cast("int").alias("pieces"))
    x = x.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("cls"), F.greatest("pieces", F.lit(1))).cast("int"))
    x = x.select("band", "cls", "root", "text", "own", F.explode(F.sequence(F.lit(0), F.greatest("pieces", F.lit(1)) - 1)).alias("other"))
    x = x.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "root", "text")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        cls = np.array(group.column("cls").to_pylist(), dtype=object)
        order = np.argsort(cls)
        cls, root = cls[order], np.array(group.column("root").to_pylist(), dtype=object)[order]
        own = group.column("own").to_numpy()[order]
        sets = [shingle_set(x.as_py() or b"") for x in group.column("text").cast(pa.binary())]  # one text at a time
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        found = edges_between(cls, root, [sets[k] for k in order], own == i, own == j)
        return pa.table({"a": pa.array([cls[k] for k, _ in found], pa.binary()), "b": pa.array([cls[k] for _, k in found], pa.binary())})

    return cut(x.groupBy("band", "i", "j").applyInArrow(run, "a binary, b binary"))


def mixed_bands(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of met, with their groups' roots, of bands whose classes aren't in one group."""
    rooted = met.join(roots, met["cls"] == roots["node"], "left").select("band", "cls", "n", F.coalesce("root", "cls").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    return cut(rooted.join(mixed, "band", "left_semi"))


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """docs, with all their columns, with one row of each group of near copies: the first by id (null last), then text hash.

    Groups are the components of all pairs of texts that are linked by the trees of SimHash fingerprints or share a band, and are
    alike by exact shingle similarity. Texts with the same shingles are one class, so copies cost one; texts without words are
    one class too. Each class is first compared with its neighbours in the trees and a hub of each of its bands, then, where a
    band's classes aren't in one group yet, with all of them that aren't in its own, in tasks of bounded size. That takes time
    and moves quadratic in texts that share a band without being alike. Of rows alike in id and text the least by their other columns stays.
    """
    source = id_and_text(docs, id_col, text_col).select("id", "text", F.xxhash64("text").alias("text_hash"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            whole = [shingle_hashes(x, SHINGLE) for x in utf8(batch.column(1))]
            fp = pa.array(np.array([fingerprint_of(h) for h in whole], dtype=np.uint64).view(np.int64))
            found = [np.unique(h) for h in whole]
            cls = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary())
            n = pa.array([len(h) for h in found], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), cls, n, fp, pa.array([bands(h) for h in found], pa.list_(pa.int64()))], names=["id", "text_hash", "cls", "n", "fp", "bands"])

        return step

    each = arrow_map(source, make, T.StructType([source.schema["id"], source.schema["text_hash"], T.StructField("cls", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]), TEXTS)
    rank = F.struct(F.col("id").isNull().alias("z"), "id", "text_hash")
    classes = cut(each.groupBy("cls").agg(F.min(rank).alias("head"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    rows = classes.select("cls", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band")
    met = cut(rows.join(shared, "band", "left_semi"))
    near_fp = cut(simhash_pairs(classes.select("cls", "fp"), radius))
    asked = met.select("cls").union(near_fp.select("a")).union(near_fp.select("b")).distinct().join(classes.select("cls", F.col("head.text_hash").alias("text_hash")), "cls")
    texts = written(source.select("text_hash", "text").join(asked, "text_hash").dropDuplicates(["cls"]).select("cls", "text"), "near-copies")
    rooted = met.withColumn("root", F.col("cls"))
    linked = cut(confirmed(near_fp.distinct(), texts))
    linked = cut(linked.union(confirmed(hub_pairs(rooted), texts)))
    roots = connected_components(linked)
    rest = mixed_bands(met, roots)
    if rest.limit(1).count():
        roots = connected_components(linked.union(compared_in_bands(rest, texts, piece_bytes)))
    named = classes.join(roots, classes["cls"] == roots["node"], "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("head").alias("head"))
    return only_rows(docs, named.select("head.id", "head.text_hash"), id_col, text_col)
