"""SimHash near-dedup: fingerprints, BK-trees over shards, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, connected_components, cut, id_and_text, merge_labels, table, utf8

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Distinct fingerprints of a shard that one tree holds; a larger shard is cut into pieces, and each pair of pieces is searched.
TREE_ROWS = 8192
#: Queries that walk a tree side by side.
SLAB = 256


def shingle_hashes(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of a UTF-8 text's word shingles in order: bytes.lower() changes A-Z only, bytes.split() splits at 0x20 and
    0x09-0x0D only. A text of fewer words is one shingle, one without words has none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        spans = zip([0, *(ends[: len(words) - shingle] + 1).tolist()], ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in spans], dtype=np.uint64)


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a UTF-8 text."""
    return fingerprint_of(shingle_hashes(raw, shingle, seed))


def fingerprint_of(h: np.ndarray) -> int:
    """SimHash of shingle hashes, repeats included."""
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65_536):
        bits = np.unpackbits(h[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Rows (id, text_hash, fp long: the 64 bits as a signed number) for every row of docs; null texts have no words, so 0."""
    source = id_and_text(docs, id_col, text_col).select("id", "text", F.xxhash64("text").alias("text_hash"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(x, shingle, seed) for x in utf8(batch.column(1))], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], names=["id", "text_hash", "fp"])

        return step

    return arrow_map(source, make, T.StructType([source.schema["id"], source.schema["text_hash"], T.StructField("fp", T.LongType())]))


class BKForest:
    """BK-trees of many groups of distinct fingerprints in flat arrays: each group's first row is its root, and the children of
    a node have the integer Hamming distances to it as keys, each key once. Built and walked a level at a time."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        """group: sorted group numbers from 0."""
        self.fp = fp
        first = np.r_[True, group[1:] != group[:-1]]
        self.root = np.flatnonzero(first)
        item = np.flatnonzero(~first)
        at = self.root[group[item]]
        keys, nodes = [], []
        while len(item):
            key = at * 65 + np.bitwise_count(fp[item] ^ fp[at])
            order = np.argsort(key, kind="stable")
            key, item = key[order], item[order]
            new = np.r_[True, key[1:] != key[:-1]]
            keys.append(key[new])
            nodes.append(item[new])
            at = item[new][np.cumsum(new) - 1][~new]
            item = item[~new]
        self.key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        self.child = np.concatenate(nodes) if nodes else np.zeros(0, dtype=np.int64)
        order = np.argsort(self.key)
        self.key, self.child = self.key[order], self.child[order]

    def search(self, fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) arrays of all pairs within radius, in parts; only edges with keys from d - radius to d + radius are followed."""
        for k in range(0, len(fp), SLAB):
            query = np.arange(k, min(k + SLAB, len(fp)))
            node = self.root[group[query]]
            while len(query):
                d = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right")
                n = high - low
                query = np.repeat(query, n)
                node = self.child[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def shard_edges(fp: np.ndarray, shard: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (x, smallest member) of the components in each shard. Rows are sorted by shard; left rows form a shard's
    tree, right rows are its queries."""
    group = np.cumsum(np.r_[0, shard[1:] != shard[:-1]])
    parent = np.arange(len(fp))
    own, ask = np.flatnonzero(left), np.flatnonzero(right)
    has, number = np.unique(group[own], return_inverse=True)
    slot = np.searchsorted(has, group[ask])
    known = (slot < len(has)) & (has[np.minimum(slot, len(has) - 1)] == group[ask])
    ask, slot = ask[known], slot[known]
    forest = BKForest(fp[own], number)
    for query, node in forest.search(fp[ask], slot, radius):
        a, b = ask[query], own[node]
        parent = merge_labels(parent, a[a != b], b[a != b])
    # the smallest fingerprint, read as a signed number, stands for each component
    signed = fp.view(np.int64)
    order = np.lexsort((signed, parent))
    head = order[np.r_[True, parent[order][1:] != parent[order][:-1]]]
    best = np.empty_like(parent)
    best[parent[head]] = head
    to = best[parent]
    x = np.flatnonzero(to != np.arange(len(fp)))
    return signed[x], signed[to[x]]


def bands(radius: int, agree: int) -> list[tuple[int, int]]:
    """(offset, width) of radius + agree blocks of bits: fingerprints within radius agree on at least `agree` of them."""
    n = radius + agree
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(classes: DataFrame, radius: int = RADIUS, agree: int = 2, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp), enough to connect all that are linked directly or in steps.

    A shard holds the fingerprints that agree on a set of `agree` bit blocks, so every pair within radius meets in some shard.
    Shards of one row are left out. Shards of more than tree_rows are cut into pieces by hash, and every pair of pieces is
    searched as a tree and its queries, so no task holds more than two pieces of a shard.
    """
    parts = bands(radius, agree)
    keys = []
    for t, chosen in enumerate(combinations(parts, agree)):
        key, at = F.lit(t).cast("long"), 0
        for offset, width in chosen:
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", offset).bitwiseAND((1 << width) - 1), 8 + at))
            at += width
        keys.append(key)
    rows = classes.select("fp", F.explode(F.array(*keys)).alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, "shard").withColumn("pieces", F.ceil(F.col("n") / tree_rows).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), "pieces").cast("int"))
    rows = rows.select("fp", "shard", "own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    rows = rows.select("fp", "shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    placed = rows.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            fp, shard, i, j, own = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.r_[True, (shard[1:] != shard[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            number = np.cumsum(new)
            n = len(fp) if last else np.flatnonzero(new)[-1]  # the last shard may go on
            held = [[x[n:] for x in (fp, shard, i, j, own)]] if n < len(fp) else []
            if n:
                a, b = shard_edges(fp[:n].view(np.uint64), number[:n], own[:n] == i[:n], own[:n] == j[:n], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
            if sum(len(x[0]) for x in held) >= 32_768:
                yield from flush(False)
        yield from flush(True)

    return placed.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, agree: int = 2) -> DataFrame:
    """Rows (id_col, fingerprint, component_id, kept) for every row of docs; kept: the row is its component's first by id (null
    last), then text hash, so that of rows with one id and different texts one is kept.

    Texts with the same fingerprint are one class: classes, not documents, are compared, so a group of copies of any size costs
    one class. Null and empty texts have fingerprint zero and link like any other. Rows with a null id belong to components but
    name none. Rows that are alike in id and text are kept or not alike. Shard trees are built where their shard lies instead
    of being broadcast, as all of them together would grow with the corpus.
    """
    each = fingerprints(docs, id_col, text_col, shingle, seed)
    return _components(cut(each), radius, agree).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "kept")


def _components(each: DataFrame, radius: int, agree: int) -> DataFrame:
    rank = F.struct(F.col("id").isNull().alias("z"), "id", "text_hash")
    classes = cut(each.groupBy("fp").agg(F.min("id").alias("least_id"), F.min(rank).alias("head")))
    roots = connected_components(links(classes.select("fp"), radius, agree))
    rooted = cut(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least_id", "head", F.coalesce("root", "fp").alias("root")))
    named = cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("head").alias("head")))
    of_class = cut(rooted.select("fp", "root").join(named, "root").select("fp", "component_id", "head"))
    return each.join(of_class, "fp").select("id", "text_hash", "fp", "component_id", rank.eqNullSafe(F.col("head")).alias("kept"))


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, agree: int = 2) -> DataFrame:
    """docs, with all their columns, without near-duplicates: one row of each component stays."""
    found = _components(cut(fingerprints(docs, id_col, text_col)), radius, agree)
    return only_rows(docs, found.where("kept").select("id", "text_hash"), id_col, text_col)


def only_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each of kept (id, text_hash): of rows alike in both, the least by all columns that have an order."""
    first = kept.select(F.col("id").alias("__ll_id"), F.col("text_hash").alias("__ll_hash")).distinct()
    named = docs.withColumn("__ll_own", F.xxhash64(docs[text_col].cast("string")))
    rows = named.join(first, named[id_col].eqNullSafe(F.col("__ll_id")) & (F.col("__ll_own") == F.col("__ll_hash")), "left_semi")
    ordered = [c.name for c in docs.schema.fields if "map<" not in c.dataType.simpleString() and c.name not in (id_col, text_col)]
    if not ordered:
        return rows.dropDuplicates([id_col, "__ll_own"]).select(*docs.columns)
    least = rows.groupBy(id_col, "__ll_own").agg(F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias("__ll_row"))
    return least.select(*[F.col("__ll_row")[c].alias(c) for c in docs.columns])


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
