"""Benchmark decontamination by Wu-Manber search for many word sequences at once."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, id_and_text, table, text_of, utf8

WINDOW = 10
#: Words of a block in the shift table.
BLOCK = 2
#: Bytes of test texts that are sent to the executors at once; a larger test set is searched for in several passes.
PASS_BYTES = 16_000_000
#: Factors of the hash of a block's two words; with word numbers below 2 ** 31 it fits 64 bits.
FACTOR_A, FACTOR_B = 0x9E3779B1, 0x85EBCA77
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(raw: bytes) -> list[str]:
    """Words of a text in UTF-8; bytes.lower() changes A-Z only."""
    return WORD.findall(text_of(raw.lower()))


class WuManber:
    """Occurrences of word sequences of one length m: the windows of given items.

    A text is read in windows of m words. The window's last BLOCK words give the shift: how far the window may move without
    skipping a place at which a pattern could stand; blocks of one hash share an entry, which holds their least shift. At shift 0
    the block's bucket and the hash of the whole window select the patterns, which are compared word by word.

    Words are numbers, an item's words lie in one flat array, and a pattern is its place there, so that a window costs about 30
    bytes however many others overlap it. Items of fewer words than m are left out.
    """

    def __init__(self, items: list[np.ndarray], owners: list, m: int, vocabulary: dict[str, int]):
        self.m, self.block, self.vocabulary, self.owners = m, min(BLOCK, m), vocabulary, owners
        self.far = m - self.block + 1
        items = [(k, w) for k, w in enumerate(items) if len(w) >= m]
        sizes = np.array([len(w) for _, w in items])
        words = np.concatenate([w for _, w in items]).astype(np.int32)
        begin = np.cumsum(sizes) - sizes
        inside = np.arange(len(words)) - np.repeat(begin, sizes)  # place in the item
        left = np.repeat(sizes, sizes) - inside  # words from here to the item's end
        blocks = left >= self.block
        self.bits = max(12, int(4 * blocks.sum()).bit_length())
        hashed = self.hash_blocks(words)
        shift = np.full(1 << self.bits, min(self.far, 255), dtype=np.uint8)
        np.minimum.at(shift, hashed[blocks[: len(hashed)].nonzero()[0]], np.minimum(np.maximum(m - self.block - inside[blocks], 0), 255).astype(np.uint8))
        self.shift = shift.tobytes()
        at = np.flatnonzero(left >= m)
        keys = self.keys_of(hashed[at + m - self.block], self.hash_windows(words)[at])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order].astype(np.int32)
        self.owner = np.repeat(np.array([k for k, _ in items], dtype=np.int32), sizes)[self.at]
        self.words = words.tobytes()

    def hash_blocks(self, words: np.ndarray) -> np.ndarray:
        """Bucket of the block that begins at each place: of words a and b, or of b alone (then a is 1)."""
        w = words.astype(np.uint64)
        before, last = (w[:-1], w[1:]) if self.block == 2 else (np.uint64(1), w)
        return ((before * np.uint64(FACTOR_A) + last * np.uint64(FACTOR_B)) >> np.uint64(7) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def hash_windows(self, words: np.ndarray) -> np.ndarray:
        """Hash of the m words from each place on."""
        out = np.zeros(len(words) - self.m + 1, dtype=np.uint64)
        for k in range(self.m):
            out = out * np.uint64(0x100000001B3) + words[k : len(words) - self.m + 1 + k].astype(np.uint64)
        return out * np.uint64(0x9E3779B97F4A7C15)

    @staticmethod
    def keys_of(buckets: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return (buckets.astype(np.uint64) << np.uint64(36)) ^ (windows >> np.uint64(28))

    def search(self, words: list[str]) -> Iterable[tuple[int, set]]:
        """(start, owners) of each occurrence."""
        m, far, shift, n, number = self.m, self.far, self.shift, len(words), self.vocabulary.get
        two, mask, end = self.block == 2, (1 << self.bits) - 1, m
        while end <= n:
            b = number(words[end - 1])
            a = number(words[end - 2]) if two else 1
            if a is None or b is None:
                end += far
                continue
            hashed = (a * FACTOR_A + b * FACTOR_B) >> 7 & mask
            if step := shift[hashed]:
                end += step
                continue
            own = np.array([number(w, 0) for w in words[end - m : end]], dtype=np.int32)
            if own.all():
                key = self.keys_of(np.array([hashed]), self.hash_windows(own))
                first, last = (int(self.keys.searchsorted(key, side)[0]) for side in ("left", "right"))
                raw = own.tobytes()
                found = {self.owners[self.owner[k]] for k in range(first, last) if self.words[4 * self.at[k] : 4 * (self.at[k] + m)] == raw}
                if found:
                    yield end - m, found
            end += 1


def searchers(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each pattern length: windows of `window` words, and whole items that are shorter."""
    vocabulary: dict[str, int] = {}
    by_length: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
    for item_id, text in items:
        words = words_of((text or "").encode("utf-8"))
        if words:
            numbers = np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in words), dtype=np.int32, count=len(words))
            own, ids = by_length[min(window, len(words))]
            own.append(numbers)
            ids.append(item_id)
    return [WuManber(own, ids, m, vocabulary) for m, (own, ids) in by_length.items()]


_built: dict[str, list[WuManber]] = {}


def searchers_of(name: str, items: list, window: int) -> list[WuManber]:
    """The searchers of a block of the test set; a Python worker builds them once for all its tasks and keeps those of two blocks."""
    if name not in _built:
        while len(_built) > 1:
            del _built[next(iter(_built))]
        _built[name] = searchers(items, window)
    return _built[name]


def hits(words: list[str], search: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Merged ranges of word positions inside occurrences, and the items with occurring windows."""
    found, items = [], set()
    for s in search:
        for start, owners in s.search(words):
            found.append((start, start + s.m))
            items |= owners
    return merged(found), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, pass_bytes: int) -> list[list[tuple[str, str]]]:
    """The test set in blocks of at most pass_bytes of text each (an item is never cut), each collected by itself."""
    items = id_and_text(benchmark, id_col, text_col).select(F.col("id").cast("string").alias("id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // pass_bytes)) if total > pass_bytes else 1
    place = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return [[(r["id"], r["text"]) for r in items.where(place == k).toLocalIterator()] for k in range(n)]


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Per row of docs: id_col, n_words, n_hit, spans (word ranges, end exclusive), items (sorted ids as strings), contaminated.

    The test set is the stated query set: its size is summed first, and it is sent to the executors in blocks of bounded size,
    each of which is searched for in all documents. Null and empty texts have no words. Items without words have no windows;
    an item id that stands in several rows counts once. Items without an id count as one, listed as null before all others. Bytes
    of docs that aren't UTF-8 count as U+FFFD. Docs are mapped where they lie: no shuffle, and a passage that many documents share
    costs each of them the same.
    """
    spark = docs.sparkSession
    blocks = benchmark_blocks(benchmark, item_id_col, item_text_col, pass_bytes)
    source = id_and_text(docs, id_col, text_col)
    key = T.StructField("id", source.schema["id"].dataType)
    state = T.StructType([key, T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])
    none = [F.lit(0).cast("long").alias("n_words"), F.array().cast(state["spans"].dataType).alias("spans"), F.array().cast("array<string>").alias("items")]
    found = source.select("id", "text", *none)
    for block in blocks:
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def make(sent=sent, name=name):
            search = searchers_of(name, sent.value, window)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                counts, spans, items = [], [], []
                for raw, old, had in zip(utf8(batch.column(1)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    words = words_of(raw)
                    ranges, owners = hits(words, search)
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in merged(ranges + [(x["start"], x["end"]) for x in old])])
                    items.append(sorted(owners.union(had), key=lambda i: (i is not None, i)))
                arrays = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays(arrays, names=state.names)

            return step

        found = arrow_map(found, make, state)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs, with all their columns, without the rows in which a window of the test set occurs; nothing is joined or shuffled."""
    at, out = docs.columns.index(text_col), docs
    for block in benchmark_blocks(benchmark, item_id_col, item_text_col, pass_bytes):
        sent, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def make(sent=sent, name=name):
            search = searchers_of(name, sent.value, window)

            def clean(raw: bytes) -> bool:
                words = words_of(raw)
                return not any(True for s in search for _ in s.search(words))

            return lambda batch: batch.filter(pa.array([clean(x) for x in utf8(batch.column(at))], pa.bool_()))

        out = arrow_map(out, make, docs.schema)
    return out


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")


def digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


OP10_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes)),
found AS (SELECT doc_id, item_id, d.size, i FROM doc_windows d JOIN item_windows USING (size, win)),
n_hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
of_items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN n_hits USING (doc_id) LEFT JOIN of_items USING (doc_id)
"""
