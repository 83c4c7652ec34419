"""Hard negatives by exact inner-product search over one-dimensional distance keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import table, written

#: Rows of a bounded sample on which pivots are fitted, and pivots for each vector length at most.
SAMPLE, PIVOTS = 4096, 64
#: Rows of a segment of the index, of the runs inside it that are scanned at a time, of a range partition, and anchors of a block.
SEGMENT, RUN, PART, BLOCK = 4096, 512, 65_536, 1024
#: Segments at most; with more rows than SEGMENT of them hold, segments grow. Their key intervals go to every task.
MOST_SEGMENTS = 1 << 18
SCALE = 256
#: Inner products under this are exact in double precision; those that might be over the other don't fit a long.
EXACT, LONGEST = 2.0**53, 2.0**62
NONE = np.iinfo(np.int64).min


def usable(rows: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """Rows (id, label, x, norm): vectors of whole numbers floor(SCALE * component), without rows that take no part."""
    vec = rows[vec_col].cast("array<double>")
    odd = F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = rows.select(rows[id_col].cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("v")).where("id is not null and label is not null and v is not null").where(~odd)
    whole = kept.select("id", "label", F.transform("v", lambda v: F.floor(v * SCALE)).alias("x"))
    return whole.withColumn("norm", F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component that gives all the length sqrt(top): then the nearest to (q, 0) has the largest product with q."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))[:, None]])


def fit_pivots(sample: list, top: float) -> dict[int, np.ndarray]:
    """Pivots by vector length: the zero vector, and k-means centres of the sample's augmented vectors."""
    by: dict[int, list] = {}
    for x in sample:
        by.setdefault(len(x), []).append(x)
    out = {}
    for dim, xs in by.items():
        points = augmented(np.array(xs).reshape(len(xs), dim), top)
        k = min(PIVOTS, len(np.unique(points, axis=0)), 1 + len(points) // 16)
        centres = np.unique(points, axis=0)[np.random.default_rng(dim).permutation(len(np.unique(points, axis=0)))[:k]]
        for _ in range(8):
            own = np.argmin((centres * centres).sum(axis=1) - 2 * points @ centres.T, axis=1)
            centres = np.stack([points[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
        out[dim] = np.vstack([np.zeros(dim + 1), centres])
    return out


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(0.0, squares))


SEGMENTS = T.StructType(
    [T.StructField("seg", T.LongType()), T.StructField("dim", T.IntegerType())]
    + [T.StructField(n, T.BinaryType()) for n in ("rows", "ids", "labels", "vecs", "runs")]
)
BLOCKS = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("dim", T.IntegerType())]
    + [T.StructField(n, T.BinaryType()) for n in ("rows", "ids", "labels", "vecs", "lo", "hi", "kth", "home")]
)
VISITS = T.StructType([T.StructField("block", T.LongType()), T.StructField("seg", T.LongType()), T.StructField("mask", T.BinaryType())])
HITS = T.StructType([T.StructField(n, T.LongType()) for n in ("block", "at", "win", "score", "id", "row")])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _one(schema: T.StructType, values: list[list]) -> pa.RecordBatch:
    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BinaryType: pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[type(f.dataType)]) for v, f in zip(values, schema.fields)], names=schema.names)


class Index:
    """All rows in segments sorted by (length, pivot, distance), and what every task needs of them: pivots and key intervals."""

    def __init__(self, rows: DataFrame, spark: SparkSession):
        self.spark = spark
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).first()
        self.n, self.top = total["n"], total["top"] or 0.0
        if self.top >= LONGEST:
            raise ValueError("inner products of these vectors may not fit a long")
        sample = [r["x"] for r in rows.orderBy(F.xxhash64("id"), "id", "label").limit(SAMPLE).select("x").collect()]
        pivots, top = fit_pivots(sample, self.top), self.top
        placed = rows.select("id", "label", "x", F.monotonically_increasing_id().alias("row"))
        keyed = T.StructType([T.StructField(n, t()) for n, t in (("id", T.LongType), ("label", T.LongType), ("row", T.LongType), ("dim", T.IntegerType), ("pivot", T.IntegerType), ("dist", T.DoubleType), ("vec", T.BinaryType))])

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                xs = batch.column("x")
                dims = np.diff(xs.offsets.to_numpy()).astype(np.int32)
                flat, starts = xs.values.to_numpy(zero_copy_only=False), xs.offsets.to_numpy()
                pivot, dist = np.zeros(len(dims), dtype=np.int32), np.zeros(len(dims))
                vec: list[bytes] = [b""] * len(dims)
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    x = flat[starts[at][:, None] + np.arange(d)]
                    far = distances(augmented(x, top), pivots.get(int(d), np.zeros((1, d + 1))))
                    pivot[at], dist[at] = far.argmin(axis=1), far.min(axis=1)
                    for i, v in zip(at, x.astype(np.int32)):
                        vec[i] = v.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("row"), pa.array(dims), pa.array(pivot), pa.array(dist), pa.array(vec, pa.binary())], names=keyed.names)

        size = max(SEGMENT, -(-self.n // MOST_SEGMENTS))
        # equal vectors have equal keys: the hash spreads them over partitions
        order = ["dim", "pivot", "dist", F.xxhash64("row"), "row"]
        parts = max(1, -(-self.n // PART))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, k = TaskContext.get().partitionId() << 32, 0
            held: list[tuple] = []

            def segment() -> pa.RecordBatch:
                nonlocal k, held
                k += 1
                rows, ids, labels, pivots, dists, vecs = zip(*held)
                p, d = np.array(pivots, dtype=np.int64), np.array(dists)
                cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                cuts = np.unique(np.concatenate([np.arange(a, b, RUN) for a, b in zip(cuts, [*cuts[1:], len(p)])]))
                runs = np.array([(a, b, p[a], *np.array([d[a], d[b - 1]]).view(np.int64)) for a, b in zip(cuts, [*cuts[1:], len(p)])], dtype=np.int64)
                held = []
                return _one(SEGMENTS, [[base + k], [dim], *[[np.array(x, dtype=np.int64).tobytes()] for x in (rows, ids, labels)], [b"".join(vecs)], [runs.tobytes()]])

            dim = None
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("dim", "row", "id", "label", "pivot", "dist", "vec"))):
                    if held and (r[0] != dim or len(held) >= size):
                        yield segment()
                    dim = r[0]
                    held.append(r[1:])
            if held:
                yield segment()

        sorted_rows = placed.mapInArrow(key, keyed).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        self.segments = written(sorted_rows.mapInArrow(pack, SEGMENTS), "negatives-index")
        entries = []
        for r in self.segments.select("seg", "dim", "runs").toLocalIterator():
            runs = np.frombuffer(r["runs"], dtype=np.int64).reshape(-1, 5)
            for p in np.unique(runs[:, 2]):
                own = runs[runs[:, 2] == p]
                entries.append((r["seg"], r["dim"], p, own[0, 3:4].view(np.float64)[0], own[-1, 4:5].view(np.float64)[0]))
        self.pivots = spark.sparkContext.broadcast(pivots)
        self.entries = spark.sparkContext.broadcast({d: tuple(np.array(x) for x in zip(*[(s, p, lo, hi) for s, e, p, lo, hi in entries if e == d])) for d in {e[1] for e in entries}})


def bounds(q: np.ndarray, pivots: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """(most, least): what inner products of each anchor with vectors in each annulus can be, by the triangle inequality."""
    norms = (q * q).sum(axis=1)
    d = distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)[:, p]
    both, slack = (norms + top)[:, None], 1e-9 * (norms + top)[:, None] + 1
    near = np.maximum(0.0, np.maximum(d - hi, lo - d))
    return (both - near * near) / 2 + slack, (both - (d + hi) ** 2) / 2 - slack


def needed(most: np.ndarray, least: np.ndarray, lo: np.ndarray, hi: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Whether an annulus may hold one of the k best of any of an anchor's windows of scores."""
    floor = np.maximum(lo, kth).astype(np.float64)
    open_ = lo <= hi
    return (open_[:, None, :] & (most[:, :, None] >= floor[:, None, :]) & (least[:, :, None] <= hi[:, None, :].astype(np.float64))).any(axis=2)


def unpack(r: dict) -> tuple[np.ndarray, ...]:
    rows, ids, labels = (np.frombuffer(r[c], dtype=np.int64) for c in ("rows", "ids", "labels"))
    return rows, ids, labels, np.frombuffer(r["vecs"], dtype=np.int32).reshape(len(rows), r["dim"])


def windows(r: dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(r[c], dtype=np.int64).reshape(n, -1) for c in ("lo", "hi", "kth"))


def anchor_blocks(index: Index, every: int) -> DataFrame:
    """Blocks of up to BLOCK anchors of one length, in key order, each with one open window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = (TaskContext.get().partitionId() + 1) << 32, 0
        held: list[list] = [[], [], [], []]
        dim = None

        def block() -> pa.RecordBatch:
            nonlocal k, held
            k += 1
            rows, ids, labels, vecs = (np.concatenate(x) for x in held)
            held = [[], [], [], []]
            n = len(rows)
            fill = lambda v: np.full(n, v, dtype=np.int64).tobytes()
            return _one(BLOCKS, [[base + k], [dim], *[[x.tobytes()] for x in (rows, ids, labels, vecs)], [fill(NONE)], [fill(np.iinfo(np.int64).max)], [fill(NONE)], [fill(-1)]])

        for r in _rows_of(batches):
            parts = unpack(r)
            chosen = np.flatnonzero(parts[1] % every == 0)
            for a in range(0, len(chosen), BLOCK):
                own = chosen[a : a + BLOCK]
                if held[0] and (dim != r["dim"] or sum(map(len, held[0])) + len(own) > BLOCK):
                    yield block()
                dim = r["dim"]
                for h, x in zip(held, parts):
                    h.append(x[own])
        if held[0]:
            yield block()

    return index.segments.mapInArrow(run, BLOCKS)


def _homes(index: Index, blocks: DataFrame) -> DataFrame:
    """Each anchor's home: of the segments it needs, the one whose annulus admits the largest product."""
    pivots, entries, top = index.pivots, index.entries, index.top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            q = unpack(r)[3].astype(np.float64)
            seg, p, lo, hi = entries.value[r["dim"]]
            most, least = bounds(q, pivots.value.get(r["dim"], np.zeros((1, r["dim"] + 1))), p, lo, hi, top)
            want = needed(most, least, *windows(r, len(q)))
            best = np.where(want, most, -np.inf).argmax(axis=1)
            home = np.where(want.any(axis=1), seg[best], -1)
            yield _one(BLOCKS, [[r[c]] for c in BLOCKS.names[:-1]] + [[home.astype(np.int64).tobytes()]])

    return blocks.mapInArrow(run, BLOCKS)


def _visits(index: Index, blocks: DataFrame, at_home: bool) -> DataFrame:
    """(block, seg, mask): the segments that a block's anchors have to look into, and which anchors; their homes, or all others."""
    pivots, entries, top = index.pivots, index.entries, index.top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            q = unpack(r)[3].astype(np.float64)
            home = np.frombuffer(r["home"], dtype=np.int64)
            seg, p, lo, hi = entries.value[r["dim"]]
            if at_home:
                segs = [s for s in np.unique(home) if s >= 0]
                masks = [home == s for s in segs]
            else:
                segs, masks = [], []
                cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])  # a segment's intervals stand together
                for a, b in zip(cuts, [*cuts[1:], len(seg)]):
                    s = seg[a]
                    most, least = bounds(q, pivots.value.get(r["dim"], np.zeros((1, r["dim"] + 1))), p[a:b], lo[a:b], hi[a:b], top)
                    mask = needed(most, least, *windows(r, len(q))).any(axis=1) & (home != s)
                    if mask.any():
                        segs.append(s)
                        masks.append(mask)
            if len(segs):
                yield _one(VISITS, [[r["block"]] * len(segs), [int(s) for s in segs], [np.packbits(m).tobytes() for m in masks]])

    return blocks.mapInArrow(run, VISITS)


def _best(of: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first entries of each value of `of`, by falling score, then id."""
    order = np.lexsort((ids, -score, of))
    o = of[order]
    rank = np.arange(len(o)) - np.maximum.accumulate(np.where(np.r_[True, o[1:] != o[:-1]], np.arange(len(o)), 0))
    return order[rank < k]


def look(r: dict, pivots: np.ndarray, top: float, alike: bool, k: int) -> list[np.ndarray]:
    """The k best of a segment for each anchor and window: runs of rows in key order, those first whose annuli admit most, until none
    left can hold a better one."""
    q_rows, _, q_labels, q = unpack({c: r[f"q_{c}"] if c != "dim" else r["dim"] for c in ("rows", "ids", "labels", "vecs", "dim")})
    lo, hi, kth = windows({c: r[f"q_{c}"] for c in ("lo", "hi", "kth")}, len(q))
    mask = np.unpackbits(np.frombuffer(r["mask"], dtype=np.uint8))[: len(q)].astype(bool)
    rows, ids, labels, x = unpack(r)
    runs = np.frombuffer(r["runs"], dtype=np.int64).reshape(-1, 5)
    kind = np.float64 if top < EXACT else np.int64  # all sums of products stay under top
    q, x, kth = q.astype(kind), x.astype(kind), kth.copy()
    most, least = bounds(q.astype(np.float64), pivots, runs[:, 2], runs[:, 3].view(np.float64), runs[:, 4].view(np.float64), top)
    w = lo.shape[1]
    held = [np.zeros(0, dtype=np.int64) for _ in range(3)]  # anchor * w + window, score, place in the segment
    for b in np.argsort(-most.max(axis=0), kind="stable"):
        sel = np.flatnonzero(mask & needed(most[:, b : b + 1], least[:, b : b + 1], lo, hi, kth)[:, 0])
        if not len(sel):
            continue
        a, e = runs[b, :2]
        scores = (q[sel] @ x[a:e].T).astype(np.int64)
        fits = (q_labels[sel][:, None] == labels[a:e]) if alike else (q_labels[sel][:, None] != labels[a:e])
        fits &= q_rows[sel][:, None] != rows[a:e]
        for j in range(w):
            ok = fits & (scores >= np.maximum(lo, kth)[sel, j][:, None]) & (scores <= hi[sel, j][:, None])
            if e - a > k and ok.sum() > 4 * k * len(sel):
                cut_at = np.partition(np.where(ok, scores, NONE), -k, axis=1)[:, -k]
                ok &= scores >= cut_at[:, None]
            i, c = np.nonzero(ok)
            if len(i):
                held = [np.concatenate([h, v]) for h, v in zip(held, (sel[i] * w + j, scores[i, c], a + c))]
        keep = _best(held[0], held[1], ids[held[2]], k)
        held = [h[keep] for h in held]
        of, count = np.unique(held[0], return_counts=True)
        full = of[count == k]
        if len(full):
            last = np.searchsorted(held[0], full, side="right") - 1
            flat = kth.reshape(-1)
            flat[full] = np.maximum(flat[full], held[1][last])
    return [held[0] // w, held[0] % w, held[1], ids[held[2]], rows[held[2]]]


def _looked(index: Index, blocks: DataFrame, visits: DataFrame, alike: bool, k: int) -> DataFrame:
    pivots, top = index.pivots, index.top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            at, win, score, ids, rows = look(r, pivots.value.get(r["dim"], np.zeros((1, r["dim"] + 1))), top, alike, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["block"], dtype=np.int64)), *map(pa.array, (at, win, score, ids, rows))], names=HITS.names)

    anchors = blocks.select("block", *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "labels", "vecs", "lo", "hi", "kth")])
    return visits.join(anchors, "block").join(index.segments, "seg").mapInArrow(run, HITS)


def _first(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("block", "at", "win").orderBy(F.desc("score"), "id", "row")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: Index, blocks: DataFrame, alike: bool, k: int) -> DataFrame:
    """Rows (block, at, win, score, id, row, rank): for each anchor (its block and place there) and each of its windows of scores, the
    k rows of the same label (alike) or of others that have the highest scores in it, ties by id.

    Anchors first look into the segment that may hold the best rows; the k-th score found there bounds what the rest must admit, and
    segments whose annuli can't are left out. So the result is exact. A block meets a segment in one row of a join, as large as the
    two; what each finds is cut to k rows before it is shuffled.
    """
    homed = written(_homes(index, blocks), "negatives-blocks")
    near = written(_first(_looked(index, homed, _visits(index, homed, True), alike, k), k), "negatives-near")
    bound = near.where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("at", "win", "score")).alias("found"))  # a block's anchors at most

    def tighten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            kth = np.frombuffer(r["kth"], dtype=np.int64).copy()
            w = len(kth) // max(1, len(r["rows"]) // 8)
            for f in r["found"] or ():
                kth[f["at"] * w + f["win"]] = f["score"]
            yield _one(BLOCKS, [[r[c] if c != "kth" else kth.tobytes()] for c in BLOCKS.names])

    tight = written(homed.join(bound, "block", "left").mapInArrow(tighten, BLOCKS), "negatives-blocks")
    far = _first(_looked(index, tight, _visits(index, tight, False), alike, k), k)
    return _first(near.unionByName(far).drop("rank"), k)


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None, every: int = 100, positives: int = 5, negatives: int = 5, ratio: tuple[int, int] = (4, 5)) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by `every`. Scores are inner products of vectors of whole numbers; an anchor's
    positives are the other rows of its label with the highest ones, and each positive's negatives the rows of other labels that
    score from ratio times the positive's score up to it, highest first; ties go by id, then by the rows' order in the table.
    Vectors are compared within their length. Null ids, labels and vectors, and vectors with null or non-finite components, take no
    part; a vector without components scores 0; repeated rows are rows of their own; other columns aren't read. Scores have to fit
    a long: if vectors' lengths say that they may not, that is an error.

    The index: vectors, made equally long by one more component, sorted by (nearest pivot, distance to it). Pivots are fitted on a
    bounded sample; every row is indexed.
    """
    index = Index(usable(rows, id_col, vec_col, rows["label"] if label is None else label), rows.sparkSession)
    blocks = written(anchor_blocks(index, every), "negatives-anchors")
    found = written(search(index, blocks, True, positives), "negatives-positives")
    num, den = ratio

    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            n = len(r["rows"]) // 8
            lo, hi = np.ones((n, positives), dtype=np.int64), np.zeros((n, positives), dtype=np.int64)  # empty
            for at in {f["at"] for f in r["found"]}:
                for j, s in enumerate(sorted({f["score"] for f in r["found"] if f["at"] == at and f["score"] >= 0}, reverse=True)):
                    lo[at, j], hi[at, j] = -(-s * num // den), s
            yield _one(BLOCKS, [[r[c]] for c in BLOCKS.names[:6]] + [[lo.tobytes()], [hi.tobytes()], [np.full(lo.size, NONE).tobytes()], [r["home"]]])

    scored = found.groupBy("block").agg(F.collect_list(F.struct("at", "score")).alias("found"))
    wide = written(blocks.join(scored, "block").mapInArrow(open_windows, BLOCKS), "negatives-windows")
    worse = search(index, wide, False, negatives)
    w = Window.partitionBy("block", "at").orderBy(F.desc("score"))
    windows_of = found.where("score >= 0").withColumn("win", (F.dense_rank().over(w) - 1).cast("long"))  # as open_windows() numbers them
    pairs = windows_of.select("block", "at", "win", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = pairs.join(worse.select("block", "at", "win", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["block", "at", "win"])

    ids = T.StructType([T.StructField("block", T.LongType()), T.StructField("at", T.LongType()), T.StructField("anchor_id", T.LongType())])

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            own = np.frombuffer(r["ids"], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r["block"], dtype=np.int64)), pa.array(np.arange(len(own))), pa.array(own)], names=ids.names)

    return named.join(blocks.select("block", "ids").mapInArrow(names, ids), ["block", "at"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(rows["vec_id"] % 7 == 0, (rows["label"] + 1) % 10).otherwise(rows["label"])
    return hard_negatives(rows, label=label)


OP12_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS row, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), s AS (
  SELECT a.row AS anchor, a.id AS anchor_id, b.row, b.id, a.label = b.label AS alike, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM e a JOIN e b ON a.id % 100 = 0 AND a.row <> b.row AND len(a.x) = len(b.x)
), p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, row) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.id, s.row) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
