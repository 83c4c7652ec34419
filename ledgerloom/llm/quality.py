"""Quality classifier: cumulative-link (ordinal logistic) regression on hashed text."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, id_and_text, table, utf8

#: Buckets of the hashed features; the weights that are sent to the executors have this fixed size.
BUCKETS = 1 << 18
#: Labelled rows that a fit uses at most: those whose hashed ids are least. Scoring covers every row.
FIT_ROWS = 8192
#: A document is kept if the highest grade is at least this likely.
KEEP = 0.5
#: Words that a task remembers with their buckets, and texts it turns into Python objects at a time. Workers outlive their tasks, so
#: what a task remembers goes with it.
REMEMBERED, TEXTS = 50_000, 1000


def bucket(feature: bytes) -> int:
    return zlib.crc32(feature) & (BUCKETS - 1)


def of_word(word: bytes, known: dict[bytes, tuple[int, ...]]) -> tuple[int, ...]:
    """Buckets of a word: its core in lower case, and the marks that stand around the core if they aren't plain punctuation. known:
    words met before, of which it holds REMEMBERED at most."""
    got = known.get(word)
    if got is None:
        core = word.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        marks = word.replace(core, b"", 1) if core else word
        out = [bucket(b"w " + core.decode("utf-8", "replace").lower().encode())] if core else []
        if len(marks) > 1 or marks and marks not in b".,;:!?":
            out.append(bucket(b"m " + marks))
        if len(known) >= REMEMBERED:
            known.clear()
        got = known[word] = tuple(out)
    return got


def features(raw: bytes, known: dict[bytes, tuple[int, ...]] | None = None) -> np.ndarray:
    """Sorted distinct buckets of a UTF-8 text: words, marks, and steps of what can be said of the whole text."""
    known = {} if known is None else known
    words = raw.split()
    counts = Counter(words)
    out = {b for w in counts for b in of_word(w, known)}
    n = len(words)
    if n:
        marked = sum(c for w, c in counts.items() if len(of_word(w, known)) != 1 or not w[:1].isalnum() and w[:1] < b"\x80")
        shouted = sum(c for w, c in counts.items() if len(w) > 2 and w.isupper())
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        for name, value in ((b"marked", marked / n), (b"shouted", shouted / n), (b"again", again / n), (b"distinct", len(counts) / n)):
            step = int(value * 10 + 1e-9)
            out |= {bucket(b"%s %d" % (name, k)) for k in range(1, step + 1)}
    length = n.bit_length()
    out |= {bucket(b"length %d" % k) for k in range(length + 1)}
    return np.fromiter(sorted(out), dtype=np.int32, count=len(out))


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(w.x - cuts[k]) with one w for all grades and rising cuts; x: which buckets a text has."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return sigmoid(float(self.weights[x].sum()) - self.cuts)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = 250, l1: float = 2e-4, rate: float = 0.08) -> Ordinal:
    """Maximum likelihood with an L1 penalty on weights, by proximal steps whose size is scaled for each weight (Adam).

    Cuts are kept in order by fitting the first and the logarithms of the gaps. A grade without rows leaves its gap as it began.
    """
    lens = np.array([len(x) for x in rows])
    idx = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=np.int32)
    used, idx = np.unique(idx, return_inverse=True)
    starts = np.r_[0, np.cumsum(lens)[:-1]]
    n = len(rows)
    share = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(0.01, 0.99)
    c = -np.log(share / (1 - share))
    p = np.r_[c[0], np.log(np.maximum(np.diff(c), 0.05))]
    w = np.zeros(len(used))
    m, v, mp, vp = np.zeros_like(w), np.zeros_like(w), np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        cuts = np.cumsum(np.r_[p[0], np.exp(p[1:])])
        z = np.add.reduceat(w[idx], starts)
        upper = sigmoid(np.r_[-np.inf, cuts][grades] * -1 + z)  # P(grade >= g)
        lower = sigmoid(z - np.r_[cuts, np.inf][grades])  # P(grade > g)
        upper[grades == 0], lower[grades == n_grades - 1] = 1, 0
        prob = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / prob, lower * (1 - lower) / prob
        gz = -(du - dl) / n
        gw = np.bincount(idx, weights=np.repeat(gz, lens), minlength=len(used))
        gc = np.array([du[grades == k + 1].sum() - dl[grades == k].sum() for k in range(n_grades - 1)]) / n
        gp = np.array([gc.sum(), *[gc[k:].sum() * np.exp(p[k]) for k in range(1, n_grades - 1)]])
        step = rate * min(1, 3 * (rounds - t + 1) / rounds)
        for x, g, a, b, penalty in ((w, gw, m, v, l1), (p, gp, mp, vp, 0)):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            scale = step / (np.sqrt(b / (1 - 0.99**t)) + 1e-5)
            x -= scale * a / (1 - 0.9**t)
            if penalty:
                x[:] = np.sign(x) * np.maximum(np.abs(x) - scale * penalty, 0)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[used] = w
    return Ordinal(weights, np.cumsum(np.r_[p[0], np.exp(p[1:])]))


def grade_of():
    """Grades from the labels: 0 toxic, 1 of low quality, 2 good; null where a label is missing."""
    return F.when(F.col("toxic").isNull() | F.col("quality").isNull(), None).when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)


def train(docs: DataFrame, grades: DataFrame, n_grades: int = 3, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    """Fit on at most fit_rows labelled rows of docs. grades: (id, grade); an id with several has the least. None if there is
    nothing to learn: fewer than two grades among the rows.

    The sample's ids (fit_rows rows at most) are broadcast; only its rows' features, not texts, come to the driver. Of rows with
    one id the least text is used, so the rows are bounded as well as the ids.
    """
    chosen = grades.where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    sample = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "id")
    sample = sample.groupBy("id").agg(F.min("grade").alias("grade"), F.min(F.coalesce("text", F.lit(""))).alias("text")).select("grade", "text")

    def make():
        known = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(x, known).tobytes() for x in utf8(batch.column(1))], pa.binary())], names=["grade", "x"])

        return step

    rows = arrow_map(sample, make, T.StructType([sample.schema["grade"], T.StructField("x", T.BinaryType())]), TEXTS).toArrow()
    y = rows.column("grade").to_numpy().astype(np.int64)
    x = [np.frombuffer(b, dtype=np.int32) for b in rows.column("x").to_pylist()]
    # an order of its own, so that the fit doesn't follow the order in which rows arrive
    order = sorted(range(len(x)), key=lambda i: (int(y[i]), x[i].tobytes()))
    return fit([x[i] for i in order], y[order], n_grades) if len(set(y.tolist())) > 1 else None


def score(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """Rows (id_col, expected_grade, tail_prob, kept) for every row of docs; tail_prob: that of the highest grade.

    Null and empty texts have the features of no words. Without a model nothing can be told: null grades, and all is kept.
    """
    source = id_and_text(docs, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_prob", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    if model is None:
        return source.select(F.col("id").alias(id_col), F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_prob"), F.lit(True).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def make():
        own, known = sent.value, {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            tails = np.array([own.tails(features(x, known)) for x in utf8(batch.column(1))])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep)], names=schema.names)

        return step

    return arrow_map(source, make, schema, TEXTS)


def keep_good(docs: DataFrame, model: Ordinal | None, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of docs, with all their columns, that score() would keep; nothing is joined or shuffled."""
    if model is None:
        return docs
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def make():
        own, known = sent.value, {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([bool(own.tails(features(x, known))[-1] >= keep) for x in utf8(batch.column(at))], pa.bool_()))

        return step

    return arrow_map(docs, make, docs.schema, TEXTS)


def graded(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("id"), grade_of().cast("int").alias("grade"))


def op5_ordinal(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, graded(table(spark, sf_dir, "labels"))))
