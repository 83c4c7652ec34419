import math
import random

import numpy as np
import pytest

from ledgerloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, id string, seg string"


def plain(rows, every=100, k=5):
    """Every anchor against every row."""
    valid = [(i, label, [math.floor(256 * float(np.float32(v))) for v in x]) for i, x, label in rows if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for a, (anchor, label, x) in enumerate(valid):
        if anchor % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, b, other) for b, (i, other, y) in enumerate(valid) if b != a and len(y) == len(x)]
        for ps, positive, _, _ in sorted(s for s in scored if s[3] == label)[:k]:
            fits = sorted(s for s in scored if s[3] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps)[:k]
            out += [(anchor, positive, r, s[1], -ps, -s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out)


def got(spark, rows, **how):
    return sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA), **how).collect()))


def clustered(n, seed, dim=6, centres=9, spread=0.1, labels=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(i, [float(v) for v in middle[i % centres] + spread * rng.normal(size=dim)], int(rng.integers(labels))) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, v in (("SEGMENT", 64), ("RUN", 16), ("PART", 256), ("BLOCK", 8), ("SAMPLE", 200)):
        monkeypatch.setattr(negatives, name, v)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_against_all(spark, small, spread):
    rows = clustered(1500, 4, spread=spread)
    assert got(spark, rows, every=20) == plain(rows, every=20)


def test_ties_repeats_nulls_and_lengths(spark, small):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)], rng.randint(0, 2)) for i in range(400)]
    rows += rows[::5] + [(100, [1.0, 1.0, 1.0], 1)] * 3
    rows += [(1000 + i, [1.0, 0.5], i % 2) for i in range(40)] + [(2000, [], 1), (2001, [], 0), (2002, [], 1), (2003, [], 0)]
    rows += [(3000, None, 1), (3100, [1.0, None, 0.0], 1), (3200, [1.0, math.nan, 0.0], 1), (3300, [math.inf, 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 1), (3400, [1.0, 1.0, 1.0], None), (3500, [-1.0, -1.0, -0.001], 1), (-100, [0.9, 0.1, 0.0], 2)]
    have = got(spark, rows)
    assert have == plain(rows) and len(have) > 50


def test_one_vector_in_most_rows(spark, small):
    rows = [(i, [0.25, -0.5, 0.75], i % 3) for i in range(900)] + clustered(300, 2, dim=3)[:0] + [(1000 + i, x, y) for i, x, y in clustered(300, 2, dim=3)]
    assert got(spark, rows) == plain(rows)


def test_large_components(spark):
    rows = [(i * 10, [x * 3e4 for x in v], y) for i, v, y in clustered(200, 3)]  # products over 2 ** 53
    assert got(spark, rows) == plain(rows)
    with pytest.raises(ValueError, match="may not fit"):
        got(spark, [(0, [1e30, 0.0], 1), (1, [1.0, 0.0], 1)])


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.repeat(rng.normal(size=(8, 16)), 200, axis=0) + 4 * rng.normal(size=(1600, 16)))
    top = (x * x).sum(axis=1).max()
    pivots = negatives.fit_pivots(list(x[::4]), top)[16]
    far = negatives.distances(negatives.augmented(x, top), pivots)
    own = far.argmin(axis=1)
    lo, hi = (np.array([f(far[own == p, p]) if (own == p).any() else 0.0 for p in range(len(pivots))]) for f in (np.min, np.max))
    q = x[::100]
    most, least = negatives.bounds(q, pivots, np.arange(len(pivots)), lo, hi, top)
    scores = q @ x.T
    assert (scores <= most[:, own]).all() and (scores >= least[:, own]).all()
    kth = np.sort(scores, axis=1)[:, -5:-4]
    assert (most >= kth).mean() < 0.5  # annuli without better rows are left out


def test_query_and_empty(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, negatives.op12_negatives(spark, sf_dir).collect())) == plain(rows)
    assert got(spark, []) == []
