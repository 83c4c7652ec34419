import numpy as np
import pytest

from ledgerloom.llm import covertree


def brute(rows, threshold=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    n[a], n[b] = n[a] + 1, n[b] + 1
                    parent[find(b)] = find(a)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((str(k), n[i], str(least.get(find(i)) if i in ok else k)) for i, (k, _) in enumerate(rows))


def rows_of(seed, singles=150, groups=6, size=30, dims=16, spread=0.08):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=dims) for _ in range(singles)]
    for g in range(groups):
        c = rng.normal(size=dims)
        x += [(c / np.linalg.norm(c) + rng.normal(size=dims) * spread * rng.random()) * rng.uniform(0.1, 9) for _ in range(size * (1 + g))]
    rng.shuffle(x)
    rows = [(i * 3 + 1, [float(v) for v in np.float32(y)]) for i, y in enumerate(x)]
    return [*rows, *((5000 + i, rows[3][1]) for i in range(40))]


@pytest.mark.parametrize("seed,cells,piece", [(1, 4, 8192), (2, 7, 25), (3, 1, 60)])
def test_against_brute_force(spark, seed, cells, piece):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = covertree.near_duplicates(df, cells=cells, piece_rows=piece).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_trees_without_spark():
    rng = np.random.default_rng(9)
    for spread in (0.02, 0.1, 0.3):
        x = np.concatenate([rng.normal(size=(1, 8)) + rng.normal(size=(200, 8)) * spread for _ in range(5)])
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= 0.95
        np.fill_diagonal(near, False)
        one = covertree.search(x, np.ones(len(x), dtype=np.int64), np.arange(len(x)), None, 0.95)
        assert (one.count == near.sum(axis=1)).all()
        two = covertree.search(x, np.ones(len(x), dtype=np.int64), np.arange(300), np.arange(300, len(x)), 0.95)
        assert (two.count[:300] == near[:300, 300:].sum(axis=1)).all() and (two.count[300:] == near[:300, 300:].sum(axis=0)).all()


def test_levels_prune():
    """Trees compare few of the pairs of vectors that lie in clusters, link or not, and lose none."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], 50, axis=0) + rng.normal(size=(3000, 32)) * 0.004
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = covertree.search(x, np.ones(len(x), dtype=np.int64), np.arange(len(x)), None, 0.95)
    near = x @ x.T >= 0.95
    assert (found.count == near.sum(axis=1) - 1).all() and found.compared < 0.05 * len(x) ** 2 / 2
    tree = covertree.Tree(x, np.arange(len(x)), 0.316)
    for k, children in enumerate(tree.children):
        assert sorted(p for c in children for p in tree.points[c].tolist()) == (sorted(tree.points[k].tolist()) if children else [])
        assert np.sqrt(((x[tree.points[k]] - x[tree.centre[k]]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (None, [1.0, 0.01]), (9, []), (8, [-1.0, -0.0]), (10, [1e-30, 0.0])]
    rows += [(20, [1.0, 0.0, 0.0]), (21, [5.0, 0.0, 0.1]), (22, [0.0, 1.0, 0.0]), (23, [1.0, 0.0, 0.0]), (24, [3.0]), (25, [-2.0]), (26, [1.0])]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "vec_id long, embedding array<float>, node string, v string, n_links int")
    got = covertree.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)


def test_empty(spark):
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
