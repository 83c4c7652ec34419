import random

import numpy as np
import xxhash

from ledgerloom.llm import common, simhash


def plain(text, width=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint(prose):
    for text in ["", " \t", "One", "one TWO three", "a b c d", "a b c d e a b c d", "É x " * 50, prose(3000, 1), "a\x85b c d e f"]:
        assert simhash.fingerprint(text.encode()) == plain(text), text


def test_forest_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)] + [base]))
    rng.shuffle(fp)
    group = np.sort(rng.integers(0, 5, len(fp)))
    forest = simhash.BKForest(fp, group - group.min())
    found = {(int(q), int(n)) for qs, ns in forest.search(fp, group - group.min(), 4) for q, n in zip(qs, ns)}
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= 4}
    assert found == want


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    fps = {0, 2**64 - 1}
    while len(fps) < 400:
        x = rng.choice(sorted(fps)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    want = components(fps)
    classes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    for agree, tree_rows in ((2, 8192), (1, 8192), (2, 7)):
        roots = {r.node % 2**64: r.root % 2**64 for r in common.connected_components(simhash.links(classes, 4, agree, tree_rows)).collect()}
        got = [roots.get(x, x) for x in fps]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want)), (agree, tree_rows)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    assert {(r.node, r.root) for r in common.connected_components(edges).collect()} == {(i, 0) for i in range(1, 301)} | {(1001, 1000)}


def test_near_duplicates(spark, docs_of, prose):
    long = prose(4000, 7)
    rows = [(5, prose(50, 1)), (3, prose(50, 1)), (9, long), (8, long.replace(" ", "  ", 5) + " zz"), (2, None), (1, " \n"), (4, ""), (7, "single"), (7, "single"), (None, "single"), (None, "nameless only")]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    fps = [plain(t) for _, t in rows]
    root = components(fps)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((str(i), f"{f:016x}", str(least.get(r))) for (i, _), f, r in zip(rows, fps, root))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert {r.doc_id for r in got if r.kept} == {*least.values(), None}


def test_empty(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
