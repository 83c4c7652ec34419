import random
import tracemalloc
from itertools import combinations

import corpus_pipeline
import numpy as np
from ledgerloom.llm import copies, simhash


def plain(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Ids kept of (id, text), ids in order."""
    sets, parent = [plain(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        x, y = sets[i], sets[j]
        if 5 * len(x & y) >= 4 * len(x | y):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [i for k, (i, _) in enumerate(rows) if find(k) == k]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def edited(text, n, seed):
    words, rng = text.split(), random.Random(seed)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"edit{seed}x{k}"
    return " ".join(words)


def test_stage_against_brute_force(spark, docs_of, sf_dir):
    base = [prose(300, s) for s in range(12)]
    rows = [(10 * s, t) for s, t in enumerate(base)]
    # two to nine changed words of 300: similarities from above to below 0.8; families whose members are alike in steps only
    rows += [(1000 + 20 * s + n, edited(t, n, s * 100 + n)) for s, t in enumerate(base) for n in range(2, 10)]
    chain = base[0]
    for k in range(6):
        chain = edited(chain, 5, 5000 + k)
        rows.append((2000 + k, chain))
    rows += [(3000, "One two"), (3001, "one  TWO"), (3002, ""), (3003, " \n"), (3004, None), (3005, "one two three")]
    rows += [(4000 + k, f"{prose(40, 77)} {prose(60, 900 + k)}") for k in range(20)]
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_near(spark, docs_of(rows), sf_dir).collect()) == sorted(brute(sorted(rows)))
    alone = [(k, f"{prose(70, 77)} {prose(30, 700 + k)}") for k in range(12)]
    crowd = [*alone, *((100 + k, edited(alone[k][1], 1, k)) for k in range(12))]
    assert sorted(r.doc_id for r in copies.keep_firsts(docs_of(crowd), piece_bytes=2000).collect()) == sorted(brute(sorted(crowd)))
    # what 4 bits of a SimHash miss
    missed = [edited(base[1], 5, k) for k in range(20)]
    missed = [(k, t) for k, t in enumerate(missed, 1) if (simhash.fingerprint(base[1].encode()) ^ simhash.fingerprint(t.encode())).bit_count() > simhash.RADIUS]
    assert missed and brute([(0, base[1]), *missed]) == [0]
    for k, t in missed[:1]:
        assert [r.doc_id for r in corpus_pipeline.dedup_near(spark, docs_of([(0, base[1]), (k, t)]), sf_dir).collect()] == [0]


def test_repeated_rows(docs_of):
    rows = [(1, prose(50, 1))] * 3 + [(None, prose(50, 1)), (2, prose(50, 2)), (2, prose(50, 2).upper()), (2, prose(50, 3))]
    assert sorted((r.doc_id, (r.text or "").lower()) for r in copies.keep_firsts(docs_of(rows)).collect()) == sorted([(1, prose(50, 1)), (2, prose(50, 2)), (2, prose(50, 3))])
    assert copies.keep_firsts(docs_of([])).count() == 0


def test_memory_of_a_comparison():
    """Two pieces of a band take a few arrays of their shingles at once, and all that are alike are connected."""
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in rng.integers(1, 4000, 200)]
    sets = [np.unique(np.r_[x[: len(x) - len(x) // k], y]) for k in (9, 3) for x in base for y in [rng.integers(0, 2**63, len(x) // k, dtype=np.uint64)]]
    sets += [np.unique(x) for x in base]
    n, total = len(sets), sum(map(len, sets))
    left = rng.random(n) < 0.5
    tracemalloc.start()
    found = copies.edges_between(np.arange(n), np.arange(n), sets, left, ~left)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {(i, j) for i in np.flatnonzero(left) for j in np.flatnonzero(~left) if copies.alike(sets[i], sets[j])}
    assert len(want) > 50 and {(int(i), int(j)) for i, j in found} <= want
    root = copies_roots(n, found)
    assert all(root[i] == root[j] for i, j in want)
    assert peak < 30 * total


def copies_roots(n, pairs):
    parent = np.arange(n)
    for i, j in pairs:
        parent[parent == parent[j]] = parent[i]
    return parent
