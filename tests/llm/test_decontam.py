import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import decontam


def brute(text, items, window=10):
    words = decontam.words_of((text or "").encode())
    hit, owners = set(), set()
    for item_id, item in items:
        w = decontam.words_of((item or "").encode())
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    owners.add(None if item_id is None else str(item_id))
    return len(words), len(hit), owners


@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=4), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_search(words, items, window):
    text, listed = " ".join(words), [(i, " ".join(x)) for i, x in enumerate(items)]
    ranges, owners = decontam.hits(words, decontam.searchers(listed, window))
    n, hit, want = brute(text, listed, window)
    assert sum(b - a for a, b in ranges) == hit and {None if x is None else str(x) for x in owners} == want


def test_words():
    assert decontam.words_of("Ab-c É_x9K".encode()) == ["ab", "c", "É", "x9K"]


def test_frame(spark, docs_of, prose):
    items = [(1, prose(14, 1)), (2, prose(10, 2)), (10, "Short one"), (3, None), (4, "..."), (2, prose(12, 3)), (None, prose(11, 4)), (None, prose(12, 6)), (77, prose(30, 4))]
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, items[0][1].upper()), (3, prose(500, 9) + " " + items[1][1] + "\n" + items[5][1]), (4, prose(900, 10)), (4, prose(900, 10)), (5, "short ONE. x short one"), (6, prose(40_000, 11) + " " + items[6][1]), (7, items[7][1])]
    rng.shuffle(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for pass_bytes in (decontam.PASS_BYTES, 150):
        got = decontam.find_contamination(docs_of(rows), bench, pass_bytes=pass_bytes).collect()
        assert len(got) == len(rows)
        want = {i: brute(t, items) for i, t in rows}
        for r in got:
            n, hit, owners = want[r.doc_id]
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, hit, sorted(owners, key=lambda i: (i is not None, i)), hit > 0)


def test_size_of_a_full_block():
    """16 MB of test texts take less than 500 MB while a searcher is built, and it finds what it should."""
    code = """
import random, resource
from ledgerloom.llm import decontam
rng = random.Random(1)
vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(200_000)]
items, total = [], 0
while total < decontam.PASS_BYTES:
    items.append((str(len(items)), " ".join(rng.choices(vocabulary, k=200))))
    total += len(items[-1][1])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
search = decontam.searchers(items)
after = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
words = decontam.words_of(("x " * 500 + items[77][1] + " y" * 30).encode())
assert decontam.hits(words, search) == ([(500, 700)], {"77"})
print((after - before) // 1024)
"""
    import subprocess
    import sys

    took = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert took.returncode == 0, took.stderr
    assert int(took.stdout) < 500, took.stdout


def test_bytes_that_are_not_utf8(spark):
    docs = spark.createDataFrame([(1, bytearray(b"one \xff two three"))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    r = decontam.find_contamination(docs, bench).first()
    assert (r.n_words, r.n_hit, r["items"]) == (4, 2, ["1"])


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(docs_of([]), none).count() == 0
    assert decontam.find_contamination(docs_of([(1, "a b")]), none).first().n_hit == 0
