import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from ledgerloom.llm import urls

CASES = [
    (None, "", "", None), ("", "", "", None), ("no scheme/com/", "", "", None), ("http://A.Com", "a.com", "", None), ("http://A.Com/X", "a.com", "/X", "com/"),
    ("https://www.example.com/en/1?x=/es/", "www.example.com", "/en/1", "www.example.com/en/"), ("https://m.example.com/en/1#a", "m.example.com", "/en/1", "example.com/en/"),
    ("https://example.com/en/", "example.com", "/en/", "example.com/en/"), ("https://example.com/EN/", "example.com", "/EN/", "com/"), ("https://notexample.com/en/", "notexample.com", "/en/", "com/"),
    ("x://y.net/es/a://b", "y.net", "/es/a://b", "net/es/"), ("x://y.net/fr", "y.net", "/fr", None), ("x://y.net/fr/", "y.net", "/fr/", "net/fr/"), ("x://net/fr/z", "net", "/fr/z", "net/fr/"),
    ("x://y.net?q=/fr/", "y.net", "", None), ("x://ÄB.org/é", "Äb.org", "/é", None), ("a://b\nc.com/x\ny?z", "b\nc.com", "/x\ny", "com/"), ("://com/", "com", "/", "com/"),
]
VERDICTS = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block", None: "allow"}


def test_rules(spark):
    rows = [(i, u, "x") for i, (u, *_) in enumerate(CASES)] + [(None, "http://a.com/", "x"), (0, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([], "id long, bad boolean")
    got = urls.judge(pages, labels).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, (u, host, path, rule) in enumerate(CASES):
        r = by[i]
        assert (r.host, r.path, r.rule, r.verdict, r.mined) == (host, path, rule, VERDICTS[rule], None), (u, r)
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_mined_rules(spark):
    """A combination of two tokens is bad, neither alone."""
    rows, labels = [], []
    for i in range(600):
        spam, shop = i % 2 == 0, i % 3 == 0
        rows.append((i, f"http://{'spam' if spam else 'good'}.org/{'shop' if shop else 'news'}/{i % 7}"))
        if i < 400:
            labels.append((i, spam and shop))
    labels += [(3, None), (None, True), (1, False), (10_000, True)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for pass_rules in (urls.PASS_RULES, 2):
        known = spark.createDataFrame(labels, "id long, bad boolean")
        tokens = pages.select(F.col("page_id").alias("id"), urls.tokens_of(F.col("url")).alias("tokens"))
        mined = urls.mine(tokens.join(known.where("bad is not null"), "id"))
        assert [sorted(r.tokens) for r in mined.collect()] == [["host:spam", "path:shop"]]
        got = urls.match(tokens, mined, pass_rules).collect()
        assert {r.id for r in got if r.mined} == {i for i in range(600) if i % 6 == 0}
    assert {r.page_id for r in urls.judge(pages, known).collect() if r.verdict == "block"} == {i for i in range(600) if i % 6 == 0}


def test_equal_long_urls(spark):
    """20 equal bad URLs of 25 tokens among 1000: one rule for them, and no search through their combinations."""
    tokens = [f"t{k}" for k in range(25)]
    rows = [(tokens, True)] * 20 + [([f"x{i % 90}", "com"], i % 40 == 0) for i in range(980)]
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert sorted(r.tokens for r in got) == [[t] for t in sorted(tokens)] and all(r.confidence == 1 and r.support == 0.02 for r in got)
    mixed = [(tokens, i % 2 == 0) for i in range(40)] + [([*tokens, "bait"], True) for _ in range(20)] + [(["com", "bait"], False) for _ in range(940)]
    assert [r.tokens for r in urls.mine(spark.createDataFrame(mixed, "tokens array<string>, bad boolean")).collect()] == [["bait", "t0"]]


def brute_rules(rows, support, confidence):
    """Minimal combinations by trying all of them."""
    n, share = len(rows), sum(bad for _, bad in rows) / len(rows)
    out = []
    for size in range(1, 5):
        for combo in sorted({c for t, _ in rows for c in combinations(sorted(t), size)}):
            held = [bad for t, bad in rows if set(combo) <= set(t)]
            if sum(held) >= max(support * n, 6) and sum(held) / len(held) >= confidence and sum(held) / len(held) > share and not any(set(r) < set(combo) for r in out):
                out.append(combo)
    return out


def test_mining_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(sorted(rng.sample("abcdefgh", rng.randint(0, 4))), False) for _ in range(300)]
    rows = [(t, {"a", "b"} <= set(t) or {"c", "d", "e"} <= set(t) or rng.random() < 0.05) for t, _ in rows]
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    rows = [r for r in rows if r[0]]
    got = sorted(tuple(r.tokens) for r in urls.mine(labelled, 0.02, 0.8, least_urls=6).collect())
    assert got == sorted(brute_rules(rows, 0.02, 0.8)) and len(got) >= 2


def test_rules_in_passes(spark):
    rules = spark.createDataFrame([([f"t{i}", f"t{i + 1}"],) for i in range(50)], "tokens array<string>")
    pages = spark.createDataFrame([(i, [f"t{i}", f"t{i + 1}", "x"]) for i in range(60)] + [(99, None)], "id long, tokens array<string>")
    whole, parts = ({r.id: r.mined for r in urls.match(pages, rules, n).collect()} for n in (1000, 7))
    assert whole == parts and sum(v is not None for v in whole.values()) == 50


def test_query(spark, sf_dir):
    got = urls.op3_urls(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and {r.verdict for r in got} <= {"allow", "block"}
    for r, (url,) in zip(sorted(got), spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").select("url").collect(), strict=True):
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(v, h, p) for v, h, p in urls.RULES if ("." + host.lower()).endswith("." + h) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=("allow", None, None))
        assert (r.host, r.path, r.rule) == (host.lower(), path, best[1] and best[1] + best[2]) and (r.verdict, r.mined) == (best[0], None), r
