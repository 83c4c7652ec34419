import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import scans, trie

SCHEMA = "conv_id long, turn long, role string, text string, c string, idx string, lead string"


def plain(rows, block=trie.BLOCK, shared=trie.SHARED):
    """The whole trie by dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        rebuilt[c] = own.get(c - int(math.fmod(c, block)), [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s))
    leaves, saved, out = {}, {}, []
    for key in sorted(members, key=len, reverse=True):
        kids = children.get(key, [])
        leaves[key] = sum(leaves[k] for k in kids) if kids else 1
        saved[key] = sum(saved[k] for k in kids) + ((len(members[key]) - 1) * words(key[-1][1]) if key else 0)
        ends = ",".join(str(c) for c in sorted(c for c in members[key] if len(rebuilt[c]) == len(key)))
        out.append((min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(kids), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return sorted(map(tuple, trie.prefix_trie(*trie.share_openings(trie.number_turns(frame))).collect()), key=str)


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), 90):
        texts = [rng.choice(["a", "b c", "d e f", "", None]) for _ in range(rng.randint(1, 5))]
        rows += [(c, rng.choice([None, i, i, 7]), rng.choice(["user", "bot", None]), t) for i, t in enumerate(texts)]
    return rows


def caterpillar():
    """Snapshots of one growing conversation, each of which also ends, and long tails; ids rise with the length."""
    rows = []
    for k in range(1, 25):
        rows += [(20 * k, i, "user", f"turn {i} of all") for i in range(k)]
    return rows + [(1000, i, "bot", f"tail {i}") for i in range(300)]


@pytest.mark.parametrize("rows", [random_rows(1), random_rows(2), caterpillar()], ids=["ties and nulls", "more", "caterpillar"])
def test_against_plain(spark, rows):
    assert built(spark, rows) == plain(rows)


def test_copies_repeats_and_turnless(spark):
    rows = [(c, t, "user", f"line {t}") for c in range(60) for t in range(2)]  # copies; some lose all their turns or their block's start
    rows = [r for r in rows if r[0] != 40] + [(c, 0, "x", "short") for c in (41, 47, 52, -3, -25)] + rows[:9] + [(None, 1, "user", "nobody"), (77, None, None, "long " * 20_000)]
    assert built(spark, rows) == plain(rows)


def test_empty(spark):
    assert built(spark, []) == []


def test_running_sums(spark):
    """A key with nearly all rows, over many partitions, and wrap at 64 bits."""
    n = 5000
    rows = spark.range(n).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 50 + 8).cast("long").alias("k"), "id", (F.col("id") * F.col("id")).alias("v"), F.lit(2**62).alias("w"))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = scans.running_sums(scans.placed(rows, "k", "id"), "k", ["v", "w"], before=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in sorted(got):
        own = by.setdefault(r.k, [0, np.int64(0)])
        assert r.before_v == own[0] and r.before_w == own[1]
        with np.errstate(over="ignore"):
            own[0], own[1] = own[0] + r.v, own[1] + np.int64(r.w)
        assert r.run_v == own[0] and r.run_w == own[1]
    assert len(got) == n and len(by) == 51


def test_rounds_grow_slowly(spark, monkeypatch):
    """Paths by hashed leaders keep message passing short on snapshots of one conversation with rising ids."""
    rounds = []
    monkeypatch.setattr(trie, "cut", lambda df, f=trie.cut: rounds.append(1) or f(df))
    rows = [(20 * k, i, "user", f"turn {i}") for k in range(1, 61) for i in range(k)]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    nodes = trie.build_nodes(trie.number_turns(frame).withColumnRenamed("idx", "pos"), frame.selectExpr("conv_id as c").distinct())
    rounds.clear()
    trie.peel(nodes)
    assert len(rounds) <= 16  # 60 levels
