import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import sharding


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 4), (4, 2)])
def test_curve(dims, bits):
    """Each cell once, and neighbours on the curve are neighbours in the grid."""
    top = (1 << bits) - 1
    point = lambda c: tuple(c >> bits * d & top for d in range(dims))
    order = sorted((point(c) for c in range(1 << bits * dims)), key=lambda p: sharding.hilbert_index(p, bits))
    assert [sharding.hilbert_index(p, bits) for p in order] == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(order, order[1:]))


def check(rows, got, shards):
    assert len(got) == len(rows)
    texts = sorted((str(i), t or "") for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == [(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in sorted(texts, key=lambda x: (x[0], len(x[1].encode()) + 8, zlib.crc32(x[1].encode())))]
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(0 <= s < shards for s in slots)
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    cells = sorted(((r.shard, r.slot), r.h) for r in got)
    assert [h for _, h in cells] == sorted(h for _, h in cells)


def test_assign(spark, docs_of, prose, tmp_path):
    rows = [(i, prose(i % 40, i)) for i in range(500)] + [(1000 + i, "the same text") for i in range(300)] + [(2000, None), (None, "x"), (None, "x"), (2000, None), (2001, ""), (2002, prose(30_000, 1))]
    docs = docs_of(rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("doc_id").cast("string")))
    for n, d in ((24, docs), (7, docs.limit(5))):
        listed = [(r.doc_id, r.text) for r in d.collect()]
        out = sharding.assign_shards(d, sharding.dims_of(d), shards=n)
        check(listed, out.collect(), n)
    out = sharding.assign_shards(docs, sharding.dims_of(docs))
    parts = {r.shard: r for r in sharding.manifest(out, ["source", "lang", "length"]).collect()}
    assert sum(r.n_rows for r in parts.values()) == len(rows) and all(r.min_source <= r.max_source for r in parts.values())
    alike = docs.union(docs.where("doc_id in (1, 2)").withColumn("n_chars", F.lit(7)))
    sharding.write_shards(alike, sharding.dims_of(alike), f"{tmp_path}/s", 5)
    again = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(map(str, again.select(*docs.columns).collect())) == sorted(map(str, alike.collect())) and again.columns == [*docs.columns, "shard"]
    counts = [r["count"] for r in again.groupBy("shard").count().collect()]
    assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_null_dimensions_and_long_texts(docs_of):
    docs = docs_of([(i, "x" * 2**i if i < 20 else None) for i in range(32)]).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    got = sharding.assign_shards(docs, sharding.dims_of(docs), 4).collect()
    length = {r.doc_id: r.length for r in got}
    assert len({r.source for r in got}) == len({r.lang for r in got}) == 1
    assert [length[i] for i in range(20)] == sorted(length[i] for i in range(20)) and len({length[i] for i in range(14, 20)}) >= 3


def test_query(spark, sf_dir):
    from ledgerloom.llm.sharding import op9_hilbert

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(rows, op9_hilbert(spark, sf_dir).collect(), 24)


def test_empty(docs_of):
    none = docs_of([])
    assert sharding.assign_shards(none, sharding.dims_of(none)).count() == 0
