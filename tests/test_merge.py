import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans import generations as G
from ledgerloom.sources.merge import KeyedTable

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("j", T.StringType()), T.StructField("v", T.StringType()), T.StructField("at", T.LongType())])


def rows_of(table):
    return sorted(map(tuple, table.read().collect()))


def test_insert_ignore_and_upsert(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k", "j"], buckets=8)
    assert rows_of(t) == []
    first = spark.createDataFrame([(1, "a", "x", 5), (1, "a", "w", 3), (2, "a", None, 1), (3, "b", "z", 1)], SCHEMA)
    m = t.merge(first, order=["at"])
    assert (m.version, m.inserted, m.updated) == (1, 3, 0)
    assert rows_of(t) == [(1, "a", "w", 3), (2, "a", None, 1), (3, "b", "z", 1)]
    again = t.merge(first, order=["at"])
    assert (again.inserted, again.updated) == (0, 0) and rows_of(t) == [(1, "a", "w", 3), (2, "a", None, 1), (3, "b", "z", 1)]
    newer = spark.createDataFrame([(1, "a", "new", 9), (3, "b", "old", 0), (4, "c", "n", 1)], SCHEMA)
    m = t.merge(newer, when=F.col("n.at") > F.col("o.at"))
    assert (m.inserted, m.updated) == (1, 1)
    assert rows_of(t) == [(1, "a", "new", 9), (2, "a", None, 1), (3, "b", "z", 1), (4, "c", "n", 1)]
    with pytest.raises(ValueError, match="no whole key"):
        t.merge(spark.createDataFrame([(None, "a", "x", 1)], SCHEMA))
    assert len(rows_of(t)) == 4 and t.merge(first.limit(0)).buckets == 0


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=16)
    t.merge(spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("j"), F.lit("x").alias("v"), F.col("id").alias("at")))
    before = {r.bucket: r.written for r in t.manifest().collect()}
    m = t.merge(spark.createDataFrame([(5000, "a", "y", 1), (5001, "a", "y", 1)], SCHEMA), name="b7")
    after = {r.bucket: r.written for r in t.manifest().collect()}
    assert m.buckets <= 2 and sum(before[b] != after[b] for b in before if b is not None) == m.buckets
    assert t.read().count() == 2002
    assert t.merge(spark.createDataFrame([(9999, "a", "y", 1)], SCHEMA), name="b7").inserted == 0 and t.read().count() == 2002


def test_failed_merge_is_not_seen(spark, tmp_path):
    """Data that a merge wrote before it failed isn't read, and the next attempt replaces it."""
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=2)
    t.merge(spark.createDataFrame([(1, "a", "x", 1)], SCHEMA))
    spark.createDataFrame([(7, "lost", "x", 1)], SCHEMA).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{tmp_path}/t/data/written=2")
    assert rows_of(t) == [(1, "a", "x", 1)]
    t.merge(spark.createDataFrame([(2, "b", "y", 1)], SCHEMA))
    assert rows_of(t) == [(1, "a", "x", 1), (2, "b", "y", 1)]


def generation(spark, pairs, changed=None):
    c = spark.createDataFrame([(*p, f'{{"n":{p[0]}}}') for p in pairs], "lec_id long, author_id long, snapshot string")
    e = [(*p, kind, "R1", "1", f"{kind}{p}" + ("!" if (p, kind) == changed else "")) for p in pairs for kind in ("NAME", "PUBLICATION")]
    return c, spark.createDataFrame(e, "lec_id long, author_id long, kind string, rule_id string, rule_version string, payload string")


def test_generation_runs(spark, tmp_path):
    pairs = [(1, 10), (1, 11), (2, 10)]
    store = G.GenerationStore(spark, f"{tmp_path}/g", buckets=4)
    meta = ("run1", "rules", "v1", "{}")
    assert store.persist(*meta, *generation(spark, pairs)) == G.Persisted("run1", 3, 3, 6, False)
    assert store.persist(*meta, *generation(spark, pairs[::-1])) == G.Persisted("run1", 3, 3, 6, True)
    with pytest.raises(G.GenerationConflict) as e:
        store.persist(*meta, *generation(spark, pairs, changed=((1, 11), "NAME")))
    assert [(r.lec_id, r.author_id, r.problem) for r in e.value.problems] == [(1, 11, "EVIDENCE_DIFFERS")] and "NAME/R1/1/" in str(e.value)
    for other, problem in ((pairs[:2], "PAIR_NOT_REQUESTED"), ([*pairs, (9, 9)], "PAIR_NOT_IN_RUN")):
        with pytest.raises(G.GenerationConflict, match=problem):
            store.persist(*meta, *generation(spark, other))
    with pytest.raises(G.GenerationConflict, match="metadata"):
        store.persist("run1", "rules", "v2", "{}", *generation(spark, pairs))
    assert store.run("run1")["status"] == "COMPLETED"
    store.persist("run2", "rules", "v1", "{}", *generation(spark, [(1, 10), (5, 5)]))
    assert {(r.lec_id, r.author_id): r.first_run for r in store.roots.read().collect()} == {(1, 10): "run1", (1, 11): "run1", (2, 10): "run1", (5, 5): "run2"}


def test_half_written_run_goes_on_or_fails(spark, tmp_path):
    pairs = [(k, k) for k in range(6)]
    store = G.GenerationStore(spark, f"{tmp_path}/g", buckets=4)
    run = ("r", "rules", "v1", "{}")
    store._set(run, "RUNNING")
    store.observations.merge(G.prepared(*generation(spark, pairs[:3])).withColumn("run_id", F.lit("r")))
    with pytest.raises(G.GenerationConflict, match="EVIDENCE_DIFFERS"):
        store.persist(*run, *generation(spark, pairs, changed=((2, 2), "PUBLICATION")))
    assert store.run("r")["status"] == "FAILED"
    assert store.persist(*run, *generation(spark, pairs)) == G.Persisted("r", 6, 6, 12, False)
    assert store.run("r")["status"] == "COMPLETED"
