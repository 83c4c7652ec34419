import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import aggregates as A
from ledgerloom.operators import filters as P
from ledgerloom.operators import latest as L
from ledgerloom.streaming import jobs


def test_zero_filled(spark):
    df = spark.createDataFrame([("a",), ("a",)], "s string")
    assert {r.s: r.n for r in A.zero_filled(df, "s", ["a", "b"]).collect()} == {"a": 2, "b": 0}


def test_dense_years_without_rows(spark):
    assert A.dense_years(spark.createDataFrame([(None,)], "year int")).count() == 0


def test_ratio(spark):
    df = spark.createDataFrame([(1, 8), (1, 0), (2, 3)], "a int, b int")
    assert [r.x for r in df.select(A.ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [0.125, None, 0.667]


def test_fingerprint_ignores_order_but_not_copies(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string"), spark.createDataFrame([(2, None), (1, "x")], "i int, t string")
    one = lambda d: A.fingerprint(d, ["i", "t"]).first().digest
    assert one(a) == one(b) != one(a.union(b))


def test_current_and_excluded(spark):
    log = spark.createDataFrame([(1, 1, 1, "EXCLUDE"), (2, 1, 1, "INCLUDE"), (3, 1, 2, "EXCLUDE")], "seq int, lec_id int, pub_id int, action string")
    assert [(r.lec_id, r.pub_id) for r in L.excluded(log).collect()] == [(1, 2)]


def test_chain_breaks(spark):
    log = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", "a"), (1, 4, "c", "b"), (2, 1, "d", "x")], "s int, q int, own string, prev string")
    assert {(r.s, r.q, r.problem) for r in L.chain_breaks(log, "s", "q", "own", "prev").collect()} == {(1, 4, "GAP"), (2, 1, "BROKEN_LINK")}


def test_like_pattern():
    assert P.like_pattern(" 50%_\\x ") == "%50\\%\\_\\\\x%"


@pytest.mark.parametrize("q,n", [("100%", 1), ("_", 0), ("tien", 1), ("nobody", 0), ("", 3)])
def test_publication_search(spark, q, n):
    pubs = spark.createDataFrame([(1, "e1", "Chi 100%", None, None), (2, "e2", "X", None, None), (3, "e3", "Tiến", None, None)], "pub_id int, eid string, title string, source_title string, doi string")
    links = spark.createDataFrame([(2, 1, 1)], "pub_id int, author_order int, author_id int")
    authors = spark.createDataFrame([(1, "570", "Anh")], "author_id int, scopus_id string, name string")
    assert P.publications(pubs, links, authors, P.PublicationFilter(q=q)).count() == n


def test_plans_push_down(spark, sf_dir):
    """Filters and columns reach the scan, and a page is a bounded sort, not a global one."""
    from ledgerloom import registry

    plan = lambda name: registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("topk_audits") and "event_id" in plan("topk_audits")
    assert "PushedFilters: [IsNotNull(o_orderkey)" in plan("publication_detail") or "PushedFilters" in plan("publication_detail")
    assert "value" not in plan("agg_comment_counts").split("ReadSchema")[1].split(">")[0]
    assert "CartesianProduct" not in plan("generate_candidates") and "BroadcastNestedLoopJoin" not in plan("generate_candidates")


def test_import_again_adds_nothing(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(3):
        spark.createDataFrame([(i, "x") for i in range(10 * (k + 1))], "id int, t string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id int, t string").parquet(source)
        jobs.import_batches(stream, jobs.append_new(target, ["id"]), f"{tmp_path}/c{k // 2}").awaitTermination()
    assert sorted(r.id for r in jobs.imported(spark, target, stream.schema, ["id"]).collect()) == list(range(30))


def test_windowed_counts(spark, tmp_path):
    spark.sql("SELECT timestamp '2024-01-01 00:00:10' + make_interval(0,0,0,0,0,id) AS at, 'k' AS key FROM range(5)").write.parquet(f"{tmp_path}/w")
    stream = spark.readStream.schema("at timestamp, key string").parquet(f"{tmp_path}/w")
    assert [r.n for r in jobs.drain(jobs.windowed_counts(stream, "at", "2 minutes", "1 minute", "key"), "complete", f"{tmp_path}/o", f"{tmp_path}/c").orderBy("window").collect()] == [2, 2, 1]
