"""Joins and groups that must not grow with the square of their tables."""

import re

from pyspark.sql import functions as F

from ledgerloom import registry
from ledgerloom.functions import text as X
from ledgerloom.plans import candidates as C
from ledgerloom.plans import discovery as D
from ledgerloom.plans import publications as PB
from ledgerloom.streaming import journal as J


def optimized(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_pairs_meet_by_both_ids(spark, sf_dir):
    """A person's publications and candidates never meet by the person alone."""
    assert not re.search(r"Join Inner, \(lec_id#\w+ = lec_id#\w+\)", optimized(spark, sf_dir, "join_evidence_pairs"))


def test_roster_text_is_no_key(spark, sf_dir):
    """A file's text doesn't go with each of its lines."""
    assert not re.search(r"Aggregate \[[^\]]*value#", optimized(spark, sf_dir, "scan_json_roster"))


def test_matching_names(spark):
    names = ["Trần Văn Binh", "TS. Trần Văn Binh", "Binh Trần", "Lê Cuc", "Le Thi Cuc", "Cuc", "", None, "Nguyen Van"]
    people = spark.createDataFrame([(i, i % 2, names[i // 2 % len(names)]) for i in range(4 * len(names))], "lec_id int, k int, full_name string")
    authors = spark.createDataFrame([(i, i % 2, names[i // 3 % len(names)]) for i in range(4 * len(names))], "author_id int, k int, name string")
    got = D.matching(people, authors, ["k"])
    assert re.search(r"word#\d+ = word#\d+", got._jdf.queryExecution().optimizedPlan().toString())
    a = people.withColumn("a", D.surface(D.X.strip_title(F.col("full_name"))))
    want = a.join(authors.withColumn("b", D.surface(F.col("name"))), "k").where(D.corresponds(F.col("a"), F.col("b"))).select("lec_id", "author_id").collect()
    assert len(want) > 20 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def world(spark):
    names = ["Trần Văn Binh", "TS. Trần Văn Binh", "Binh Trần Văn", "Lê Cuc", "Cuc Lê", "Trần-Văn Binh", "A"]
    people = spark.createDataFrame([(i, names[i % len(names)]) for i in range(20)], "lec_id int, full_name string")
    forms = [(i, "PREFERRED_NAME", names[i % 4].replace(" ", ", ", 1)) for i in range(12)] + [(i, "VARIANT", names[i % 3]) for i in range(0, 12, 2)]
    return people, spark.createDataFrame(forms + forms[:2], "author_id int, kind string, surface string")


def plain(people, surfaces):
    """Evidence pair by pair, with the names of each person and author by themselves."""
    surfaces = surfaces.distinct()
    out = set()
    hits = C.people_keys(people).join(C.surface_keys(surfaces), ["rule", "value"]).collect()
    ordered = {(h.lec_id, h.author_id) for h in hits if h.rule < C.TOKEN_SET}
    best = {}
    for h in hits:
        if h.rule < C.TOKEN_SET or (h.lec_id, h.author_id) not in ordered:
            key = (h.lec_id, h.author_id, h.kind, h.value)
            best[key] = min(best.get(key, (99, "")), (h.rule, h.surface))
    for (lec, author, kind, value), (rule, surface) in best.items():
        out.add((lec, author, rule, kind, surface, value))
    return out


def test_evidence_of_equal_names(spark):
    people, surfaces = world(spark)
    found = C.generate(people, surfaces)
    # nothing is grouped once the pairs of all bearers are made
    top = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert "Join" in "".join(top[:3]) and "Aggregate" not in "".join(top[:3])
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(people, surfaces)


def test_gated_pairs_of_equal_names(spark):
    people, surfaces = world(spark)
    papers = spark.createDataFrame([(1, 2), (2, 0), (6, 1)], "author_id int, n int")
    got = [tuple(r) for r in C.gated_pairs(people, surfaces, papers).collect()]
    want = {tuple(r) for r in C.gate(C.generate(people, surfaces), papers).select("lec_id", "author_id").distinct().collect()}
    every = {(r.lec_id, r.author_id) for r in C.generate(people, surfaces).collect()}
    assert len(got) == len(set(got)) and set(got) == want < every


def test_rule_counts_of_equal_names(spark):
    people, surfaces = world(spark)
    hits = C.people_keys(people).join(C.surface_keys(surfaces), ["rule", "value"]).groupBy("rule").count()
    assert sorted(map(tuple, C.rule_counts(people, surfaces).collect())) == sorted(map(tuple, hits.collect()))


def test_known_plans_are_streams(spark):
    """No group of its own for each list; existing keys come first, those of nobody's list give nothing."""
    rows = spark.createDataFrame([(s, line, f"10.1/{line % 3}" if line % 2 else None, f"T {line % 4}") for s in range(50) for line in range(8)], "snapshot long, line long, doi string, title string")
    existing = spark.createDataFrame([(s, "doi:10.1/1") for s in range(0, 60, 2)] + [(3, None)], "snapshot long, key string")
    got = PB.plan_known(rows, existing)
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    plan = lambda s: PB.known_plan([(line, f"10.1/{line % 3}" if line % 2 else None, f"t {line % 4}") for line in range(8)], {"doi:10.1/1"} if s % 2 == 0 else set())
    assert sorted(map(tuple, got.collect())) == sorted((s, *p) for s in range(50) for p in plan(s))


def test_journal_of_a_table_keeps_no_state(spark, sf_dir, monkeypatch):
    """One batch is a sorted stream a candidate: no state store is opened."""
    monkeypatch.setattr(J, "cut", lambda df: df)
    commands = spark.createDataFrame([(c, 1, "PROPOSE", "STANDARD", "u", "p", None, None, None, None, "r", "s", False) for c in range(3)], J.COMMAND)
    assert "MapInArrow" in J.decide(commands)._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.outcome, r.stream_seq) for r in J.decide(commands).collect()] == [("RECORDED", 1)] * 3


def test_orcid_check_has_no_loop(spark):
    x = spark.createDataFrame([("0000-0002-1825-0097",), ("0000-0002-1694-233X",), ("0000-0002-1825-0098",), ("0000-0002-1825-009",), ("𝟘000-0002-1825-0097",), ("",), (None,)], "o string").select(X.orcid_check(F.col("o")).alias("ok"))
    assert "lambda" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert [r.ok for r in x.collect()] == [True, True, False, False, False, False, None]


def test_resolution_inputs_are_kept_in_columns(spark, sf_dir):
    """What an import's inputs are cut to is compressed by column, and they meet places and contradictions in one join."""
    plan = optimized(spark, sf_dir, "plan_resolutions")
    assert "kept-" in registry.QUERIES["plan_resolutions"](spark, sf_dir).inputFiles()[0] and "ExistingRDD" not in plan and "LogicalRDD" not in plan


def test_author_lists_are_read_once(spark, sf_dir):
    """Even and uneven lists are taken apart in one pass, and rows with an error are left out without a second one."""
    for name in ("parse_author_occurrences", "normalize_authors"):
        plan = optimized(spark, sf_dir, name)
        assert plan.count("Relation [") == 1 and "Join" not in plan


def test_claims_are_summed_up_before_they_meet(spark, sf_dir):
    """No claim's observations are gathered in one place, no row is expanded for distinct counts, and all read one result."""
    for name in ("bridge_evidence", "bridge_pairs", "bridge_findings"):
        assert not re.search(r"Expand|collect_list\(|event_id", optimized(spark, sf_dir, name)), name


def test_export_takes_current_resolutions_once(spark, sf_dir):
    """Units, positions and decisions of an export read what is kept, and entries come from one pass."""
    from ledgerloom.plans import q_exports as Q
    from ledgerloom.plans.standins import Relations

    _, _, units, decisions, _ = Q.export_world(Relations(spark, sf_dir))
    for df in (units, decisions):
        assert "row_number" not in df._jdf.queryExecution().optimizedPlan().toString()
    entries = Q.affiliation_rows(Relations(spark, sf_dir).res.select("res_id", "affiliation"))
    assert "Union" not in entries._jdf.queryExecution().optimizedPlan().toString()


def broadcast_keys(df):
    """The first key of each join that would send a side to the driver."""
    return re.findall(r"Broadcast\w*Join \[(?:\w+\()*(\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_claims_are_not_broadcast(spark, sf_dir, monkeypatch):
    """Spark takes exploded observations for few bytes; they and their captures are dealt out, however few it takes them for."""
    from ledgerloom.plans import claims as CL
    from ledgerloom.plans import q_reviews as Q
    from ledgerloom.plans.standins import Relations

    monkeypatch.setattr(CL, "cut", lambda df: df)
    observations, captures, lecturers, authors, decisions = Q.claim_world(Relations(spark, sf_dir))
    b = CL.bridge(observations, captures, lecturers, authors, refs=False)
    plan = CL.assess(CL.evidence(b), decisions, b)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"SortMergeJoin \[capture_id#\w+\], \[capture_id#\w+\], Inner", plan)) >= 2
    for key in (r"capture_id#\w+\], \[capture_id#\w+\], Inner", r"record_source_id#", r"record_email#", r"value_normalized#", r"lec_id#"):
        assert not re.search(r"Broadcast\w*Join \[" + key, plan), key


def test_export_broadcasts_authors_only(spark, sf_dir):
    """Kept resolutions compress well, so that their files look small; no table of positions or publications goes to the driver."""
    from ledgerloom.plans import exports as E
    from ledgerloom.plans import q_exports as Q
    from ledgerloom.plans.standins import Relations

    assert set(broadcast_keys(E.export_rows(*Q.export_world(Relations(spark, sf_dir))))) <= {"author_id"}


def test_all_names_are_compared(spark, sf_dir):
    """People and authors whose ids end differently correspond too; equal common surnames alone don't bring names together."""
    from ledgerloom.plans.standins import Relations

    r = Relations(spark, sf_dir)
    a = r.lec.withColumn("a", D.surface(X.strip_title(F.col("full_name"))))
    want = a.crossJoin(r.author.withColumn("b", D.surface(F.col("name")))).where(D.corresponds(F.col("a"), F.col("b"))).select("lec_id", "author_id").collect()
    got = [tuple(x) for x in registry.QUERIES["name_correspondence"](spark, sf_dir).collect()]
    assert any(lec % 10 != author % 10 for lec, author in got) and sorted(got) == sorted(map(tuple, want))
    people = spark.createDataFrame([(1, "Nguyễn Văn Khoa"), (2, "Nguyễn Thị Lan"), (3, "Lan Nguyễn")], "lec_id int, full_name string")
    authors = spark.createDataFrame([(7, "Nguyen, Van"), (8, "Thi Lan Nguyen"), (9, "Nguyen, Lan Khoa")], "author_id int, name string")
    assert sorted(map(tuple, D.matching(people, authors).collect())) == [(1, 9), (2, 8), (2, 9), (3, 8), (3, 9)]


def test_bearers_of_one_name_are_dealt_out(spark, sf_dir):
    """The pairs of all who bear a name aren't one task's work, and people aren't broadcast to the few rows of distinct names."""
    from ledgerloom.session import spread_join

    for name in ("generate_candidates", "name_correspondence"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin \[(?:lec_rep|full_name)#\w+, __part#\w+\]", plan), name
    many = spark.range(1000).selectExpr("id", "id % 2 AS k")
    few = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c")], "k long, v string")
    got = spread_join(many, few, ["k"], "id")
    assert got.columns == ["k", "id", "v"] and sorted(map(tuple, got.collect())) == sorted((0, i, v) for i in range(0, 1000, 2) for v in "ab")


def test_planned_inputs_are_dealt_out_once(spark, sf_dir):
    """First inputs and existing resolutions are met by one key, and what was shuffled for a kept table goes with it."""
    from ledgerloom.session import SHUFFLE_CLEANUP, kept

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["plan_resolutions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"SortMergeJoin \[spread#\w+, pa_id#\w+, source#\w+, payload_sha256#\w+\]", plan)) == 2
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    assert kept(spark.range(10).repartition(3)).count() == 10 and spark.conf.get(SHUFFLE_CLEANUP, None) == was
