import pytest

from ledgerloom.plans import affiliations as AF
from ledgerloom.plans import candidates as C
from ledgerloom.plans import commands as CM
from ledgerloom.plans import publications as PB

SLOT = "paper int, author_order int, scopus_id string, full_name string"
EXT = "paper int, position int, name string, orcid string, entity_name string, entity_orcid string"


def aligned(spark, slots, ext, bridge=(), source="crossref"):
    out = AF.align(spark.createDataFrame([(1, *s) for s in slots], SLOT), spark.createDataFrame([(1, *e) for e in ext], EXT), spark.createDataFrame(list(bridge), "orcid string, scopus_id string"), source)
    return [(r.status, r.reason) for r in out.orderBy("author_order").collect()]


AB = [(1, "10", "An Binh"), (2, "20", "Cao Dung")]


@pytest.mark.parametrize(
    "ext,bridge,source,want",
    [
        ([], [], "crossref", [("UNRESOLVED", "NO_EXTERNAL_AUTHOR_LIST")] * 2),
        ([(1, "Binh An", None, None, None), (2, "Cao D", None, None, None)], [], "crossref", [("CORROBORATED", None), ("UNRESOLVED", "NAME_MISMATCH")]),
        ([(1, "An Binh", None, None, None)], [], "crossref", [("UNRESOLVED", "AUTHOR_COUNT_MISMATCH")] * 2),
        ([(1, "x", "o1", None, None), (2, "Cao Dung", None, None, None)], [("o1", "10")], "crossref", [("VERIFIED", None), ("CORROBORATED", None)]),
        ([(1, "x", "o1", None, None), (2, "Cao Dung", None, None, None)], [("o1", "10")], "openalex", [("UNRESOLVED", "NAME_MISMATCH"), ("CORROBORATED", None)]),
        ([(1, "x", "o1", None, None), (2, "y", "o1", None, None)], [("o1", "10")], "crossref", [("UNRESOLVED", "ID_CONFLICT"), ("UNRESOLVED", "NAME_MISMATCH")]),
        ([(1, "An Binh", "o1", None, None), (2, "Cao Dung", None, None, None)], [("o1", "10"), ("o1", "20")], "crossref", [("UNRESOLVED", "ID_AMBIGUOUS"), ("CORROBORATED", None)]),
        ([(1, "An Binh", None, None, None), (2, "Cao Dung", "o1", None, None)], [("o1", "10")], "crossref", [("VERIFIED", None), ("UNRESOLVED", "POSITION_CLAIMED_BY_OTHER_ID")]),
        ([(1, " ", None, None, None), (2, "Cao Dung", None, "Cao Dung Minh", None)], [], "openalex", [("UNRESOLVED", "NO_RAW_AUTHOR_NAME"), ("UNRESOLVED", "OPENALEX_ENTITY_NAME_CONFLICT")]),
        ([(1, "An Binh", None, "A Binh", None), (2, "Cao Dung", None, "Cao Dung", None)], [], "openalex", [("CORROBORATED", None)] * 2),
    ],
)
def test_align(spark, ext, bridge, source, want):
    assert aligned(spark, AB, ext, bridge, source) == want


def test_align_order(spark):
    slots = [*AB, (3, "30", "Em Giang")]
    ext = [(1, "An Binh", None, None, None), (2, "Em Giang", "o3", None, None), (3, "Cao Dung", None, None, None)]
    assert aligned(spark, slots, ext, [("o3", "30")]) == [("UNRESOLVED", "ORDER_INCONSISTENT_WITH_VERIFIED_ID"), ("UNRESOLVED", "POSITION_CLAIMED_BY_OTHER_ID"), ("VERIFIED", None)]


def decide(spark, res, over):
    positions = spark.createDataFrame([(1, 1)], "pub_id int, author_order int")
    r = spark.createDataFrame([(1, 1, *x) for x in res], "pub_id int, author_order int, source string, status string, reason string, presence string, affiliation string")
    o = spark.createDataFrame([(1, 1, i, *x) for i, x in enumerate(over)], "pub_id int, author_order int, over_id int, confidence string, affiliation string")
    d = AF.decide(positions, r, o).first()
    return d.status, d.units, d.gap_reason, d.admin_reviewed


@pytest.mark.parametrize(
    "res,over,want",
    [
        ([], [], ("NOT_RECONCILED", "", "NOT_RECONCILED", False)),
        ([("a", "VERIFIED", None, "PRESENT", "U")], [("UNRESOLVED", "x")], ("VERIFIED", "U", None, True)),
        ([("a", "VERIFIED", None, "PRESENT", "U")], [("CORROBORATED", "M")], ("VERIFIED", "M", None, True)),
        ([("b", "VERIFIED", None, "PRESENT", "V"), ("a", "CORROBORATED", None, "PRESENT", "C")], [], ("VERIFIED", "V | C", None, False)),
        ([("a", "VERIFIED", None, "ABSENT", "U"), ("b", "UNRESOLVED", "ID_CONFLICT", None, None)], [], ("VERIFIED", "", "SOURCE_HAS_NO_AFFILIATION", False)),
        ([("a", "UNRESOLVED", "NAME_MISMATCH", None, None), ("b", "UNRESOLVED", "ID_CONFLICT", None, None)], [], ("UNRESOLVED", "", "ID_CONFLICT", False)),
        ([("a", "UNRESOLVED", "NEW_CODE", None, None)], [], ("UNRESOLVED", "", "UNKNOWN", False)),
        ([], [("UNRESOLVED", "x")], ("NOT_RECONCILED", "", "ADMIN_MARKED_UNRESOLVED", True)),
    ],
)
def test_decide(spark, res, over, want):
    assert decide(spark, res, over) == want


def pairs(spark, people, surfaces):
    p = spark.createDataFrame(list(enumerate(people)), "lec_id int, full_name string")
    s = spark.createDataFrame([(i, "PREFERRED_NAME", x) for i, x in enumerate(surfaces)], "author_id int, kind string, surface string")
    return {(r.lec_id, r.author_id, C.RULES[r.rule][0]) for r in C.generate(p, s).collect()}


def test_candidate_rules(spark):
    got = pairs(spark, ["TS. Nguyễn Văn An", "Lê Bình"], ["Nguyễn Văn An", "nguyen van an", "Nguyen, Van An", "Nguyen, Van-An", "An Nguyen Van", "Lê Bình", "Le Binh", "Binh, Le", "Le"])
    assert {(a, r) for lec, a, r in got if lec == 0} == {(0, "RULE_TITLE_STRIPPED_N0"), (0, "RULE_TITLE_STRIPPED_N2"), (1, "RULE_TITLE_STRIPPED_N2"), (2, "RULE_TITLE_STRIPPED_N2_FORMAT")}
    assert {(a, r) for lec, a, r in got if lec == 1} == {(5, "RULE_EXACT_N0"), (5, "RULE_N2"), (6, "RULE_N2"), (7, "RULE_TOKEN_SET")}


def test_gate(spark):
    evidence = spark.createDataFrame([(1, 1, 7), (1, 2, 7), (1, 3, 0), (1, 3, 7)], "lec_id int, author_id int, rule int")
    papers = spark.createDataFrame([(2, 1), (1, 0)], "author_id int, n long")
    assert {r.author_id for r in C.gate(evidence, papers).collect()} == {2, 3}


def test_known_plan():
    rows = [(1, "d1", "t1"), (2, "d1", "t2"), (3, None, "t9"), (4, None, "t9"), (5, "d5", "t1"), (6, None, None), (7, "d7", "t9")]
    assert PB.known_plan(rows, {"t:t9"}) == [(1, "create"), (2, "collapse"), (3, "reuse_existing"), (4, "collapse"), (5, "collapse"), (6, "create"), (7, "collapse")]


def test_known_plan_frame(spark):
    rows = spark.createDataFrame([(1, 1, "10.1/A", "T"), (1, 2, "doi:10.1/a", "U"), (2, 1, None, " T  x"), (2, 2, None, "t X")], "snapshot long, line long, doi string, title string")
    existing = spark.createDataFrame([(2, "t:t x"), (3, "t:q")], "snapshot long, key string")
    got = {(r.snapshot, r.line): r.action for r in PB.plan_known(rows, existing).collect()}
    assert got == {(1, 1): "create", (1, 2): "collapse", (2, 1): "reuse_existing", (2, 2): "collapse"}


def test_author_occurrences(spark):
    rows = spark.createDataFrame([(1, "A; B ;C;D", "Aa (1);Bb (9);Cc;Dd (1)", "1;2;x;1"), (2, "A;B", "A", "1;2"), (3, "A; ;", "Aa;;", "1;")], "raw_id int, authors string, full_names string, ids string")
    got = [(r.raw_id, r.author_order, r.full_name, r.error) for r in PB.author_occurrences(rows).orderBy("raw_id", "author_order").collect()]
    assert got == [(1, 1, "Aa", None), (1, 2, "Bb", "AUTHOR_ID_MISMATCH"), (1, 3, "Cc", "NON_NUMERIC_SCOPUS_ID"), (1, 4, "Dd", "DUPLICATE_SCOPUS_ID_IN_PUBLICATION"), (2, None, None, "AUTHOR_LIST_LENGTH_MISMATCH"), (3, 1, "Aa", None)]


def test_review(spark):
    commands = spark.createDataFrame([(1, 1, "ACCEPT", 0, 5), (2, 1, "REJECT", 0, 5), (3, 2, "ACCEPT", 1, 6), (4, 3, "ACCEPT", 0, 7), (5, 4, "ACCEPT", 0, 8), (6, 5, "REJECT", 0, 9), (7, 9, "ACCEPT", 0, 1), (8, 6, "ACCEPT", 0, 0)], "seq int, cand_id int, action string, version int, obs_id int")
    candidates = spark.createDataFrame([(i, 10, i, "ACCEPTED" if i == 3 else "PENDING", 0) for i in range(1, 7)], "cand_id int, lec_id int, author_id int, status string, version int")
    latest = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (4, 8), (5, 9), (6, 9)], "cand_id int, obs_id int")
    owners = spark.createDataFrame([(4, 11), (5, 11)], "author_id int, owner int")
    checked = CM.review(commands, candidates, latest, owners)
    assert {r.seq: r.error for r in checked.collect()} == {1: None, 2: "STALE_IN_BATCH", 3: "STALE_VERSION", 4: "ALREADY_DECIDED", 5: "OWNED_BY_OTHER", 6: None, 7: "NOT_FOUND", 8: "STALE_OBSERVATION"}
    assert {(r.cand_id, r.status) for r in CM.events(checked).collect()} == {(1, "ACCEPTED"), (5, "REJECTED")}


def test_withhold(spark):
    rows = [(1, 1, "a", "VERIFIED", None), (1, 1, "b", "UNRESOLVED", "ID_CONFLICT"), (1, 2, "a", "VERIFIED", None)]
    got = {(r.author_order, r.source): (r.status, r.reason) for r in AF.withhold(spark.createDataFrame(rows, "pub_id int, author_order int, source string, status string, reason string")).collect()}
    assert got == {(1, "a"): ("UNRESOLVED", "WITHHELD_SOURCE_CONFLICT"), (1, "b"): ("UNRESOLVED", "ID_CONFLICT"), (2, "a"): ("VERIFIED", None)}
