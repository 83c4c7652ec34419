"""The needs-review list against plain rules over small tables."""

import pytest

from ledgerloom.plans import needs_review as N


def items(spark, **how):
    f = spark.createDataFrame
    pos = f([(1, 1, 10, "2-s2.0-A", "Đánh giá hệ thống", None, "570", "Nguyễn, An"), (1, 2, 11, "2-s2.0-A", "Đánh giá hệ thống", None, "571", "Binh"), (2, 1, 10, "2-s2.0-B", "Other", "d", "570", "Nguyễn, An"), (3, 1, 12, "2-s2.0-C", None, None, "572", None), (4, 1, 13, "2-s2.0-D", "Never asked", None, "573", "Cy")], "pub_id long, author_order int, author_id long, eid string, title string, doi string, scopus_id string, name string")
    res = f([(1, 1, 1, "openalex", "VERIFIED", None), (2, 1, 1, "crossref", "UNRESOLVED", "NAME_MISMATCH"), (3, 1, 2, "crossref", "VERIFIED", None), (4, 2, 1, "crossref", "CORROBORATED", None), (5, 3, 1, "crossref", "UNRESOLVED", "NO_EXTERNAL_WORK"), (6, 3, 1, "openalex", "UNRESOLVED", "ID_CONFLICT")], "res_id long, pub_id long, author_order int, source string, status string, reason string")
    texts = f([(1, 2, "B"), (1, 1, "A"), (1, 3, "A"), (1, 4, ""), (5, 0, "Z")], "res_id long, ord int, raw_text string")
    over = f([(7, 2, 1, "REVOKED", "x"), (9, 2, 1, "ACTIVE", "y"), (8, 3, 1, "REVOKED", "z")], "over_id long, pub_id long, author_order int, state string, affiliation string")
    return {(r.pub_id, r.author_order): r for r in N.list_items(pos, res, texts, over, **how).collect()}


def test_kinds_summaries_and_overrides(spark):
    got = items(spark)
    assert {k: r.kind for k, r in got.items()} == {(1, 1): "CONFLICTING_SOURCES", (2, 1): "LOW_CONFIDENCE", (3, 1): "CONFLICTING_SOURCES"}
    assert [(s.source, s.status, s.reason, s.raw_affiliations) for s in got[1, 1].summaries] == [("crossref", "UNRESOLVED", "NAME_MISMATCH", []), ("openalex", "VERIFIED", None, ["A", "B"])]
    assert [(o.over_id, o.state) for o in got[2, 1].overrides] == [(9, "ACTIVE"), (7, "REVOKED")] and got[2, 1].has_override and not got[3, 1].has_override


@pytest.mark.parametrize(
    "how,want",
    [
        ({"query": "he thong nguyen"}, {(1, 1)}), ({"query": "2-S2.0-c"}, {(3, 1)}), ({"query": "570"}, {(1, 1), (2, 1)}), ({"query": " "}, {(1, 1), (2, 1), (3, 1)}), ({"query": "nothing"}, set()),
        ({"kind": "ADJUSTED"}, {(2, 1)}), ({"kind": "LOW_CONFIDENCE"}, {(2, 1)}), ({"kind": "UNRESOLVED"}, set()),
    ],
)
def test_search_and_kind(spark, how, want):
    assert set(items(spark, **how)) == want


def test_tied_authors(spark):
    assert set(items(spark, tied=spark.createDataFrame([(12,), (12,)], "author_id long"))) == {(3, 1)}
