from ledgerloom.plans import imports as IM

INPUT = "seq int, eid string, scopus_id string, author_order int, doi string, source string, payload_sha256 string, retrieved_at date, status string, method string, reason string, presence string, position int, orcid string, work_id string, source_doi string, entries array<struct<raw_index int, raw_text string, org string>>"
BRIDGE, PLACE = IM.METHODS["VERIFIED"], IM.METHODS["CORROBORATED"]


def one(seq, **other):
    from datetime import date

    row = {"eid": "e1", "scopus_id": "10", "author_order": 1, "doi": None, "source": "crossref", "payload_sha256": f"h{seq}", "retrieved_at": date(2026, 1, 1), "status": "CORROBORATED", "method": PLACE, "reason": None, "presence": "PRESENT", "position": 1, "orcid": None, "work_id": None, "source_doi": None, "entries": [(1, "Unit", None)]}
    return (seq, *(row | other).values())


def test_plan_resolutions(spark):
    verified = {"status": "VERIFIED", "method": BRIDGE, "orcid": "o"}
    unresolved = {"status": "UNRESOLVED", "method": None, "reason": "NAME_MISMATCH", "entries": []}
    second = {"scopus_id": "20", "author_order": 2}
    cases = [
        (one(1), "INSERTED"),
        (one(2, status=None), "INVALID_LINK_STATUS"),
        (one(3, **unresolved | {"entries": [(1, "Unit", None)]}), "UNRESOLVED_WITH_AFFILIATION"),
        (one(4, **unresolved | {"reason": ""}), "INVALID_UNRESOLVED"),
        (one(5, **unresolved), "INSERTED"),
        (one(6, **verified | {"method": PLACE}), "INVALID_LINK_METHOD"),
        (one(7, position=None), "INVALID_TRUSTED_LINK"),
        (one(8, retrieved_at=None), "INVALID_TRUSTED_LINK"),
        (one(9, **verified | {"orcid": ""}), "VERIFIED_WITHOUT_IDENTIFIER"),
        (one(10, eid="e9"), "AUTHOR_POSITION_NOT_FOUND"),
        (one(11, author_order=2), "AUTHOR_ORDER_MISMATCH"),
        (one(12, doi="10.1/Y"), "DOI_MISMATCH"),
        (one(13, doi=" 10.1/X\t"), "INSERTED"),
        (one(14, payload_sha256="h1"), "DUPLICATE_INPUT"),
        (one(15, payload_sha256="h1", presence="ABSENT"), "DUPLICATE_KEY_DIFFERENT_CONTENT"),
        (one(16, payload_sha256="old"), "REUSED"),
        (one(17, payload_sha256="older"), "EXISTING_DIFFERENT_CONTENT"),
        (one(18, payload_sha256="old"), "DUPLICATE_INPUT"),
        (one(19, **second, **unresolved | {"reason": "ID_CONFLICT"}), "INSERTED"),
        (one(20, **second, **verified | {"source": "openalex"}), "WITHHELD_SOURCE_CONFLICT"),
        (one(21, **second, method="wrong", source="openalex"), "WITHHELD_SOURCE_CONFLICT"),
        # a faulty input comes first, but doesn't count as the first of its key
        (one(22, payload_sha256="k", method=None), "INVALID_LINK_METHOD"),
        (one(23, payload_sha256="k"), "INSERTED"),
    ]
    inputs = spark.createDataFrame([c[0] for c in cases], INPUT)
    slots = spark.createDataFrame([("e1", "10", 1, 1, "10.1/x"), ("e1", "20", 2, 2, None)], "eid string, scopus_id string, pa_id int, slot_order int, pub_doi string")
    columns = [f for f in INPUT.split(", ") if f.split()[0] in IM.CONTENT and "raw_" not in f]
    content = ("CORROBORATED", PLACE, None, "PRESENT", 1, None, None, None)
    existing = spark.createDataFrame([(1, "crossref", "old", *content, [(1, "Unit", None)]), (1, "crossref", "older", *content, [(2, "Unit", None)])], "pa_id int, source string, payload_sha256 string, " + ", ".join(c for c in columns if not c.startswith("entries")) + ", entries array<struct<raw_index int, raw_text string, org string>>")
    got = {r.seq: r for r in IM.plan_resolutions(inputs, slots, existing).collect()}
    assert {k: r.outcome for k, r in got.items()} == {c[0][0]: c[1] for c in cases}
    assert got[20].status == "UNRESOLVED" and got[5].pa_id == 1 and got[10].pa_id is None
    assert IM.plan_resolutions(inputs.limit(0), slots, existing).count() == 0


def test_correction_plan(spark):
    good = ("2-s2.0-1 ", None, " Wrong", "Right ", "VALID", "APPLIED")
    cases = [
        ("Wrong", [good], "CORRECT"),
        ("Wrong", [], "NO_RAW_SOURCE"),
        ("Wrong", [good, good], "PROVENANCE_NOT_1TO1"),
        ("Right", [good], "ALREADY_CORRECT"),
        (None, [good], "NOT_WRONG_VALUE"),
        ("Wrong", [(*good[:5], "STAGED")], "IMPORT_NOT_APPLIED"),
        ("Wrong", [(*good[:4], "INVALID", "APPLIED")], "RAW_NOT_VALID"),
        ("Wrong", [("2-s2.0-2", *good[1:])], "EID_MISMATCH"),
        ("Wrong", [(good[0], "other", *good[2:])], "EID_MISMATCH"),
        ("Wrong", [(*good[:2], "Elsewhere", *good[3:])], "STORED_NOT_PROVIDER_VALUE"),
        ("Wrong", [(*good[:3], " ", *good[4:])], "SOURCE_TITLE_MISSING"),
        ("Wrong", [(*good[:3], "Wrong ", *good[4:])], "NO_CHANGE"),
    ]
    publications = [(i, "2-s2.0-1", title) for i, (title, _, _) in enumerate(cases)]
    raws = [(i, 100 * i + k, *raw) for i, (_, links, _) in enumerate(cases) for k, raw in enumerate(links)]
    # one record behind two publications, and a publication that nothing is behind and that isn't wrong
    publications += [(50, "2-s2.0-1", "Wrong"), (51, "2-s2.0-1", "Wrong"), (52, "2-s2.0-1", "Right")]
    raws += [(50, 9000, *good), (51, 9000, *good)]
    found = IM.correction_plan(
        spark.createDataFrame(publications, "pub_id int, eid string, source_title string"),
        spark.createDataFrame(raws, "pub_id int, raw_id int, raw_eid string, payload_eid string, raw_source string, raw_source_title string, validation string, import_status string"),
        "Wrong",
    )
    got = {r.pub_id: (r.outcome, r.new_title) for r in found.collect()}
    want = {i: (c[2], "Right" if c[2] == "CORRECT" else None) for i, c in enumerate(cases)}
    assert got == want | {50: ("PROVENANCE_NOT_1TO1", None), 51: ("PROVENANCE_NOT_1TO1", None)}
