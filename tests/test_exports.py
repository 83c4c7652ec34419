"""Exports are written, put together and read back."""

import csv
import glob
import io
import json

from pyspark.sql import functions as F

from ledgerloom.plans import exports as E
from ledgerloom.sources import sinks


def whole(path):
    return b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_write_csv(spark, tmp_path):
    rows = [(i, f'a "{i}", b' if i % 3 else "=1+2", None if i % 5 else "line\r\nbreak", i % 2 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, t string, u string, b boolean").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.write_csv(df, f"{tmp_path}/x", ["i"], ["i", "t", "u", "b"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    data = whole(f"{tmp_path}/x")
    assert len(glob.glob(f"{tmp_path}/x/part-*")) > 2 and data.startswith(b"\xef\xbb\xbfi,t,u,b\r\n") and data.count(b"\xef\xbb\xbf") == 1
    want = io.StringIO()
    writer = csv.writer(want, lineterminator="\r\n")
    writer.writerow(["i", "t", "u", "b"])
    writer.writerows([i, "'=1+2" if t.startswith("=") else t, u or "", str(b).lower()] for i, t, u, b in rows)
    assert data.decode("utf-8-sig") == want.getvalue()
    sinks.write_csv(df.limit(0), f"{tmp_path}/none", ["i"], ["i"])
    assert whole(f"{tmp_path}/none") == b"\xef\xbb\xbfi\r\n"


def test_write_json_document(spark, tmp_path):
    df = spark.createDataFrame([(3, None, ["x"]), (1, 'q"', []), (2, "é", ["a", "b"])], "i int, t string, l array<string>")
    sinks.write_json_document(df, f"{tmp_path}/j", ["i"], '{"dataset": {"n": 3}}', "records")
    got = json.loads(whole(f"{tmp_path}/j"))
    assert got["dataset"] == {"n": 3} and got["records"] == [None, {"i": 1, "t": 'q"', "l": []}, {"i": 2, "t": "é", "l": ["a", "b"]}, {"i": 3, "t": None, "l": ["x"]}]


def test_units_by_raw_index(spark):
    res = spark.createDataFrame([(1, "VERIFIED", "crossref", None, "10.1/x"), (2, "CORROBORATED", "openalex", "https://o/W1", None)], "res_id long, status string, source string, work_url string, doi string")
    aff = spark.createDataFrame([(1, 5, 0, "Faculty A, U", "U", "VN"), (1, 7, 0, "Faculty A, U", "V", None), (1, 6, 1, "Lab | B", None, None), (1, 9, None, None, "W", "FR"), (1, 8, None, None, "X", None), (2, 1, 0, "", "Y", "DE")], "res_id long, aff_id long, raw_index int, raw_text string, org_name string, country string")
    got = [(r.res_id, r.text, [tuple(o) for o in r.organizations], r.label, r.evidence_url) for r in E.build_units(res, aff).orderBy("res_id", "place").collect()]
    assert got == [
        (1, "Faculty A, U", [("U", "VN"), ("V", None)], "Faculty A, U", "https://doi.org/10.1/x"), (1, "Lab | B", [], "Lab | B", "https://doi.org/10.1/x"),
        (1, None, [("X", None)], "X", "https://doi.org/10.1/x"), (1, None, [("W", "FR")], "W", "https://doi.org/10.1/x"), (2, "", [("Y", "DE")], "Y", "https://o/W1"),
    ]


def world(spark):
    f = spark.createDataFrame
    pubs = f([(1, "e1", "d", "=T", 2020, "J"), (2, "e2", None, "U", None, None), (3, "e3", None, "V", 1999, "K")], "pub_id long, eid string, doi string, title string, year int, source_title string")
    pos = f([(1, 1, "s1", "An"), (1, 2, "s2", "Bo"), (3, 1, "s3", "Cy")], "pub_id long, author_order int, scopus_id string, author_name string")
    units = f([(1, 1, 1, 2, "B | C", "VERIFIED", "crossref", "u2"), (1, 1, 0, 5, "A", "VERIFIED", "openalex", None), (3, 1, 0, 0, "", "CORROBORATED", "x", "u")], "pub_id long, author_order int, rank int, place long, label string, confidence string, source string, evidence_url string")
    dec = f([(1, 1, "VERIFIED", None, False), (1, 2, "UNRESOLVED", "NAME_MISMATCH", True), (3, 1, "CORROBORATED", None, False)], "pub_id long, author_order int, affiliation_status string, gap_reason string, admin_reviewed boolean")
    lec = f([(1, 1, "Binh | X"), (1, 1, "An")], "pub_id long, author_order int, full_name string")
    return pubs, pos, units, dec, lec


def test_export_and_gaps(spark, tmp_path):
    pubs, pos, units, dec, lec = world(spark)
    sinks.write_csv(E.export_rows(pubs, pos, units, dec, lec), f"{tmp_path}/e", ["eid", "author_order"], E.CSV_COLUMNS)
    rows = list(csv.reader(io.StringIO(whole(f"{tmp_path}/e").decode("utf-8-sig"))))
    assert rows == [
        E.CSV_COLUMNS,
        ["e1", "d", "'=T", "2020", "J", "2", "1", "s1", "An", "A | B / C", "VERIFIED | VERIFIED", "openalex | crossref", " | u2", "VERIFIED", "", "An | Binh / X"],
        ["e1", "d", "'=T", "2020", "J", "2", "2", "s2", "Bo", "", "", "", "", "UNRESOLVED", "NAME_MISMATCH", ""],
        ["e2", "", "U", "", "", "0", *[""] * 10],
        ["e3", "", "V", "1999", "K", "1", "1", "s3", "Cy", "", "CORROBORATED", "x", "u", "CORROBORATED", "", ""],
    ]
    out = spark.createDataFrame([(1, 2, "openalex", "NAME_MISMATCH", "UNRESOLVED"), (1, 2, "crossref", None, "VERIFIED")], "pub_id long, author_order int, source string, reason string, status string")
    gaps = [tuple(r) for r in E.gap_rows(pubs, pos, dec, out, lec).select(*E.GAP_COLUMNS).collect()]
    assert gaps == [("e1", "d", "=T", 2020, 2, 2, "s2", "Bo", "UNRESOLVED", "NAME_MISMATCH", "crossref:VERIFIED | openalex:NAME_MISMATCH", "true", "")]


def test_roster(spark, tmp_path):
    f = spark.createDataFrame
    lec = f([(1, "An"), (2, "Bo"), (3, "Cy")], "lec_id long, full_name string")
    snaps = f([(1, 9, 5, "b", "late"), (1, 8, 5, "a", "early"), (1, 1, 1, None, "nameless"), (2, 2, 2, None, "x")], "lec_id long, snap_id long, created_at long, source_id string, provenance string")
    known = f([(1, 3, "T ", "t", None, 2001), (1, 2, "T", "t", None, 2001), (1, 4, "A", "a", "d", None)], "lec_id long, known_id long, title string, title_key string, doi string, year int")
    ids = f([(1, "7", False), (1, "5", True), (1, "7", False)], "lec_id long, scopus_id string, is_main boolean")
    sinks.write_json_document(E.roster_records(lec, snaps, known, ids), f"{tmp_path}/r", ["source_id"], '{"dataset":{}}', "lecturers")
    records = json.loads(whole(f"{tmp_path}/r"))["lecturers"][1:]
    assert records == [{"source_id": "a", "full_name": "An", "scopus_ids": ["5", "7"], "primary_scopus_id": "5", "provenance": "early", "known_publications": [{"title_raw": "A", "title_normalized": "a", "doi_raw": "d", "published_year": None}, {"title_raw": "T", "title_normalized": "t", "doi_raw": None, "published_year": 2001}]}]


def test_query(spark, sf_dir):
    """The registered export against lists and dictionaries over the same inputs."""
    from ledgerloom.plans.q_exports import export_world
    from ledgerloom.plans.standins import Relations
    from ledgerloom.registry import QUERIES

    pubs, pos, units, dec, lec = ([r.asDict() for r in f.collect()] for f in export_world(Relations(spark, sf_dir)))
    key = lambda r: (r["pub_id"], r["author_order"])
    of = lambda rows: {k: [r for r in rows if key(r) == k] for k in {key(r) for r in rows}}
    by_pub, u, d, names = {}, of(units), {key(r): r for r in dec}, of(lec)
    for p in pos:
        by_pub.setdefault(p["pub_id"], []).append(p)
    join = lambda xs: " | ".join((x or "").replace(" | ", " / ") for x in xs)
    want = []
    for p in pubs:
        head = [p[c] for c in ("eid", "doi", "title", "year", "source_title")] + [len(by_pub.get(p["pub_id"], []))]
        for q in by_pub.get(p["pub_id"], []):
            us = sorted(u.get(key(q), []), key=lambda x: (x["rank"], x["place"]))
            x = d.get(key(q), {})
            want.append(head + [q["author_order"], q["scopus_id"], q["author_name"], *[join(y[c] for y in us) for c in ("label", "confidence", "source", "evidence_url")], x.get("affiliation_status"), x.get("gap_reason"), join(sorted(r["full_name"] for r in names.get(key(q), [])))])
        if p["pub_id"] not in by_pub:
            want.append(head + [None] * 10)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for r in want:
        writer.writerow(["" if v is None else "'" + v if isinstance(v, str) and v[:1] in ("=", "+", "-", "@", "\t", "\r") and v else v for v in r])
    got = [r.line for r in QUERIES["export_csv_file"](spark, sf_dir).collect()]
    assert sorted(got) == sorted([",".join(E.CSV_COLUMNS), *out.getvalue().splitlines()])
