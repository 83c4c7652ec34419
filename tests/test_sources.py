import csv
import hashlib
import io
import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.sources import csv_lossless, documents, http, sinks


def test_csv_rows_keep_everything():
    content = '﻿EID,Title\r\n1,"a, ""b""\r\nc"\r\n\r\n , \r\n2,x,y\r\n'.encode()
    rows = list(csv_lossless.parse(content))
    assert [(r[0], r[3], r[4]) for r in rows] == [(3, ["1", 'a, "b"\r\nc'], None), (6, ["2", "x", "y"], "COLUMN_COUNT_MISMATCH")]
    assert rows[0][1] == hashlib.sha256(json.dumps(["1", 'a, "b"\r\nc'], separators=(",", ":")).encode()).hexdigest()


@given(st.lists(st.lists(st.text(alphabet='ab,"\n é', max_size=6), min_size=2, max_size=2), min_size=1, max_size=8))
def test_csv_round_trip(table):
    out = io.StringIO()
    csv.writer(out).writerows([["EID", "x"], *table])
    got = [r[3] for r in csv_lossless.parse(out.getvalue().encode()) if r[3]]
    assert got == [r for r in table if any(v.strip() for v in r)]


def test_csv_problems():
    problem = lambda b: next(csv_lossless.parse(b))[4]
    assert problem(b"") == "EMPTY_IMPORT_FILE" and problem(b"EID\n\xff") == "INVALID_CSV" and problem(b'EID\n"x') == "INVALID_CSV" and problem(b"EID\n") == "INVALID_CSV"


def test_csv_that_breaks_late_gives_no_row():
    for content in (b'EID,Title\n1,a\n2,b\n"3,c', b"EID,Title\n1,a\n2,b\n3,\xff\n", b'EID,Title\n1,a\n2,"b"x\n', b"EID,T\n" + b"1,a\n" * 30_000 + b'"'):
        assert list(csv_lossless.parse(content)) == [(0, None, None, None, "INVALID_CSV")]


def test_csv_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"Eid,T\n 7 ,x\n7,y\n8,x\n 7 ,x\n")
    rows = csv_lossless.read(spark, f"{tmp_path}/a.csv")
    assert [r.duplicate for r in csv_lossless.duplicate_candidates(rows).orderBy("row_number").collect()] == [False, True, False, True]


def test_strict_json():
    error = lambda b: documents.artifact(b)[2]
    assert error(b'{"a":1,"a":2}') == "DUPLICATE_JSON_KEY" and error(b'{"capture":{},"content":{"x":NaN}}') == "FLOAT_NOT_ALLOWED"
    assert error(b"\xff") == "NOT_UTF8" and error(b"{") == "NOT_JSON" and error(b"{}") == "INCOMPLETE_ENVELOPE"
    text, digest, none = documents.artifact('{"capture":{},"content":{"b":"é","a":null}}'.encode())
    assert text == '{"a":null,"b":"é"}' and none is None and digest == hashlib.sha256(text.encode()).hexdigest()


def test_openalex_without_pairs(spark):
    work = {"authorships": [{"raw_author_name": None, "institutions": [{"id": "I1"}], "raw_affiliation_strings": ["A", " "]}, {"raw_author_name": "B"}]}
    df = spark.createDataFrame([("d", json.dumps(work))], "query_doi string, work string")
    rows = documents.openalex_authors(df).orderBy("position").collect()
    assert [(r.name, [(e.raw, list(e.orgs)) for e in (r.entries or [])]) for r in rows] == [("", [("A", []), (None, ["I1"])]), ("B", [])]


def test_roster(spark):
    file = {"dataset": {"schema_version": "2.0"}, "lecturers": [{"full_name": "A", "institutional_email": "a@b.vn", "academic_degree": "Dr"}, {"full_name": " ", "institutional_email": "A@B.vn"}, {"full_name": "C", "institutional_email": "bad"}]}
    df = spark.createDataFrame([("f", json.dumps(file))], "file string, value string")
    got = {r.line: set(r.errors) for r in documents.roster(df).collect()}
    assert got == {0: {"UNSUPPORTED_SCHEMA", "DEGREE_UNKNOWN", "DUPLICATE_EMAIL"}, 1: {"UNSUPPORTED_SCHEMA", "NO_NAME", "DUPLICATE_EMAIL"}, 2: {"UNSUPPORTED_SCHEMA", "EMAIL_INVALID"}}


def test_merge_guide(spark, tmp_path):
    path = tmp_path / "guide.json"
    path.write_text(json.dumps({"entries": [{"email": "A@b", "scopus_ids": ["12345678", "x"], "primary_scopus_id": "x"}, {"email": "a@b ", "scopus_ids": ["87654321"], "primary_scopus_id": "87654321"}, {"email": "c@d", "scopus_ids": []}]}))
    assert [tuple(r) for r in documents.merge_guide(spark, str(path)).collect()] == [("a@b", ["87654321"], "87654321")]


def test_retries():
    waits, calls = [], []

    def fetch(dois):
        calls.append(dois)
        return (503 if len(calls) < 3 else 200), {"d": {}}

    assert http.with_retries(fetch, ["d"], waits.append) == (200, {"d": {}}) and waits == [0.5, 1.0]
    assert http.with_retries(lambda d: (404, {}), ["d"], waits.append) == (404, {}) and len(waits) == 2
    assert http.with_retries(lambda d: (429, {}), ["d"], waits.append)[0] == 429 and len(waits) == 5


def test_csv_bytes(spark):
    df = spark.createDataFrame([(1, 'a,"b"', None)], "i int, t string, n string")
    assert sinks.csv_bytes(df) == b'\xef\xbb\xbfi,t,n\r\n1,"a,""b""",\r\n'


def test_write_json(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([(1, None)], "i int, t string"), f"{tmp_path}/o")
    assert spark.read.text(f"{tmp_path}/o").first().value == '{"i":1,"t":null}'


def test_value_of(spark):
    df = spark.createDataFrame([(["A", " eid "], ["x", "y"])], "headers array<string>, row array<string>")
    assert df.select(csv_lossless.value_of("EID".lower()).alias("v")).first().v == "y" and df.select(F.size("row")).first()[0] == 2


def test_roster_codes_of_long_numbers(spark, tmp_path):
    """People whose numbers begin alike and have six digits have staff codes of their own, and the SQL gives the same rows."""
    import duckdb

    from ledgerloom import registry

    keys = [1, 10000, 100000, 100001, 100060, 100700, 10001]
    spark.createDataFrame([(k, f"C{k}", 3, 1.0, "BUILDING") for k in keys], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.QUERIES["scan_json_roster"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLE_SQL["scan_json_roster"]).fetchall())
    assert len(got) == len(keys) and not any("STAFF_CODE" in r.errors for r in got)
