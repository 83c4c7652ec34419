from ledgerloom import schema
from ledgerloom.functions.register import register


def test_tables(spark, tmp_path):
    folder = str(tmp_path)
    events = spark.createDataFrame([("2", "a", "p", "EXCLUDE", None), ("1", "a", "p", "INCLUDE", None), ("3", "b", "p", "DROP", None)], "seq string, lecturer_id string, publication_id string, action string, created_at timestamp")
    schema.append(events, folder, "exclusion_events")
    back = schema.read(spark, folder, "exclusion_events")
    assert back.schema == schema.schema("exclusion_events") and back.count() == 3
    assert [(r.rule, r.value, r.n) for r in schema.violations(back, "exclusion_events").collect()] == [("domain:action", "DROP", 1)]
    schema.append(events.limit(1), folder, "exclusion_events")
    assert {r.rule for r in schema.violations(schema.read(spark, folder, "exclusion_events"), "exclusion_events").collect()} == {"domain:action", "unique:seq"}
    assert schema.views(spark, folder) == ["exclusion_events", "current_exclusion_events"]
    assert spark.sql("SELECT last.action FROM current_exclusion_events WHERE lecturer_id = 'a'").first()[0] == "EXCLUDE"


def test_every_schema_parses(spark):
    assert all(schema.schema(t).fields for t in schema.TABLES)
    assert all(t in schema.TABLES and c in schema.schema(t).names for t, c in schema.VOCABULARIES)
    assert all(set(k) <= set(schema.schema(t).names) for t, k in schema.KEYS.items())


def test_functions_in_sql(spark):
    assert "romanize" in register(spark)
    row = spark.sql("SELECT fold_exact('Đà Ç') AS a, romanize('Щука') AS b, names_compatible('Smith J', 'Smith John') AS c, nfkc_casefold(' Ａ ') AS d").first()
    assert tuple(row) == ("da c", "shchuka", True, "a")
    rows = spark.sql("SELECT * FROM parse_csv_lossless(CAST('EID,x\n1,2\n3\n' AS BINARY))").collect()
    assert [(r.row_number, r.row, r.error) for r in rows] == [(2, ["1", "2"], None), (3, ["3"], "COLUMN_COUNT_MISMATCH")]
    assert spark.sql("SELECT error FROM parse_claim_artifact(CAST('[1' AS BINARY))").first().error == "NOT_JSON"
