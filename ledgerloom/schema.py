"""Schemas of the canonical tables and event logs: fixed, never inferred. Ids are lower-case hyphenated strings, whose order as
text is part of results; instants are UTC; JSON documents are canonical text beside a digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "imports": "id string, sha256 string, file_name string, status string, created_at timestamp",
    "raw_records": "id string, import_id string, row_number int, row_hash string, eid_raw string, doi_raw string, payload map<string,string>, malformed struct<headers:array<string>,row:array<string>>, validation string, created_at timestamp",
    "publications": "id string, eid string, title string, source_title string, year int, volume string, issue string, article_number string, page_start string, page_end string, cited_by int, document_type string, publication_stage string, open_access string, doi string, version int, created_at timestamp",
    "authors": "id string, scopus_id string, preferred_name string",
    "name_variants": "id string, author_id string, variant_name string, variant_type string",
    "publication_authors": "id string, publication_id string, author_id string, author_order int",
    "lecturers": "id string, full_name string, email string, staff_code string, orcid string, degree string, academic_rank string, position string, faculty string, department string, date_of_birth date, is_active boolean",
    "candidates": "id string, lecturer_id string, author_id string, status string, version int",
    "observations": "id string, candidate_id string, run_id string, snapshot string, snapshot_sha256 string, created_at timestamp",
    "identities": "id string, lecturer_id string, author_id string, status string, confidence decimal(5,4)",
    "identity_evidence": "id string, identity_id string, evidence_type string, direction string, payload string",
    "resolutions": "id string, publication_author_id string, source string, link_status string, link_method string, unresolved_reason string, presence string, payload_sha256 string, created_at timestamp",
    "affiliations": "id string, resolution_id string, organization_id string, raw_index int, raw_text string",
    "organizations": "id string, source string, source_org_id string, name string, ror string, country_code string",
    "overrides": "id string, publication_author_id string, affiliation_text string, confidence string, state string, evidence_url string, created_at timestamp",
    "exclusion_events": "seq long, lecturer_id string, publication_id string, action string, created_at timestamp",
    "primary_events": "seq long, lecturer_id string, identity_id string, action string, created_at timestamp",
    "audit_events": "id string, action string, entity_type string, entity_id string, actor_id string, payload string, created_at timestamp",
}

# Closed vocabularies.
VOCABULARIES = {
    ("candidates", "status"): ("PENDING", "ACCEPTED", "REJECTED", "REVOKED"),
    ("identities", "status"): ("PENDING", "APPROVED", "REJECTED", "REVOKED"),
    ("resolutions", "link_status"): ("VERIFIED", "CORROBORATED", "UNRESOLVED"),
    ("exclusion_events", "action"): ("EXCLUDE", "INCLUDE"),
}
KEYS = {"publications": ["eid"], "publication_authors": ["publication_id", "author_order"], "authors": ["scopus_id"], "exclusion_events": ["seq"], "primary_events": ["seq"]}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(schema(table)).parquet(f"{folder}/{table}")


def append(df: DataFrame, folder: str, table: str) -> None:
    """Append rows in the table's schema; columns are matched by name and cast."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema(table)]).write.mode("append").parquet(f"{folder}/{table}")


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows (rule, value, n) of closed vocabularies and natural keys that are broken."""
    found = df.sparkSession.createDataFrame([], "rule string, value string, n long")
    for (t, column), words in VOCABULARIES.items():
        if t == table:
            bad = df.where(F.col(column).isNull() | ~F.col(column).isin(*words)).groupBy(F.col(column).alias("value"))
            found = found.union(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"domain:{column}"), "value", "n"))
    if keys := KEYS.get(table):
        twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.union(twice.select(F.lit("unique:" + ",".join(keys)), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), "n"))
    return found


def views(spark: SparkSession, folder: str) -> list[str]:
    """Temporary views of all tables in a folder, and of what event logs say now."""
    names = []
    for table in TABLES:
        try:
            read(spark, folder, table).createOrReplaceTempView(table)
        except Exception as problem:  # a folder needn't hold every table
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            continue
        names.append(table)
    for log, keys in (("exclusion_events", "lecturer_id, publication_id"), ("primary_events", "lecturer_id")):
        if log in names:
            spark.sql(f"CREATE OR REPLACE TEMP VIEW current_{log} AS SELECT {keys}, max_by(struct(*), seq) AS last FROM {log} GROUP BY {keys}")
            names.append(f"current_{log}")
    return names
