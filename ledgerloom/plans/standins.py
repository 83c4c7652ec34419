"""Relations of the reconciliation domain, put together from the driver's tables.

Each is a projection (and at most one grouping) in expressions that Spark and DuckDB read alike, so that a query's SQL can start
from the same relations. Nulls and blanks are put in by fixed rules, as the driver's tables hold none.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession

#: A surname with its marks as letters of their own, as some sources write it.
DECOMPOSED = unicodedata.normalize("NFD", "Trần")

#: name: (table, expressions, grouping)
RELATIONS: dict[str, tuple[str, list[str], str]] = {
    "pub": ("orders", [
        "o_orderkey AS pub_id",
        "concat('2-s2.0-', lpad(cast(o_orderkey as string), 10, '0')) AS eid",
        "concat(CASE WHEN o_custkey % 2 = 0 THEN 'Nghiên cứu ' ELSE 'Đánh giá  ' END, o_orderpriority, ' số ', cast(o_orderkey % 900 as string)) AS title",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(year(o_orderdate) as int) END AS year",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '  ' ELSE o_orderstatus END AS doc_type",
        "CASE WHEN o_custkey % 9 = 0 THEN '' ELSE o_orderpriority END AS stage",
        "CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN 'Gold' ELSE 'Green' END AS access",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '  ' ELSE concat('10.1000/', cast(o_orderkey % 12000 as string)) END AS doi",
        "CASE WHEN o_custkey % 3 = 0 THEN 'Tạp chí Khoa học' WHEN o_custkey % 3 = 1 THEN 'Journal of Systems' ELSE NULL END AS source_title",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_custkey % 50 as int) END AS cited",
        "o_custkey AS import_id",
        "o_orderdate AS created_at",
    ], ""),
    "pa": ("lineitem", ["l_orderkey AS pub_id", "l_linenumber AS author_order", "min(l_suppkey) AS author_id"], "l_orderkey, l_linenumber"),
    "author": ("supplier", [
        "s_suppkey AS author_id",
        "cast(57000000000 + s_suppkey as string) AS scopus_id",
        f"concat(CASE s_suppkey % 4 WHEN 0 THEN 'Nguyễn' WHEN 1 THEN CASE WHEN s_suppkey % 8 = 1 THEN '{DECOMPOSED}' ELSE 'Trần' END WHEN 2 THEN 'Lê' ELSE CASE WHEN s_suppkey % 8 = 3 THEN 'Müller' ELSE 'Núñez' END END, CASE WHEN s_suppkey % 3 = 0 THEN ', Văn ' ELSE ' Thị-' END, chr(cast(65 + s_suppkey % 26 as int)), 'nh') AS name",
        "s_nationkey AS org_id",
    ], ""),
    "lec": ("customer", [
        "c_custkey AS lec_id",
        "concat(CASE c_custkey % 3 WHEN 0 THEN 'TS. ' WHEN 1 THEN 'PGS.TS.  ' ELSE '' END, CASE c_custkey % 4 WHEN 0 THEN 'Nguyễn' WHEN 1 THEN 'TRẦN' WHEN 2 THEN 'Lê' ELSE CASE WHEN c_custkey % 8 = 3 THEN 'Muller' WHEN c_custkey % 16 = 7 THEN 'Hoàng' ELSE 'Nuñez' END END, CASE WHEN c_custkey % 5 = 0 THEN ' Thị ' ELSE ' Văn ' END, chr(cast(65 + c_custkey % 26 as int)), 'nh') AS full_name",
        "c_mktsegment AS department",
        "concat('Khoa ', cast(c_nationkey as string)) AS faculty",
        "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('GV', lpad(cast(c_custkey as string), 5, '0')) END AS staff_code",
        "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE concat('U', cast(c_custkey % 700 as string), '@uni.edu.vn') END AS email",
        "CASE c_custkey % 4 WHEN 0 THEN 'TS' WHEN 1 THEN 'ThS' ELSE NULL END AS degree",
        "CASE c_custkey % 6 WHEN 0 THEN 'GS' WHEN 1 THEN 'PGS' ELSE NULL END AS acad_rank",
        "CASE c_custkey % 7 WHEN 0 THEN 'DEAN' WHEN 1 THEN 'HEAD' ELSE NULL END AS job",
        "c_custkey % 10 <> 0 AS active",
        "c_custkey % 3 = 1 AS has_account",
    ], ""),
    "ident": ("customer", [
        "c_custkey AS ident_id", "c_custkey % 400 AS lec_id", "(c_custkey * 7) % 100 + 1 AS author_id",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'APPROVED' WHEN 'MACHINERY' THEN 'APPROVED' WHEN 'AUTOMOBILE' THEN 'REVOKED' ELSE 'PENDING' END AS status",
    ], ""),
    "cand": ("customer", [
        "c_custkey AS cand_id", "c_custkey % 350 AS lec_id", "(c_custkey * 13) % 100 + 1 AS author_id",
        "CASE c_custkey % 5 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'REVOKED' ELSE 'PENDING' END AS status", "c_custkey % 3 AS version",
    ], ""),
    "obs": ("events", [
        "event_id AS obs_id", "user_id * 9 + event_id % 9 AS cand_id", "event_id % 40 AS run_id",
        "CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS run_status", "ts AS completed_at", "ts AS created_at",
    ], ""),
    "evid": ("events", [
        "event_id AS evid_id", "(event_id * 7) % 10000 AS obs_id",
        "CASE event_type WHEN 'view' THEN 'PUBLICATION' WHEN 'click' THEN 'NAME' WHEN 'error' THEN 'NAME' WHEN 'signup' THEN 'AFFILIATION' ELSE 'MANUAL' END AS kind",
    ], ""),
    "excl": ("events", ["event_id AS seq", "user_id * 2 % 400 AS lec_id", "(event_id * 37) % 1500 AS pub_id", "CASE WHEN event_id % 3 = 0 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS action", "ts AS created_at"], ""),
    "prim": ("events", ["event_id AS seq", "user_id AS lec_id", "(user_id + 400 * (event_id % 4)) AS ident_id", "CASE WHEN event_id % 5 = 0 THEN 'CLEAR' ELSE 'SET' END AS action"], ""),
    "audit": ("events", [
        "event_id AS audit_id", "event_type AS action", "CASE WHEN event_id % 2 = 0 THEN 'import' ELSE 'lecturer' END AS entity_type", "user_id AS entity_id",
        "CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id * 3) % 1700 END AS actor_id", "ts AS created_at", "props",
    ], ""),
    "res": ("lineitem", [
        "l_orderkey AS pub_id", "l_linenumber AS author_order", "CASE WHEN l_partkey % 2 = 0 THEN 'openalex' ELSE 'crossref' END AS source",
        "CASE l_returnflag WHEN 'A' THEN 'VERIFIED' WHEN 'N' THEN 'CORROBORATED' ELSE 'UNRESOLVED' END AS status",
        "CASE WHEN l_returnflag <> 'R' THEN NULL WHEN l_suppkey % 5 = 0 THEN 'NAME_MISMATCH' WHEN l_suppkey % 5 = 1 THEN 'NO_EXTERNAL_WORK' WHEN l_suppkey % 5 = 2 THEN 'ID_CONFLICT' WHEN l_suppkey % 5 = 3 THEN 'AUTHOR_COUNT_MISMATCH' ELSE 'SOMETHING_NEW' END AS reason",
        "CASE WHEN l_partkey % 4 = 1 THEN 'ABSENT' ELSE 'PRESENT' END AS presence",
        "l_shipdate AS created_at", "l_partkey * 100000 + l_suppkey AS res_id",
        "concat('Khoa ', cast(l_partkey % 7 as string), CASE WHEN l_partkey % 10 < 3 THEN ', VKTU University' ELSE ', Đại học' END) AS affiliation",
    ], ""),
    "over": ("part", [
        "p_partkey AS over_id", "p_partkey % 1000 AS pub_id", "cast(1 + p_partkey % 7 as int) AS author_order",
        "CASE WHEN p_size % 3 = 0 THEN 'UNRESOLVED' ELSE 'CORROBORATED' END AS confidence", "CASE WHEN p_size % 2 = 0 THEN 'ACTIVE' ELSE 'REVOKED' END AS state",
        "concat('Sửa ', p_brand) AS affiliation",
    ], ""),
    "org": ("nation", ["n_nationkey AS org_id", "n_name AS org_name", "n_regionkey AS region_id"], ""),
    "raw": ("orders", [
        "o_orderkey AS raw_id", "o_custkey % 60 AS import_id", "o_orderkey % 4000 AS pub_id", "cast(o_orderkey % 250 + 1 as int) AS row_number",
        "CASE WHEN o_orderkey % 29 = 0 THEN ' ' WHEN o_orderkey % 31 = 0 THEN '2-s2.0 9' ELSE concat(' 2-s2.0-', cast(o_orderkey % 4000 as string), ' ') END AS eid_raw",
        "concat('Title ', cast(o_custkey % 40 as string)) AS title_raw", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE cast(o_custkey % 30 as string) END AS cited_raw",
        "o_orderdate AS created_at", "CASE WHEN o_orderkey % 19 = 0 THEN 'INVALID' ELSE 'VALID' END AS validation",
    ], ""),
    "imp": ("customer", [
        "c_custkey AS import_id", "concat('f', cast(c_custkey % 120 as string)) AS sha", "c_custkey * 3 % 1501 AS moment",
        "CASE c_custkey % 4 WHEN 0 THEN 'APPLIED' WHEN 1 THEN 'STAGED' WHEN 2 THEN 'FAILED' ELSE 'PROCESSING' END AS status",
    ], ""),
    "doc": ("documents", ["doc_id", "text", "lang", "source", "n_chars"], ""),
}


class Relations:
    """The relations as DataFrames of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in RELATIONS:
            raise AttributeError(name)
        source, columns, grouping = RELATIONS[name]
        df = self.table(source)
        if grouping:
            keys = [c for c in columns if "(" not in c]
            return df.selectExpr(*keys, *{_argument(c) for c in columns if "(" in c}).groupBy(*[_alias(k) for k in keys]).agg(*[_aggregate(c) for c in columns if "(" in c])
        return df.selectExpr(*columns)



def _alias(column: str) -> str:
    return column.split(" AS ")[-1]


def _argument(column: str) -> str:
    return column[column.index("(") + 1 : column.index(")")]


def _aggregate(column: str):
    from pyspark.sql import functions as F

    return F.expr(column.split(" AS ")[0]).alias(_alias(column))


def prelude(*names: str) -> str:
    """The WITH clause of relations, for DuckDB."""
    parts = []
    for name in names:
        source, columns, grouping = RELATIONS[name]
        parts.append(f"{name} AS (SELECT {', '.join(columns)} FROM {source}{' GROUP BY ' + grouping if grouping else ''})")
    return "WITH " + ", ".join(parts)
