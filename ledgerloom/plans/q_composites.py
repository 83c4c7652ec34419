"""Queries: the composite algorithms over the stand-in relations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import aggregates as A
from ..operators.diff import names_of
from ..operators.latest import first_by, ranked
from ..session import kept, shared_dir
from ..sources.merge import KeyedTable
from . import affiliations as AF
from . import candidates as C
from . import claims as CL
from . import commands as CM
from . import discovery as D
from . import imports as IM
from . import publications as PB
from .base import fold_sql, query
from .q_groups import CURRENT_RES, current_resolutions, n_rows
from .q_lists import QUEUE, latest_observation, roster_resolved
from .q_scalars import CORRESPONDS, HYPHEN, N0, SURFACE, TITLE_SQL, clean, n2, review_kind

# ---------------------------------------------------------------- candidates
STRIPPED = f"regexp_replace(full_name, {TITLE_SQL}, '')"
HAS = f"regexp_matches(full_name, {TITLE_SQL})"


def token_set(c):
    h = HYPHEN.format(c)
    return f"CASE WHEN contains({h}, ' ') THEN array_to_string(list_sort(string_split({h}, ' ')), ' ') ELSE '' END"


def keys_sql(name, titled, comma):
    c = f"CASE WHEN contains({name}, ',') THEN " if comma else ""
    end = " END" if comma else ""
    t = (lambda e: f"CASE WHEN {HAS} THEN {e} END") if titled else (lambda e: "NULL")
    s = STRIPPED if titled else name
    plain = [(0, N0.format(name)), (4, n2(name)), (5, c + clean(n2(name), ",") + end), (6, HYPHEN.format(name)), (7, token_set(name))]
    other = [(1, t(N0.format(s))), (2, t(n2(s))), (3, t(clean(n2(s), ",")))] if titled else [(1, N0.format(name)), (2, n2(name)), (3, c + clean(n2(name), ",") + end)]
    return "[" + ", ".join(f"{{'rule': {i}, 'value': {e}}}" for i, e in sorted(plain + other)) + "]"


SURFACES = "surf AS (SELECT author_id, 'PREFERRED_NAME' AS kind, name AS surface FROM author UNION ALL SELECT author_id, 'VARIANT', replace(name, ', ', ' ') FROM author WHERE author_id % 2 = 0)"
CANDIDATES = f"""
 , {SURFACES},
 pk AS (SELECT lec_id, unnest({keys_sql('full_name', True, False)}, recursive := true) FROM lec),
 sk AS (SELECT author_id, kind, surface, unnest({keys_sql('surface', False, True)}, recursive := true) FROM surf),
 hits AS (SELECT * FROM pk JOIN sk USING (rule, value) WHERE value <> ''),
 kept AS (SELECT * FROM hits h WHERE rule < 7 OR NOT EXISTS (SELECT 1 FROM hits o WHERE o.rule < 7 AND o.lec_id = h.lec_id AND o.author_id = h.author_id)),
 evidence AS (SELECT lec_id, author_id, kind, value, min((rule, surface)) AS best FROM kept GROUP BY ALL)"""


def surfaces(r):
    a = r.author.select("author_id", F.lit("PREFERRED_NAME").alias("kind"), F.col("name").alias("surface"))
    return a.unionByName(r.author.where("author_id % 2 = 0").select("author_id", F.lit("VARIANT").alias("kind"), F.expr("replace(name, ', ', ' ')").alias("surface")))


@query("generate_candidates", "lec author", CANDIDATES + " SELECT lec_id, author_id, CAST(best[1] AS INTEGER) AS rule, kind, best[2] AS surface, value FROM evidence")
def generate_candidates(r):
    return C.generate(r.lec, surfaces(r))


@query("hash_join_rules", "lec author", CANDIDATES + " SELECT rule, count(*) AS n FROM hits GROUP BY rule")
def hash_join_rules(r):
    return C.rule_counts(r.lec, surfaces(r))


@query("evidence_gate", "lec author res pa", CANDIDATES + f"""
 , papers AS (SELECT author_id, count(DISTINCT (pub_id, author_order)) AS n FROM pa JOIN res USING (pub_id, author_order) WHERE author_id % 3 = 0 AND regexp_matches({fold_sql('affiliation')}, '\\bvktu\\b') GROUP BY 1),
 pairs AS (SELECT lec_id, author_id, min(best[1]) AS rule FROM evidence GROUP BY ALL)
 SELECT lec_id, author_id FROM pairs WHERE rule < 7 OR author_id IN (SELECT author_id FROM papers)""")
def evidence_gate(r):
    named = r.res.where(F.rlike(X.folded(F.col("affiliation")), F.lit(r"\bvktu\b"))).select("pub_id", "author_order").distinct()
    papers = r.pa.where("author_id % 3 = 0").join(named, ["pub_id", "author_order"]).groupBy("author_id").agg(n_rows())
    return C.gated_pairs(r.lec, surfaces(r), papers)


KNOWN = "known AS (SELECT o_custkey % 350 AS lec_id, o_orderkey AS known_id, concat('10.1000/', CAST(o_orderkey % 12000 AS VARCHAR)) AS doi FROM orders)"
ENRICHED = f"""
 , {KNOWN}, by_doi AS (SELECT lower(trim(doi)) AS doi, min(pub_id) AS pub_id FROM pub WHERE trim(doi) <> '' GROUP BY 1 HAVING count(*) = 1),
 rec AS (SELECT lec_id, known_id, pub_id FROM known JOIN by_doi USING (doi)), pairs AS (SELECT DISTINCT lec_id, author_id FROM cand)"""


def reconciled(r):
    """Known publications with the one publication of their DOI."""
    known = r.table("orders").selectExpr("o_custkey % 350 AS lec_id", "o_orderkey AS known_id", "concat('10.1000/', cast(o_orderkey % 12000 as string)) AS doi")
    by_doi = r.pub.select(X.doi_for_matching(F.col("doi")).alias("doi"), "pub_id").where("doi is not null").groupBy("doi").agg(F.min("pub_id").alias("pub_id"), n_rows("n")).where("n = 1")
    return known.join(by_doi.drop("n"), "doi").select("lec_id", "known_id", "pub_id")


@query("enrich_candidates", "pub pa cand", ENRICHED + " SELECT lec_id, author_id, pub_id, min(known_id) AS known_id FROM rec JOIN pa USING (pub_id) JOIN pairs USING (lec_id, author_id) GROUP BY ALL")
def enrich_candidates(r):
    x = reconciled(r).join(r.pa, "pub_id").join(r.cand.select("lec_id", "author_id").distinct(), ["lec_id", "author_id"])
    return x.groupBy("lec_id", "author_id", "pub_id").agg(F.min("known_id").alias("known_id"))


FORMS = "CASE WHEN author_id % 5 = 0 THEN concat('Hoàng Văn ', chr(cast(65 + author_id % 26 as int)), 'nh') ELSE upper(name) END"
DISCOVERED = ENRICHED + f"""
 , forms AS (SELECT author_id, name FROM author UNION ALL SELECT author_id, {FORMS} FROM author WHERE author_id % 10 < 6)
 , new AS (SELECT DISTINCT lec_id, author_id, pub_id FROM rec JOIN pa USING (pub_id) ANTI JOIN pairs USING (lec_id, author_id)),
 judged AS (SELECT new.*, coalesce({CORRESPONDS}, false) AS anchored FROM new LEFT JOIN (SELECT lec_id, {SURFACE.format(STRIPPED)} AS a FROM lec) USING (lec_id) LEFT JOIN (SELECT author_id, {SURFACE.format('name')} AS b FROM forms) USING (author_id))"""


@query("discover_candidates", "pub pa cand lec author", DISCOVERED + " SELECT lec_id, author_id, pub_id, CASE WHEN bool_or(anchored) THEN 'DISCOVERED' ELSE 'UNATTRIBUTED' END AS verdict FROM judged GROUP BY ALL")
def discover_candidates(r):
    """By every form of an author's name."""
    forms = r.author.select("author_id", "name").union(r.author.where("author_id % 10 < 6").selectExpr("author_id", FORMS))
    return D.discover(reconciled(r), r.pa, r.lec, forms, r.cand)


@query("prepare_observation", "cand evid", """
 , k AS (SELECT obs_id AS cand_id, string_agg(kind, ',' ORDER BY kind, evid_id) AS kinds FROM evid GROUP BY obs_id)
 SELECT cand_id, sha256(concat('{"author_id":', author_id, ',"cand_id":', cand_id, ',"lec_id":', lec_id, '}')) AS snapshot, sha256(coalesce(kinds, '')) AS fingerprint FROM cand LEFT JOIN k USING (cand_id)""")
def prepare_observation(r):
    kinds = r.evid.groupBy(F.col("obs_id").alias("cand_id")).agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"))
    snapshot = F.sha2(F.to_json(F.struct("author_id", "cand_id", "lec_id"), {"ignoreNullFields": "false"}), 256)
    return r.cand.join(kinds, "cand_id", "left").select("cand_id", snapshot.alias("snapshot"), F.sha2(F.coalesce("kinds", F.lit("")), 256).alias("fingerprint"))


@query("persist_generation", "cand ident", """
 SELECT c.lec_id, c.author_id, CASE WHEN i.lec_id IS NULL THEN 'INSERT' ELSE 'REUSE' END AS outcome FROM (SELECT DISTINCT lec_id, author_id FROM cand) c LEFT JOIN (SELECT DISTINCT lec_id, author_id FROM ident) i USING (lec_id, author_id)""")
def persist_generation(r):
    old = r.ident.select("lec_id", "author_id").distinct().withColumn("old", F.lit(True))
    x = r.cand.select("lec_id", "author_id").distinct().join(old, ["lec_id", "author_id"], "left")
    return x.select("lec_id", "author_id", F.when(F.col("old").isNull(), "INSERT").otherwise("REUSE").alias("outcome"))


@query("insert_ignore", "cand ident", " SELECT lec_id, author_id FROM cand ANTI JOIN ident USING (lec_id, author_id) GROUP BY ALL")
def insert_ignore(r):
    """Pairs merged into a table that has some: what it has stays as it is."""
    schema = T.StructType([T.StructField("lec_id", T.LongType()), T.StructField("author_id", T.LongType()), T.StructField("source", T.StringType())])
    table = KeyedTable(r.spark, f"{shared_dir(r.spark)}/pairs-{uuid.uuid4().hex}", schema, ["lec_id", "author_id"], 8)
    table.merge(r.ident.select("lec_id", "author_id", F.lit("ident").alias("source")))
    table.merge(r.cand.select("lec_id", "author_id", F.lit("cand").alias("source")))
    return table.read().where("source = 'cand'").select("lec_id", "author_id")


@query("savepoint_upsert", "pa author", " SELECT author_id, min(pub_id * 10 + author_order) AS first_seen FROM pa ANTI JOIN (SELECT author_id FROM author WHERE author_id % 2 = 0) USING (author_id) GROUP BY author_id")
def savepoint_upsert(r):
    """Authors put into a table that has the even ones, each with where it was seen first."""
    schema = T.StructType([T.StructField("author_id", T.LongType()), T.StructField("first_seen", T.LongType())])
    table = KeyedTable(r.spark, f"{shared_dir(r.spark)}/authors-{uuid.uuid4().hex}", schema, ["author_id"], 8)
    table.merge(r.author.where("author_id % 2 = 0").select("author_id", F.lit(None).cast("long").alias("first_seen")))
    table.merge(r.pa.select("author_id", (F.col("pub_id") * 10 + F.col("author_order")).alias("first_seen")), order=["first_seen"])
    return table.read().where("first_seen is not null")


# ---------------------------------------------------------------- publications and authors
@query("normalize_publications", "raw pub", """
 , k AS (SELECT *, validation = 'VALID' AND trim(eid_raw) <> '' AND NOT contains(trim(eid_raw), ' ') AS valid, trim(eid_raw) AS key FROM raw),
 w AS (SELECT *, row_number() OVER (PARTITION BY valid, key ORDER BY row_number, raw_id) AS rk FROM k),
 old AS (SELECT concat('2-s2.0-', CAST(pub_id AS VARCHAR)) AS eid, CASE WHEN pub_id % 2 = 0 THEN concat('TITLE ', CAST(import_id % 40 AS VARCHAR)) ELSE title END AS title FROM pub WHERE pub_id % 3 = 0)
 SELECT raw_id, CASE WHEN valid THEN key END AS eid, CASE WHEN NOT valid THEN 'INVALID_EID' WHEN rk > 1 THEN 'INTRA_DUPLICATE' WHEN old.eid IS NULL THEN 'NEW' WHEN lower(trim(title_raw)) = lower(trim(old.title)) THEN 'EXISTING_UNCHANGED' ELSE 'EXISTING_METADATA_CHANGED' END AS outcome
 FROM w LEFT JOIN old ON valid AND old.eid = w.key""")
def normalize_publications(r):
    old = r.pub.where("pub_id % 3 = 0").selectExpr("concat('2-s2.0-', cast(pub_id as string)) AS eid", "CASE WHEN pub_id % 2 = 0 THEN concat('TITLE ', cast(import_id % 40 as string)) ELSE title END AS title")
    return PB.normalize(r.raw, old).drop("changed")


METADATA = [
    ("title", "trim(title_raw)", "CASE WHEN raw_id % 4 = 0 THEN concat('Title ', cast(import_id % 7 as string)) ELSE title_raw END"),
    ("cited", "cited_raw", "CASE WHEN raw_id % 5 = 0 THEN '0' ELSE cited_raw END"),
    ("doi", "concat('10.1/', cast(raw_id as string))", "CASE WHEN raw_id % 6 = 0 THEN NULL ELSE concat('10.1/', cast(raw_id as string)) END"),
    ("source_title", "CASE WHEN raw_id % 7 = 0 THEN NULL ELSE 'Journal' END", "CASE WHEN raw_id % 14 = 0 THEN 'Journal' WHEN raw_id % 7 = 0 THEN NULL ELSE 'Journal' END"),
]


@query("normalize_metadata", "raw", f"""
 , k AS (SELECT *, validation = 'VALID' AND trim(eid_raw) <> '' AND NOT contains(trim(eid_raw), ' ') AS valid, trim(eid_raw) AS key FROM raw),
 w AS (SELECT *, row_number() OVER (PARTITION BY valid, key ORDER BY row_number, raw_id) AS rk FROM k),
 old AS (SELECT key, {', '.join(f'{o} AS {f}' for f, _, o in METADATA)} FROM w WHERE valid AND rk = 1 AND raw_id % 3 = 0),
 c AS (SELECT raw_id, w.valid, w.rk, w.key, old.key AS had, raw_id % 17 = 0 AND w.valid AS elsewhere, concat_ws(',', {', '.join(f"CASE WHEN old.{f} IS DISTINCT FROM {n} THEN '{f}' END" for f, n, _ in sorted(METADATA))}) AS diff FROM w LEFT JOIN old ON w.valid AND old.key = w.key)
 SELECT raw_id, CASE WHEN valid THEN key END AS eid, CASE WHEN NOT valid THEN 'INVALID_EID' WHEN elsewhere THEN 'NORMALIZATION_ERROR' WHEN rk > 1 THEN 'INTRA_DUPLICATE' WHEN had IS NULL THEN 'NEW' WHEN diff = '' THEN 'EXISTING_UNCHANGED' ELSE 'EXISTING_METADATA_CHANGED' END AS outcome,
  CASE WHEN valid AND NOT elsewhere AND rk = 1 AND had IS NOT NULL THEN diff ELSE '' END AS changed FROM c""")
def normalize_metadata(r):
    """All fields of a publication compared, and provenance that another publication has."""
    valid = r.raw.withColumn("key", X.normalize_eid(F.col("eid_raw"))).where("validation = 'VALID' and key is not null")
    old = first_by(valid, ["key"], [F.asc("row_number"), F.asc("raw_id")]).where("raw_id % 3 = 0").selectExpr("key AS eid", *[f"{o} AS {f}" for f, _, o in METADATA])
    links = r.raw.where("raw_id % 17 = 0").selectExpr("raw_id", "'other' AS eid")
    out = PB.normalize(r.raw, old, {f: F.expr(n) for f, n, _ in METADATA}, links)
    return out.withColumn("changed", F.coalesce(names_of(F.col("changed")), F.lit("")))


OCCURRENCES = """
 , r AS (SELECT l_orderkey AS raw_id, l_linenumber AS k, l_partkey AS p, l_suppkey AS s FROM lineitem),
 l AS (SELECT raw_id, list(struct_pack(name := concat('A', s), full_name := concat('Full ', s, CASE WHEN p % 9 = 0 THEN concat(' (', s + 1, ')') WHEN p % 2 = 0 THEN concat(' (', s, ')') ELSE '' END), id := CASE WHEN p % 31 = 0 THEN 'x1' ELSE CAST(s AS VARCHAR) END) ORDER BY k, p, s) AS a FROM r GROUP BY raw_id),
 e AS (SELECT raw_id, a, unnest(range(1, len(a) + 1)) AS i FROM l WHERE raw_id % 17 <> 0)
 SELECT raw_id, CAST(i AS INTEGER) AS author_order, a[i].id AS scopus_id, a[i].name AS name, trim(regexp_replace(a[i].full_name, '\\(\\d+\\)\\s*$', '')) AS full_name,
  CASE WHEN a[i].id = 'x1' THEN 'NON_NUMERIC_SCOPUS_ID' WHEN list_position(list_transform(a, lambda x: x.id), a[i].id) < i THEN 'DUPLICATE_SCOPUS_ID_IN_PUBLICATION'
   WHEN regexp_extract(a[i].full_name, '\\((\\d+)\\)\\s*$', 1) NOT IN ('', a[i].id) THEN 'AUTHOR_ID_MISMATCH' END AS error FROM e
 UNION ALL SELECT raw_id, NULL, NULL, NULL, NULL, 'AUTHOR_LIST_LENGTH_MISMATCH' FROM l WHERE raw_id % 17 = 0"""


def author_lists(r):
    parts = r.table("lineitem").groupBy(F.col("l_orderkey").alias("raw_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")))).alias("a"))
    text = lambda v: v.cast("string")
    full = lambda x: F.concat(F.lit("Full "), text(x["s"]), F.when(x["p"] % 9 == 0, F.concat(F.lit(" ("), text(x["s"] + 1), F.lit(")"))).when(x["p"] % 2 == 0, F.concat(F.lit(" ("), text(x["s"]), F.lit(")"))).otherwise(""))
    return parts.select(
        "raw_id", F.concat(F.array_join(F.transform("a", lambda x: F.concat(F.lit("A"), text(x["s"]))), "; "), F.when(F.col("raw_id") % 17 == 0, "; more").otherwise(" ; ")).alias("authors"),
        F.array_join(F.transform("a", full), ";").alias("full_names"), F.array_join(F.transform("a", lambda x: F.when(x["p"] % 31 == 0, "x1").otherwise(text(x["s"]))), " ;").alias("ids"),
    )


@query("parse_author_occurrences", "pub", OCCURRENCES)
def parse_author_occurrences(r):
    return PB.author_occurrences(author_lists(r))


@query("normalize_authors", "pub", " , o AS (" + OCCURRENCES.replace(", r AS", "WITH r AS", 1).strip() + ") SELECT scopus_id, min(raw_id) AS first_raw, count(DISTINCT full_name) AS n_variants FROM o ANTI JOIN (SELECT raw_id FROM o WHERE error IS NOT NULL) USING (raw_id) GROUP BY scopus_id")
def normalize_authors(r):
    """Authors of rows without any error: a row with one is left out whole."""
    o = PB.author_occurrences(author_lists(r)).groupBy("raw_id").agg(F.bool_or(F.col("error").isNotNull()).alias("bad"), F.collect_list(F.struct("scopus_id", "full_name")).alias("each"))
    good = o.where("not bad").select("raw_id", F.inline("each"))
    return good.groupBy("scopus_id").agg(F.min("raw_id").alias("first_raw"), F.countDistinct("full_name").alias("n_variants"))


@query("merge_drift", "raw", " SELECT pub_id, string_agg(DISTINCT title_raw, '|' ORDER BY title_raw) AS seen FROM raw GROUP BY pub_id HAVING count(DISTINCT title_raw) > 1")
def merge_drift(r):
    x = r.raw.groupBy("pub_id").agg(F.array_sort(F.collect_set("title_raw")).alias("s")).where(F.size("s") > 1)
    return x.select("pub_id", F.array_join("s", "|").alias("seen"))


@query("known_pub_plan")
def known_pub_plan(r):
    """Sequential per snapshot (tested against a plain loop)."""
    return PB.plan_known(*known_rows(r))


def known_rows(r):
    rows = r.pub.selectExpr("import_id AS snapshot", "pub_id AS line", "CASE WHEN pub_id % 4 = 0 THEN NULL ELSE concat('https://doi.org/10.1/', cast(pub_id % 6 as string)) END AS doi", "concat('Title  ', cast(pub_id % 9 as string)) AS title")
    existing = r.pub.where("pub_id % 10 = 0").selectExpr("import_id AS snapshot", "concat('doi:10.1/', cast(pub_id % 6 as string)) AS key")
    return rows, existing


@query("known_pub_preview")
def known_pub_preview(r):
    return PB.plan_known(*known_rows(r)).groupBy("action").agg(n_rows())


# ---------------------------------------------------------------- affiliations
REASONS_SQL = "[" + ", ".join(f"'{c}'" for c in AF.GAP_REASONS) + "]"
DECIDED = CURRENT_RES + f"""
 , rr AS (SELECT pub_id, author_order, max(CASE status WHEN 'VERIFIED' THEN 2 WHEN 'CORROBORATED' THEN 1 ELSE 0 END) AS best,
   string_agg(CASE WHEN status <> 'UNRESOLVED' AND presence <> 'ABSENT' THEN affiliation END, ' | ' ORDER BY CASE status WHEN 'VERIFIED' THEN -2 WHEN 'CORROBORATED' THEN -1 ELSE 0 END, source) AS units,
   min(coalesce(list_position({REASONS_SQL}, CASE WHEN status <> 'UNRESOLVED' THEN CASE WHEN presence = 'ABSENT' THEN 'SOURCE_HAS_NO_AFFILIATION' ELSE 'UNKNOWN' END ELSE reason END), 16)) AS why FROM cur GROUP BY ALL),
 oo AS (SELECT pub_id, author_order, string_agg(CASE WHEN confidence = 'CORROBORATED' THEN affiliation END, ' | ' ORDER BY over_id) AS manual, bool_or(confidence = 'UNRESOLVED') AS marked FROM over WHERE state = 'ACTIVE' GROUP BY ALL),
 decided AS (SELECT pub_id, author_order, CASE best WHEN 2 THEN 'VERIFIED' WHEN 1 THEN 'CORROBORATED' WHEN 0 THEN 'UNRESOLVED' ELSE 'NOT_RECONCILED' END AS status, coalesce(manual, units, '') AS units,
   CASE WHEN coalesce(manual, units) IS NULL THEN CASE WHEN marked THEN 'ADMIN_MARKED_UNRESOLVED' WHEN best IS NULL THEN 'NOT_RECONCILED' ELSE {REASONS_SQL}[why] END END AS gap_reason, marked IS NOT NULL AS admin_reviewed
   FROM (SELECT pub_id, author_order FROM pa UNION SELECT pub_id, author_order FROM over) p LEFT JOIN rr USING (pub_id, author_order) LEFT JOIN oo USING (pub_id, author_order))"""


def decided(r, current=None):
    positions = r.pa.select("pub_id", "author_order").union(r.over.select("pub_id", "author_order")).distinct()
    return AF.decide(positions, current_resolutions(r) if current is None else current, r.over.where("state = 'ACTIVE'"))


@query("decide_position", "pa res over", DECIDED + " SELECT * FROM decided")
def decide_position(r):
    return decided(r)


@query("load_positions", "pa res over author", DECIDED + " SELECT pub_id, author_order, scopus_id, status, units FROM decided JOIN pa USING (pub_id, author_order) LEFT JOIN author USING (author_id)")
def load_positions(r):
    return decided(r).join(r.pa, AF.POSITION).join(r.author, "author_id", "left").select("pub_id", "author_order", "scopus_id", "status", "units")


@query("agg_coverage", "pa res over", DECIDED + " SELECT count(*) AS n, count(*) FILTER (gap_reason IS NULL) AS covered FROM decided")
def agg_coverage(r):
    return decided(r).agg(n_rows(), F.count_if(F.col("gap_reason").isNull()).alias("covered"))


@query("pubs_with_gaps", "pa res over pub", DECIDED + " SELECT pub_id FROM pub SEMI JOIN (SELECT pub_id FROM decided WHERE gap_reason IS NOT NULL) USING (pub_id)")
def pubs_with_gaps(r):
    return r.pub.join(decided(r).where("gap_reason is not null"), "pub_id", "left_semi").select("pub_id")


@query("list_gaps", "pa res over", DECIDED + " SELECT pub_id, author_order, gap_reason FROM decided WHERE gap_reason IN ('NAME_MISMATCH', 'ID_CONFLICT')")
def list_gaps(r):
    return decided(r).where("gap_reason in ('NAME_MISMATCH', 'ID_CONFLICT')").select("pub_id", "author_order", "gap_reason")


@query("agg_gap_summary", "pa res over", DECIDED + " SELECT gap_reason, count(*) AS n, count(DISTINCT pub_id) AS n_pubs FROM decided WHERE gap_reason IS NOT NULL GROUP BY gap_reason")
def agg_gap_summary(r):
    return decided(r).where("gap_reason is not null").groupBy("gap_reason").agg(n_rows(), F.countDistinct("pub_id").alias("n_pubs"))


@query("sink_gaps_csv", "pa res over", CURRENT_RES + DECIDED.split("WHERE rk = 1)", 1)[1] + """
 SELECT d.pub_id, d.author_order, gap_reason, string_agg(concat(source, ':', coalesce(reason, CASE WHEN presence = 'ABSENT' THEN 'SOURCE_HAS_NO_AFFILIATION' ELSE '' END)), ' | ' ORDER BY source) AS by_source
 FROM decided d JOIN cur c ON c.pub_id = d.pub_id AND c.author_order = d.author_order WHERE gap_reason IS NOT NULL GROUP BY ALL""")
def sink_gaps_csv(r):
    pair = F.concat_ws(":", "source", F.coalesce("reason", F.when(F.col("presence") == "ABSENT", "SOURCE_HAS_NO_AFFILIATION").otherwise("")))
    per = current_resolutions(r).groupBy(*AF.POSITION).agg(F.array_join(F.array_sort(F.collect_list(pair)), " | ").alias("by_source"))
    return decided(r).where("gap_reason is not null").join(per, AF.POSITION).select("pub_id", "author_order", "gap_reason", "by_source")


@query("sink_export_csv", "pub pa res over", DECIDED + """
 SELECT eid, CASE WHEN regexp_matches(title, '^[=+\\-@\\t\\r]') THEN concat('''', title) ELSE title END AS title, author_order, coalesce(units, '') AS affiliation FROM pub LEFT JOIN (SELECT pub_id, author_order, units FROM decided SEMI JOIN pa USING (pub_id, author_order)) d USING (pub_id)""")
def sink_export_csv(r):
    d = decided(r).join(r.pa, AF.POSITION, "left_semi").select("pub_id", "author_order", "units")
    return r.pub.join(d, "pub_id", "left").select("eid", X.cell_guard(F.col("title")).alias("title"), "author_order", F.coalesce("units", F.lit("")).alias("affiliation"))


@query("csv_cell_guard", "doc", " SELECT doc_id, sha256(CASE WHEN regexp_matches(x, '^[=+\\-@\\t\\r]') THEN concat('''', x) ELSE x END) AS value FROM (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN 'x' ELSE chr(9) END, text) AS x FROM doc)")
def csv_cell_guard(r):
    x = F.concat(F.expr("CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN 'x' ELSE chr(9) END"), "text")
    return r.doc.select("doc_id", F.sha2(X.cell_guard(x), 256).alias("value"))


@query("sink_export_json", "pub pa author", """
 , w AS (SELECT pub_id, string_agg(concat('{"author_order":', author_order, ',"scopus_id":"', scopus_id, '"}'), ',' ORDER BY author_order) AS a FROM pa JOIN author USING (author_id) GROUP BY pub_id)
 SELECT pub_id, concat('{"eid":"', eid, '","authors":[', coalesce(a, ''), ']}') AS json FROM pub LEFT JOIN w USING (pub_id)""")
def sink_export_json(r):
    a = r.pa.join(r.author, "author_id").groupBy("pub_id").agg(F.array_sort(F.collect_list(F.struct("author_order", "scopus_id"))).alias("authors"))
    x = r.pub.join(a, "pub_id", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<struct<author_order:int,scopus_id:string>>")))
    return x.select("pub_id", F.to_json(F.struct("eid", "authors")).alias("json"))


@query("agg_affiliation_summary", "res", """
 SELECT pub_id, count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status = 'CORROBORATED') AS corroborated, count(*) FILTER (status = 'UNRESOLVED') AS unresolved, bool_and(status <> 'UNRESOLVED') AS all_linked, bool_and(status = 'VERIFIED') AS all_verified FROM res GROUP BY pub_id""")
def agg_affiliation_summary(r):
    of = lambda s: F.count_if(F.col("status") == s)
    return r.res.groupBy("pub_id").agg(of("VERIFIED").alias("verified"), of("CORROBORATED").alias("corroborated"), of("UNRESOLVED").alias("unresolved"), F.bool_and(F.col("status") != "UNRESOLVED").alias("all_linked"), F.bool_and(F.col("status") == "VERIFIED").alias("all_verified"))


@query("cross_source_policy", "res", """
 , bad AS (SELECT DISTINCT pub_id, author_order FROM res WHERE reason IN ('ID_CONFLICT', 'ID_AMBIGUOUS', 'POSITION_CLAIMED_BY_OTHER_ID'))
 SELECT pub_id, author_order, res_id, source, CASE WHEN bad.pub_id IS NOT NULL AND status <> 'UNRESOLVED' THEN 'UNRESOLVED' ELSE status END AS status, CASE WHEN bad.pub_id IS NOT NULL AND status <> 'UNRESOLVED' THEN 'WITHHELD_SOURCE_CONFLICT' ELSE reason END AS reason
 FROM res LEFT JOIN bad USING (pub_id, author_order)""")
def cross_source_policy(r):
    return AF.withhold(r.res).select("pub_id", "author_order", "res_id", "source", "status", "reason")


# What an import brings: two sources' resolutions, with faults of every kind; some come twice, some exist already.
INPUT = [
    "concat(lpad(cast(pub_id as string), 12, '0'), cast(author_order as string), lpad(cast(res_id as string), 15, '0'), cast(copy as string)) AS seq",
    "eid",
    "CASE WHEN res_id % 41 = 0 THEN 'none' ELSE scopus_id END AS scopus_id",
    "CASE WHEN res_id % 43 = 0 THEN author_order + 1 ELSE author_order END AS author_order",
    "CASE WHEN res_id % 37 = 0 THEN 'X' WHEN res_id % 2 = 0 THEN ' ' || upper(doi) END AS doi",
    "source",
    "concat(source, CASE WHEN res_id % 3 = 0 THEN '1' ELSE '2' END) AS payload_sha256",
    "CASE WHEN res_id % 53 = 0 THEN 'MAYBE' ELSE status END AS status",
    "CASE status WHEN 'VERIFIED' THEN 'ORCID_SCOPUS_ID_BRIDGE' WHEN 'CORROBORATED' THEN CASE WHEN res_id % 11 = 0 THEN 'X' ELSE 'POSITION_COUNT_NAME' END END AS method",
    "CASE WHEN res_id % 13 <> 0 THEN reason END AS reason",
    "presence",
    "CASE WHEN res_id % 17 <> 0 THEN author_order END AS position",
    "CASE WHEN res_id % 7 <> 0 THEN 'o' END AS orcid",
    "CASE WHEN status <> 'UNRESOLVED' OR res_id % 19 = 0 THEN CASE WHEN copy = 1 AND pub_id % 2 = 0 THEN concat(affiliation, '!') ELSE affiliation END END AS unit",
    "pub_id * 10 + author_order AS own",
    "pub_id",
    "copy",
]
SIG = "concat_ws('|', status, coalesce(method, '-'), coalesce(reason, '-'), presence, coalesce(CAST(position AS VARCHAR), '-'), coalesce(orcid, '-'), coalesce({}, '-'))"
PLAN = f"""
 , sl AS (SELECT pub_id, author_order, eid, scopus_id, doi FROM pa JOIN author USING (author_id) JOIN pub USING (pub_id)),
 base AS (SELECT res.*, eid, scopus_id, doi, copy FROM res JOIN sl USING (pub_id, author_order), (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR pub_id % 7 = 0),
 i AS (SELECT DISTINCT {', '.join(INPUT)} FROM base),
 bad AS (SELECT DISTINCT eid, scopus_id, author_order FROM i WHERE reason IN ('ID_CONFLICT', 'ID_AMBIGUOUS', 'POSITION_CLAIMED_BY_OTHER_ID')),
 h AS (SELECT i.*, bad.eid IS NOT NULL AND status IN ('VERIFIED', 'CORROBORATED') AS held FROM i LEFT JOIN bad USING (eid, scopus_id, author_order)),
 w AS (SELECT * REPLACE (CASE WHEN held THEN 'UNRESOLVED' ELSE status END AS status, CASE WHEN held THEN 'WITHHELD_SOURCE_CONFLICT' ELSE reason END AS reason,
   CASE WHEN NOT held THEN method END AS method, CASE WHEN NOT held THEN unit END AS unit) FROM h),
 p AS (SELECT eid, scopus_id, min(pub_id * 10 + author_order) AS pa_id, min(author_order) AS slot_order, min(doi) AS pub_doi FROM sl GROUP BY ALL),
 e AS (SELECT w.*, pa_id, {SIG.format('unit')} AS sig, CASE
   WHEN status NOT IN ('VERIFIED', 'CORROBORATED', 'UNRESOLVED') THEN 'INVALID_LINK_STATUS'
   WHEN status = 'UNRESOLVED' AND unit IS NOT NULL THEN 'UNRESOLVED_WITH_AFFILIATION'
   WHEN status = 'UNRESOLVED' AND (reason IS NULL OR method IS NOT NULL) THEN 'INVALID_UNRESOLVED'
   WHEN status <> 'UNRESOLVED' AND method IS DISTINCT FROM CASE status WHEN 'VERIFIED' THEN 'ORCID_SCOPUS_ID_BRIDGE' ELSE 'POSITION_COUNT_NAME' END THEN 'INVALID_LINK_METHOD'
   WHEN status <> 'UNRESOLVED' AND (reason IS NOT NULL OR position IS NULL) THEN 'INVALID_TRUSTED_LINK'
   WHEN status = 'VERIFIED' AND orcid IS NULL THEN 'VERIFIED_WITHOUT_IDENTIFIER'
   WHEN pa_id IS NULL THEN 'AUTHOR_POSITION_NOT_FOUND' WHEN slot_order <> author_order THEN 'AUTHOR_ORDER_MISMATCH'
   WHEN doi <> '' AND lower(trim(doi)) <> lower(trim(coalesce(pub_doi, ''))) THEN 'DOI_MISMATCH' END AS early FROM w LEFT JOIN p USING (eid, scopus_id)),
 k AS (SELECT *, first_value(seq) OVER win AS first_seq, first_value(sig) OVER win AS first_sig FROM e WHERE early IS NULL WINDOW win AS (PARTITION BY pa_id, source, payload_sha256 ORDER BY seq)),
 stored AS (SELECT own AS pa_id, source, payload_sha256, arg_min({SIG.format("CASE WHEN pub_id % 18 = 0 THEN unit || '?' ELSE unit END")}, seq) AS old FROM i WHERE copy = 0 AND pub_id % 9 = 0 GROUP BY 1, 2, 3)
 SELECT seq, early AS outcome, pa_id, status FROM e WHERE early IS NOT NULL
 UNION ALL SELECT seq, CASE WHEN seq <> first_seq AND sig = first_sig THEN 'DUPLICATE_INPUT' WHEN seq <> first_seq THEN 'DUPLICATE_KEY_DIFFERENT_CONTENT' WHEN old = sig THEN 'REUSED' WHEN old IS NOT NULL THEN 'EXISTING_DIFFERENT_CONTENT'
   WHEN held THEN 'WITHHELD_SOURCE_CONFLICT' ELSE 'INSERTED' END, pa_id, status FROM k LEFT JOIN stored USING (pa_id, source, payload_sha256)"""


@query("plan_resolutions", "res pa author pub", PLAN)
def plan_resolutions(r):
    places = r.pa.join(r.author, "author_id").join(r.pub, "pub_id").select(*AF.POSITION, "eid", "scopus_id", "doi")
    base = r.res.join(places, AF.POSITION).withColumn("copy", F.explode(F.expr("CASE WHEN pub_id % 7 = 0 THEN array(0, 1) ELSE array(0) END")))
    units = lambda c: F.expr(f"CASE WHEN {c} IS NULL THEN array() ELSE array(named_struct('raw_index', 1, 'raw_text', {c}, 'org', cast(null as string))) END")
    # the place, which `own` tells anyway, lets rows be made distinct where the join has left them
    x = kept(base.selectExpr(*INPUT, "author_order AS place").distinct().drop("place")).withColumns({"retrieved_at": F.current_date(), "work_id": F.lit(None).cast("string"), "source_doi": F.lit(None).cast("string")})
    old = x.where("copy = 0 and pub_id % 9 = 0").withColumn("entries", units("if(pub_id % 18 = 0, unit || '?', unit)"))
    old = old.groupBy(F.col("own").alias("pa_id"), "source", "payload_sha256").agg(F.min_by(F.struct(*IM.CONTENT), "seq").alias("c")).select("pa_id", "source", "payload_sha256", "c.*")
    slots = places.select("eid", "scopus_id", F.expr("pub_id * 10 + author_order").alias("pa_id"), F.col("author_order").alias("slot_order"), F.col("doi").alias("pub_doi"))
    return IM.plan_resolutions(x.withColumn("entries", units("unit")), slots, old)


@query("ensure_orgs", "author org", " SELECT DISTINCT org_id FROM author ANTI JOIN (SELECT org_id FROM org WHERE region_id <> 3) USING (org_id)")
def ensure_orgs(r):
    return r.author.select("org_id").distinct().join(r.org.where("region_id <> 3"), "org_id", "left_anti")


@query("build_units", "res", " SELECT pub_id, author_order, source, string_agg(DISTINCT affiliation, ' | ' ORDER BY affiliation) AS units FROM res WHERE status <> 'UNRESOLVED' GROUP BY ALL")
def build_units(r):
    x = r.res.where("status <> 'UNRESOLVED'").groupBy("pub_id", "author_order", "source").agg(F.array_sort(F.collect_set("affiliation")).alias("u"))
    return x.select("pub_id", "author_order", "source", F.array_join("u", " | ").alias("units"))


@query("affiliation_blocks", "res", " SELECT pub_id, string_agg(concat(author_order, ':', source, ':', status), ' ' ORDER BY author_order, CASE status WHEN 'VERIFIED' THEN 0 WHEN 'CORROBORATED' THEN 1 ELSE 2 END, source, res_id) AS blocks FROM res GROUP BY pub_id")
def affiliation_blocks(r):
    key = F.struct("author_order", (2 - AF.rank_of(F.col("status"))).alias("o"), "source", "res_id", "status")
    x = r.res.groupBy("pub_id").agg(F.array_sort(F.collect_list(key)).alias("b"))
    return x.select("pub_id", F.array_join(F.transform("b", lambda b: F.concat_ws(":", b["author_order"].cast("string"), b["source"], b["status"])), " ").alias("blocks"))


@query("publication_detail", "pub pa author res", """
 , a AS (SELECT pub_id, string_agg(scopus_id, ',' ORDER BY author_order) AS authors FROM pa JOIN author USING (author_id) GROUP BY 1), n AS (SELECT pub_id, count(*) AS n_res FROM res GROUP BY 1)
 SELECT pub_id, title, authors, coalesce(n_res, 0) AS n_res FROM pub LEFT JOIN a USING (pub_id) LEFT JOIN n USING (pub_id)""")
def publication_detail(r):
    a = r.pa.join(r.author, "author_id").groupBy("pub_id").agg(F.array_sort(F.collect_list(F.struct("author_order", "scopus_id"))).alias("a"))
    x = r.pub.join(a, "pub_id", "left").join(r.res.groupBy("pub_id").agg(n_rows("n_res")), "pub_id", "left")
    return x.select("pub_id", "title", F.array_join("a.scopus_id", ",").alias("authors"), F.coalesce("n_res", F.lit(0)).alias("n_res"))


@query("list_needs_review", "res", CURRENT_RES + """
 , g AS (SELECT pub_id, author_order, bool_or(status = 'VERIFIED') AS v, bool_or(status = 'UNRESOLVED') AS u, bool_and(status = 'UNRESOLVED') AS only_u, bool_and(status = 'VERIFIED') AS only_v, coalesce(bool_or(reason IN ('ID_CONFLICT', 'ID_AMBIGUOUS', 'POSITION_CLAIMED_BY_OTHER_ID')), false) AS c FROM cur GROUP BY ALL)
 SELECT pub_id, author_order, CASE WHEN (v AND u) OR c THEN 'CONFLICTING_SOURCES' WHEN only_u THEN 'UNRESOLVED' ELSE 'LOW_CONFIDENCE' END AS kind FROM g WHERE NOT only_v""")
def list_needs_review(r):
    cur = current_resolutions(r)
    open_ = cur.where("status <> 'VERIFIED'").select("pub_id", "author_order").distinct()
    return review_kind(cur).join(open_, AF.POSITION, "left_semi")


@query("build_resolution_inputs", "pub pa", """
 , s AS (SELECT unnest(['crossref', 'openalex']) AS source), d AS (SELECT lower(trim(doi)) AS doi, count(*) AS n FROM pub WHERE trim(doi) <> '' GROUP BY 1)
 SELECT pub_id, author_order, source, CASE WHEN d.doi IS NULL THEN 'NO_EXTERNAL_WORK' WHEN n > 1 THEN 'DUPLICATE_DOI_IN_SOURCE' ELSE 'TO_ALIGN' END AS state FROM pa JOIN pub USING (pub_id) LEFT JOIN d ON d.doi = lower(trim(pub.doi)), s""")
def build_resolution_inputs(r):
    d = A.duplicates(r.pub.select(X.doi_plain(F.col("doi")).alias("key")).where("key is not null"), ["key"])
    x = r.pa.join(r.pub.select("pub_id", X.doi_plain(F.col("doi")).alias("key")), "pub_id").join(d, "key", "left")
    state = F.when(F.col("key").isNull(), "NO_EXTERNAL_WORK").when(F.col("n") > 1, "DUPLICATE_DOI_IN_SOURCE").otherwise("TO_ALIGN")
    return x.select("pub_id", "author_order", F.explode(F.array(F.lit("crossref"), F.lit("openalex"))).alias("source"), state.alias("state"))


@query("align_paper")
def align_paper(r):
    """Slots of orders' line items against a list in which some names, places and ORCIDs differ (tested against listed cases)."""
    slots = r.pa.join(r.author, "author_id").select(F.col("pub_id").alias("paper"), "author_order", "scopus_id", F.col("name").alias("full_name"))
    keep = slots.where("paper % 11 <> 0 or author_order <> 3").where("paper % 13 <> 0")
    ext = keep.select("paper", F.col("author_order").alias("position"), F.when(F.col("paper") % 5 == 0, F.concat("full_name", F.lit("x"))).otherwise(F.col("full_name")).alias("name"), F.when(F.col("author_order") % 2 == 0, F.concat(F.lit("o"), "scopus_id")).alias("orcid"), F.lit(None).cast("string").alias("entity_name"), F.lit(None).cast("string").alias("entity_orcid"))
    bridge = r.author.select(F.concat(F.lit("o"), "scopus_id").alias("orcid"), "scopus_id")
    return AF.align(slots, ext, bridge, "crossref")


# ---------------------------------------------------------------- roster, claims, reviews
@query("lecturer_warnings", "lec", f"""
 , x AS (SELECT lec_id, lower(trim(email)) AS mail, trim(regexp_replace(lower(regexp_replace(regexp_replace(full_name, {TITLE_SQL}, ''), {TITLE_SQL}, '')), '\\s+', ' ', 'g')) AS core, lower(department) AS dep FROM lec),
 m AS (SELECT mail, count(*) AS nm FROM x WHERE mail IS NOT NULL GROUP BY 1), c AS (SELECT core, dep, count(*) AS nc FROM x GROUP BY ALL)
 SELECT lec_id, CASE WHEN nm > 1 THEN 'SHARED_EMAIL' ELSE 'SAME_NAME_NO_EMAIL' END AS warning FROM x LEFT JOIN m USING (mail) JOIN c USING (core, dep) WHERE nm > 1 OR (x.mail IS NULL AND nc > 1)""")
def lecturer_warnings(r):
    x = r.lec.select("lec_id", F.lower(F.trim("email")).alias("mail"), X.core_name(F.col("full_name")).alias("core"), F.lower("department").alias("dep"))
    m = x.where("mail is not null").groupBy("mail").agg(n_rows("nm"))
    c = x.groupBy("core", "dep").agg(n_rows("nc"))
    y = x.join(m, "mail", "left").join(c, ["core", "dep"]).where("nm > 1 or (mail is null and nc > 1)")
    return y.select("lec_id", F.when(F.col("nm") > 1, "SHARED_EMAIL").otherwise("SAME_NAME_NO_EMAIL").alias("warning"))


@query("roster_plan", "lec", """
 , entry AS (SELECT c_custkey AS line, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('GV', lpad(CAST(c_custkey * 2 % 1700 AS VARCHAR), 5, '0')) END AS staff_code, c_mktsegment AS department FROM customer),
 one AS (SELECT staff_code, min(lec_id) AS lec_id, min(department) AS had FROM lec WHERE staff_code IS NOT NULL GROUP BY 1)
 SELECT line, CASE WHEN staff_code IS NULL THEN 'CONFLICT' WHEN one.lec_id IS NULL THEN 'CREATE' WHEN had IS DISTINCT FROM department THEN 'UPDATE' ELSE 'UNCHANGED' END AS action FROM entry LEFT JOIN one USING (staff_code)""")
def roster_plan(r):
    entry = r.table("customer").selectExpr("c_custkey AS line", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('GV', lpad(cast(c_custkey * 2 % 1700 as string), 5, '0')) END AS staff_code", "c_mktsegment AS department")
    one = r.lec.where("staff_code is not null").groupBy("staff_code").agg(F.min("lec_id").alias("lec_id"), F.min("department").alias("had"))
    action = F.when(F.col("staff_code").isNull(), "CONFLICT").when(F.col("lec_id").isNull(), "CREATE").when(~F.col("had").eqNullSafe(F.col("department")), "UPDATE").otherwise("UNCHANGED")
    return entry.join(one, "staff_code", "left").select("line", action.alias("action"))


PRESENCE = """
 , caps AS (SELECT user_id % 5 AS scope, event_id AS cap, date_trunc('day', ts) AS instant, event_id % 3 <> 0 AS complete FROM events),
 seen AS (SELECT DISTINCT c.scope, c.cap, instant, complete, k AS claim, k % 7 = 0 AS weak FROM caps c, (SELECT unnest(range(40)) AS k) WHERE (c.cap * 31 + k * 17) % 9 < 4),
 last AS (SELECT scope, max(instant) AS latest FROM caps GROUP BY scope),
 fin AS (SELECT scope, count(*) AS n_latest, bool_and(complete) AS all_complete FROM caps JOIN last USING (scope) WHERE instant = latest GROUP BY scope),
 g AS (SELECT scope, claim, max(instant) AS last_seen, max_by(c, instant) AS seen_complete, bool_or(weak) AS weak FROM (SELECT scope, claim, instant, bool_or(complete) AS c, bool_or(weak) AS weak FROM seen GROUP BY ALL) GROUP BY ALL),
 h AS (SELECT scope, claim, count(DISTINCT cap) AS n_hit FROM seen JOIN last USING (scope) WHERE instant = latest GROUP BY ALL)
 SELECT scope, claim, CASE WHEN n_hit = n_latest THEN 'CURRENT' WHEN n_hit > 0 THEN 'NOT_OBSERVED' WHEN NOT weak AND last_seen < latest AND all_complete AND seen_complete THEN 'WITHDRAWN' ELSE 'NOT_OBSERVED' END AS presence
 FROM g JOIN last USING (scope) JOIN fin USING (scope) LEFT JOIN h USING (scope, claim)"""


def presence(captures, seen):
    """(scope, claim, presence) of captures (scope, cap, instant, complete) and what they list (scope, cap, claim, weak)."""
    x = seen.join(captures, ["scope", "cap"])
    per = x.groupBy("scope", "claim", "instant").agg(F.bool_or("complete").alias("seen_complete"), F.bool_or("weak").alias("weak"), F.countDistinct("cap").alias("hits"))
    g = per.groupBy("scope", "claim").agg(F.max_by(F.struct(F.col("instant").alias("last_seen"), "hits", "seen_complete"), "instant").alias("e"), F.bool_or("weak").alias("weak"))
    y = g.select("scope", "claim", "weak", "e.*").join(CL.scope_ends(captures, ["scope"], "instant", "cap"), "scope")
    return y.select("scope", "claim", CL.presence_of(F.col("last_seen"), F.col("hits"), F.col("seen_complete"), F.col("weak")).alias("presence"))


def captures(r):
    caps = r.table("events").selectExpr("user_id % 5 AS scope", "event_id AS cap", "date_trunc('day', ts) AS instant", "event_id % 3 <> 0 AS complete")
    seen = caps.select("scope", "cap", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("claim")).where("(cap * 31 + claim * 17) % 9 < 4").withColumn("weak", F.col("claim") % 7 == 0)
    return caps, seen


@query("bridge_claims", "doc", PRESENCE)
def bridge_claims(r):
    return presence(*captures(r))


@query("assess_pairs", "cand ident", """
 , o AS (SELECT author_id, count(DISTINCT lec_id) AS n_live FROM cand WHERE cand_id % 7 <> 0 GROUP BY 1), own AS (SELECT author_id, min(lec_id) AS a, max(lec_id) AS b FROM ident WHERE status = 'APPROVED' AND ident_id % 5 = 0 GROUP BY 1),
 p AS (SELECT lec_id, author_id, bool_or(cand_id % 7 <> 0) AS live, bool_or(status IN ('REJECTED', 'REVOKED')) AS negative FROM cand GROUP BY ALL),
 i AS (SELECT DISTINCT lec_id, author_id, true AS approved FROM ident WHERE status = 'APPROVED' AND ident_id % 5 = 0)
 SELECT lec_id, author_id, CASE WHEN approved THEN 'VERIFIED_ASSOCIATION' WHEN (a IS NOT NULL AND (a <> lec_id OR b <> lec_id)) OR coalesce(n_live, 0) > 12 THEN 'CONFLICTING_EVIDENCE' WHEN NOT live THEN 'INSUFFICIENT_EVIDENCE' ELSE 'PLAUSIBLE_CANDIDATE' END AS class,
  concat_ws(',', CASE WHEN negative THEN 'PRIOR_NEGATIVE_DECISION' END, CASE WHEN a IS NOT NULL AND (a <> lec_id OR b <> lec_id) THEN 'APPROVED_FOR_OTHER' END, CASE WHEN coalesce(n_live, 0) > 12 THEN 'DECLARED_FOR_SEVERAL' END, CASE WHEN NOT live THEN 'WITHDRAWN' END) AS reasons
 FROM p LEFT JOIN o USING (author_id) LEFT JOIN own USING (author_id) LEFT JOIN i USING (lec_id, author_id)""")
def assess_pairs(r):
    o = r.cand.where("cand_id % 7 <> 0").groupBy("author_id").agg(F.countDistinct("lec_id").alias("n_live"))
    ok = r.ident.where("status = 'APPROVED' and ident_id % 5 = 0")
    own = ok.groupBy("author_id").agg(F.min("lec_id").alias("a"), F.max("lec_id").alias("b"))
    p = r.cand.groupBy("lec_id", "author_id").agg(F.bool_or(F.expr("cand_id % 7 <> 0")).alias("live"), F.bool_or(F.expr("status in ('REJECTED', 'REVOKED')")).alias("negative"))
    x = p.join(o, "author_id", "left").join(own, "author_id", "left").join(ok.select("lec_id", "author_id", F.lit(True).alias("approved")).distinct(), ["lec_id", "author_id"], "left")
    other, several = F.expr("a is not null and (a <> lec_id or b <> lec_id)"), F.expr("coalesce(n_live, 0) > 12")
    kind = F.when(F.col("approved"), "VERIFIED_ASSOCIATION").when(other | several, "CONFLICTING_EVIDENCE").when(~F.col("live"), "INSUFFICIENT_EVIDENCE").otherwise("PLAUSIBLE_CANDIDATE")
    reasons = F.array_compact(F.array(F.when(F.col("negative"), "PRIOR_NEGATIVE_DECISION"), F.when(other, "APPROVED_FOR_OTHER"), F.when(several, "DECLARED_FOR_SEVERAL"), F.when(~F.col("live"), "WITHDRAWN")))
    return x.select("lec_id", "author_id", kind.alias("class"), F.array_join(reasons, ",").alias("reasons"))


@query("hybrid_policy", "evid", """
 , g AS (SELECT obs_id, bool_or(kind = 'AFFILIATION') AS conflict, bool_or(kind = 'MANUAL' AND evid_id % 3 = 0) AS invalid, bool_or(kind = 'PUBLICATION') AS qualifies, bool_or(evid_id % 4 <> 0) AS proven FROM evid GROUP BY obs_id)
 SELECT obs_id, CASE WHEN conflict THEN 'HARD_CONFLICT' WHEN invalid THEN 'INDEPENDENT_INVALID' WHEN NOT qualifies THEN 'INDEPENDENT_MISSING' END AS standard_denial,
  CASE WHEN conflict THEN 'HARD_CONFLICT' WHEN invalid THEN 'INDEPENDENT_INVALID' WHEN qualifies THEN 'STANDARD_AVAILABLE' WHEN NOT proven THEN 'PROVENANCE_UNVERIFIED' END AS exception_denial FROM g""")
def hybrid_policy(r):
    """The denial that governs each branch: a conflict before an invalid piece of evidence, that before the other branch being open."""
    any_ = lambda e: F.bool_or(F.expr(e))
    g = r.evid.groupBy("obs_id").agg(any_("kind = 'AFFILIATION'").alias("conflict"), any_("kind = 'MANUAL' and evid_id % 3 = 0").alias("invalid"), any_("kind = 'PUBLICATION'").alias("qualifies"), any_("evid_id % 4 <> 0").alias("proven"))
    common = F.when(F.col("conflict"), "HARD_CONFLICT").when(F.col("invalid"), "INDEPENDENT_INVALID")
    return g.select("obs_id", common.when(~F.col("qualifies"), "INDEPENDENT_MISSING").alias("standard_denial"), common.when(F.col("qualifies"), "STANDARD_AVAILABLE").when(~F.col("proven"), "PROVENANCE_UNVERIFIED").alias("exception_denial"))


REVIEW = QUEUE + """
 , cmd AS (SELECT event_id AS seq, user_id * 9 + event_id % 9 AS cand_id, CASE WHEN event_id % 3 = 0 THEN 'REJECT' ELSE 'ACCEPT' END AS action, event_id % 3 AS version, event_id AS asked FROM events),
 own AS (SELECT author_id, min(lec_id) AS a, max(lec_id) AS b FROM ident WHERE status = 'APPROVED' AND ident_id % 9 = 0 GROUP BY 1),
 x AS (SELECT cmd.*, cand.status, cand.version AS now_version, lec_id, a, b, obs_id AS now_obs, cand.cand_id AS found, row_number() OVER (PARTITION BY cmd.cand_id ORDER BY seq) AS k
   FROM cmd LEFT JOIN cand USING (cand_id) LEFT JOIN latest ON latest.cand_id = cmd.cand_id LEFT JOIN own USING (author_id)),
 checked AS (SELECT seq, cand_id, action, CASE WHEN found IS NULL THEN 'NOT_FOUND' WHEN k > 1 THEN 'STALE_IN_BATCH' WHEN status <> 'PENDING' THEN 'ALREADY_DECIDED' WHEN version <> now_version THEN 'STALE_VERSION'
   WHEN (CASE WHEN seq % 2 = 0 THEN now_obs ELSE asked END) IS DISTINCT FROM now_obs THEN 'STALE_OBSERVATION' WHEN action = 'ACCEPT' AND a IS NOT NULL AND (a <> lec_id OR b <> lec_id) THEN 'OWNED_BY_OTHER' END AS error FROM x)"""


def reviewed(r):
    latest = latest_observation(r).select("cand_id", "obs_id")
    cmd = r.table("events").selectExpr("event_id AS seq", "user_id * 9 + event_id % 9 AS cand_id", "CASE WHEN event_id % 3 = 0 THEN 'REJECT' ELSE 'ACCEPT' END AS action", "event_id % 3 AS version", "event_id AS asked")
    cmd = cmd.join(latest.withColumnRenamed("obs_id", "o"), "cand_id", "left").select("seq", "cand_id", "action", "version", F.when(F.col("seq") % 2 == 0, F.col("o")).otherwise(F.col("asked")).alias("obs_id"))
    return CM.review(cmd, r.cand, latest, r.ident.where("status = 'APPROVED' and ident_id % 9 = 0").select("author_id", F.col("lec_id").alias("owner")))


@query("review_commands", "cand lec author obs evid ident", REVIEW + " SELECT seq, cand_id, action, error FROM checked")
def review_commands(r):
    return reviewed(r)


@query("manual_assign", "cand lec author obs evid ident", REVIEW + " SELECT seq, cand_id, CASE action WHEN 'ACCEPT' THEN 'ACCEPTED' ELSE 'REJECTED' END AS status FROM checked WHERE error IS NULL")
def manual_assign(r):
    return CM.events(reviewed(r))


@query("journal_append", "audit", """
 , o AS (SELECT audit_id, entity_id, sha256(concat_ws('|', CAST(entity_id AS VARCHAR), CAST(audit_id AS VARCHAR), props)) AS own FROM audit)
 SELECT audit_id, own, lag(own) OVER (PARTITION BY entity_id ORDER BY audit_id) AS previous FROM o""")
def journal_append(r):
    return CM.chain(r.audit, "entity_id", "audit_id", "props").select("audit_id", "own", "previous")


@query("stage_claims", "cand evid", " SELECT cand_id, count(evid_id) AS n, count(evid_id) FILTER (kind <> 'NAME') > 0 AS stageable FROM cand LEFT JOIN evid ON evid.obs_id = cand_id GROUP BY cand_id")
def stage_claims(r):
    e = r.evid.groupBy(F.col("obs_id").alias("cand_id")).agg(n_rows("n"), F.count_if(F.col("kind") != "NAME").alias("m"))
    return r.cand.join(e, "cand_id", "left").select("cand_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("m", F.lit(0)) > 0).alias("stageable"))


@query("claim_read_preview", "obs", " , l AS (SELECT cand_id, max(obs_id) AS cur FROM obs WHERE run_status = 'COMPLETED' GROUP BY 1) SELECT obs_id, CASE WHEN cur IS NULL THEN 'HISTORICAL_ONLY' WHEN obs_id = cur THEN 'ACTIVE_PROJECTION' ELSE 'STALE' END AS state FROM obs LEFT JOIN l USING (cand_id)")
def claim_read_preview(r):
    last = r.obs.where("run_status = 'COMPLETED'").groupBy("cand_id").agg(F.max("obs_id").alias("cur"))
    state = F.when(F.col("cur").isNull(), "HISTORICAL_ONLY").when(F.col("obs_id") == F.col("cur"), "ACTIVE_PROJECTION").otherwise("STALE")
    return r.obs.join(last, "cand_id", "left").select("obs_id", state.alias("state"))


@query("rollback_import", "raw pub ident", """
 SELECT pub_id, CASE WHEN EXISTS (SELECT 1 FROM raw o WHERE o.pub_id = p.pub_id AND o.import_id <> 5) THEN 'KEEP' WHEN pub_id % 400 IN (SELECT lec_id FROM ident WHERE status = 'APPROVED') THEN 'BLOCKED' ELSE 'DELETE' END AS action FROM (SELECT DISTINCT pub_id FROM raw WHERE import_id = 5) p""")
def rollback_import(r):
    mine = r.raw.where("import_id = 5").select("pub_id").distinct()
    others = r.raw.where("import_id <> 5").select("pub_id").distinct().withColumn("other", F.lit(True))
    held = r.ident.where("status = 'APPROVED'").select("lec_id").distinct().withColumn("held", F.lit(True))
    x = mine.join(others, "pub_id", "left").withColumn("lec_id", F.col("pub_id") % 400).join(held, "lec_id", "left")
    return x.select("pub_id", F.when(F.col("other"), "KEEP").when(F.col("held"), "BLOCKED").otherwise("DELETE").alias("action"))


# Records behind publications: some stand behind several, some publications have several or none.
RECORD = [
    "raw_id",
    "to_pub AS pub_id",
    "CASE WHEN raw_id % 23 = 0 THEN eid_raw ELSE concat(' 2-s2.0-', lpad(cast(to_pub as string), 10, '0')) END AS raw_eid",
    "CASE WHEN raw_id % 11 = 0 THEN 'x' WHEN raw_id % 2 = 0 THEN concat('2-s2.0-', lpad(cast(to_pub as string), 10, '0')) END AS payload_eid",
    "CASE WHEN raw_id % 8 = 0 THEN 'Scopus' ELSE ' Journal of Systems' END AS raw_source",
    "CASE WHEN raw_id % 9 = 0 THEN NULL WHEN raw_id % 10 = 0 THEN 'Journal of Systems ' ELSE concat('Journal ', cast(raw_id % 4 as string)) END AS raw_source_title",
    "validation",
    "import_status",
]
TO_PUB = "CASE WHEN raw_id % 5 = 0 THEN pub_id ELSE raw_id END"


@query("correction_plan", "raw pub imp", f"""
 , l AS (SELECT raw.*, status AS import_status, unnest(CASE WHEN raw_id % 45 = 1 THEN [{TO_PUB}, raw_id + 1] ELSE [{TO_PUB}] END) AS to_pub FROM raw LEFT JOIN imp USING (import_id)),
 x AS (SELECT {', '.join(RECORD)} FROM l),
 y AS (SELECT pub.pub_id AS pid, eid, coalesce(source_title, '') AS cur, trim(coalesce(raw_source_title, '')) AS new, x.*, count(raw_id) OVER (PARTITION BY pub.pub_id) AS links FROM pub LEFT JOIN x ON x.pub_id = pub.pub_id),
 z AS (SELECT * FROM y LEFT JOIN (SELECT raw_id, count(*) AS raw_links FROM x GROUP BY 1) USING (raw_id)),
 o AS (SELECT DISTINCT pid AS pub_id, new, CASE WHEN links = 0 THEN 'NO_RAW_SOURCE' WHEN links > 1 THEN 'PROVENANCE_NOT_1TO1' WHEN cur <> 'Journal of Systems' THEN CASE WHEN new <> '' AND cur = new THEN 'ALREADY_CORRECT' ELSE 'NOT_WRONG_VALUE' END
   WHEN raw_links > 1 THEN 'PROVENANCE_NOT_1TO1' WHEN import_status IS DISTINCT FROM 'APPLIED' THEN 'IMPORT_NOT_APPLIED' WHEN validation <> 'VALID' THEN 'RAW_NOT_VALID' WHEN trim(raw_eid) <> eid OR trim(payload_eid) <> eid THEN 'EID_MISMATCH'
   WHEN trim(raw_source) <> cur THEN 'STORED_NOT_PROVIDER_VALUE' WHEN new = '' THEN 'SOURCE_TITLE_MISSING' WHEN new = cur THEN 'NO_CHANGE' ELSE 'CORRECT' END AS outcome FROM z WHERE links > 0 OR cur = 'Journal of Systems')
 SELECT DISTINCT pub_id, outcome, CASE WHEN outcome = 'CORRECT' THEN new END AS new_title FROM o""")
def correction_plan(r):
    links = r.raw.join(r.imp.select("import_id", F.col("status").alias("import_status")), "import_id", "left")
    links = links.withColumn("to_pub", F.explode(F.expr(f"CASE WHEN raw_id % 45 = 1 THEN array({TO_PUB}, raw_id + 1) ELSE array({TO_PUB}) END")))
    return IM.correction_plan(r.pub.select("pub_id", "eid", "source_title"), links.selectExpr(*RECORD), "Journal of Systems")
