"""Queries: exports that are written and read back, tables that are merged, and rosters."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import functions as F

from ..operators.diff import names_of
from ..session import dealt, kept, shared_dir
from ..sources import http, sinks
from ..sources.merge import KeyedTable
from . import affiliations as AF
from . import authors as AU
from . import exports as E
from . import generations as G
from . import needs_review as NR
from . import publications as PB
from . import roster as RO
from .base import fold_sql, query
from .q_composites import OCCURRENCES, author_lists, decided
from .q_groups import CURRENT_RES, current_resolutions
from .q_sources import HTTP, known_dois, replay


def scratch(r, kind):
    return f"{shared_dir(r.spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- units and exports
AFFILIATIONS = [
    ("res_id * 4 AS aff_id", "0 AS raw_index", "affiliation AS raw_text", "concat('Org ', cast(res_id % 9 as string)) AS org_name", "true"),
    ("res_id * 4 + 1 AS aff_id", "0 AS raw_index", "affiliation AS raw_text", "concat('Org ', cast(res_id % 11 as string)) AS org_name", "res_id % 3 = 0"),
    ("res_id * 4 + 2 AS aff_id", "NULL AS raw_index", "NULL AS raw_text", "concat('Lab | ', cast(res_id % 5 as string)) AS org_name", "res_id % 5 = 0"),
]


#: One for each position and source.
RES_ID = "pub_id * 100 + author_order * 10 + CASE WHEN source = 'openalex' THEN 1 ELSE 0 END"


def affiliation_rows(res):
    """The entries of each resolution, all from one pass over them."""
    entries = ", ".join(f"CASE WHEN {where} THEN named_struct('aff_id', {aff_id.split(' AS ')[0]}, 'raw_index', cast({index.split(' AS ')[0]} as int), 'raw_text', cast({text.split(' AS ')[0]} as string), 'org_name', {org.split(' AS ')[0]}) END" for aff_id, index, text, org, where in AFFILIATIONS)
    return res.select("res_id", F.expr(f"inline(array_compact(array({entries})))")).withColumn("country", F.expr("CASE WHEN res_id % 2 = 0 THEN 'VN' END"))


def units_of(r, current=None):
    """Units of current trusted resolutions, with their positions. current: the current resolutions, where they are at hand."""
    cur = (current_resolutions(r) if current is None else current).where("status <> 'UNRESOLVED' and presence <> 'ABSENT'").withColumn("res_id", F.expr(RES_ID))
    heads = cur.select("res_id", "status", "source", F.lit(None).cast("string").alias("work_url"), F.concat(F.lit("10.1/"), F.col("pub_id").cast("string")).alias("doi"))
    return cur, E.build_units(heads, affiliation_rows(cur.select("res_id", "affiliation").repartition("res_id")))


@query("unit_groups", "res", CURRENT_RES + f" , t AS (SELECT {RES_ID} AS res_id, affiliation, status, source, pub_id FROM cur WHERE status <> 'UNRESOLVED' AND presence <> 'ABSENT'), a AS (" + " UNION ALL ".join(f"SELECT res_id, {a}, {i}, {t}, {o}, CASE WHEN res_id % 2 = 0 THEN 'VN' END AS country FROM t WHERE {w}" for a, i, t, o, w in AFFILIATIONS) + """),
 g AS (SELECT res_id, min(aff_id) AS place, min_by(raw_text, aff_id) AS text, string_agg(concat(org_name, '/', coalesce(country, '')), ';' ORDER BY aff_id) AS orgs, min_by(org_name, aff_id) AS first_org FROM a GROUP BY res_id, coalesce(concat('s', raw_index), concat('o', aff_id)))
 SELECT g.res_id, place, text, orgs, coalesce(text, first_org) AS label, status AS confidence, source, concat('https://doi.org/10.1/', CAST(pub_id AS VARCHAR)) AS evidence_url FROM g JOIN t USING (res_id)""")
def unit_groups(r):
    """Units by raw index with their organisations; an organisation without a string is a unit of its own."""
    _, units = units_of(r)
    orgs = F.array_join(F.transform("organizations", lambda o: F.concat(o["name"], F.lit("/"), F.coalesce(o["country"], F.lit("")))), ";")
    return units.select("res_id", "place", "text", orgs.alias("orgs"), "label", "confidence", "source", "evidence_url")


def export_world(r):
    """(publications, positions, units, decisions, lecturers) of the stand-ins."""
    current = kept(current_resolutions(r).select(*AF.POSITION, "source", "status", "presence", "reason", "affiliation"))
    cur, units = units_of(r, current)
    placed = cur.select("res_id", *AF.POSITION, F.when(F.col("status") == "VERIFIED", 0).otherwise(1).alias("rank"))
    pubs = r.pub.select("pub_id", "eid", "doi", "title", "year", "source_title")
    positions = r.pa.join(r.author, "author_id").join(dealt(pubs.select("pub_id")), "pub_id", "left_semi").select(*AF.POSITION, "scopus_id", F.col("name").alias("author_name"))
    d = decided(r, current).select(*AF.POSITION, F.col("status").alias("affiliation_status"), "gap_reason", "admin_reviewed")
    links = r.ident.where("status = 'APPROVED'").select("author_id", "lec_id").distinct().join(dealt(r.lec.select("lec_id", "full_name")), "lec_id")
    lecturers = r.pa.join(links, "author_id").select(*AF.POSITION, "full_name")
    return pubs, positions, placed.join(dealt(units), "res_id").select(*AF.POSITION, "rank", "place", "label", "confidence", "source", "evidence_url"), d, lecturers


@query("export_csv_file")
def export_csv_file(r):
    """The affiliation export, written in ordered parts and read back line by line; a test compares it with lists."""
    path = scratch(r, "export")
    sinks.write_csv(E.export_rows(*export_world(r)), path, ["eid", "author_order"], E.CSV_COLUMNS)
    lines = r.spark.read.option("lineSep", "\r\n").text(path)
    return lines.select(F.regexp_replace("value", "^﻿", "").alias("line"))


# ---------------------------------------------------------------- merges
@query("merge_tables", "cand ident", """
 , a AS (SELECT lec_id, author_id, min(ident_id) AS id FROM ident GROUP BY ALL), b AS (SELECT lec_id, author_id, min(cand_id) AS id, max_by(version, -cand_id) AS version FROM cand GROUP BY ALL)
 SELECT lec_id, author_id, CASE WHEN a.id IS NULL OR b.version = 2 THEN b.id ELSE a.id END AS id, CASE WHEN a.id IS NULL THEN 'INSERTED' WHEN b.version = 2 THEN 'UPDATED' ELSE 'KEPT' END AS outcome FROM a FULL JOIN b USING (lec_id, author_id)""")
def merge_tables(r):
    """Identities, then candidates merged into them: a pair's first row stays, unless the candidate's version says that it is newer."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("lec_id", "author_id", "id", "version")])
    table = KeyedTable(r.spark, scratch(r, "merged"), schema, ["lec_id", "author_id"], 16)
    table.merge(r.ident.selectExpr("lec_id", "author_id", "ident_id AS id", "-1L AS version"), order=["id"])
    for _ in range(2):  # a batch that comes again changes nothing
        table.merge(r.cand.selectExpr("lec_id", "author_id", "cand_id AS id", "version"), order=["id"], when=(F.col("n.version") == 2) & (F.col("o.version") < 2))
    seeded = r.ident.select("lec_id", "author_id").distinct().withColumn("had", F.lit(True))
    x = table.read().join(seeded, ["lec_id", "author_id"], "left")
    outcome = F.when(F.col("had").isNull(), "INSERTED").when(F.col("version") == 2, "UPDATED").otherwise("KEPT")
    return x.select("lec_id", "author_id", "id", outcome.alias("outcome"))


@query("generation_runs", "cand evid", """
 , p AS (SELECT DISTINCT lec_id, author_id FROM cand), e AS (SELECT DISTINCT lec_id, author_id, kind FROM cand JOIN evid ON evid.obs_id = cand.cand_id)
 SELECT lec_id, author_id, count(kind) AS n_evidence, 'run-1' AS run_id, 'COMPLETED' AS status, true AS replayed FROM p LEFT JOIN e USING (lec_id, author_id) GROUP BY ALL""")
def generation_runs(r):
    """A generation of all candidate pairs, persisted, and replayed: the second time it is compared and not written."""
    store = G.GenerationStore(r.spark, scratch(r, "generation"), 16)
    pairs = r.cand.select("lec_id", "author_id").distinct()
    evidence = r.cand.join(r.evid.withColumnRenamed("obs_id", "cand_id"), "cand_id").selectExpr("lec_id", "author_id", "kind", "'R1' AS rule_id", "'1' AS rule_version", "kind AS payload").distinct()
    candidates = pairs.withColumn("snapshot", F.to_json(F.struct("author_id", "lec_id")))
    results = [store.persist("run-1", "rules", "v1", "{}", candidates, evidence) for _ in range(2)]
    out = store.of_run("run-1").select("lec_id", "author_id", F.size("evidence").cast("long").alias("n_evidence"), "run_id")
    return out.withColumn("status", F.lit(store.run("run-1")["status"])).withColumn("replayed", F.lit(results[1].idempotent_replay and not results[0].idempotent_replay))


# ---------------------------------------------------------------- rosters
def roster_world(r):
    """(records, lecturers, bindings): a file that repeats people, changes some fields, and gives some keys of others."""
    full = "full_name staff_code email degree acad_rank job faculty department orcid specialization gender birth phone url active".split()
    lec = r.lec.selectExpr(
        "lec_id", "full_name", "staff_code", "lower(email) AS email", "degree", "acad_rank", "job", "faculty", "department", "CASE WHEN lec_id % 6 = 0 THEN concat('o', cast(lec_id as string)) END AS orcid", "cast(NULL as string) AS specialization",
        "cast(NULL as string) AS gender", "cast(NULL as string) AS birth", "cast(NULL as string) AS phone", "CASE WHEN lec_id % 7 = 0 THEN concat('u', cast(lec_id as string)) END AS url", "cast(active as string) AS active",
    )
    bindings = lec.where("lec_id % 3 = 0").selectExpr("lec_id", "concat('q', cast(lec_id as string)) AS source_id")
    changes = {
        "department": "CASE WHEN lec_id % 4 = 1 THEN 'Moved' ELSE department END", "phone": "CASE WHEN lec_id % 10 = 1 THEN '0' END", "orcid": "CASE WHEN lec_id % 44 = 0 THEN 'o12' ELSE orcid END",
        "staff_code": "CASE WHEN lec_id % 15 = 2 THEN NULL WHEN lec_id % 15 = 4 THEN concat('NEW', cast(lec_id div 30 as string)) ELSE staff_code END", "email": "CASE WHEN lec_id % 15 IN (2, 4) THEN NULL ELSE email END",
    }
    source = "CASE WHEN lec_id % 3 = 0 THEN concat('q', cast(CASE WHEN lec_id % 33 = 0 THEN lec_id + 3 ELSE lec_id END as string)) END AS source_id"
    records = lec.where("lec_id % 5 <> 3").selectExpr("lec_id AS line", source, *[f"{changes.get(f, f)} AS {f}" for f in full])
    return records, lec, bindings


@query("roster_import_plan")
def roster_import_plan(r):
    """What an import does with each record of a file, keys claimed by earlier records included; a test holds it against a loop."""
    out = RO.plan(*roster_world(r))
    return out.select("line", "action", "lec_id", F.array_join("blocking", ",").alias("blocking"), F.coalesce(names_of(F.col("changed")), F.lit("")).alias("changed"), "warned")


@query("rollback_roster", "lec ident", """
 , s AS (SELECT event_id AS snap_id, user_id * 4 + event_id % 4 AS lec_id, event_id % 6 AS import_id, CASE WHEN event_type = 'view' THEN 'CRAW' ELSE 'A' END AS source_system, ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('name ', event_id) END AS name FROM events),
 made AS (SELECT lec_id, lec_id % 6 AS import_id FROM lec WHERE lec_id % 5 <> 0),
 t AS (SELECT lec_id FROM s WHERE import_id = 2 UNION SELECT lec_id FROM made WHERE import_id = 2),
 o AS (SELECT lec_id, name, row_number() OVER (PARTITION BY lec_id ORDER BY ts DESC, snap_id DESC) AS k FROM s WHERE import_id <> 2 AND source_system <> 'CRAW'),
 x AS (SELECT lec_id, CASE WHEN o.lec_id IS NOT NULL THEN CASE WHEN name IS NOT NULL THEN 'RESTORE' ELSE 'KEEP_OTHER_SOURCE' END WHEN lec_id IN (SELECT lec_id FROM made) THEN 'DELETE' ELSE 'KEEP_MANUAL' END AS action, name FROM t SEMI JOIN lec USING (lec_id) LEFT JOIN (SELECT * FROM o WHERE k = 1) o USING (lec_id))
 SELECT lec_id, action, CASE WHEN action = 'DELETE' THEN CASE WHEN lec_id % 9 = 1 THEN 'LINKED_ACCOUNT' WHEN lec_id IN (SELECT lec_id FROM ident WHERE status = 'APPROVED') THEN 'SCOPUS_IDENTITY' END END AS blocker, CASE WHEN action = 'RESTORE' THEN name END AS restored FROM x""")
def rollback_roster(r):
    s = r.table("events").selectExpr("event_id AS snap_id", "user_id * 4 + event_id % 4 AS lec_id", "event_id % 6 AS import_id", "CASE WHEN event_type = 'view' THEN 'CRAW' ELSE 'A' END AS source_system", "ts AS created_at", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE named_struct('full_name', concat('name ', cast(event_id as string))) END AS canonical")
    made = r.lec.where("lec_id % 5 <> 0").selectExpr("lec_id", "lec_id % 6 AS import_id")
    users = r.lec.selectExpr("lec_id", "CASE WHEN lec_id % 9 = 1 THEN 'ADMIN' ELSE 'LECTURER' END AS role")
    return RO.rollback(2, s, made, r.lec, users, r.ident.where("status = 'APPROVED'")).withColumn("restored", F.col("restored.full_name"))


# ---------------------------------------------------------------- lookups
@query("http_resume", "pub", HTTP)
def http_resume(r):
    """Lookups that are stopped after a round and gone on with: the second run asks the rest."""
    store = KeyedTable(r.spark, scratch(r, "answers"), http.ANSWER, ["key"], 8)
    keys = known_dois(r).select(F.col("doi").alias("key"))
    rounds = iter((True, False))
    how = {"lanes": 4, "rate": 1e9, "round_keys": 5000}
    with contextlib.suppress(http.Cancelled):
        http.fetch_all(keys, replay, store, should_continue=lambda: next(rounds), **how)
    http.fetch_all(keys, replay, store, **(how | {"round_keys": 1_000_000}))
    return store.read().select(F.col("key").alias("query_doi"), "http", F.col("record").isNotNull().alias("found"))


# ---------------------------------------------------------------- positions to review
REVIEWED = CURRENT_RES + f""" , c AS (SELECT *, {RES_ID} AS rid FROM cur),
 s AS (SELECT pub_id, author_order, string_agg(concat_ws('/', source, status, coalesce(reason, ''), affiliation), ';' ORDER BY source) AS summaries, bool_or(status = 'VERIFIED') AS v, bool_or(status = 'UNRESOLVED') AS u, bool_and(status = 'UNRESOLVED') AS only_u, bool_and(status = 'VERIFIED') AS fine,
   coalesce(bool_or(reason IN ('ID_CONFLICT', 'ID_AMBIGUOUS', 'POSITION_CLAIMED_BY_OTHER_ID')), false) AS bad FROM c GROUP BY ALL),
 o AS (SELECT pub_id, author_order, bool_or(state = 'ACTIVE') AS has_override, string_agg(concat(over_id, '/', state), ';' ORDER BY over_id DESC) AS overrides FROM over GROUP BY ALL),
 tied AS (SELECT author_id FROM cand WHERE status IN ('PENDING', 'ACCEPTED') UNION SELECT author_id FROM ident WHERE status = 'APPROVED' AND ident_id % 7 = 0),
 i AS (SELECT pub_id, author_order, eid, scopus_id, CASE WHEN (v AND u) OR bad THEN 'CONFLICTING_SOURCES' WHEN only_u THEN 'UNRESOLVED' ELSE 'LOW_CONFIDENCE' END AS kind, summaries, coalesce(has_override, false) AS has_override, overrides,
   concat_ws(' ', {fold_sql('name')}, scopus_id, eid, {fold_sql('title')}) AS target
  FROM pa SEMI JOIN tied USING (author_id) JOIN pub USING (pub_id) JOIN author USING (author_id) JOIN s USING (pub_id, author_order) LEFT JOIN o USING (pub_id, author_order) WHERE NOT fine)"""


def review_items(r, **how):
    cur = current_resolutions(r).withColumn("res_id", F.expr(RES_ID))
    texts = cur.select("res_id", F.lit(0).alias("ord"), F.col("affiliation").alias("raw_text"))
    positions = r.pa.join(r.pub.select("pub_id", "eid", "title", "doi"), "pub_id").join(r.author.select("author_id", "scopus_id", "name"), "author_id")
    tied = r.cand.where("status in ('PENDING', 'ACCEPTED')").select("author_id").union(r.ident.where("status = 'APPROVED' and ident_id % 7 = 0").select("author_id"))
    items = NR.list_items(positions, cur, texts, r.over, tied, **how)
    line = F.transform("summaries", lambda s: F.concat_ws("/", s["source"], s["status"], F.coalesce(s["reason"], F.lit("")), F.array_join(s["raw_affiliations"], "|")))
    over = F.transform("overrides", lambda o: F.concat_ws("/", o["over_id"].cast("string"), o["state"]))
    return items.select("pub_id", "author_order", "eid", "scopus_id", "kind", F.array_join(line, ";").alias("summaries"), "has_override", F.array_join(over, ";").alias("overrides"))


FOUND = " SELECT pub_id, author_order, eid, scopus_id, kind, summaries, has_override, overrides FROM i"


@query("needs_review_search", "pub pa author res over cand ident", REVIEWED + FOUND + " WHERE contains(target, 'danh nguyen') OR (contains(target, 'danh') AND contains(target, 'nguyen'))")
def needs_review_search(r):
    """Positions of authors tied to people, by words of name and title, with what each source says and overrides."""
    return review_items(r, query="Đánh  Nguyễn,")


@query("needs_review_adjusted", "pub pa author res over cand ident", REVIEWED + FOUND + " WHERE has_override")
def needs_review_adjusted(r):
    return review_items(r, kind="ADJUSTED")


# ---------------------------------------------------------------- authors
def occurrences_of(r):
    """Sound author lists of raw rows, two of which belong to one publication; every nineteenth row belongs to none."""
    o = PB.author_occurrences(author_lists(r)).where("error is null").selectExpr("raw_id * 1000 + author_order AS seq", "raw_id", "scopus_id", "name AS display", "full_name", "CASE WHEN raw_id % 23 = 0 THEN NULL ELSE author_order END AS author_order")
    provenance = r.table("orders").where("o_orderkey % 19 <> 0").selectExpr("o_orderkey AS raw_id", "o_orderkey div 2 AS pub_id")
    return AU.attributed(o, provenance)


@query("author_records", "author", " , o AS (" + OCCURRENCES.replace(", r AS", "WITH r AS", 1).strip() + """), g AS (SELECT scopus_id, min_by(coalesce(nullif(full_name, ''), name), raw_id * 1000 + author_order) AS name FROM o WHERE error IS NULL AND raw_id % 19 <> 0 AND raw_id IN (SELECT o_orderkey FROM orders) GROUP BY 1),
 e AS (SELECT CAST(author_id AS VARCHAR) AS scopus_id, CASE WHEN author_id % 3 <> 0 THEN name END AS preferred FROM author WHERE author_id % 4 <> 0)
 SELECT g.scopus_id, CASE WHEN e.scopus_id IS NULL THEN 'CREATED' WHEN preferred IS NULL THEN 'NAMED' ELSE 'EXISTING' END AS action, coalesce(preferred, g.name) AS preferred FROM g LEFT JOIN e USING (scopus_id)""")
def author_records(r):
    existing = r.author.where("author_id % 4 <> 0").selectExpr("cast(author_id as string) AS scopus_id", "CASE WHEN author_id % 3 <> 0 THEN name END AS preferred")
    return AU.authors(occurrences_of(r).where("pub_id is not null"), existing)


@query("author_links")
def author_links(r):
    """Links of occurrences as if they came one by one; a test holds them against a loop."""
    links = r.pa.where("pub_id % 5 = 0").selectExpr("pub_id", "cast(author_id as string) AS scopus_id", "author_order").groupBy("pub_id", "scopus_id").agg(F.min("author_order").alias("author_order"))
    return AU.links(occurrences_of(r).where("pub_id is not null"), links)
