"""Queries: aggregates, facets, latest-per-key, event logs and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators.latest import chain_breaks, current, excluded, first_by, ranked
from .base import fold_sql, query
from .q_lists import APPROVED, QUEUE, approved_links, evidence_counts, latest_observation

N = "n"


def n_rows(name=N):
    return F.count(F.lit(1)).alias(name)


# ---------------------------------------------------------------- aggregates
@query("agg_count_all", "pub", " SELECT count(*) AS n_all, count(*) FILTER (year IS NULL) AS n_no_year, count(*) FILTER (doi IS NULL OR trim(doi) = '') AS n_no_doi, count(*) FILTER (cited > 10) AS n_cited FROM pub")
def agg_count_all(r):
    return r.pub.agg(n_rows("n_all"), F.count_if(F.col("year").isNull()).alias("n_no_year"), F.count_if(P.missing_doi(F.col("doi"))).alias("n_no_doi"), F.count_if(F.coalesce(F.col("cited") > 10, F.lit(False))).alias("n_cited"))


STATUSES = ["PENDING", "ACCEPTED", "REJECTED", "REVOKED", "WITHDRAWN"]


@query("agg_status_counts", "cand", " SELECT status, count(cand_id) AS n FROM (VALUES ('PENDING'), ('ACCEPTED'), ('REJECTED'), ('REVOKED'), ('WITHDRAWN')) v(status) LEFT JOIN cand USING (status) GROUP BY status")
def agg_status_counts(r):
    return A.zero_filled(r.cand, "status", STATUSES)


@query("agg_count_distinct_pub", "pa ident lec excl", APPROVED + " SELECT count(DISTINCT pub_id) AS n FROM links")
def agg_count_distinct_pub(r):
    return approved_links(r).agg(F.countDistinct("pub_id").alias(N))


@query("agg_by_year", "pub", " SELECT year, count(*) AS n FROM pub GROUP BY year")
def agg_by_year(r):
    """Years with their counts; the row without a year counts those that have none."""
    return r.pub.groupBy("year").agg(n_rows())


@query("agg_by_type_coalesce", "pub", " SELECT coalesce(doc_type, 'UNSPECIFIED') AS doc_type, count(*) AS n FROM pub GROUP BY 1")
def agg_by_type_coalesce(r):
    return r.pub.groupBy(F.coalesce("doc_type", F.lit("UNSPECIFIED")).alias("doc_type")).agg(n_rows())


RANK_SQL = "CASE status WHEN 'VERIFIED' THEN 2 WHEN 'CORROBORATED' THEN 1 ELSE 0 END"


@query("agg_best_status", "res", f" SELECT best, count(*) AS n FROM (SELECT max({RANK_SQL}) AS best FROM res GROUP BY pub_id, author_order) GROUP BY best")
def agg_best_status(r):
    """Positions by the best status that any of their resolutions, current or not, ever had."""
    return r.res.groupBy("pub_id", "author_order").agg(F.max(F.expr(RANK_SQL)).alias("best")).groupBy("best").agg(n_rows())


CURRENT_RES = """
 , cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pub_id, author_order, source ORDER BY created_at DESC, res_id ASC) AS rk FROM res) WHERE rk = 1)"""


def current_resolutions(r):
    return first_by(r.res, ["pub_id", "author_order", "source"], [F.desc("created_at"), F.asc("res_id")])


@query("latest_resolution", "res", CURRENT_RES + " SELECT pub_id, author_order, source, res_id, status FROM cur")
def latest_resolution(r):
    return current_resolutions(r).select("pub_id", "author_order", "source", "res_id", "status")


@query("agg_facets", "pub", """
 , m AS (SELECT *, coalesce(doc_type = 'O', false) AS f_type, coalesce(access = 'Gold', false) AS f_access, coalesce(year >= 1995, false) AS f_year FROM pub)
 SELECT 'year' AS facet, CAST(year AS VARCHAR) AS value, count(*) AS n FROM m WHERE f_type AND f_access AND year IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'doc_type', doc_type, count(*) FROM m WHERE f_year AND f_access AND trim(doc_type) <> '' GROUP BY 2
 UNION ALL SELECT 'access', access, count(*) FROM m WHERE f_year AND f_type AND access IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'stage', stage, count(*) FROM m WHERE f_year AND f_type AND f_access AND trim(stage) <> '' GROUP BY 2""")
def agg_facets(r):
    own = {"year": F.col("year") >= 1995, "doc_type": F.col("doc_type") == "O", "access": F.col("access") == "Gold"}
    return A.facets(r.pub, own, {"year": "year", "doc_type": "doc_type", "access": "access", "stage": "stage"})


@query("agg_facet_values", "pub", " SELECT source_title AS value, count(*) AS n FROM pub WHERE source_title IS NOT NULL AND trim(source_title) <> '' GROUP BY 1")
def agg_facet_values(r):
    return A.facet(r.pub, "source_title", "source_title").select("value", N)


@query("agg_lecturer_pubs", "pub pa ident lec excl", APPROVED + """
 SELECT lec_id, count(*) AS n, CAST(coalesce(sum(cited), 0) AS BIGINT) AS cited, count(*) FILTER (cited IS NULL) AS no_count, count(*) FILTER (year IS NULL) AS no_year
 FROM (SELECT DISTINCT lec_id, pub_id FROM links) JOIN pub USING (pub_id) GROUP BY lec_id""")
def agg_lecturer_pubs(r):
    x = approved_links(r).select("lec_id", "pub_id").distinct().join(r.pub, "pub_id")
    return x.groupBy("lec_id").agg(n_rows(), F.coalesce(F.sum("cited"), F.lit(0)).alias("cited"), F.count_if(F.col("cited").isNull()).alias("no_count"), F.count_if(F.col("year").isNull()).alias("no_year"))


@query("agg_conditional_count", "evid", " SELECT obs_id, count(*) FILTER (kind = 'NAME') AS n_name, count(*) FILTER (kind = 'PUBLICATION') AS n_pub FROM evid GROUP BY obs_id")
def agg_conditional_count(r):
    return evidence_counts(r)


@query("agg_ambiguity", "cand", " SELECT lec_id, count(*) AS n FROM cand GROUP BY lec_id")
def agg_ambiguity(r):
    return r.cand.groupBy("lec_id").agg(n_rows())


@query("agg_sharing", "cand", " SELECT author_id, count(*) AS n FROM cand GROUP BY author_id")
def agg_sharing(r):
    return r.cand.groupBy("author_id").agg(n_rows())


@query("agg_identity_pub_counts", "ident pa", " SELECT ident_id, count(DISTINCT pub_id) AS n FROM ident LEFT JOIN pa USING (author_id) WHERE status = 'APPROVED' GROUP BY ident_id")
def agg_identity_pub_counts(r):
    per_author = r.pa.groupBy("author_id").agg(F.countDistinct("pub_id").alias(N))
    return r.ident.where("status = 'APPROVED'").join(per_author, "author_id", "left").select("ident_id", F.coalesce(N, F.lit(0)).alias(N))


@query("agg_review_context", "cand", """
 SELECT lec_id, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status = 'REJECTED') AS rejected,
  CASE WHEN count(*) FILTER (status = 'PENDING') > 0 AND count(*) FILTER (status = 'ACCEPTED') > 0 THEN 'PARTLY' WHEN count(*) FILTER (status = 'PENDING') > 0 THEN 'OPEN'
   WHEN count(*) FILTER (status = 'ACCEPTED') > 0 THEN 'DONE' ELSE 'NONE' END AS verdict FROM cand GROUP BY lec_id""")
def agg_review_context(r):
    of = lambda s: F.count_if(F.col("status") == s)
    x = r.cand.groupBy("lec_id").agg(of("PENDING").alias("pending"), of("ACCEPTED").alias("accepted"), of("REJECTED").alias("rejected"))
    return x.withColumn("verdict", F.when((F.col("pending") > 0) & (F.col("accepted") > 0), "PARTLY").when(F.col("pending") > 0, "OPEN").when(F.col("accepted") > 0, "DONE").otherwise("NONE"))


@query("agg_author_counts", "author pa raw", " , n AS (SELECT author_id, count(DISTINCT pub_id) AS n_pubs, count(DISTINCT author_order) AS n_orders FROM pa GROUP BY author_id) SELECT author_id, coalesce(n_pubs, 0) AS n_pubs, coalesce(n_orders, 0) AS n_orders FROM author LEFT JOIN n USING (author_id)")
def agg_author_counts(r):
    n = r.pa.groupBy("author_id").agg(F.countDistinct("pub_id").alias("n_pubs"), F.countDistinct("author_order").alias("n_orders"))
    return r.author.join(n, "author_id", "left").select("author_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pubs", "n_orders")])


@query("agg_author_stats", "author cand", " SELECT count(*) AS n_authors, count(*) FILTER (author_id IN (SELECT author_id FROM cand)) AS n_with_candidate FROM author")
def agg_author_stats(r):
    flagged = r.author.join(r.cand.select("author_id").distinct().withColumn("has", F.lit(True)), "author_id", "left")
    return flagged.agg(n_rows("n_authors"), F.count_if(F.col("has").isNotNull()).alias("n_with_candidate"))


@query("agg_lecturer_stats", "lec", " SELECT count(*) AS n, count(*) FILTER (active) AS n_active, count(*) FILTER (active AND has_account) AS n_linked, count(*) FILTER (NOT active AND has_account) AS n_locked, count(*) FILTER (email IS NULL) AS n_no_mail FROM lec")
def agg_lecturer_stats(r):
    return r.lec.agg(n_rows(), F.count_if("active").alias("n_active"), F.count_if(F.expr("active and has_account")).alias("n_linked"), F.count_if(F.expr("not active and has_account")).alias("n_locked"), F.count_if(F.col("email").isNull()).alias("n_no_mail"))


@query("agg_comment_counts", "audit", " SELECT entity_id, count(*) AS n FROM audit WHERE action = 'click' GROUP BY entity_id")
def agg_comment_counts(r):
    return r.audit.where("action = 'click'").groupBy("entity_id").agg(n_rows())


@query("agg_reports", "audit", " SELECT count(*) AS n, count(*) FILTER (actor_id IS NULL) AS n_open FROM audit WHERE entity_type = 'lecturer'")
def agg_reports(r):
    return r.audit.where("entity_type = 'lecturer'").agg(n_rows(), F.count_if(F.col("actor_id").isNull()).alias("n_open"))


@query("agg_resolution_counts", "res", " SELECT source, status, count(*) AS n, max(created_at) AS last_run FROM res GROUP BY source, status")
def agg_resolution_counts(r):
    return r.res.groupBy("source", "status").agg(n_rows(), F.max("created_at").alias("last_run"))


@query("agg_import_report", "res", " SELECT source, status, count(*) FILTER (reason IS NULL) AS linked, count(*) FILTER (reason = 'NAME_MISMATCH') AS names, count(*) FILTER (reason NOT IN ('NAME_MISMATCH')) AS other FROM res GROUP BY source, status")
def agg_import_report(r):
    of = lambda e: F.count_if(F.coalesce(F.expr(e), F.lit(False)))
    return r.res.groupBy("source", "status").agg(of("reason is null").alias("linked"), of("reason = 'NAME_MISMATCH'").alias("names"), of("reason <> 'NAME_MISMATCH'").alias("other"))


@query("agg_import_stats", "imp", " SELECT count(*) FILTER (status IN ('APPLIED', 'STAGED')) AS success, count(*) FILTER (status = 'PROCESSING') AS processing, count(*) FILTER (status = 'FAILED') AS failed FROM imp")
def agg_import_stats(r):
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return r.imp.agg(of("APPLIED", "STAGED").alias("success"), of("PROCESSING").alias("processing"), of("FAILED").alias("failed"))


INSTITUTION_SQL = fold_sql("affiliation")


@query("agg_affiliation_papers", "pa res over", f"""
 , named AS (SELECT pub_id, author_order FROM res WHERE regexp_matches({INSTITUTION_SQL}, '\\bvktu\\b') UNION SELECT pub_id, author_order FROM over WHERE state = 'ACTIVE' AND regexp_matches({INSTITUTION_SQL}, '\\bvktu\\b|brand#1'))
 SELECT author_id, count(*) AS n FROM pa JOIN named USING (pub_id, author_order) GROUP BY author_id""")
def agg_affiliation_papers(r):
    """Positions whose text, in any resolution or in an active override, names the institution; each counts once."""
    names = lambda pattern: F.rlike(X.folded(F.col("affiliation")), F.lit(pattern))
    a = r.res.where(names(r"\bvktu\b")).select("pub_id", "author_order")
    b = r.over.where((F.col("state") == "ACTIVE") & names(r"\bvktu\b|brand#1")).select("pub_id", "author_order")
    return r.pa.join(a.union(b).distinct(), ["pub_id", "author_order"]).groupBy("author_id").agg(n_rows())


@query("agg_eval_precision_recall", "cand ident", """
 , proposed AS (SELECT DISTINCT lec_id, author_id FROM cand WHERE status <> 'REJECTED'), truth AS (SELECT DISTINCT lec_id, author_id FROM ident WHERE status = 'APPROVED'),
 n AS (SELECT (SELECT count(*) FROM proposed) AS n_proposed, (SELECT count(*) FROM truth) AS n_truth, (SELECT count(*) FROM proposed SEMI JOIN truth USING (lec_id, author_id)) AS n_hit)
 SELECT n_proposed, n_truth, n_hit, round_even(n_hit / nullif(n_proposed, 0), 3) AS precision_, round_even(n_hit / nullif(n_truth, 0), 3) AS recall_ FROM n""")
def agg_eval_precision_recall(r):
    a = r.cand.where("status <> 'REJECTED'").select("lec_id", "author_id").distinct().withColumn("p", F.lit(True))
    b = r.ident.where("status = 'APPROVED'").select("lec_id", "author_id").distinct().withColumn("t", F.lit(True))
    n = a.join(b, ["lec_id", "author_id"], "full_outer").agg(F.count("p").alias("n_proposed"), F.count("t").alias("n_truth"), F.count_if(F.expr("p and t")).alias("n_hit"))
    return n.select("*", A.ratio(F.col("n_hit"), F.col("n_proposed")).alias("precision_"), A.ratio(F.col("n_hit"), F.col("n_truth")).alias("recall_"))


@query("agg_declared_vs_actual", "raw imp", " , d AS (SELECT import_id, moment % 300 AS declared FROM imp), a AS (SELECT import_id, count(*) AS actual FROM raw GROUP BY 1) SELECT import_id, declared, actual, coalesce(declared = actual, false) AS same FROM d FULL JOIN a USING (import_id)")
def agg_declared_vs_actual(r):
    d = r.imp.select("import_id", (F.col("moment") % 300).alias("declared"))
    a = r.raw.groupBy("import_id").agg(n_rows("actual"))
    return d.join(a, "import_id", "full_outer").withColumn("same", F.coalesce(F.col("declared") == F.col("actual"), F.lit(False)))


@query("agg_distinct_ids", "res", " SELECT source, count(DISTINCT pub_id) AS n FROM res GROUP BY source UNION ALL SELECT 'ALL', count(DISTINCT pub_id) FROM res")
def agg_distinct_ids(r):
    per = r.res.groupBy("source").agg(F.countDistinct("pub_id").alias(N))
    return per.union(r.res.agg(F.countDistinct("pub_id").alias(N)).select(F.lit("ALL"), N))


@query("agg_collisions", "ident", " SELECT author_id, count(DISTINCT lec_id) AS n_owners, count(*) AS n_rows, count(DISTINCT lec_id) > 1 AS multi_owner, count(*) > count(DISTINCT lec_id) AS repeated FROM ident GROUP BY author_id HAVING count(*) > 1")
def agg_collisions(r):
    x = r.ident.groupBy("author_id").agg(F.countDistinct("lec_id").alias("n_owners"), n_rows("n_rows")).where("n_rows > 1")
    return x.select("*", (F.col("n_owners") > 1).alias("multi_owner"), (F.col("n_rows") > F.col("n_owners")).alias("repeated"))


@query("agg_field_coverage", "lec", " SELECT round_even(count(staff_code) / count(*), 3) AS staff_code, round_even(count(email) / count(*), 3) AS email, round_even(count(degree) / count(*), 3) AS degree FROM lec")
def agg_field_coverage(r):
    return r.lec.agg(*[A.ratio(F.count(c), F.count(F.lit(1))).alias(c) for c in ("staff_code", "email", "degree")])


@query("agg_title_profile", "raw", " SELECT title_raw, count(*) AS n FROM raw GROUP BY title_raw ORDER BY n DESC, title_raw LIMIT 3")
def agg_title_profile(r):
    return r.raw.groupBy("title_raw").agg(n_rows()).orderBy(F.desc(N), "title_raw").limit(3)


@query("agg_run_counts", "obs evid", " SELECT run_id, count(DISTINCT cand_id) AS n_cands, count(DISTINCT obs.obs_id) AS n_obs, count(evid_id) AS n_evid FROM obs LEFT JOIN evid USING (obs_id) GROUP BY run_id")
def agg_run_counts(r):
    per = r.evid.groupBy("obs_id").agg(n_rows("e"))
    return r.obs.join(per, "obs_id", "left").groupBy("run_id").agg(F.countDistinct("cand_id").alias("n_cands"), n_rows("n_obs"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_evid"))


@query("agg_matching_counts", "cand", " SELECT status, count(*) AS n, count(DISTINCT lec_id) AS n_lecs, count(DISTINCT author_id) AS n_authors FROM cand GROUP BY status")
def agg_matching_counts(r):
    return r.cand.groupBy("status").agg(n_rows(), F.countDistinct("lec_id").alias("n_lecs"), F.countDistinct("author_id").alias("n_authors"))


@query("agg_plan_summary", "cand evid", " SELECT count(DISTINCT lec_id) AS n_lecs, count(DISTINCT author_id) AS n_authors, (SELECT count(*) FROM evid) AS n_evid FROM cand")
def agg_plan_summary(r):
    c = r.cand.agg(F.countDistinct("lec_id").alias("n_lecs"), F.countDistinct("author_id").alias("n_authors"))
    both = c.unionByName(r.evid.agg(n_rows("n_evid")), allowMissingColumns=True)  # two rows
    return both.agg(*[F.max(x).alias(x) for x in ("n_lecs", "n_authors", "n_evid")])


@query("agg_normalization_counters", "raw", """
 , k AS (SELECT raw_id, CASE WHEN validation <> 'VALID' OR trim(eid_raw) = '' OR contains(trim(eid_raw), ' ') THEN 'INVALID_EID' WHEN row_number() OVER (PARTITION BY trim(eid_raw), validation ORDER BY raw_id) > 1 THEN 'DUPLICATE' ELSE 'NEW' END AS outcome FROM raw)
 SELECT outcome, count(*) AS n FROM k GROUP BY outcome""")
def agg_normalization_counters(r):
    x = r.raw.withColumn("eid", X.normalize_eid(F.col("eid_raw")))
    x = ranked(x.withColumn("group", F.coalesce("eid", F.concat(F.lit("\0"), F.col("raw_id").cast("string")))), ["group", "validation"], [F.asc("raw_id")], "k")
    outcome = F.when((F.col("validation") != "VALID") | F.col("eid").isNull(), "INVALID_EID").when(F.col("k") > 1, "DUPLICATE").otherwise("NEW")
    return x.groupBy(outcome.alias("outcome")).agg(n_rows())


@query("agg_author_counters", "pa author", " SELECT count(*) AS n_links, count(author.author_id) AS n_known, count(*) - count(author.author_id) AS n_unknown, count(DISTINCT pa.author_id) AS n_authors FROM pa LEFT JOIN author USING (author_id)")
def agg_author_counters(r):
    x = r.pa.join(r.author.select("author_id", F.lit(True).alias("known")), "author_id", "left")
    return x.agg(n_rows("n_links"), F.count("known").alias("n_known"), F.count_if(F.col("known").isNull()).alias("n_unknown"), F.countDistinct("author_id").alias("n_authors"))


DIGEST_PARTS = ", ':', ".join(f"CAST(sum(CAST(concat('0x', substr(h, {1 + 8 * i}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query("fingerprint_rows", "cand", f" , hashed AS (SELECT sha256(concat('{{\"author_id\":', author_id, ',\"cand_id\":', cand_id, ',\"status\":\"', status, '\"}}')) AS h FROM cand) SELECT count(*) AS n, sha256(concat({DIGEST_PARTS})) AS digest FROM hashed")
def fingerprint_rows(r):
    return A.fingerprint(r.cand, ["cand_id", "author_id", "status"])


@query("dense_year_series", "pub", " SELECT CAST(y.year AS INTEGER) AS year, count(pub_id) AS n FROM (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM pub WHERE year <> 1996) y LEFT JOIN (SELECT * FROM pub WHERE year <> 1996) p ON p.year = y.year GROUP BY 1")
def dense_year_series(r):
    return A.dense_years(r.pub.where("year <> 1996"))


# ---------------------------------------------------------------- latest per key
@query("win_latest_observation", "obs", " SELECT cand_id, obs_id FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY completed_at DESC, created_at DESC, obs_id DESC) AS rk FROM obs WHERE run_status = 'COMPLETED') WHERE rk = 1")
def win_latest_observation(r):
    return latest_observation(r).select("cand_id", "obs_id")


@query("win_current_reviewable", "cand lec author obs evid", QUEUE + " SELECT cand_id, obs_id FROM cand JOIN latest USING (cand_id) WHERE status IN ('PENDING', 'ACCEPTED')")
def win_current_reviewable(r):
    return r.cand.where("status in ('PENDING', 'ACCEPTED')").join(latest_observation(r), "cand_id").select("cand_id", "obs_id")


@query("win_archive_state", "audit", " SELECT entity_id, action FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, audit_id DESC) AS rk FROM audit WHERE action IN ('view', 'click')) WHERE rk = 1")
def win_archive_state(r):
    return first_by(r.audit.where("action in ('view', 'click')"), ["entity_id"], [F.desc("created_at"), F.desc("audit_id")]).select("entity_id", "action")


@query("win_capture_selection", "res", " SELECT pub_id, res_id FROM (SELECT *, row_number() OVER (PARTITION BY pub_id ORDER BY CASE WHEN status = 'VERIFIED' THEN 0 ELSE 1 END, res_id % 7 DESC, created_at DESC, res_id, author_order, source) AS rk FROM res) WHERE rk = 1")
def win_capture_selection(r):
    order = [F.when(F.col("status") == "VERIFIED", 0).otherwise(1), (F.col("res_id") % 7).desc(), F.desc("created_at"), F.asc("res_id"), F.asc("author_order"), F.asc("source")]
    return first_by(r.res, ["pub_id"], order).select("pub_id", "res_id")


@query("latest_raw_per_pub", "raw", " SELECT pub_id, max_by(raw_id, (created_at, raw_id)) AS raw_id FROM raw GROUP BY pub_id")
def latest_raw_per_pub(r):
    return r.raw.groupBy("pub_id").agg(F.max_by("raw_id", F.struct("created_at", "raw_id")).alias("raw_id"))


@query("latest_exclusion", "excl", " SELECT lec_id, pub_id FROM (SELECT lec_id, pub_id, max_by(action, seq) AS action FROM excl GROUP BY ALL) WHERE action = 'EXCLUDE'")
def latest_exclusion(r):
    return excluded(r.excl).select("lec_id", "pub_id")


PRIMARY = """
 , last AS (SELECT lec_id, max_by(ident_id, seq) AS ident_id, max_by(action, seq) AS action FROM prim GROUP BY lec_id),
 kept AS (SELECT last.lec_id, last.ident_id FROM last JOIN ident ON ident.ident_id = last.ident_id AND ident.lec_id = last.lec_id AND status = 'APPROVED' WHERE action = 'SET')"""


def primaries(r):
    """The last SET of each lecturer, if that identity is still approved and still theirs; else it lapses."""
    last = current(r.prim, ["lec_id"], "seq", "ident_id", "action").where("action = 'SET'")
    return last.join(r.ident.where("status = 'APPROVED'").select("ident_id", "lec_id"), ["ident_id", "lec_id"], "left_semi").select("lec_id", "ident_id")


@query("latest_primary", "prim ident", PRIMARY + " SELECT lec_id, ident_id FROM kept")
def latest_primary(r):
    return primaries(r)


@query("suggest_primary", "prim ident pa author", PRIMARY + """
 , n AS (SELECT author_id, count(DISTINCT pub_id) AS n FROM pa GROUP BY author_id),
 own AS (SELECT lec_id, ident_id, coalesce(n, 0) AS n, scopus_id FROM ident JOIN author USING (author_id) LEFT JOIN n USING (author_id) WHERE status = 'APPROVED')
 SELECT lec_id, min_by(ident_id, (-n, scopus_id, ident_id)) AS ident_id FROM own ANTI JOIN kept USING (lec_id) GROUP BY lec_id HAVING count(*) >= 2""")
def suggest_primary(r):
    n = r.pa.groupBy("author_id").agg(F.countDistinct("pub_id").alias("n"))
    own = r.ident.where("status = 'APPROVED'").join(r.author, "author_id").join(n, "author_id", "left").join(primaries(r), "lec_id", "left_anti")
    best = F.min_by("ident_id", F.struct(-F.coalesce("n", F.lit(0)), F.col("scopus_id"), F.col("ident_id")))
    return own.groupBy("lec_id").agg(best.alias("ident_id"), n_rows("many")).where("many >= 2").select("lec_id", "ident_id")


@query("first_accept", "audit", " SELECT entity_id, min_by(audit_id, (created_at, audit_id)) AS audit_id FROM audit WHERE action = 'purchase' GROUP BY entity_id")
def first_accept(r):
    return r.audit.where("action = 'purchase'").groupBy("entity_id").agg(F.min_by("audit_id", F.struct("created_at", "audit_id")).alias("audit_id"))


@query("earliest_origin", "raw", " SELECT pub_id, min_by(trim(eid_raw), (created_at, raw_id)) AS eid FROM raw WHERE trim(eid_raw) <> '' GROUP BY pub_id")
def earliest_origin(r):
    return r.raw.where("trim(eid_raw) <> ''").groupBy("pub_id").agg(F.min_by(F.trim("eid_raw"), F.struct("created_at", "raw_id")).alias("eid"))


@query("latest_pending_refs", "cand ident", """
 , wanted AS (SELECT lec_id, list(DISTINCT author_id) AS ids FROM cand WHERE status = 'ACCEPTED' GROUP BY lec_id), have AS (SELECT lec_id, list(DISTINCT author_id) AS ids FROM ident WHERE status = 'APPROVED' GROUP BY lec_id)
 SELECT lec_id, CAST(len(list_filter(wanted.ids, lambda x: NOT list_contains(coalesce(have.ids, []), x))) AS INTEGER) AS n_missing FROM wanted LEFT JOIN have USING (lec_id)""")
def latest_pending_refs(r):
    wanted = r.cand.where("status = 'ACCEPTED'").select("lec_id", "author_id").distinct()
    have = r.ident.where("status = 'APPROVED'").select("lec_id", "author_id", F.lit(True).alias("ok")).distinct()
    return wanted.join(have, ["lec_id", "author_id"], "left").groupBy("lec_id").agg(F.count_if(F.col("ok").isNull()).cast("int").alias("n_missing"))


@query("active_rule_set", "obs", " SELECT max_by(obs_id, (run_id, obs_id)) AS obs_id, max(run_id) AS sequence_no FROM obs WHERE run_status = 'COMPLETED'")
def active_rule_set(r):
    return r.obs.where("run_status = 'COMPLETED'").agg(F.max_by("obs_id", F.struct("run_id", "obs_id")).alias("obs_id"), F.max("run_id").alias("sequence_no"))


@query("latest_actor", "audit lec", """
 , last AS (SELECT entity_id, max_by(actor_id, audit_id) AS actor_id FROM (SELECT entity_id, audit_id, coalesce(actor_id, -1) AS actor_id FROM audit WHERE entity_type = 'import' AND action = 'signup') GROUP BY entity_id)
 SELECT entity_id, full_name AS actor FROM last LEFT JOIN lec ON lec_id = last.actor_id""")
def latest_actor(r):
    last = current(r.audit.where("entity_type = 'import' and action = 'signup'"), ["entity_id"], "audit_id", "actor_id")
    return last.join(r.lec, F.col("lec_id") == F.col("actor_id"), "left").select("entity_id", F.col("full_name").alias("actor"))


@query("latest_live_import", "imp audit", """
 , live AS (SELECT * FROM imp ANTI JOIN (SELECT entity_id AS import_id FROM audit WHERE action = 'error' AND audit_id % 30 = 0) USING (import_id))
 SELECT sha, max_by(import_id, (moment, import_id)) AS import_id FROM live GROUP BY sha""")
def latest_live_import(r):
    marked = r.audit.where("action = 'error' and audit_id % 30 = 0").select(F.col("entity_id").alias("import_id"))
    return r.imp.join(marked, "import_id", "left_anti").groupBy("sha").agg(F.max_by("import_id", F.struct("moment", "import_id")).alias("import_id"))


@query("supersede_older", "imp", " SELECT import_id, sha FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY moment DESC, import_id DESC) AS rk FROM imp WHERE status <> 'FAILED') WHERE rk > 1")
def supersede_older(r):
    return ranked(r.imp.where("status <> 'FAILED'"), ["sha"], [F.desc("moment"), F.desc("import_id")]).where("rank > 1").select("import_id", "sha")


@query("first_wins_position", "pub", """
 , slots AS (SELECT l_orderkey AS pub_id, l_linenumber AS author_order, l_suppkey AS author_id, l_partkey AS seen FROM lineitem),
 k AS (SELECT *, row_number() OVER (PARTITION BY pub_id, author_order ORDER BY seen, author_id) AS of_order FROM slots)
 SELECT pub_id, author_order, author_id, seen, CASE WHEN of_order = 1 THEN 'LINKED' WHEN author_id = first_value(author_id) OVER (PARTITION BY pub_id, author_order ORDER BY seen, author_id) THEN 'EXISTING' ELSE 'CONFLICT' END AS outcome FROM k""")
def first_wins_position(r):
    """The first author at a position has it; later rows are the same link again or conflicts."""
    slots = r.table("lineitem").select(F.col("l_orderkey").alias("pub_id"), F.col("l_linenumber").alias("author_order"), F.col("l_suppkey").alias("author_id"), F.col("l_partkey").alias("seen"))
    w = Window.partitionBy("pub_id", "author_order").orderBy("seen", "author_id")
    outcome = F.when(F.row_number().over(w) == 1, "LINKED").when(F.col("author_id") == F.first("author_id").over(w), "EXISTING").otherwise("CONFLICT")
    return slots.withColumn("outcome", outcome)


@query("stream_head", "audit", """
 , chain AS (SELECT entity_id AS stream, row_number() OVER (PARTITION BY entity_id ORDER BY audit_id) AS seq, sha256(CAST(audit_id AS VARCHAR)) AS own, lag(sha256(CAST(audit_id AS VARCHAR))) OVER (PARTITION BY entity_id ORDER BY audit_id) AS prev FROM audit)
 SELECT stream, max(seq) AS head, max_by(own, seq) AS head_hash FROM chain GROUP BY stream""")
def stream_head(r):
    seq = F.row_number().over(Window.partitionBy("entity_id").orderBy("audit_id"))
    chain = r.audit.select(F.col("entity_id").alias("stream"), seq.cast("long").alias("seq"), F.sha2(F.col("audit_id").cast("string"), 256).alias("own"))
    return chain.groupBy("stream").agg(F.max("seq").alias("head"), F.max_by("own", "seq").alias("head_hash"))


@query("dq_append_only", "audit", """
 , chain AS (SELECT entity_id AS stream, audit_id AS id, row_number() OVER (PARTITION BY entity_id ORDER BY audit_id) + CASE WHEN audit_id % 500 = 7 THEN 1 ELSE 0 END AS seq, CAST(audit_id AS VARCHAR) AS own,
   CASE WHEN audit_id % 400 = 3 THEN 'x' ELSE lag(CAST(audit_id AS VARCHAR)) OVER (PARTITION BY entity_id ORDER BY audit_id) END AS prev FROM audit),
 b AS (SELECT *, lag(seq) OVER (PARTITION BY stream ORDER BY seq, id) AS before, lag(own) OVER (PARTITION BY stream ORDER BY seq, id) AS linked FROM chain WHERE NOT (id % 500 = 7))
 SELECT stream, id, CASE WHEN before IS NOT NULL AND seq <> before + 1 THEN 'GAP' ELSE 'BROKEN_LINK' END AS problem FROM b WHERE (before IS NOT NULL AND seq <> before + 1) OR prev IS DISTINCT FROM linked""")
def dq_append_only(r):
    w = Window.partitionBy("entity_id").orderBy("audit_id")
    chain = r.audit.select(F.col("entity_id").alias("stream"), F.col("audit_id").alias("id"), F.row_number().over(w).cast("long").alias("seq"), F.col("audit_id").cast("string").alias("own"), F.when(F.col("audit_id") % 400 == 3, "x").otherwise(F.lag(F.col("audit_id").cast("string")).over(w)).alias("prev"))
    return chain_breaks(chain.where("id % 500 <> 7"), "stream", "seq", "own", "prev").select("stream", "id", "problem")


# ---------------------------------------------------------------- set operations
@query("set_distinct", "pa ident", " SELECT DISTINCT pub_id FROM pa JOIN ident USING (author_id) WHERE status = 'APPROVED'")
def set_distinct(r):
    return r.pa.join(r.ident.where("status = 'APPROVED'").select("author_id").distinct(), "author_id").select("pub_id").distinct()


@query("set_union_ids", "cand ident", " SELECT author_id FROM cand WHERE status IN ('PENDING', 'ACCEPTED') UNION SELECT author_id FROM ident WHERE status = 'APPROVED'")
def set_union_ids(r):
    return r.cand.where("status in ('PENDING', 'ACCEPTED')").select("author_id").union(r.ident.where("status = 'APPROVED'").select("author_id")).distinct()


@query("set_union_all_candidates", "cand ident", " SELECT lec_id, author_id, status, 'name' AS origin FROM cand UNION ALL SELECT lec_id, author_id, NULL, 'discovered' FROM ident")
def set_union_all_candidates(r):
    a = r.cand.select("lec_id", "author_id", "status", F.lit("name").alias("origin"))
    return a.unionByName(r.ident.select("lec_id", "author_id", F.lit("discovered").alias("origin")), allowMissingColumns=True)


@query("set_difference_pairs", "cand ident", " SELECT lec_id, author_id FROM ident EXCEPT SELECT lec_id, author_id FROM cand")
def set_difference_pairs(r):
    return r.ident.select("lec_id", "author_id").subtract(r.cand.select("lec_id", "author_id"))


@query("set_absent_from_file", "lec ident", " SELECT lec_id FROM lec EXCEPT SELECT lec_id FROM ident WHERE status = 'PENDING'")
def set_absent_from_file(r):
    return r.lec.select("lec_id").subtract(r.ident.where("status = 'PENDING'").select("lec_id"))


@query("set_intersect_eval", "cand ident", " SELECT lec_id, author_id FROM ident INTERSECT SELECT lec_id, author_id FROM cand")
def set_intersect_eval(r):
    return r.ident.select("lec_id", "author_id").intersect(r.cand.select("lec_id", "author_id"))


SNAPSHOTS = """
 , a AS (SELECT doc_id, min(n_chars) AS v FROM documents WHERE doc_id % 5 <> 0 GROUP BY doc_id), b AS (SELECT doc_id, min(CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END) AS v FROM documents WHERE doc_id % 7 <> 0 GROUP BY doc_id)"""


@query("snapshot_diff", "doc", SNAPSHOTS + " SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'ADDED' WHEN b.doc_id IS NULL THEN 'REMOVED' WHEN a.v IS DISTINCT FROM b.v THEN 'CHANGED' ELSE 'UNCHANGED' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def snapshot_diff(r):
    a = r.doc.where("doc_id % 5 <> 0").groupBy("doc_id").agg(F.min("n_chars").alias("a"), F.lit(True).alias("in_a"))
    b = r.doc.where("doc_id % 7 <> 0").groupBy("doc_id").agg(F.min(F.expr("CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END")).alias("b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "ADDED").when(F.col("in_b").isNull(), "REMOVED").when(~F.col("a").eqNullSafe(F.col("b")), "CHANGED").otherwise("UNCHANGED")
    return a.join(b, "doc_id", "full_outer").select("doc_id", status.alias("status"))


@query("diff_comparability", "imp", """
 SELECT a.import_id, concat_ws(',', CASE WHEN a.sha <> b.sha THEN 'DIFFERENT_SOURCE' END, CASE WHEN a.status <> b.status THEN 'DIFFERENT_STATUS' END, CASE WHEN a.moment = b.moment THEN 'SAME_INSTANT' END, CASE WHEN b.moment < a.moment THEN 'OUT_OF_ORDER' END) AS reasons
 FROM imp a JOIN imp b ON b.import_id = a.import_id + 120""")
def diff_comparability(r):
    a, b = r.imp.alias("a"), r.imp.withColumn("import_id", F.col("import_id") - 120).alias("b")
    why = lambda cond, code: F.when(F.expr(cond), code)
    reasons = F.array_compact(F.array(why("a.sha <> b.sha", "DIFFERENT_SOURCE"), why("a.status <> b.status", "DIFFERENT_STATUS"), why("a.moment = b.moment", "SAME_INSTANT"), why("b.moment < a.moment", "OUT_OF_ORDER")))
    return a.join(b, "import_id").select("import_id", F.array_join(reasons, ",").alias("reasons"))


@query("orphan_set", "ident cand", " SELECT DISTINCT lec_id FROM ident ANTI JOIN cand USING (lec_id)")
def orphan_set(r):
    return r.ident.select("lec_id").distinct().join(r.cand, "lec_id", "left_anti")


@query("set_equality_replay", "cand", " , a AS (SELECT cand_id, status FROM cand), b AS (SELECT cand_id, CASE WHEN cand_id % 97 = 0 THEN 'X' ELSE status END AS status FROM cand WHERE cand_id % 101 <> 0) SELECT coalesce(a.cand_id, b.cand_id) AS cand_id, a.status AS persisted, b.status AS requested FROM a FULL JOIN b ON a.cand_id = b.cand_id WHERE a.status IS DISTINCT FROM b.status")
def set_equality_replay(r):
    """Rows in which a replay differs from what was persisted; none means that they are equal."""
    a = r.cand.select("cand_id", F.col("status").alias("persisted"))
    b = r.cand.where("cand_id % 101 <> 0").select("cand_id", F.expr("CASE WHEN cand_id % 97 = 0 THEN 'X' ELSE status END").alias("requested"))
    return a.join(b, "cand_id", "full_outer").where(~F.col("persisted").eqNullSafe(F.col("requested")))


# ---------------------------------------------------------------- data quality
@query("dq_unique", "raw", " SELECT trim(eid_raw) AS eid, count(*) AS n FROM raw GROUP BY 1 HAVING count(*) > 1")
def dq_unique(r):
    return A.duplicates(r.raw.select(F.trim("eid_raw").alias("eid")), ["eid"])


@query("dq_partial_unique", "ident", " SELECT author_id, count(*) AS n FROM ident WHERE status = 'APPROVED' GROUP BY author_id HAVING count(*) > 1")
def dq_partial_unique(r):
    return A.duplicates(r.ident.where("status = 'APPROVED'"), ["author_id"])


@query("dq_domain", "res", " SELECT res_id, reason FROM res WHERE reason NOT IN ('NAME_MISMATCH', 'NO_EXTERNAL_WORK', 'ID_CONFLICT', 'AUTHOR_COUNT_MISMATCH')")
def dq_domain(r):
    return r.res.where(~F.col("reason").isin("NAME_MISMATCH", "NO_EXTERNAL_WORK", "ID_CONFLICT", "AUTHOR_COUNT_MISMATCH")).select("res_id", "reason")


@query("dq_coherence", "res", " SELECT pub_id, author_order, res_id FROM res WHERE (status = 'UNRESOLVED') <> (reason IS NOT NULL) OR (status = 'UNRESOLVED' AND presence = 'ABSENT')")
def dq_coherence(r):
    open_ = F.col("status") == "UNRESOLVED"
    return r.res.where((open_ != F.col("reason").isNotNull()) | (open_ & (F.col("presence") == "ABSENT"))).select("pub_id", "author_order", "res_id")


@query("dq_hash_format", "imp", " SELECT import_id FROM imp WHERE NOT regexp_full_match(CASE WHEN import_id % 6 = 0 THEN sha ELSE sha256(sha) END, '[0-9a-f]{64}')")
def dq_hash_format(r):
    h = F.when(F.col("import_id") % 6 == 0, F.col("sha")).otherwise(F.sha2("sha", 256))
    return r.imp.where(~F.rlike(h, F.lit("^[0-9a-f]{64}$"))).select("import_id")


@query("dq_fk", "ident author", " SELECT ident_id, author_id FROM ident WHERE NOT EXISTS (SELECT 1 FROM author WHERE author.author_id = ident.author_id)")
def dq_fk(r):
    return r.ident.join(r.author, "author_id", "left_anti").select("ident_id", "author_id")


@query("dq_coverage", "obs evid", " SELECT run_id, count(DISTINCT obs.obs_id) AS n_obs, count(DISTINCT evid.obs_id) AS n_covered FROM obs LEFT JOIN evid USING (obs_id) GROUP BY run_id HAVING count(DISTINCT obs.obs_id) <> count(DISTINCT evid.obs_id) OR run_id < 5")
def dq_coverage(r):
    x = r.obs.join(r.evid.select("obs_id", F.lit(True).alias("has")).distinct(), "obs_id", "left").groupBy("run_id").agg(F.countDistinct("obs_id").alias("n_obs"), F.count("has").alias("n_covered"))
    return x.where("n_obs <> n_covered or run_id < 5")


@query("dq_roster_validate", "lec", " SELECT lec_id, concat_ws(',', CASE WHEN staff_code IS NULL THEN 'NO_STAFF_CODE' END, CASE WHEN email IS NULL THEN 'NO_EMAIL' END, CASE WHEN email IS NOT NULL AND count(*) OVER (PARTITION BY lower(email)) > 1 THEN 'DUPLICATE_EMAIL' END, CASE WHEN degree IS NULL AND acad_rank IS NOT NULL THEN 'RANK_WITHOUT_DEGREE' END) AS errors FROM lec")
def dq_roster_validate(r):
    """Rule columns of each record. Shared e-mails are counted before they are joined, so a value that many share meets no window."""
    shared = A.duplicates(r.lec.where("email is not null").select(F.lower("email").alias("key")), ["key"])
    x = r.lec.join(shared, F.lower("email") == F.col("key"), "left")
    rule = lambda cond, code: F.when(F.expr(cond), code)
    errors = F.array_compact(F.array(rule("staff_code is null", "NO_STAFF_CODE"), rule("email is null", "NO_EMAIL"), rule("key is not null", "DUPLICATE_EMAIL"), rule("degree is null and acad_rank is not null", "RANK_WITHOUT_DEGREE")))
    return x.select("lec_id", F.array_join(errors, ",").alias("errors"))
