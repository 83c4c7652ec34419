"""Queries: predicates, joins, sorting and paging of the lists (filters, joins, pages, searches)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import filters as P
from ..operators.latest import excluded, first_by
from . import discovery
from .base import fold_sql, query
from .q_scalars import CORRESPONDS, SURFACE, TITLE_SQL

NULLS_LAST = "desc_nulls_last"


def page(df, order, limit, offset=0):
    """One page of a total order; Spark keeps only offset + limit rows of each partition."""
    return df.orderBy(*order).offset(offset).limit(limit)


# ---------------------------------------------------------------- predicates
FILTER = P.PublicationFilter(q="nghien cuu 3", doc_type="O", missing_doi=False)
FILTER_SQL = f"""
 , hit AS (SELECT DISTINCT pub_id FROM pa JOIN author USING (author_id) WHERE contains({fold_sql('name')}, 'nghien cuu 3') OR contains(lower(scopus_id), 'nghien cuu 3')),
 found AS (SELECT pub.* FROM pub LEFT JOIN hit ON hit.pub_id = pub.pub_id
   WHERE (coalesce(contains({fold_sql('title')}, 'nghien cuu 3'), false) OR coalesce(contains({fold_sql('source_title')}, 'nghien cuu 3'), false)
          OR contains(lower(eid), 'nghien cuu 3') OR coalesce(contains(lower(doi), 'nghien cuu 3'), false) OR hit.pub_id IS NOT NULL)
     AND doc_type = 'O' AND NOT (doi IS NULL OR trim(doi) = ''))"""


@query("filter_publications", "pub pa author", FILTER_SQL + " SELECT pub_id, eid, title, year FROM found")
def filter_publications(r):
    return P.publications(r.pub, r.pa, r.author, FILTER).select("pub_id", "eid", "title", "year")


ENTRY_SQL = f"""
 , hit AS (SELECT DISTINCT pub_id FROM pa JOIN author USING (author_id) WHERE contains({fold_sql('name')}, 'nguyen') OR contains(lower(scopus_id), 'nguyen')),
 found AS (SELECT pub.* FROM pub LEFT JOIN hit ON hit.pub_id = pub.pub_id WHERE coalesce(contains({fold_sql('title')}, 'nguyen'), false)
    OR coalesce(contains({fold_sql('source_title')}, 'nguyen'), false) OR contains(lower(eid), 'nguyen') OR coalesce(contains(lower(doi), 'nguyen'), false) OR hit.pub_id IS NOT NULL)"""


@query("page_publications", "pub pa author", ENTRY_SQL + " SELECT pub_id, eid, title, year FROM found ORDER BY year DESC NULLS LAST, eid LIMIT 20 OFFSET 20")
def page_publications(r):
    found = P.publications(r.pub, r.pa, r.author, P.PublicationFilter(q="Nguyễn"))
    return page(found, [F.desc_nulls_last("year"), F.asc("eid")], 20, 20).select("pub_id", "eid", "title", "year")


@query("like_escape_literal", "pub", r" SELECT pub_id FROM pub WHERE contains(concat(title, '_50%'), '_50%') AND contains(title, 'số 1')")
def like_escape_literal(r):
    """Wildcards in the term are literal characters, by an escaped pattern."""
    held = F.concat("title", F.lit("_50%"))
    return r.pub.where(F.like(held, F.lit(P.like_pattern("_50%")), F.lit("\\")) & F.contains("title", F.lit("số 1"))).select("pub_id")


@query("contains_folded", "pub", f" SELECT pub_id, title FROM pub WHERE contains({fold_sql('title')}, 'danh gia')")
def contains_folded(r):
    return r.pub.where(X.contains_folded(F.col("title"), " Đánh Giá ")).select("pub_id", "title")


@query("ilike_substring", "author", " SELECT author_id, scopus_id FROM author WHERE scopus_id ILIKE '%0000012%'")
def ilike_substring(r):
    return r.author.where(P.ilike_literal(F.col("scopus_id"), "0000012")).select("author_id", "scopus_id")


@query("pred_missing_doi", "pub", " SELECT pub_id, doi FROM pub WHERE doi IS NULL OR trim(doi) = ''")
def pred_missing_doi(r):
    return r.pub.where(P.missing_doi(F.col("doi"))).select("pub_id", "doi")


@query("multi_token_and", "lec", f"""
 SELECT lec_id FROM lec WHERE
 (contains({fold_sql('full_name')}, 'le') OR contains({fold_sql('department')}, 'le') OR coalesce(contains({fold_sql('staff_code')}, 'le'), false) OR coalesce(contains({fold_sql('email')}, 'le'), false)) AND
 (contains({fold_sql('full_name')}, 'gv0') OR contains({fold_sql('department')}, 'gv0') OR coalesce(contains({fold_sql('staff_code')}, 'gv0'), false) OR coalesce(contains({fold_sql('email')}, 'gv0'), false))""")
def multi_token_and(r):
    return r.lec.where(P.tokens_all("Lê  GV0", [F.col(c) for c in ("full_name", "department", "staff_code", "email")])).select("lec_id")


@query("role_projection", "over", " SELECT over_id, CASE WHEN state = 'ACTIVE' THEN affiliation END AS affiliation FROM over")
def role_projection(r):
    """What a reader who isn't staff sees: no confidence, and no text of revoked overrides."""
    return r.over.select("over_id", F.when(F.col("state") == "ACTIVE", F.col("affiliation")).alias("affiliation"))


@query("filter_audits", "audit", " SELECT audit_id, action, actor_id FROM audit WHERE action = 'click' AND entity_type = 'lecturer' AND created_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'")
def filter_audits(r):
    when = F.col("created_at").between(F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-01-20 23:59:59'"))
    return r.audit.where((F.col("action") == "click") & (F.col("entity_type") == "lecturer") & when).select("audit_id", "action", "actor_id")


@query("filter_client_publications", "pub pa", f"""
 , first_of AS (SELECT DISTINCT pub_id FROM pa WHERE author_order = 1)
 SELECT pub.pub_id FROM pub SEMI JOIN first_of ON first_of.pub_id = pub.pub_id
 WHERE contains(concat({fold_sql('title')}, ' ', coalesce({fold_sql('source_title')}, '')), 'khoa') AND contains(concat({fold_sql('title')}, ' ', coalesce({fold_sql('source_title')}, '')), 'urgent')
   AND year IS NULL AND cited > 0""")
def filter_client_publications(r):
    held = F.concat_ws(" ", X.folded(F.col("title")), F.coalesce(X.folded(F.col("source_title")), F.lit("")))
    words = P.all_of(*(F.contains(held, F.lit(w)) for w in "khoa urgent".split()))
    firsts = r.pa.where("author_order = 1").select("pub_id")
    return r.pub.where(words & F.col("year").isNull() & (F.col("cited") > 0)).join(firsts, "pub_id", "left_semi").select("pub_id")


@query("filter_identities", "ident author", f" SELECT ident_id, author_id FROM ident JOIN author USING (author_id) WHERE contains({fold_sql('name')}, 'thi') AND contains(scopus_id, '5700000001')")
def filter_identities(r):
    return r.ident.join(r.author, "author_id").where(X.contains_folded(F.col("name"), "Thị") & F.contains("scopus_id", F.lit("5700000001"))).select("ident_id", "author_id")


@query("needs_review_match", "pub author pa", f"""
 SELECT DISTINCT pub_id FROM pub JOIN pa USING (pub_id) JOIN author USING (author_id)
 WHERE contains(scopus_id, 'anh gia') OR contains({fold_sql('title')}, 'danh gia urgent') OR (contains({fold_sql('title')}, 'danh') AND contains({fold_sql('title')}, 'urgent'))""")
def needs_review_match(r):
    x = r.pub.join(r.pa, "pub_id").join(r.author, "author_id")
    phrase = X.contains_folded(F.col("title"), "đánh giá urgent")
    return x.where(F.contains("scopus_id", F.lit("anh gia")) | phrase | P.tokens_all("đánh urgent", [F.col("title")])).select("pub_id").distinct()


@query("search_lecturers", "lec", f" SELECT lec_id, full_name FROM lec WHERE contains({fold_sql('full_name')}, 'hoang') ORDER BY staff_code ASC NULLS LAST, lec_id LIMIT 20")
def search_lecturers(r):
    return page(r.lec.where(X.contains_folded(F.col("full_name"), "hoàng")), [F.asc_nulls_last("staff_code"), F.asc("lec_id")], 20).select("lec_id", "full_name")


@query("search_publications", "pub", f" SELECT pub_id, title, year FROM pub WHERE contains({fold_sql('title')}, 'nghien') ORDER BY year DESC NULLS LAST, pub_id LIMIT 20")
def search_publications(r):
    return page(r.pub.where(X.contains_folded(F.col("title"), "nghiên")), [F.desc_nulls_last("year"), F.asc("pub_id")], 20).select("pub_id", "title", "year")


@query("search_authors", "author", f" SELECT author_id, name FROM author WHERE contains({fold_sql('name')}, 'tran') ORDER BY name, author_id LIMIT 20")
def search_authors(r):
    return page(r.author.where(X.contains_folded(F.col("name"), "TRẦN")), [F.asc("name"), F.asc("author_id")], 20).select("author_id", "name")


@query("topk_search", "lec author", f"""
 SELECT * FROM (SELECT 'lecturer' AS kind, lec_id AS id, full_name AS label FROM lec WHERE contains({fold_sql('full_name')}, 'le') ORDER BY lec_id LIMIT 5)
 UNION ALL SELECT * FROM (SELECT 'author' AS kind, author_id AS id, name AS label FROM author WHERE contains({fold_sql('name')}, 'le') ORDER BY author_id LIMIT 5)""")
def topk_search(r):
    most = max(1, min(20, 5))
    a = page(r.lec.where(X.contains_folded(F.col("full_name"), "Lê")), [F.asc("lec_id")], most).select(F.lit("lecturer").alias("kind"), F.col("lec_id").alias("id"), F.col("full_name").alias("label"))
    b = page(r.author.where(X.contains_folded(F.col("name"), "Lê")), [F.asc("author_id")], most).select(F.lit("author").alias("kind"), F.col("author_id").alias("id"), F.col("name").alias("label"))
    return a.union(b)


@query("filter_lecturers", "lec", f" SELECT lec_id FROM lec WHERE ({fold_sql('full_name')} LIKE '%le_van%' OR lower(staff_code) LIKE '%le_van%' OR lower(email) LIKE '%le_van%') AND faculty = 'Khoa 3'")
def filter_lecturers(r):
    """The pattern isn't escaped here: its % and _ are wildcards."""
    like = lambda c: F.like(c, F.lit("%" + X.fold_text("Lê_văn") + "%"))
    hit = F.coalesce(like(X.folded(F.col("full_name"))), F.lit(False)) | F.coalesce(like(F.lower("staff_code")), F.lit(False)) | F.coalesce(like(F.lower("email")), F.lit(False))
    return r.lec.where(hit & (F.col("faculty") == "Khoa 3")).select("lec_id")


@query("filter_authors", "author", f" SELECT author_id FROM author WHERE scopus_id ILIKE '%th_-_nh%' OR {fold_sql('name')} LIKE '%th_-_nh%'")
def filter_authors(r):
    return r.author.where(F.ilike("scopus_id", F.lit("%th_-_nh%")) | F.like(X.folded(F.col("name")), F.lit("%th_-_nh%"))).select("author_id")


@query("list_users", "lec", " SELECT lec_id, email FROM lec WHERE has_account ORDER BY email ASC NULLS LAST, lec_id LIMIT 50")
def list_users(r):
    return page(r.lec.where("has_account"), [F.asc_nulls_last("email"), F.asc("lec_id")], 50).select("lec_id", "email")


@query("unread_notifications", "audit lec", """
 SELECT lec_id, audit_id FROM audit JOIN lec ON lec_id = entity_id WHERE entity_type = 'lecturer' AND has_account ORDER BY audit_id DESC LIMIT 40""")
def unread_notifications(r):
    x = r.audit.where("entity_type = 'lecturer'").join(r.lec.where("has_account"), F.col("entity_id") == F.col("lec_id"))
    return page(x, [F.desc("audit_id")], 40).select("lec_id", "audit_id")


# ---------------------------------------------------------------- joins
@query("join_inner_chain", "pa author", " SELECT pub_id, author_order, scopus_id, name FROM pa JOIN author USING (author_id)")
def join_inner_chain(r):
    return r.pa.join(r.author, "author_id").select("pub_id", "author_order", "scopus_id", "name")


APPROVED = """
 , gone AS (SELECT lec_id, pub_id FROM (SELECT lec_id, pub_id, max_by(action, seq) AS action FROM excl GROUP BY lec_id, pub_id) WHERE action = 'EXCLUDE'),
 links AS (SELECT DISTINCT ident.lec_id, pa.pub_id, pa.author_id FROM pa JOIN ident ON ident.author_id = pa.author_id AND ident.status = 'APPROVED' JOIN lec ON lec.lec_id = ident.lec_id
   ANTI JOIN gone ON gone.lec_id = ident.lec_id AND gone.pub_id = pa.pub_id)"""


def approved_links(r):
    """Distinct (lec_id, pub_id, author_id) over approved identities, without current exclusions."""
    x = r.pa.join(r.ident.where("status = 'APPROVED'").select("author_id", "lec_id").distinct(), "author_id").join(r.lec.select("lec_id"), "lec_id", "left_semi")
    return x.join(excluded(r.excl), ["lec_id", "pub_id"], "left_anti").select("lec_id", "pub_id", "author_id").distinct()


@query("join_approved_links", "pa ident lec excl", APPROVED + " SELECT lec_id, pub_id, author_id FROM links")
def join_approved_links(r):
    return approved_links(r)


@query("join_batch_links", "pa ident lec excl", APPROVED + " SELECT pub_id, count(*) AS n, string_agg(DISTINCT CAST(lec_id AS VARCHAR), ',' ORDER BY CAST(lec_id AS VARCHAR)) AS lecs FROM links GROUP BY pub_id")
def join_batch_links(r):
    names = F.array_join(F.array_sort(F.collect_set(F.col("lec_id").cast("string"))), ",")
    return approved_links(r).groupBy("pub_id").agg(F.count(F.lit(1)).alias("n"), names.alias("lecs"))


@query("join_provenance", "raw imp pub", " SELECT raw_id, raw.pub_id, sha FROM raw JOIN imp USING (import_id) JOIN pub ON pub.pub_id = raw.pub_id WHERE validation = 'VALID'")
def join_provenance(r):
    return r.raw.where("validation = 'VALID'").join(r.imp, "import_id").join(r.pub.select("pub_id"), "pub_id").select("raw_id", "pub_id", "sha")


@query("join_left_actor", "audit lec", " SELECT audit_id, full_name AS actor FROM audit LEFT JOIN lec ON lec_id = actor_id")
def join_left_actor(r):
    return r.audit.join(r.lec, F.col("lec_id") == F.col("actor_id"), "left").select("audit_id", F.col("full_name").alias("actor"))


@query("join_left_org", "author org", " SELECT author_id, org_name FROM author LEFT JOIN org ON org.org_id = author.org_id AND region_id <> 2")
def join_left_org(r):
    return r.author.join(r.org.where("region_id <> 2"), "org_id", "left").select("author_id", "org_name")


@query("join_history", "cand lec author", " SELECT cand_id, full_name, scopus_id, status FROM cand JOIN lec USING (lec_id) JOIN author USING (author_id) WHERE status <> 'PENDING'")
def join_history(r):
    return r.cand.where("status <> 'PENDING'").join(r.lec, "lec_id").join(r.author, "author_id").select("cand_id", "full_name", "scopus_id", "status")


QUEUE = """
 , ranked AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY completed_at DESC, created_at DESC, obs_id DESC) AS rk FROM obs WHERE run_status = 'COMPLETED'),
 latest AS (SELECT * FROM ranked WHERE rk = 1),
 kinds AS (SELECT obs_id, count(*) FILTER (kind = 'NAME') AS n_name, count(*) FILTER (kind = 'PUBLICATION') AS n_pub FROM evid GROUP BY obs_id),
 per_lec AS (SELECT lec_id, count(*) AS of_lec FROM cand GROUP BY lec_id), per_author AS (SELECT author_id, count(*) AS of_author FROM cand GROUP BY author_id)"""


def latest_observation(r):
    return first_by(r.obs.where("run_status = 'COMPLETED'"), ["cand_id"], [F.desc("completed_at"), F.desc("created_at"), F.desc("obs_id")])


def evidence_counts(r):
    return r.evid.groupBy("obs_id").agg(F.count_if(F.col("kind") == "NAME").alias("n_name"), F.count_if(F.col("kind") == "PUBLICATION").alias("n_pub"))


@query("join_queue", "cand lec author obs evid", QUEUE + """
 SELECT cand_id, obs_id, coalesce(n_name, 0) AS n_name, coalesce(n_pub, 0) AS n_pub, of_lec, of_author
 FROM cand JOIN lec USING (lec_id) JOIN author USING (author_id) JOIN latest USING (cand_id) LEFT JOIN kinds USING (obs_id) JOIN per_lec USING (lec_id) JOIN per_author USING (author_id)
 WHERE status = 'PENDING'""")
def join_queue(r):
    of = lambda key, name: r.cand.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    x = r.cand.where("status = 'PENDING'").join(r.lec.select("lec_id"), "lec_id").join(r.author.select("author_id"), "author_id").join(latest_observation(r).select("cand_id", "obs_id"), "cand_id")
    x = x.join(evidence_counts(r), "obs_id", "left").join(of("lec_id", "of_lec"), "lec_id").join(of("author_id", "of_author"), "author_id")
    return x.select("cand_id", "obs_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_name", "n_pub")], "of_lec", "of_author")


@query("semi_exists_author", "pub pa author", f" SELECT pub_id FROM pub WHERE doi IS NULL OR EXISTS (SELECT 1 FROM pa JOIN author USING (author_id) WHERE pa.pub_id = pub.pub_id AND contains({fold_sql('name')}, 'smith thi-h'))")
def semi_exists_author(r):
    hit = r.pa.join(r.author.where(X.contains_folded(F.col("name"), "smith thị-h")), "author_id").select("pub_id").distinct().withColumn("hit", F.lit(True))
    return r.pub.join(hit, "pub_id", "left").where(F.col("doi").isNull() | F.col("hit").isNotNull()).select("pub_id")


@query("semi_in_subquery", "author cand", " SELECT author_id FROM author WHERE author_id IN (SELECT author_id FROM cand WHERE status = 'ACCEPTED')")
def semi_in_subquery(r):
    return r.author.join(r.cand.where("status = 'ACCEPTED'"), "author_id", "left_semi").select("author_id")


@query("anti_not_in", "lec cand", " SELECT lec_id FROM lec WHERE active AND lec_id NOT IN (SELECT DISTINCT lec_id FROM cand)")
def anti_not_in(r):
    return r.lec.where("active").join(r.cand, "lec_id", "left_anti").select("lec_id")


@query("anti_not_excluded", "pa ident excl", """
 , gone AS (SELECT lec_id, pub_id FROM (SELECT lec_id, pub_id, max_by(action, seq) AS action FROM excl GROUP BY lec_id, pub_id) WHERE action = 'EXCLUDE')
 SELECT DISTINCT lec_id, pub_id FROM pa JOIN ident USING (author_id) ANTI JOIN gone USING (lec_id, pub_id)""")
def anti_not_excluded(r):
    x = r.pa.join(r.ident.select("author_id", "lec_id").distinct(), "author_id").select("lec_id", "pub_id").distinct()
    return x.join(excluded(r.excl), ["lec_id", "pub_id"], "left_anti")


@query("anti_effective_proposal", "excl", " SELECT seq FROM excl p WHERE action = 'INCLUDE' AND NOT EXISTS (SELECT 1 FROM excl v WHERE v.action = 'EXCLUDE' AND v.lec_id = p.lec_id AND v.pub_id = p.pub_id)")
def anti_effective_proposal(r):
    return r.excl.where("action = 'INCLUDE'").join(r.excl.where("action = 'EXCLUDE'"), ["lec_id", "pub_id"], "left_anti").select("seq")


@query("join_usage", "raw imp", """
 , a AS (SELECT import_id, count(*) AS n_raw, count(DISTINCT pub_id) AS n_pubs FROM raw GROUP BY import_id), b AS (SELECT import_id % 90 AS import_id, count(*) AS n_imports FROM imp GROUP BY 1)
 SELECT coalesce(a.import_id, b.import_id) AS import_id, coalesce(n_raw, 0) AS n_raw, coalesce(n_pubs, 0) AS n_pubs, coalesce(n_imports, 0) AS n_imports FROM a FULL JOIN b ON a.import_id = b.import_id""")
def join_usage(r):
    a = r.raw.groupBy("import_id").agg(F.count(F.lit(1)).alias("n_raw"), F.countDistinct("pub_id").alias("n_pubs"))
    b = r.imp.groupBy((F.col("import_id") % 90).alias("import_id")).agg(F.count(F.lit(1)).alias("n_imports"))
    return a.join(b, "import_id", "full_outer").select("import_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_raw", "n_pubs", "n_imports")])


@query("join_self_duplicate_import", "imp", """
 SELECT a.import_id, max_by(b.import_id, (b.moment, b.import_id)) AS duplicate_of FROM imp a JOIN imp b ON a.sha = b.sha AND (b.moment, b.import_id) < (a.moment, a.import_id) GROUP BY a.import_id""")
def join_self_duplicate_import(r):
    """Latest earlier import of the same content: an as-of join on a hash, as the row before in its group."""
    from pyspark.sql import Window

    w = Window.partitionBy("sha").orderBy("moment", "import_id")
    return r.imp.withColumn("duplicate_of", F.lag("import_id").over(w)).where("duplicate_of is not null").select("import_id", "duplicate_of")


@query("join_primary_export", "ident author prim", """
 , last AS (SELECT lec_id, max_by(ident_id, seq) AS ident_id, max_by(action, seq) AS action FROM prim GROUP BY lec_id)
 SELECT ident.ident_id, scopus_id, coalesce(last.ident_id = ident.ident_id AND action = 'SET', false) AS is_primary
 FROM ident JOIN author USING (author_id) LEFT JOIN last ON last.lec_id = ident.lec_id WHERE status = 'APPROVED'""")
def join_primary_export(r):
    last = r.prim.groupBy("lec_id").agg(F.max_by(F.struct("ident_id", "action"), "seq").alias("last"))
    x = r.ident.where("status = 'APPROVED'").join(r.author, "author_id").join(last, "lec_id", "left")
    return x.select("ident_id", "scopus_id", F.coalesce((F.col("last.ident_id") == F.col("ident_id")) & (F.col("last.action") == "SET"), F.lit(False)).alias("is_primary"))


@query("join_lateral_sources", "obs evid", """
 SELECT obs_id, run_status, kind FROM obs JOIN (SELECT obs_id, max_by(kind, evid_id) AS kind FROM evid GROUP BY obs_id) USING (obs_id) WHERE run_id = 3""")
def join_lateral_sources(r):
    r.obs.createOrReplaceTempView("lateral_obs")
    r.evid.createOrReplaceTempView("lateral_evid")
    return r.spark.sql("SELECT obs_id, run_status, kind FROM lateral_obs o, LATERAL (SELECT max_by(kind, evid_id) AS kind FROM lateral_evid e WHERE e.obs_id = o.obs_id) WHERE run_id = 3 AND kind IS NOT NULL")


@query("semi_anti_exists_combo", "lec cand ident excl", """
 SELECT lec_id FROM lec WHERE EXISTS (SELECT 1 FROM cand WHERE cand.lec_id = lec.lec_id AND status = 'REVOKED') AND NOT EXISTS (SELECT 1 FROM ident WHERE ident.lec_id = lec.lec_id AND status = 'APPROVED')
   AND NOT EXISTS (SELECT 1 FROM excl WHERE excl.lec_id = lec.lec_id AND action = 'INCLUDE') AND NOT has_account""")
def semi_anti_exists_combo(r):
    x = r.lec.where("not has_account").join(r.cand.where("status = 'REVOKED'"), "lec_id", "left_semi").join(r.ident.where("status = 'APPROVED'"), "lec_id", "left_anti")
    return x.join(r.excl.where("action = 'INCLUDE'"), "lec_id", "left_anti").select("lec_id")


@query("join_compare_sources", "pub raw", """
 , oldest AS (SELECT pub_id, min_by(title_raw, (created_at, raw_id)) AS title_raw, min_by(cited_raw, (created_at, raw_id)) AS cited_raw FROM raw GROUP BY pub_id)
 SELECT pub.pub_id, title, title_raw FROM pub JOIN oldest USING (pub_id)""")
def join_compare_sources(r):
    oldest = r.raw.groupBy("pub_id").agg(F.min_by("title_raw", F.struct("created_at", "raw_id")).alias("title_raw"))
    return r.pub.join(oldest, "pub_id").select("pub_id", "title", "title_raw")


@query("join_identity_summary", "ident author pa", """
 , n AS (SELECT author_id, count(DISTINCT pub_id) AS n_pubs FROM pa GROUP BY author_id)
 SELECT lec_id, string_agg(scopus_id, ',' ORDER BY scopus_id) AS ids, CAST(sum(coalesce(n_pubs, 0)) AS BIGINT) AS n_pubs
 FROM (SELECT DISTINCT lec_id, author_id FROM ident WHERE status = 'APPROVED') JOIN author USING (author_id) LEFT JOIN n USING (author_id) GROUP BY lec_id""")
def join_identity_summary(r):
    n = r.pa.groupBy("author_id").agg(F.countDistinct("pub_id").alias("n_pubs"))
    x = r.ident.where("status = 'APPROVED'").select("lec_id", "author_id").distinct().join(r.author, "author_id").join(n, "author_id", "left")
    return x.groupBy("lec_id").agg(F.array_join(F.array_sort(F.collect_list("scopus_id")), ",").alias("ids"), F.sum(F.coalesce("n_pubs", F.lit(0))).alias("n_pubs"))


@query("join_candidate_detail", "cand author", """
 SELECT c.cand_id, count(DISTINCT s.cand_id) AS n_siblings, count(DISTINCT h.cand_id) AS n_sharing FROM cand c LEFT JOIN cand s ON s.lec_id = c.lec_id AND s.cand_id <> c.cand_id
 LEFT JOIN cand h ON h.author_id = c.author_id AND h.cand_id <> c.cand_id GROUP BY c.cand_id""")
def join_candidate_detail(r):
    of = lambda key, name: r.cand.groupBy(key).agg((F.count(F.lit(1)) - 1).alias(name))
    return r.cand.join(of("lec_id", "n_siblings"), "lec_id").join(of("author_id", "n_sharing"), "author_id").select("cand_id", "n_siblings", "n_sharing")


@query("join_assignment_check", "lec author", """
 , asked AS (SELECT c_custkey AS line, concat('u', CAST(c_custkey % 900 AS VARCHAR), '@uni.edu.vn') AS email, CAST(57000000000 + c_custkey % 130 AS VARCHAR) AS scopus_id FROM customer),
 by_mail AS (SELECT DISTINCT lower(email) AS email FROM lec WHERE email IS NOT NULL)
 SELECT line, CASE WHEN by_mail.email IS NULL THEN 'MISSING_LECTURER' WHEN author.scopus_id IS NULL THEN 'MISSING_AUTHOR' ELSE 'OK' END AS verdict
 FROM asked LEFT JOIN by_mail ON by_mail.email = asked.email LEFT JOIN author ON author.scopus_id = asked.scopus_id""")
def join_assignment_check(r):
    asked = r.table("customer").selectExpr("c_custkey AS line", "concat('u', cast(c_custkey % 900 as string), '@uni.edu.vn') AS email", "cast(57000000000 + c_custkey % 130 as string) AS scopus_id")
    mails = r.lec.where("email is not null").select(F.lower("email").alias("email")).distinct().withColumn("known", F.lit(True))
    x = asked.join(mails, "email", "left").join(r.author.select("scopus_id", F.lit(True).alias("written")), "scopus_id", "left")
    return x.select("line", F.when(F.col("known").isNull(), "MISSING_LECTURER").when(F.col("written").isNull(), "MISSING_AUTHOR").otherwise("OK").alias("verdict"))


@query("hash_join_doi_title", "pub raw", """
 , known AS (SELECT o_orderkey AS known_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('10.1000/', CAST(o_orderkey * 3 % 16000 AS VARCHAR)) END AS doi, concat('Title ', CAST(o_custkey % 90 AS VARCHAR)) AS title FROM orders),
 by_doi AS (SELECT trim(doi) AS doi, count(*) AS n_doi, min(pub_id) AS doi_pub FROM pub WHERE trim(doi) <> '' GROUP BY 1),
 by_title AS (SELECT lower(title_raw) AS title, count(DISTINCT pub_id) AS n_title, min(pub_id) AS title_pub FROM raw GROUP BY 1)
 SELECT known_id, CASE WHEN n_doi = 1 THEN 'DOI' WHEN n_doi > 1 THEN 'AMBIGUOUS_DOI' WHEN n_title = 1 THEN 'TITLE' WHEN n_title > 1 THEN 'AMBIGUOUS_TITLE' ELSE 'NONE' END AS verdict,
   CASE WHEN n_doi = 1 THEN doi_pub WHEN n_doi IS NULL AND n_title = 1 THEN title_pub END AS pub_id
 FROM known LEFT JOIN by_doi ON by_doi.doi = known.doi LEFT JOIN by_title ON by_title.title = lower(known.title)""")
def hash_join_doi_title(r):
    known = r.table("orders").selectExpr("o_orderkey AS known_id", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('10.1000/', cast(o_orderkey * 3 % 16000 as string)) END AS doi", "concat('Title ', cast(o_custkey % 90 as string)) AS title")
    by_doi = r.pub.select(X.doi_for_matching(F.col("doi")).alias("doi"), "pub_id").where("doi is not null").groupBy("doi").agg(F.count(F.lit(1)).alias("n_doi"), F.min("pub_id").alias("doi_pub"))
    by_title = r.raw.groupBy(X.normalize_title_t0(F.col("title_raw")).alias("key")).agg(F.countDistinct("pub_id").alias("n_title"), F.min("pub_id").alias("title_pub"))
    x = known.withColumn("key", X.normalize_title_t0(F.col("title"))).join(by_doi, "doi", "left").join(by_title, "key", "left")
    verdict = F.when(F.col("n_doi") == 1, "DOI").when(F.col("n_doi") > 1, "AMBIGUOUS_DOI").when(F.col("n_title") == 1, "TITLE").when(F.col("n_title") > 1, "AMBIGUOUS_TITLE").otherwise("NONE")
    return x.select("known_id", verdict.alias("verdict"), F.when(verdict == "DOI", F.col("doi_pub")).when(verdict == "TITLE", F.col("title_pub")).alias("pub_id"))


@query("join_evidence_pairs", "cand pa", " SELECT cand_id, pub_id FROM (SELECT DISTINCT c_custkey % 350 AS lec_id, o_orderkey AS pub_id FROM customer JOIN orders ON o_custkey = c_custkey) known JOIN cand USING (lec_id) JOIN pa USING (pub_id, author_id)")
def join_evidence_pairs(r):
    known = r.table("customer").join(r.table("orders"), F.col("o_custkey") == F.col("c_custkey")).select((F.col("c_custkey") % 350).alias("lec_id"), F.col("o_orderkey").alias("pub_id")).distinct()
    # positions first: a person's publications times their candidates would be far more rows than either
    positions = r.pa.join(r.cand.select("author_id").distinct(), "author_id", "left_semi")
    return known.join(positions, "pub_id").join(r.cand, ["lec_id", "author_id"]).select("cand_id", "pub_id")


@query("join_discovery", "cand pa lec author", f"""
 , known AS (SELECT DISTINCT c_custkey % 350 AS lec_id, o_orderkey AS pub_id FROM customer JOIN orders ON o_custkey = c_custkey),
 new AS (SELECT DISTINCT lec_id, author_id FROM known JOIN pa USING (pub_id) ANTI JOIN cand USING (lec_id, author_id)),
 named AS (SELECT lec_id, author_id, {SURFACE.format(f"regexp_replace(full_name, {TITLE_SQL}, '')")} AS a, {SURFACE.format('name')} AS b FROM new JOIN lec USING (lec_id) JOIN author USING (author_id))
 SELECT lec_id, author_id FROM named WHERE {CORRESPONDS}""")
def join_discovery(r):
    known = r.table("customer").join(r.table("orders"), F.col("o_custkey") == F.col("c_custkey")).select((F.col("c_custkey") % 350).alias("lec_id"), F.col("o_orderkey").alias("pub_id")).distinct()
    found = discovery.discover(known, r.pa, r.lec, r.author, r.cand)
    return found.where("verdict = 'DISCOVERED'").select("lec_id", "author_id").distinct()


@query("join_url_unique", "lec", """
 , by_mail AS (SELECT lower(email) AS email, count(*) AS n, min(lec_id) AS lec_id FROM lec WHERE email IS NOT NULL GROUP BY 1),
 asked AS (SELECT c_custkey AS line, concat('u', CAST(c_custkey % 900 AS VARCHAR), '@uni.edu.vn') AS email FROM customer)
 SELECT line, CASE WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS verdict, CASE WHEN n = 1 THEN lec_id END AS lec_id FROM asked LEFT JOIN by_mail USING (email)""")
def join_url_unique(r):
    index = r.lec.where("email is not null").groupBy(F.lower("email").alias("email")).agg(F.count(F.lit(1)).alias("n"), F.min("lec_id").alias("one"))
    asked = r.table("customer").selectExpr("c_custkey AS line", "concat('u', cast(c_custkey % 900 as string), '@uni.edu.vn') AS email")
    verdict = F.when(F.col("n").isNull(), "NOT_FOUND").when(F.col("n") > 1, "AMBIGUOUS").otherwise("FOUND")
    return asked.join(index, "email", "left").select("line", verdict.alias("verdict"), F.when(F.col("n") == 1, F.col("one")).alias("lec_id"))


ROSTER = """
 , entry AS (SELECT c_custkey AS line, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('GV', lpad(CAST(c_custkey * 2 % 1700 AS VARCHAR), 5, '0')) END AS staff_code,
   CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('u', CAST(c_custkey % 800 AS VARCHAR), '@uni.edu.vn') END AS email FROM customer),
 by_code AS (SELECT staff_code, count(*) AS n_code, min(lec_id) AS code_id FROM lec WHERE staff_code IS NOT NULL GROUP BY 1),
 by_mail AS (SELECT lower(email) AS email, count(*) AS n_mail, min(lec_id) AS mail_id FROM lec WHERE email IS NOT NULL GROUP BY 1),
 resolved AS (SELECT line, CASE WHEN n_code > 1 THEN 'DUPLICATE_STAFF_CODE' WHEN n_code = 1 AND n_mail = 1 AND code_id <> mail_id THEN 'CODE_MAIL_CONFLICT' WHEN n_code = 1 THEN 'BY_CODE'
   WHEN n_mail > 1 THEN 'DUPLICATE_EMAIL' WHEN n_mail = 1 THEN 'BY_MAIL' ELSE 'NEW' END AS verdict, code_id, mail_id
   FROM entry LEFT JOIN by_code USING (staff_code) LEFT JOIN by_mail USING (email))"""


def roster_resolved(r):
    entry = r.table("customer").selectExpr("c_custkey AS line", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('GV', lpad(cast(c_custkey * 2 % 1700 as string), 5, '0')) END AS staff_code", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('u', cast(c_custkey % 800 as string), '@uni.edu.vn') END AS email")
    index = lambda key, name: r.lec.where(key.isNotNull()).groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("lec_id").alias(f"{name}_id"))
    x = entry.join(index(F.col("staff_code"), "code"), F.col("staff_code") == F.col("code"), "left").join(index(F.lower("email"), "mail"), F.col("email") == F.col("mail"), "left")
    verdict = (
        F.when(F.col("n_code") > 1, "DUPLICATE_STAFF_CODE").when((F.col("n_code") == 1) & (F.col("n_mail") == 1) & (F.col("code_id") != F.col("mail_id")), "CODE_MAIL_CONFLICT")
        .when(F.col("n_code") == 1, "BY_CODE").when(F.col("n_mail") > 1, "DUPLICATE_EMAIL").when(F.col("n_mail") == 1, "BY_MAIL").otherwise("NEW")
    )
    return x.select("line", verdict.alias("verdict"), "code_id", "mail_id")


@query("join_roster_resolve", "lec", ROSTER + " SELECT line, verdict FROM resolved")
def join_roster_resolve(r):
    return roster_resolved(r).select("line", "verdict")


@query("join_claim_resolve", "lec", ROSTER + " SELECT verdict, count(*) AS n FROM resolved GROUP BY verdict")
def join_claim_resolve(r):
    return roster_resolved(r).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("join_slot_lookup", "pub pa author", """
 , slot AS (SELECT l_orderkey AS k, concat('2-s2.0-', lpad(CAST(l_orderkey AS VARCHAR), 10, '0')) AS eid, CAST(57000000000 + l_suppkey AS VARCHAR) AS scopus_id, l_linenumber AS author_order FROM lineitem),
 spot AS (SELECT eid, scopus_id, min(author_order) AS found_order FROM pa JOIN pub USING (pub_id) JOIN author USING (author_id) GROUP BY ALL)
 SELECT eid, scopus_id, slot.author_order, CASE WHEN found_order IS NULL THEN 'NO_POSITION' WHEN found_order <> slot.author_order THEN 'ORDER_CHANGED' ELSE 'OK' END AS verdict FROM slot LEFT JOIN spot USING (eid, scopus_id)""")
def join_slot_lookup(r):
    slot = r.table("lineitem").selectExpr("concat('2-s2.0-', lpad(cast(l_orderkey as string), 10, '0')) AS eid", "cast(57000000000 + l_suppkey as string) AS scopus_id", "l_linenumber AS author_order")
    at = r.pa.join(r.pub.select("pub_id", "eid"), "pub_id").join(r.author, "author_id").groupBy("eid", "scopus_id").agg(F.min("author_order").alias("found_order"))
    verdict = F.when(F.col("found_order").isNull(), "NO_POSITION").when(F.col("found_order") != F.col("author_order"), "ORDER_CHANGED").otherwise("OK")
    return slot.join(at, ["eid", "scopus_id"], "left").select("eid", "scopus_id", "author_order", verdict.alias("verdict"))


# ---------------------------------------------------------------- sorting and pages
@query("page_two_stage", "pub pa ident", """
 , mine AS (SELECT DISTINCT pub_id FROM pa JOIN ident USING (author_id) WHERE lec_id = 7 AND status = 'APPROVED'),
 chosen AS (SELECT pub.pub_id, title, year FROM pub JOIN mine USING (pub_id) ORDER BY year DESC NULLS LAST, pub.pub_id LIMIT 10)
 SELECT pub_id, title, year, string_agg(DISTINCT CAST(author_order AS VARCHAR), ',' ORDER BY CAST(author_order AS VARCHAR)) AS orders FROM chosen JOIN pa USING (pub_id) GROUP BY ALL""")
def page_two_stage(r):
    mine = r.pa.join(r.ident.where("lec_id = 7 and status = 'APPROVED'"), "author_id", "left_semi").select("pub_id").distinct()
    chosen = page(r.pub.join(mine, "pub_id", "left_semi"), [F.desc_nulls_last("year"), F.asc("pub_id")], 10).select("pub_id", "title", "year")
    orders = F.array_join(F.array_sort(F.collect_set(F.col("author_order").cast("string"))), ",")
    return chosen.join(r.pa, "pub_id").groupBy("pub_id", "title", "year").agg(orders.alias("orders"))


@query("sort_custom_priority", "lec", """
 SELECT lec_id FROM lec ORDER BY CASE WHEN email IS NULL THEN 0 ELSE 1 END, CASE job WHEN 'DEAN' THEN 0 WHEN 'HEAD' THEN 1 ELSE 2 END, has_account DESC,
  CASE acad_rank WHEN 'GS' THEN 0 WHEN 'PGS' THEN 1 ELSE 2 END, CASE degree WHEN 'TS' THEN 0 WHEN 'ThS' THEN 1 ELSE 2 END, full_name, lec_id LIMIT 100""")
def sort_custom_priority(r):
    rank = lambda c, *words: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for i, w in enumerate(words) for v in (w, i)]), F.coalesce(F.col(c), F.lit(""))), F.lit(len(words)))
    order = [F.when(F.col("email").isNull(), 0).otherwise(1), rank("job", "DEAN", "HEAD"), F.desc("has_account"), rank("acad_rank", "GS", "PGS"), rank("degree", "TS", "ThS"), F.asc("full_name"), F.asc("lec_id")]
    return page(r.lec, order, 100).select("lec_id")


@query("topk_latest_import", "imp", " SELECT import_id, status FROM imp ORDER BY moment DESC, import_id DESC LIMIT 1")
def topk_latest_import(r):
    return page(r.imp, [F.desc("moment"), F.desc("import_id")], 1).select("import_id", "status")


@query("topk_audits", "audit", " SELECT audit_id, action FROM audit ORDER BY created_at DESC, audit_id DESC LIMIT 5")
def topk_audits(r):
    return page(r.audit, [F.desc("created_at"), F.desc("audit_id")], 5).select("audit_id", "action")


@query("sort_locale")
def sort_locale(r):
    """Titles in Vietnamese order (a collation; the oracle has none)."""
    return page(r.pub.withColumn("key", F.collate("title", "vi")), [F.asc("key"), F.asc("pub_id")], 50).select("pub_id", "title")


@query("chunking", "pa pub", " SELECT pub_id, count(*) AS n FROM pa SEMI JOIN (SELECT pub_id FROM pub WHERE year = 1996) USING (pub_id) GROUP BY pub_id")
def chunking(r):
    """What takes lists of ids in chunks elsewhere is one semi-join here."""
    return r.pa.join(r.pub.where("year = 1996").select("pub_id"), "pub_id", "left_semi").groupBy("pub_id").agg(F.count(F.lit(1)).alias("n"))


@query("cap_errors", "raw", " , e AS (SELECT import_id, raw_id, row_number() OVER (PARTITION BY import_id ORDER BY raw_id) AS k FROM raw WHERE validation = 'INVALID') SELECT import_id, string_agg(CAST(raw_id AS VARCHAR), ',' ORDER BY raw_id) AS samples FROM e WHERE k <= 5 GROUP BY import_id")
def cap_errors(r):
    """The first five of each import's errors: the report shows no more. Groups are cut before they are gathered."""
    from ..operators.latest import ranked

    x = ranked(r.raw.where("validation = 'INVALID'"), ["import_id"], [F.asc("raw_id")], "k").where("k <= 5")
    return x.groupBy("import_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("raw_id")), lambda v: v.cast("string")), ",").alias("samples"))


@query("list_imports_union", "imp audit", """
 SELECT * FROM (SELECT 'import' AS kind, import_id AS id, moment AS place FROM imp UNION ALL SELECT 'roster', audit_id, audit_id % 1501 FROM audit WHERE entity_type = 'import' AND action = 'signup') ORDER BY place DESC, kind, id LIMIT 30""")
def list_imports_union(r):
    a = r.imp.select(F.lit("import").alias("kind"), F.col("import_id").alias("id"), F.col("moment").alias("place"))
    b = r.audit.where("entity_type = 'import' and action = 'signup'").select(F.lit("roster").alias("kind"), F.col("audit_id").alias("id"), (F.col("audit_id") % 1501).alias("place"))
    return page(a.unionByName(b), [F.desc("place"), F.asc("kind"), F.asc("id")], 30)
