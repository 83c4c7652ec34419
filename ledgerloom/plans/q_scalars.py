"""Queries: scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .base import fold_sql, query
from .discovery import GENERIC, matching


def digest(c):
    return F.sha2(c, 256)


N0 = "trim(regexp_replace(lower(nfc_normalize({0})), '\\s+', ' ', 'g'))"


def n2(c):
    return f"strip_accents(translate({N0.format(c)}, 'đð', 'dd'))"


def clean(e, pattern):
    return f"trim(regexp_replace(regexp_replace({e}, '{pattern}', ' ', 'g'), '\\s+', ' ', 'g'))"


HYPHEN = clean(n2("{0}"), "[,\\-]")
TITLE_SQL = r"'(?i)^\s*(?:DH\.|GS\.TS\.|PGS\.TS\.|ThS\.|TS\.)(?:\s|$)\s*'"


def unary(key, relation, id_col, column, value, sql):
    """A query (id, value) that applies one function to a column of a relation."""
    query(key, relation, f" SELECT {id_col}, {sql.format(column)} AS value FROM {relation}")(lambda r: getattr(r, relation).select(id_col, value(F.col(column)).alias("value")))


unary("folded", "doc", "doc_id", "text", lambda c: digest(X.folded(c)), f"sha256({fold_sql('{0}')})")
unary("fold_text", "doc", "doc_id", "text", lambda c: digest(X.fold_exact(c)), "sha256(strip_accents(replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), 'đ', 'd')))")
unary("name_n0", "lec", "lec_id", "full_name", X.name_n0, N0)
unary("name_n2", "lec", "lec_id", "full_name", X.name_n2, n2("{0}"))
unary("name_comma", "author", "author_id", "name", X.name_comma, clean(n2("{0}"), ","))
unary("name_hyphen", "author", "author_id", "name", X.name_hyphen, HYPHEN)
unary("name_token_set", "author", "author_id", "name", X.name_token_set, f"CASE WHEN contains({HYPHEN}, ' ') THEN array_to_string(list_sort(string_split({HYPHEN}, ' ')), ' ') ELSE '' END")
unary("title_prefix_has", "lec", "lec_id", "full_name", X.has_title, f"regexp_matches({{0}}, {TITLE_SQL})")
unary("title_prefix_strip", "lec", "lec_id", "full_name", X.strip_title, f"regexp_replace({{0}}, {TITLE_SQL}, '')")
unary("core_name", "lec", "lec_id", "full_name", X.core_name, f"trim(regexp_replace(lower(regexp_replace(regexp_replace({{0}}, {TITLE_SQL}, ''), {TITLE_SQL}, '')), '\\s+', ' ', 'g'))")
TOKENS = f"list_sort(list_filter(regexp_split_to_array(strip_accents(translate(lower(nfc_normalize(regexp_replace({{0}}, '\\(\\s*\\d+\\s*\\)', ' ', 'g'))), 'đ', 'd')), '[^a-z0-9]+'), lambda x: x <> ''))"
unary("name_tokens", "lec", "lec_id", "full_name", lambda c: F.array_join(X.name_tokens(c), " "), f"array_to_string({TOKENS}, ' ')")
unary("normalize_name_variant", "lec", "lec_id", "full_name", X.normalize_name_variant, "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))")
unary("normalize_eid", "raw", "raw_id", "eid_raw", X.normalize_eid, "CASE WHEN trim({0}) <> '' AND NOT regexp_matches(trim({0}), '[ \\t]') THEN trim({0}) END")
unary("normalize_title", "pub", "pub_id", "title", X.normalize_title, "trim(lower({0}))")
unary("normalize_title_t0", "pub", "pub_id", "title", X.normalize_title_t0, N0)
URL_DOI = "CASE WHEN pub_id % 3 = 0 THEN ' HTTPS://doi.org/' || doi WHEN pub_id % 3 = 1 THEN 'doi:' || doi ELSE upper(doi) END"


def doi_query(key, value, sql):
    query(key, "pub", f" , d AS (SELECT pub_id, {URL_DOI} AS doi FROM pub) SELECT pub_id, {sql} AS value FROM d")(lambda r: r.pub.select("pub_id", value(F.expr(URL_DOI)).alias("value")))


doi_query("normalize_doi_n0", X.doi_n0, "nullif(trim(regexp_replace(lower(trim(doi)), '^(?:https?://(?:dx\\.)?doi\\.org/|doi:)', '')), '')")
doi_query("doi_for_matching", X.doi_for_matching, "nullif(trim(regexp_replace(lower(trim(doi)), '^(?:https?://(?:dx\\.)?doi\\.org/|doi:)', '')), '')")
doi_query("doi_plain", X.doi_plain, "nullif(lower(trim(doi)), '')")
doi_query("doi_strict", X.doi_strict, "CASE WHEN regexp_full_match(lower(trim(doi)), '10\\.\\d+/\\S+') THEN lower(trim(doi)) END")

unary("norm_email", "lec", "lec_id", "email", X.norm_email, "CASE WHEN regexp_full_match(lower(trim({0})), '[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{{2,}}') THEN lower(trim({0})) END")
unary("norm_scopus_id", "author", "author_id", "scopus_id", X.norm_scopus_id, "CASE WHEN regexp_full_match(trim({0}), '\\d{{6,15}}') THEN trim({0}) END")
unary("split_semicolon", "doc", "doc_id", "text", lambda c: digest(F.array_join(X.split_semicolon(F.translate(c, ".", ";")), "|")), "sha256(array_to_string(list_transform(string_split(regexp_replace(translate({0}, '.', ';'), '(?:\\s*;\\s*)+$', ''), ';'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '|'))")
unary("split_id_list", "doc", "doc_id", "text", lambda c: digest(F.array_join(X.split_id_list(c), "+")), "sha256(array_to_string(list_filter(regexp_split_to_array({0}, '[\\s,;/|]+'), lambda x: x <> ''), '+'))")


@query("embedded_id", "author", " , n AS (SELECT author_id, CASE WHEN author_id % 3 = 0 THEN name ELSE concat(name, ' (', scopus_id, ') ') END AS x FROM author) SELECT author_id, nullif(regexp_extract(x, '\\((\\d+)\\)\\s*$', 1), '') AS id, trim(regexp_replace(x, '\\(\\d+\\)\\s*$', '')) AS rest FROM n")
def embedded_id(r):
    x = F.expr("CASE WHEN author_id % 3 = 0 THEN name ELSE concat(name, ' (', scopus_id, ') ') END")
    return r.author.select("author_id", X.embedded_id(x).alias("id"), X.without_embedded_id(x).alias("rest"))


@query("scopus_slots", "pub", """
 , l AS (SELECT l_orderkey AS pub_id, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ';') AS ids FROM lineitem GROUP BY l_orderkey),
 s AS (SELECT pub_id, unnest(range(1, len(string_split(ids, ';')) + 1)) AS author_order, unnest(string_split(ids, ';')) AS scopus_id FROM l)
 SELECT pub_id, CAST(author_order AS INTEGER) AS author_order, scopus_id, CASE WHEN CAST(scopus_id AS BIGINT) % 4 = 0 THEN '' ELSE concat('Name ', scopus_id) END AS full_name FROM s""")
def scopus_slots(r):
    """Ids in order; a name belongs to the id in its brackets, wherever it stands in the list of names."""
    ids = r.table("lineitem").groupBy(F.col("l_orderkey").alias("pub_id")).agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("x"))
    raw = ids.select("pub_id", F.array_join("x", ";").alias("ids"), F.array_join(F.transform(F.reverse(F.filter("x", lambda i: i.cast("long") % 4 != 0)), lambda i: F.concat(F.lit("Name "), i, F.lit(" ("), i, F.lit(")"))), "; ").alias("names"))
    return slots(raw)


def slots(raw):
    names = F.map_from_entries(F.array_distinct(F.transform(F.filter(F.split("names", ";"), lambda p: X.embedded_id(p).isNotNull()), lambda p: F.struct(X.embedded_id(p), X.without_embedded_id(p)))))
    at = F.posexplode(F.filter(X.split_semicolon(F.col("ids")), lambda x: x != ""))
    return raw.select("pub_id", names.alias("by_id"), at).select("pub_id", (F.col("pos") + 1).alias("author_order"), F.col("col").alias("scopus_id"), F.coalesce(F.try_element_at("by_id", F.col("col")), F.lit("")).alias("full_name"))


@query("names_match", "lec author", f" SELECT lec_id, author_id, {TOKENS.format('full_name')} = {TOKENS.format('name')} AND len({TOKENS.format('name')}) > 0 AS same FROM lec JOIN author ON author_id = lec_id % 100")
def names_match(r):
    x = r.lec.join(r.author, F.col("author_id") == F.col("lec_id") % 100)
    return x.select("lec_id", "author_id", X.names_match(F.col("full_name"), F.col("name")).alias("same"))


@query("names_compatible")
def names_compatible(r):
    """Initials-aware comparison (an Arrow UDF; tested against listed cases)."""
    x = r.lec.join(r.author, F.col("author_id") == F.col("lec_id") % 100)
    return x.select("lec_id", "author_id", X.names_compatible("full_name", "name").alias("compatible"))


RUSSIAN = "translate(substr(text, 1, 60), 'aeiostnrlmk', 'аеищстнрлжх')"


@query("romanize_cyrillic", "doc", f" SELECT doc_id, replace(replace(replace(translate(replace(lower({RUSSIAN}), 'ß', 'ss'), 'аеистнрл', 'aeistnrl'), 'щ', 'shch'), 'ж', 'zh'), 'х', 'kh') AS value FROM doc")
def romanize_cyrillic(r):
    """Texts' first words, some of their letters written as Russian ones."""
    return r.doc.select("doc_id", X.romanize(F.expr(RUSSIAN)).alias("value"))


SURFACE = f"list_filter(string_split({clean(n2('{0}'), '[,-]')}, ' '), lambda w: length(w) >= 2)"
GENERIC_SQL = "[" + ", ".join(f"'{g}'" for g in GENERIC) + "]"


CORRESPONDS = f"""((a[1] = b[1] AND len(list_filter(a, lambda t: list_contains(b, t) AND t <> a[1] AND NOT list_contains({GENERIC_SQL}, t))) > 0)
  OR (a[1] <> b[1] AND list_contains(b, a[1]) AND len(list_filter(a, lambda t: NOT list_contains({GENERIC_SQL}, t))) > 0
   AND len(list_filter(a, lambda t: NOT list_contains({GENERIC_SQL}, t) AND NOT list_contains(b, t))) = 0))"""


@query("name_correspondence", "lec author", f"""
 , p AS (SELECT lec_id, {SURFACE.format(f"regexp_replace(full_name, {TITLE_SQL}, '')")} AS a FROM lec), q AS (SELECT author_id, {SURFACE.format('name')} AS b FROM author)
 SELECT lec_id, author_id FROM p CROSS JOIN q WHERE {CORRESPONDS}""")
def name_correspondence(r):
    """All people against all authors."""
    return matching(r.lec.select("lec_id", "full_name"), r.author.select("author_id", "name"))


@query("orcid_checksum", "lec", """
 , o AS (SELECT lec_id, lpad(CAST(lec_id * 7919 % 1000000000000000 AS VARCHAR), 15, '0') AS d FROM lec),
 t AS (SELECT lec_id, d, list_reduce(list_transform(range(1, 16), lambda i: CAST(d[i] AS BIGINT)), lambda acc, x: (acc + x) * 2, CAST(0 AS BIGINT)) AS total FROM o),
 c AS (SELECT lec_id, d, CASE WHEN (12 - total % 11) % 11 = 10 THEN 'X' ELSE CAST((12 - total % 11) % 11 AS VARCHAR) END AS want, CASE WHEN lec_id % 2 = 0 THEN '3' ELSE CASE WHEN (12 - total % 11) % 11 = 10 THEN 'X' ELSE CAST((12 - total % 11) % 11 AS VARCHAR) END END AS got FROM t)
 SELECT lec_id, want = got AS valid FROM c""")
def orcid_checksum(r):
    d = F.lpad((F.col("lec_id") * 7919 % 1000000000000000).cast("string"), 15, "0")
    full = lambda last: F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 4), F.lit("-"), F.substring(d, 9, 4), F.lit("-"), F.substring(d, 13, 3), last)
    last = F.when(F.col("lec_id") % 2 == 0, "3").otherwise(X.orcid_last(d))
    return r.lec.select("lec_id", X.orcid_check(full(last)).alias("valid"))


@query("norm_orcid", "lec", " , o AS (SELECT lec_id, concat(CASE WHEN lec_id % 2 = 0 THEN 'https://orcid.org/' ELSE ' ' END, '0000-0001-', lpad(CAST(lec_id AS VARCHAR), 4, '0'), '-123', CASE WHEN lec_id % 3 = 0 THEN 'x' ELSE '4' END) AS o FROM lec) SELECT lec_id, nullif(regexp_extract(upper(o), '(\\d{4}-\\d{4}-\\d{4}-\\d{3}[\\dX])$', 1), '') AS value FROM o")
def norm_orcid(r):
    o = F.expr("concat(CASE WHEN lec_id % 2 = 0 THEN 'https://orcid.org/' ELSE ' ' END, '0000-0001-', lpad(cast(lec_id as string), 4, '0'), '-123', CASE WHEN lec_id % 3 = 0 THEN 'x' ELSE '4' END)")
    return r.lec.select("lec_id", F.nullif(F.regexp_extract(F.upper(o), r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])$", 1), F.lit("")).alias("value"))


RAW_NUMBER = "CASE pub_id % 6 WHEN 0 THEN ' 12.9' WHEN 1 THEN '-3.7' WHEN 2 THEN 'x1' WHEN 3 THEN '1e3' WHEN 4 THEN '99999999999' ELSE cast(pub_id as string) END"


@query("raw_int", "pub", f" , x AS (SELECT pub_id, try_cast(trim({RAW_NUMBER}) AS DOUBLE) AS d FROM pub) SELECT pub_id, CASE WHEN abs(d) < 2147483648 THEN CAST(trunc(d) AS INTEGER) END AS value FROM x")
def raw_int(r):
    return r.pub.select("pub_id", X.raw_int(F.trim(F.expr(RAW_NUMBER))).alias("value"))


@query("bounded", "pub", " SELECT pub_id, substr(nullif(trim(concat(coalesce(source_title, ''), ' ', title)), ''), 1, 20) AS value FROM pub")
def bounded(r):
    return r.pub.select("pub_id", X.bounded(F.concat(F.coalesce("source_title", F.lit("")), F.lit(" "), "title"), 20).alias("value"))


@query("compare_status", "pub", """
 , x AS (SELECT pub_id, CASE WHEN pub_id % 5 = 0 THEN doi WHEN pub_id % 5 = 1 THEN concat('https://doi.org/', doi) ELSE upper(concat(doi, 'A')) END AS raw, CASE WHEN pub_id % 5 < 3 THEN doi ELSE concat(doi, 'b') END AS stored FROM pub),
 y AS (SELECT *, nullif(trim(regexp_replace(lower(trim(raw)), '^(?:https?://(?:dx\\.)?doi\\.org/|doi:)', '')), '') AS canonical FROM x)
 SELECT pub_id, CASE WHEN raw IS NULL AND stored IS NULL THEN 'MISSING' WHEN trim(coalesce(raw, '')) <> coalesce(stored, '') THEN CASE WHEN canonical IS NOT NULL AND canonical = stored THEN 'CLEANED' ELSE 'CHANGED' END
   WHEN canonical IS NOT NULL AND canonical <> coalesce(stored, '') THEN 'CLEANED' ELSE 'SAME' END AS status FROM y""")
def compare_status(r):
    x = r.pub.selectExpr("pub_id", "CASE WHEN pub_id % 5 = 0 THEN doi WHEN pub_id % 5 = 1 THEN concat('https://doi.org/', doi) ELSE upper(concat(doi, 'A')) END AS raw", "CASE WHEN pub_id % 5 < 3 THEN doi ELSE concat(doi, 'b') END AS stored")
    return x.select("pub_id", raw_vs_stored(F.col("raw"), F.col("stored"), X.doi_n0(F.col("raw"))).alias("status"))


def raw_vs_stored(raw, stored, canonical):
    kept, form = F.coalesce(stored, F.lit("")), F.coalesce(canonical, F.lit("\0"))
    changed = X.strip(F.coalesce(raw, F.lit(""))) != kept
    return F.when(raw.isNull() & stored.isNull(), "MISSING").when(changed, F.when(form == kept, "CLEANED").otherwise("CHANGED")).when(canonical.isNotNull() & (canonical != kept), "CLEANED").otherwise("SAME")


@query("compare_metadata", "pub raw", """
 SELECT raw_id, concat_ws(',', CASE WHEN title IS DISTINCT FROM title_raw THEN 'title' END, CASE WHEN CAST(cited AS VARCHAR) IS DISTINCT FROM cited_raw THEN 'cited' END, CASE WHEN eid IS DISTINCT FROM trim(eid_raw) THEN 'eid' END) AS changed FROM raw JOIN pub USING (pub_id)""")
def compare_metadata(r):
    pairs = (("title", F.col("title_raw")), ("cited", F.col("cited_raw")), ("eid", F.trim("eid_raw")))
    changed = F.array_compact(F.array(*[F.when(~F.col(c).cast("string").eqNullSafe(v), c) for c, v in pairs]))
    return r.raw.join(r.pub, "pub_id").select("raw_id", F.array_join(changed, ",").alias("changed"))


@query("evidence_url_for", "pub", " SELECT pub_id, coalesce(CASE WHEN pub_id % 4 = 0 THEN 'https://x.org/1' END, CASE WHEN trim(doi) <> '' THEN concat('https://doi.org/', trim(doi)) END) AS url FROM pub")
def evidence_url_for(r):
    return r.pub.select("pub_id", X.evidence_url(F.expr("CASE WHEN pub_id % 4 = 0 THEN 'https://x.org/1' END"), F.col("doi")).alias("url"))


#: How an institution's name may be written: pairs of folded phrases that stand together, and its acronym as a word.
INSTITUTION = ((("cong nghe thong tin", "truyen thong"), ("information and communication technology", "ha long")), "vktu")


def is_institution(c, names=INSTITUTION):
    """Whether a text names the institution, in either language or by its acronym; its names are a parameter."""
    pairs, acronym = names
    plain = X.folded(c)
    found = F.rlike(plain, F.lit(rf"\b{acronym}\b"))
    for a, b in pairs:
        found = found | (F.contains(plain, F.lit(a)) & F.contains(plain, F.lit(b)))
    return F.coalesce(found, F.lit(False))


@query("is_institution_text", "res", f" SELECT res_id, author_order, pub_id, regexp_matches({fold_sql('affiliation')}, '\\bvktu\\b') AS named FROM res")
def is_institution_text(r):
    return r.res.select("res_id", "author_order", "pub_id", is_institution(F.col("affiliation")).alias("named"))


@query("evidence_basis", "evid", """
 , x AS (SELECT obs_id % 500 AS ident_id, CASE kind WHEN 'MANUAL' THEN 'ORCID_EXACT' WHEN 'PUBLICATION' THEN 'DOI_EXACT' WHEN 'NAME' THEN 'NAME_SIMILARITY' ELSE 'AFFILIATION_MATCH' END AS t, evid_id % 6 <> 0 AS supports FROM evid),
 g AS (SELECT ident_id, count(*) FILTER (t = 'ORCID_EXACT' AND supports) AS a, count(*) FILTER (t = 'DOI_EXACT' AND supports) AS b, count(*) FILTER (t = 'NAME_SIMILARITY' AND supports) AS c, count(*) FILTER (NOT supports) AS d FROM x GROUP BY 1)
 SELECT ident_id, CASE WHEN a > 0 THEN 'IDENTIFIER_SUPPORT' WHEN b > 0 THEN 'PUBLICATION_SUPPORT' WHEN c > 0 THEN 'NAME_ONLY' ELSE 'NO_RECORDED_EVIDENCE' END AS level, a > 0 AND d = 0 AS verified FROM g""")
def evidence_basis(r):
    kind = F.expr("CASE kind WHEN 'MANUAL' THEN 'ORCID_EXACT' WHEN 'PUBLICATION' THEN 'DOI_EXACT' WHEN 'NAME' THEN 'NAME_SIMILARITY' ELSE 'AFFILIATION_MATCH' END")
    x = r.evid.select((F.col("obs_id") % 500).alias("ident_id"), kind.alias("t"), (F.col("evid_id") % 6 != 0).alias("supports"))
    n = lambda *t: F.count_if(F.col("t").isin(*t) & F.col("supports"))
    g = x.groupBy("ident_id").agg(n("ORCID_EXACT").alias("a"), n("DOI_EXACT", "PUBLICATION_OVERLAP", "COAUTHOR_CONFIRMED").alias("b"), n("NAME_SIMILARITY").alias("c"), F.count_if(~F.col("supports")).alias("d"))
    level = F.when(F.col("a") > 0, "IDENTIFIER_SUPPORT").when(F.col("b") > 0, "PUBLICATION_SUPPORT").when(F.col("c") > 0, "NAME_ONLY").otherwise("NO_RECORDED_EVIDENCE")
    return g.select("ident_id", level.alias("level"), ((F.col("a") > 0) & (F.col("d") == 0)).alias("verified"))


@query("needs_review_kind", "res", """
 , g AS (SELECT pub_id, author_order, bool_or(status = 'VERIFIED') AS v, bool_or(status = 'UNRESOLVED') AS u, bool_and(status = 'UNRESOLVED') AS only_u, coalesce(bool_or(reason IN ('ID_CONFLICT', 'ID_AMBIGUOUS', 'POSITION_CLAIMED_BY_OTHER_ID')), false) AS c FROM res GROUP BY ALL)
 SELECT pub_id, author_order, CASE WHEN (v AND u) OR c THEN 'CONFLICTING_SOURCES' WHEN only_u THEN 'UNRESOLVED' ELSE 'LOW_CONFIDENCE' END AS kind FROM g""")
def needs_review_kind(r):
    return review_kind(r.res)


def review_kind(resolutions):
    is_ = lambda s: F.col("status") == s
    conflict = F.coalesce(F.bool_or(F.col("reason").isin("ID_CONFLICT", "ID_AMBIGUOUS", "POSITION_CLAIMED_BY_OTHER_ID")), F.lit(False))
    g = resolutions.groupBy("pub_id", "author_order").agg(F.bool_or(is_("VERIFIED")).alias("v"), F.bool_or(is_("UNRESOLVED")).alias("u"), F.bool_and(is_("UNRESOLVED")).alias("only"), conflict.alias("c"))
    kind = F.when(F.expr("(v and u) or c"), "CONFLICTING_SOURCES").when(F.col("only"), "UNRESOLVED").otherwise("LOW_CONFIDENCE")
    return g.select("pub_id", "author_order", kind.alias("kind"))


@query("canonical_json", "cand", " SELECT cand_id, sha256(concat('{\"author_id\":', author_id, ',\"lec_id\":', lec_id, ',\"status\":', CASE WHEN cand_id % 3 = 0 THEN 'null' ELSE concat('\"', status, '\"') END, '}')) AS digest FROM cand")
def canonical_json(r):
    """Keys in order, no spaces, nulls kept."""
    x = r.cand.select("cand_id", "author_id", "lec_id", F.when(F.col("cand_id") % 3 != 0, F.col("status")).alias("status"))
    return x.select("cand_id", F.sha2(F.to_json(F.struct("author_id", "lec_id", "status"), {"ignoreNullFields": "false"}), 256).alias("digest"))


@query("sha256_json", "cand", " SELECT sha256(string_agg(concat('{\"cand_id\":', cand_id, ',\"status\":\"', status, '\"}'), ',' ORDER BY cand_id)) AS digest, lec_id FROM cand GROUP BY lec_id")
def sha256_json(r):
    """Digest of each person's candidates as one canonical list."""
    x = r.cand.groupBy("lec_id").agg(F.array_sort(F.collect_list(F.struct("cand_id", "status"))).alias("l"))
    return x.select(F.sha2(F.array_join(F.transform("l", lambda e: F.to_json(e)), ","), 256).alias("digest"), "lec_id")


@query("text_getters", "pub", " SELECT pub_id, nullif(trim(doc_type), '') AS doc_type, nullif(trim(stage), '') AS stage FROM pub")
def text_getters(r):
    return r.pub.select("pub_id", X.blank_to_null(F.col("doc_type")).alias("doc_type"), X.blank_to_null(F.col("stage")).alias("stage"))


@query("payload_hash_ascii")
def payload_hash_ascii(r):
    """Digest of JSON in which letters beyond ASCII are escaped (Spark's JSON has no such form, so an Arrow UDF)."""
    return r.pub.select("pub_id", X.title_payload_hash("title").alias("digest"))


@query("json_path", "audit", " SELECT audit_id, CAST(props->>'$.k' AS BIGINT) AS k FROM audit")
def json_path(r):
    return r.audit.select("audit_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("progress_percent", "imp", " SELECT import_id, CAST(round_even(100.0 * (import_id % 9) / (import_id % 8 + 8), 0) AS INTEGER) AS percent FROM imp")
def progress_percent(r):
    return r.imp.select("import_id", F.bround(F.expr("100.0D * (import_id % 9) / (import_id % 8 + 8)"), 0).cast("int").alias("percent"))


@query("reason_triggers", "cand evid", """
 , live AS (SELECT * FROM cand WHERE status IN ('PENDING', 'ACCEPTED')), a AS (SELECT author_id, count(*) AS na FROM live GROUP BY 1), l AS (SELECT lec_id, count(*) AS nl FROM live GROUP BY 1),
 p AS (SELECT DISTINCT obs_id AS cand_id FROM evid WHERE kind = 'PUBLICATION')
 SELECT cand_id, concat_ws(',', CASE WHEN p.cand_id IS NULL THEN 'NAME_ONLY' END, CASE WHEN na > 1 THEN 'SHARED' END, CASE WHEN nl > 1 THEN 'MULTIPLE' END) AS triggers
 FROM cand LEFT JOIN a USING (author_id) LEFT JOIN l USING (lec_id) LEFT JOIN p USING (cand_id)""")
def reason_triggers(r):
    live = r.cand.where("status in ('PENDING', 'ACCEPTED')")
    n = lambda k, name: live.groupBy(k).agg(F.count(F.lit(1)).alias(name))
    p = r.evid.where("kind = 'PUBLICATION'").select(F.col("obs_id").alias("cand_id")).distinct().withColumn("p", F.lit(True))
    x = r.cand.join(n("author_id", "na"), "author_id", "left").join(n("lec_id", "nl"), "lec_id", "left").join(p, "cand_id", "left")
    found = F.array_compact(F.array(F.when(F.col("p").isNull(), "NAME_ONLY"), F.when(F.col("na") > 1, "SHARED"), F.when(F.col("nl") > 1, "MULTIPLE")))
    return x.select("cand_id", F.array_join(found, ",").alias("triggers"))


@query("year_valid", "pub", " SELECT pub_id, year IS NULL OR year - 1995 BETWEEN 1 AND 3 OR year BETWEEN 9999 AND 1000 AS ok FROM pub")
def year_valid(r):
    """NULL or four digits; here shifted so that some fail."""
    return r.pub.select("pub_id", X.year_valid(F.when(F.col("year").between(1996, 1998), F.col("year")).when(F.col("year").isNull(), None).otherwise(F.col("year") * 10)).alias("ok"))


@query("profile_validate", "lec", """
 , x AS (SELECT lec_id, CASE lec_id % 4 WHEN 0 THEN 'https://uni.edu.vn/u' WHEN 1 THEN 'ftp://uni.edu.vn' WHEN 2 THEN 'https://me:pw@uni.edu.vn' ELSE 'http://a b.vn' END AS url, DATE '1990-01-01' + CAST(lec_id % 20000 * 20 AS INTEGER) AS born FROM lec)
 SELECT lec_id, regexp_full_match(url, 'https?://[^\\s@/]+(?:/\\S*)?') AS url_ok, born <= DATE '2026-01-01' AS born_ok FROM x""")
def profile_validate(r):
    url = F.expr("CASE lec_id % 4 WHEN 0 THEN 'https://uni.edu.vn/u' WHEN 1 THEN 'ftp://uni.edu.vn' WHEN 2 THEN 'https://me:pw@uni.edu.vn' ELSE 'http://a b.vn' END")
    born = F.expr("date_add(DATE '1990-01-01', cast(lec_id % 20000 * 20 as int))")
    return r.lec.select("lec_id", F.rlike(url, F.lit(r"^https?://[^\s@/]+(?:/\S*)?$")).alias("url_ok"), (born <= F.expr("DATE '2026-01-01'")).alias("born_ok"))


@query("assess_fit", "cand evid", """
 , e AS (SELECT obs_id AS cand_id, count(*) FILTER (kind = 'NAME') AS n, count(*) FILTER (kind = 'PUBLICATION') AS p, count(*) FILTER (kind = 'AFFILIATION') AS f FROM evid GROUP BY 1),
 a AS (SELECT author_id, count(*) AS na FROM cand GROUP BY 1), l AS (SELECT lec_id, count(*) AS nl FROM cand GROUP BY 1),
 x AS (SELECT cand_id, coalesce(n, 0) > 0 AS named, coalesce(p, 0) > 0 AS supported, coalesce(f, 0) > 0 AS affiliated, na > 12 AS shared, nl > 4 AS many FROM cand JOIN a USING (author_id) JOIN l USING (lec_id) LEFT JOIN e USING (cand_id))
 SELECT cand_id, CASE WHEN supported AND affiliated AND NOT shared THEN 'HIGH' WHEN supported OR (affiliated AND named) THEN 'MEDIUM' WHEN named OR affiliated THEN 'LOW' ELSE 'INSUFFICIENT' END AS level,
  concat_ws(',', CASE WHEN supported THEN 'PUBLICATION_SUPPORT' END, CASE WHEN affiliated THEN 'INSTITUTION_AFFILIATION' END, CASE WHEN named THEN 'NAME_MATCH' END, CASE WHEN named AND NOT supported AND NOT affiliated THEN 'NAME_ONLY' END,
   CASE WHEN shared THEN 'SHARED_ID' END, CASE WHEN many THEN 'MULTIPLE_IDS_FOR_LECTURER' END) AS reasons FROM x""")
def assess_fit(r):
    of = lambda k: F.count_if(F.col("kind") == k)
    e = r.evid.groupBy(F.col("obs_id").alias("cand_id")).agg(of("NAME").alias("n"), of("PUBLICATION").alias("p"), of("AFFILIATION").alias("f"))
    n = lambda k, name: r.cand.groupBy(k).agg(F.count(F.lit(1)).alias(name))
    x = r.cand.join(n("author_id", "na"), "author_id").join(n("lec_id", "nl"), "lec_id").join(e, "cand_id", "left")
    x = x.select("cand_id", *[(F.coalesce(c, F.lit(0)) > 0).alias(v) for c, v in (("n", "named"), ("p", "supported"), ("f", "affiliated"))], (F.col("na") > 12).alias("shared"), (F.col("nl") > 4).alias("many"))
    return x.select("cand_id", *fit(x))


def fit(x):
    """(level, reasons) from the flags named, supported, affiliated, shared and many."""
    e = F.expr
    level = F.when(e("supported and affiliated and not shared"), "HIGH").when(e("supported or (affiliated and named)"), "MEDIUM").when(e("named or affiliated"), "LOW").otherwise("INSUFFICIENT")
    codes = (("supported", "PUBLICATION_SUPPORT"), ("affiliated", "INSTITUTION_AFFILIATION"), ("named", "NAME_MATCH"), ("named and not supported and not affiliated", "NAME_ONLY"), ("shared", "SHARED_ID"), ("many", "MULTIPLE_IDS_FOR_LECTURER"))
    return level.alias("level"), F.array_join(F.array_compact(F.array(*[F.when(e(c), v) for c, v in codes])), ",").alias("reasons")
