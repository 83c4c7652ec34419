"""JSON and HTML sources: rosters, author lists of bibliographic services, claim artifacts, profile cards."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# The class of profile cards, and the item properties and data attributes that hold their fields.
CARD_CLASS, LINK, PREFIX, JOB = "gv-card", "url", "honorificPrefix", "jobTitle"
DEGREE_DATA, RANK_DATA, POSITION_DATA = "degree", "rank", "position"

CARD = rf'(?is)(<article\s(?:[^>]*\s)?class="(?:[^"]*\s)?{CARD_CLASS}(?:\s[^"]*)?"[^>]*>.*?</article>)'
AUTHORS_OPENALEX = (
    "array<struct<raw_author_name:string,author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<id:string,display_name:string,ror:string,country_code:string>>,"
    "raw_affiliation_strings:array<string>,affiliations:array<struct<raw_affiliation_string:string,institution_ids:array<string>>>>>"
)
AUTHORS_CROSSREF = "array<struct<given:string,family:string,name:string,ORCID:string,affiliation:array<struct<name:string>>>>"


def cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row a profile card of a page, in order."""
    return pages.select("*", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(CARD), F.lit(1))).alias("card_no", "card")).drop(html)


def tagless(c: Column) -> Column:
    return X.collapse(F.regexp_replace(c, "<[^>]+>", " "))


def honorific(c: Column) -> Column:
    """struct(degree, rank) of a prefix such as "GS – TS"."""
    parts = F.filter(F.transform(F.split(F.translate(c, "–", "-"), "-"), lambda p: F.regexp_replace(F.upper(p), r"^[\s.]+|[\s.]+$", "")), lambda p: p != "")
    last, first = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(1))
    degree = F.when(last == "TS", "TS").when(last == "THS", "ThS").when(last == "KS", "KS").when(last.isin("CN", "DH"), "CN")
    return F.struct(degree.alias("degree"), F.when((F.size(parts) > 1) & first.isin("GS", "PGS"), first).alias("rank"))


def card_fields(df: DataFrame, card: str = "card") -> DataFrame:
    """Name, link, e-mail, degree, rank and position of a card; attributes of the tag stand in for missing parts."""
    get = lambda pattern: F.nullif(F.trim(F.regexp_extract(card, pattern, 1)), F.lit(""))
    inside = lambda key, end: F.nullif(tagless(F.regexp_extract(card, rf'(?is)\sitemprop="{key}"[^>]*>(.*?){end}', 1)), F.lit(""))
    data = lambda name: get(rf'(?i)\sdata-{name}="([^"]*)"')
    prefix = honorific(F.coalesce(inside(PREFIX, "<"), F.lit("")))
    degree = F.expr("CASE {0} WHEN 'gs' THEN 'TS' WHEN 'pgs' THEN 'TS' WHEN 'ts' THEN 'TS' WHEN 'ths' THEN 'ThS' WHEN 'ks' THEN 'KS' WHEN 'cn' THEN 'CN' WHEN 'dh' THEN 'CN' END".format("__degree"))
    link = F.regexp_extract(card, rf'(?is)(<a\s[^>]*\bitemprop="{LINK}"[^>]*>)', 1)  # the link's whole tag; its attributes may stand in any order
    mail = F.coalesce(get(r'(?i)"mailto:([^"?]+)'), get(r"([\w.%+-]+@(?:[\w-]+\.)+[A-Za-z]{2,})"))
    x = df.withColumn("__degree", F.lower(data(DEGREE_DATA))).withColumn("__prefix", prefix)
    rank = F.upper(data(RANK_DATA))
    return x.select(
        *df.columns,
        F.nullif(tagless(F.regexp_extract(card, rf'(?is)<a\s[^>]*\bitemprop="{LINK}"[^>]*>(.*?)</a>', 1)), F.lit("")).alias("full_name"),
        F.nullif(F.trim(F.regexp_extract(link, r'(?i)\shref="([^"]+)"', 1)), F.lit("")).alias("profile_url"),
        F.lower(mail).alias("email"),
        F.coalesce("__prefix.degree", degree).alias("degree"),
        F.coalesce("__prefix.rank", F.when(rank.isin("GS", "PGS"), rank)).alias("acad_rank"),
        F.coalesce(data(POSITION_DATA), inside(JOB, "<")).alias("job"),
    )


def openalex_authors(works: DataFrame, work: str = "work") -> DataFrame:
    """Rows (query_doi, position, name, entity_name, entity_orcid, entries) of a work's JSON; entries pair each raw string with its
    institutions by the source's own pairing, and institutions without one follow alone."""
    a = works.select("query_doi", F.posexplode(F.from_json(F.get_json_object(work, "$.authorships"), AUTHORS_OPENALEX)).alias("pos", "a"))
    none = F.array().cast("array<string>")
    ids = F.coalesce(F.transform("a.institutions", lambda i: i["id"]), none)
    pairs = F.filter(F.transform("a.affiliations", lambda p: F.struct(F.nullif(F.trim(p["raw_affiliation_string"]), F.lit("")).alias("raw"), F.array_intersect(F.coalesce(p["institution_ids"], none), ids).alias("orgs"))), lambda p: p["raw"].isNotNull() | (F.size(p["orgs"]) > 0))
    plain = F.transform(F.filter(F.coalesce("a.raw_affiliation_strings", none), lambda s: F.trim(s) != ""), lambda s: F.struct(s.alias("raw"), none.alias("orgs")))
    entries = F.when(F.size("a.affiliations") > 0, pairs).otherwise(plain)
    left = F.array_except(ids, F.flatten(F.transform(entries, lambda e: e["orgs"])))
    alone = F.transform(left, lambda i: F.struct(F.lit(None).cast("string").alias("raw"), F.array(i).alias("orgs")))
    return a.select("query_doi", (F.col("pos") + 1).alias("position"), F.coalesce("a.raw_author_name", F.lit("")).alias("name"), F.col("a.author.display_name").alias("entity_name"), F.col("a.author.orcid").alias("entity_orcid"), F.concat(entries, alone).alias("entries"))


def crossref_authors(works: DataFrame, work: str = "work") -> DataFrame:
    a = works.select("query_doi", F.posexplode(F.from_json(F.get_json_object(work, "$.author"), AUTHORS_CROSSREF)).alias("pos", "a"))
    whole = F.nullif(F.concat_ws(" ", F.nullif(F.col("a.given"), F.lit("")), F.nullif(F.col("a.family"), F.lit(""))), F.lit(""))
    raws = F.filter(F.transform(F.coalesce(F.col("a.affiliation"), F.array().cast("array<struct<name:string>>")), lambda x: F.trim(x["name"])), lambda s: s != "")
    orcid = F.nullif(F.regexp_extract("a.ORCID", r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", 1), F.lit(""))
    return a.select("query_doi", (F.col("pos") + 1).alias("position"), F.coalesce(whole, "a.name", F.lit("")).alias("name"), orcid.alias("orcid"), raws.alias("affiliations"))


def bundle(lines: DataFrame) -> DataFrame:
    """The last record with a work for each DOI of a JSONL file: rows (line_no, value) to (query_doi, work, retrieved_at)."""
    x = lines.where("trim(value) <> ''").select("line_no", *[F.get_json_object("value", f"$.{c}").alias(c) for c in ("query_doi", "work", "retrieved_at")])
    last = x.where("work is not null").groupBy("query_doi").agg(F.max_by(F.struct("work", "retrieved_at"), "line_no").alias("r"))
    return last.select("query_doi", "r.work", "r.retrieved_at")


def orcid_scopus_ids(records: DataFrame) -> DataFrame:
    """(orcid, scopus_id) from records (orcid, ids: array of struct(type, value, url)): value before url, the first that holds an id."""
    e = records.select("orcid", F.explode("ids").alias("e")).where(F.lower(F.trim("e.type")) == "scopus author id")
    found = lambda c: F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"(\d{6,13})", 1), F.lit(""))
    return e.select("orcid", F.coalesce(found("e.value"), found("e.url")).alias("scopus_id")).where("scopus_id is not null").distinct()


def merge_guide(spark: SparkSession, path: str) -> DataFrame:
    """(email, ids, primary) of a hint file; the last entry of an e-mail counts."""
    raw = spark.read.schema("entries array<struct<email:string,scopus_ids:array<string>,primary_scopus_id:string>>").json(path, multiLine=True)
    e = raw.select(F.posexplode("entries").alias("n", "e")).select("n", F.lower(F.trim("e.email")).alias("email"), F.filter("e.scopus_ids", lambda i: F.rlike(i, F.lit(r"^\d{8,12}$"))).alias("ids"), F.col("e.primary_scopus_id").alias("p"))
    last = e.where("email <> '' and size(ids) > 0").groupBy("email").agg(F.max_by(F.struct("ids", "p"), "n").alias("x"))
    return last.select("email", "x.ids", F.when(F.array_contains("x.ids", F.col("x.p")), F.col("x.p")).alias("primary"))


class ArtifactProblem(ValueError):
    pass


def strict_json(content: bytes):
    """JSON in which repeated keys and floats are errors."""

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise ArtifactProblem("DUPLICATE_JSON_KEY")
        return dict(items)

    def no_float(text):
        raise ArtifactProblem("FLOAT_NOT_ALLOWED")

    try:
        return json.loads(content.decode("utf-8"), object_pairs_hook=pairs, parse_float=no_float, parse_constant=no_float)
    except UnicodeDecodeError:
        raise ArtifactProblem("NOT_UTF8") from None
    except json.JSONDecodeError:
        raise ArtifactProblem("NOT_JSON") from None


ENVELOPE = {"contract", "contract_version", "source_system", "capture", "content"}


def artifact(content: bytes) -> tuple[str | None, str | None, str | None]:
    """(canonical content, digest, error) of a claim artifact."""
    try:
        data = strict_json(content)
        if not isinstance(data, dict):
            raise ArtifactProblem("ARTIFACT_NOT_OBJECT")
        if set(data) - ENVELOPE:
            raise ArtifactProblem("UNKNOWN_ENVELOPE_FIELD")
        if not isinstance(data.get("capture"), dict) or not isinstance(data.get("content"), dict):
            raise ArtifactProblem("INCOMPLETE_ENVELOPE")
    except ArtifactProblem as problem:
        return None, None, str(problem)
    text = json.dumps(data["content"], sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return text, hashlib.sha256(text.encode()).hexdigest(), None


def artifacts(files: DataFrame) -> DataFrame:
    """Rows (path, content, content_sha256, error) of artifact files (path, content): Spark's JSON reader can't see repeated keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(p, *artifact(bytes(c))) for p, c in zip(frame["path"], frame["content"], strict=True)], columns=["path", "content", "content_sha256", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content string, content_sha256 string, error string")


def guide_rows(rows: DataFrame) -> DataFrame:
    """Claims and issues of guide table rows (row_no, email, id_list, primary, declared): distinct ids, repeats, a primary that isn't
    listed and counts that don't agree."""
    ids = X.split_id_list(F.col("id_list"))
    x = rows.withColumn("listed", F.array_distinct(ids)).withColumn("n_all", F.size(ids))
    valid = F.filter("listed", lambda i: F.rlike(i, F.lit(r"^\d{6,15}$")))
    primary = X.blank_to_null(F.col("primary"))
    issue = lambda cond, code: F.when(cond, code)
    issues = F.array_compact(F.array(
        issue(F.size("listed") < F.col("n_all"), "DUPLICATE_ID_IN_ROW"), issue(F.size("listed") == 0, "NO_SCOPUS_ID_LISTED"),
        issue(primary.isNotNull() & ~F.array_contains("listed", primary), "PRIMARY_NOT_IN_LIST"), issue(F.col("declared").isNotNull() & (F.size(valid) != F.col("declared")), "ID_COUNT_MISMATCH"),
    ))
    return x.select("row_no", X.norm_email(F.col("email")).alias("record_key"), valid.alias("ids"), issues.alias("issues"))


def profile_key(source_id: Column, email: Column, content: Column) -> Column:
    """struct(key, strength): source id, else e-mail, else a digest of the content."""
    s, e = X.blank_to_null(source_id), X.norm_email(email)
    return F.struct(F.coalesce(s, e, F.sha2(content, 256)).alias("key"), F.when(s.isNotNull(), "STRONG").when(e.isNotNull(), "MEDIUM").otherwise("WEAK").alias("strength"))


ROSTER = "dataset struct<schema_version:string,record_count:long>, lecturers array<struct<full_name:string,institutional_email:string,staff_code:string,orcid:string,academic_degree:string,academic_rank:string,is_active:boolean,provenance:struct<source_record_id:string>>>"
# The vocabularies of degrees and ranks.
DEGREES, RANKS = ("TS", "ThS", "KS", "CN"), ("GS", "PGS")


def roster(envelopes: DataFrame, value: str = "value") -> DataFrame:
    """Rows (file, line, full_name, email, staff_code, errors) of roster JSON (file, value): vocabularies, mandatory fields, and
    e-mails and staff codes that stand twice in a file. Counts are taken before they are joined."""
    x = envelopes.select("file", F.from_json(value, ROSTER).alias("j"))
    major = F.try_element_at(F.split("j.dataset.schema_version", r"\."), F.lit(1))
    r = x.select("file", major.alias("major"), F.posexplode("j.lecturers").alias("line", "l")).select("file", "major", "line", "l.*").withColumn("email", X.norm_email(F.col("institutional_email")))
    for key in ("email", "staff_code"):
        twice = r.where(F.col(key).isNotNull()).groupBy("file", key).agg(F.count(F.lit(1)).alias(f"n_{key}")).where(f"n_{key} > 1")
        r = r.join(twice, ["file", key], "left")
    bad = lambda c, words: F.col(c).isNotNull() & ~F.col(c).isin(*words)
    rules = (
        (F.col("major") != "1", "UNSUPPORTED_SCHEMA"), (X.blank_to_null(F.col("full_name")).isNull(), "NO_NAME"), (F.col("institutional_email").isNotNull() & F.col("email").isNull(), "EMAIL_INVALID"),
        (bad("academic_degree", DEGREES), "DEGREE_UNKNOWN"), (bad("academic_rank", RANKS), "RANK_UNKNOWN"), (F.col("n_email").isNotNull(), "DUPLICATE_EMAIL"), (F.col("n_staff_code").isNotNull(), "DUPLICATE_STAFF_CODE"),
    )
    errors = F.array_compact(F.array(*[F.when(cond, code) for cond, code in rules]))
    return r.select("file", "line", "full_name", "email", "staff_code", errors.alias("errors"))


def crawl_triplet(people: DataFrame, publications: DataFrame, links: DataFrame) -> DataFrame:
    """Links (lec_source, pub_source) with their publication's title, doi and year, and what is wrong: an unknown id on either side.
    A year counts only if it is four digits."""
    p = people.select(F.col("source_id").alias("lec_source"), F.lit(True).alias("has_lec")).distinct()
    b = publications.select(F.col("source_id").alias("pub_source"), "title", "doi", F.when(F.rlike("year", F.lit(r"^\d{4}$")), F.col("year").cast("int")).alias("year"))
    x = links.join(p, "lec_source", "left").join(b.withColumn("has_pub", F.lit(True)), "pub_source", "left")
    problem = F.when(F.col("has_lec").isNull(), "UNKNOWN_LECTURER").when(F.col("has_pub").isNull(), "UNKNOWN_PUBLICATION")
    return x.select("lec_source", "pub_source", "title", "doi", "year", problem.alias("problem"))


def provenance(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files (path, content) against the digests of several passes (path, pass, sha256): all passes must agree with the bytes."""
    e = expected.groupBy("path").agg(F.count(F.lit(1)).alias("passes"), F.countDistinct("sha256").alias("digests"), F.min("sha256").alias("sha256"))
    x = files.select("path", F.sha2("content", 256).alias("own")).join(e, "path", "left")
    state = F.when(F.col("passes").isNull(), "UNKNOWN_FILE").when(F.col("digests") > 1, "PASSES_DISAGREE").when(F.col("own") != F.col("sha256"), "CONTENT_CHANGED").when(F.col("passes") < 3, "TOO_FEW_PASSES").otherwise("BOUND")
    return x.select("path", state.alias("state"))
