"""What exports hold: affiliation units with their organisations, a row for each author position, gaps, rosters with their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import dealt

JOIN = " | "
POSITION = ["pub_id", "author_order"]
CSV_COLUMNS = ["eid", "doi", "title", "year", "source_title", "author_count", "author_order", "scopus_id", "author_name", "affiliation", "confidence", "source", "evidence_url", "affiliation_status", "gap_reason", "lecturers"]
GAP_COLUMNS = ["eid", "doi", "title", "year", "author_count", "author_order", "scopus_id", "author_name", "affiliation_status", "gap_reason", "by_source", "admin_reviewed", "lecturers"]


def build_units(resolutions: DataFrame, affiliations: DataFrame) -> DataFrame:
    """(res_id, place, text, organizations, confidence, source, evidence_url, label): a unit for each affiliation string of a
    resolution, with the organisations that it names; an entry without a string, an organisation alone, is a unit of its own.

    resolutions: res_id, status, source, work_url, doi; affiliations: res_id, aff_id, raw_index, raw_text, org_name, country. Units
    and their organisations stand in the order of aff_id. label is the source's own words, or else the first organisation.
    """
    own = F.coalesce(F.concat(F.lit("s"), F.col("raw_index").cast("string")), F.concat(F.lit("o"), F.col("aff_id").cast("string")))
    org = F.when(F.col("org_name").isNotNull(), F.struct("aff_id", F.col("org_name").alias("name"), "country"))
    units = affiliations.withColumn("unit", own).groupBy("res_id", "unit").agg(
        F.min("aff_id").alias("place"), F.min_by("raw_text", "aff_id").alias("text"), F.array_sort(F.collect_list(org)).alias("orgs")
    )
    x = units.join(dealt(resolutions.select("res_id", F.col("status").alias("confidence"), "source", X.evidence_url(F.col("work_url"), F.col("doi")).alias("evidence_url"))), "res_id")
    orgs = F.transform("orgs", lambda o: F.struct(o["name"].alias("name"), o["country"].alias("country")))
    label = F.coalesce(F.nullif("text", F.lit("")), F.when(F.size("orgs") > 0, F.col("orgs")[0]["name"]), F.lit(""))
    return x.select("res_id", "place", "text", orgs.alias("organizations"), "confidence", "source", "evidence_url", label.alias("label"))


def part(c: Column) -> Column:
    """A part of a joined cell: the separator inside it is written otherwise, so that the cell can be taken apart again."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit(JOIN), F.lit(" / "))


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(parts, F.array().cast("array<string>")), part), JOIN)


def position_units(units: DataFrame) -> DataFrame:
    """(pub_id, author_order, affiliation, confidence, source, evidence_url): a position's units in one cell a column, all in one order.

    units: pub_id, author_order, rank (order of the unit's resolution among the position's), place, label, confidence, source, evidence_url.
    """
    one = units.groupBy(*POSITION).agg(F.array_sort(F.collect_list(F.struct("rank", "place", "label", "confidence", "source", "evidence_url"))).alias("u"))
    cell = lambda name: joined(F.transform("u", lambda x: x[name]))
    return one.select(*POSITION, cell("label").alias("affiliation"), cell("confidence").alias("confidence"), cell("source").alias("source"), cell("evidence_url").alias("evidence_url"))


def lecturer_cells(lecturers: DataFrame) -> DataFrame:
    """(pub_id, author_order, lecturers) of names (pub_id, author_order, full_name)."""
    return lecturers.groupBy(*POSITION).agg(joined(F.array_sort(F.collect_list("full_name"))).alias("lecturers"))


def export_rows(publications: DataFrame, positions: DataFrame, units: DataFrame, decisions: DataFrame, lecturers: DataFrame) -> DataFrame:
    """CSV_COLUMNS and pub_id: a row for each author position, and one for a publication without authors.

    publications: pub_id, eid, doi, title, year, source_title; positions: pub_id, author_order, scopus_id, author_name; units as
    position_units() takes them; decisions: pub_id, author_order, affiliation_status, gap_reason; lecturers: pub_id, author_order, full_name.
    """
    counts = positions.groupBy("pub_id").agg(F.count(F.lit(1)).alias("author_count"))
    full = positions
    for of_position in (position_units(units), decisions.select(*POSITION, "affiliation_status", "gap_reason"), lecturer_cells(lecturers)):
        full = full.join(dealt(of_position), POSITION, "left")
    x = publications.join(dealt(counts), "pub_id", "left").join(dealt(full), "pub_id", "left")
    has = F.col("author_order").isNotNull()
    cells = [F.when(has, F.coalesce(c, F.lit(""))).alias(c) for c in ("affiliation", "confidence", "source", "evidence_url", "lecturers")]
    return x.select("pub_id", *[F.col(c) for c in CSV_COLUMNS if c not in ("author_count", "affiliation", "confidence", "source", "evidence_url", "lecturers")], F.coalesce("author_count", F.lit(0)).alias("author_count"), *cells).select("pub_id", *CSV_COLUMNS)


def gap_rows(publications: DataFrame, positions: DataFrame, decisions: DataFrame, outcomes: DataFrame, lecturers: DataFrame) -> DataFrame:
    """GAP_COLUMNS and pub_id: a row for each position with a gap. decisions have admin_reviewed too; outcomes: pub_id, author_order,
    source, reason, status, one a source, each shown with its reason or else its status."""
    counts = positions.groupBy("pub_id").agg(F.count(F.lit(1)).alias("author_count"))
    by = outcomes.groupBy(*POSITION).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source", F.coalesce("reason", "status")))), JOIN).alias("by_source"))
    x = decisions.where("gap_reason is not null").join(positions, POSITION).join(publications, "pub_id").join(counts, "pub_id").join(by, POSITION, "left").join(lecturer_cells(lecturers), POSITION, "left")
    return x.select("pub_id", *[F.col("admin_reviewed").cast("string").alias(c) if c == "admin_reviewed" else F.coalesce(c, F.lit("")).alias(c) if c in ("by_source", "lecturers") else F.col(c) for c in GAP_COLUMNS])


def roster_records(lecturers: DataFrame, snapshots: DataFrame, known: DataFrame, ids: DataFrame) -> DataFrame:
    """One record a lecturer whom the source's snapshots name by an id: the lecturer's own fields, source_id and provenance of the
    earliest such snapshot, publications known of them (equal ones once), approved author ids and the main one.

    snapshots: lec_id, snap_id, created_at, source_id, provenance; known: lec_id, known_id, title, title_key, doi, year; ids: lec_id,
    scopus_id, is_main.
    """
    origin = snapshots.where("source_id is not null").groupBy("lec_id").agg(F.min_by(F.struct("source_id", "provenance"), F.struct("created_at", "snap_id")).alias("o"))
    once = known.groupBy("lec_id", "title_key", F.coalesce("doi", F.lit("")).alias("doi_key"), "year").agg(F.min(F.struct("known_id", "title", "doi")).alias("k"))
    pubs = once.groupBy("lec_id").agg(F.array_sort(F.collect_list(F.struct("title_key", F.col("k.known_id").alias("known_id"), F.col("k.title").alias("title"), F.col("k.doi").alias("doi"), "year"))).alias("p"))
    pubs = pubs.select("lec_id", F.transform("p", lambda x: F.struct(x["title"].alias("title_raw"), x["title_key"].alias("title_normalized"), x["doi"].alias("doi_raw"), x["year"].alias("published_year"))).alias("known_publications"))
    linked = ids.groupBy("lec_id").agg(F.array_sort(F.collect_set("scopus_id")).alias("scopus_ids"), F.max(F.when(F.col("is_main"), F.col("scopus_id"))).alias("primary_scopus_id"))
    x = lecturers.join(origin, "lec_id").join(pubs, "lec_id", "left").join(linked, "lec_id", "left")
    empty = pubs.schema["known_publications"].dataType
    return x.select("o.source_id", *[c for c in lecturers.columns if c != "lec_id"], F.coalesce("scopus_ids", F.array().cast("array<string>")).alias("scopus_ids"), "primary_scopus_id", F.col("o.provenance").alias("provenance"), F.coalesce("known_publications", F.array().cast(empty)).alias("known_publications"))
