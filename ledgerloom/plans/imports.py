"""Plans of writes that are decided before anything is written: resolutions of author positions, corrections of source titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import kept
from .affiliations import CONFLICTS, TRUSTED

# The method that each kind of trusted link is made by.
METHODS = {"VERIFIED": "ORCID_SCOPUS_ID_BRIDGE", "CORROBORATED": "POSITION_COUNT_NAME"}
#: What two resolutions with one key must share to be the same.
CONTENT = ["status", "method", "reason", "presence", "position", "orcid", "work_id", "source_doi", "entries"]


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def input_fault() -> Column:
    """The first of six faults that an input has in itself, or null."""
    expected = F.when(F.col("status") == "VERIFIED", METHODS["VERIFIED"]).otherwise(METHODS["CORROBORATED"])
    unresolved = F.when(F.size("entries") > 0, "UNRESOLVED_WITH_AFFILIATION").when(blank("reason") | ~blank("method"), "INVALID_UNRESOLVED")
    trusted = (
        F.when(~F.col("method").eqNullSafe(expected), "INVALID_LINK_METHOD")
        .when(~blank("reason") | F.col("position").isNull() | F.col("retrieved_at").isNull(), "INVALID_TRUSTED_LINK")
        .when((F.col("status") == "VERIFIED") & blank("orcid"), "VERIFIED_WITHOUT_IDENTIFIER")
    )
    known = F.coalesce(F.col("status").isin(*TRUSTED, "UNRESOLVED"), F.lit(False))
    return F.when(~known, "INVALID_LINK_STATUS").when(F.col("status") == "UNRESOLVED", unresolved).otherwise(trusted)


def plan_resolutions(inputs: DataFrame, slots: DataFrame, existing: DataFrame) -> DataFrame:
    """(seq, outcome, pa_id, status): what an import does with each input, and the status that it would write.

    inputs: seq (of an ordered type, a different one each), eid, scopus_id, author_order, doi, source, payload_sha256, retrieved_at and CONTENT;
    slots: eid, scopus_id, pa_id, slot_order, pub_doi, of which the least pa_id counts where an author stands twice in a paper;
    existing: pa_id, source, payload_sha256 (each once) and CONTENT; sources and digests aren't null. Links that another source contradicts are withheld first.
    Then come faults of the input, its position, inputs before it with the same key, and what exists under that key.

    The first input of a key is found by an aggregate and joined back, so that a key with many inputs isn't one task's work;
    inputs that have failed before get no key and are spread by their seq. The inputs are read twice, so they had better be a table.
    They are wide, so they meet places and contradictions in one join, and their early faults are worked out once and kept in columns.
    """
    at = ["eid", "scopus_id"]
    places = slots.groupBy(*at).agg(F.min(F.struct("pa_id", "slot_order", "pub_doi")).alias("slot"))
    culprits = inputs.where(F.col("reason").isin(*CONFLICTS)).groupBy(*at).agg(F.collect_set("author_order").alias("contradicted"))
    x = inputs.join(places.join(culprits, at, "full"), at, "left").select(*inputs.columns, "slot.*", "contradicted")
    held = F.coalesce(F.array_contains("contradicted", F.col("author_order")) & F.col("status").isin(*TRUSTED), F.lit(False))
    x = x.withColumn("held", held).withColumns({
        "reason": F.when(F.col("held"), "WITHHELD_SOURCE_CONFLICT").otherwise(F.col("reason")), "status": F.when(F.col("held"), "UNRESOLVED").otherwise(F.col("status")),
        "method": F.when(~F.col("held"), F.col("method")), "entries": F.when(F.col("held"), F.slice("entries", 1, 0)).otherwise(F.col("entries")),
    })
    folded = lambda c: F.lower(X.strip(F.coalesce(F.col(c), F.lit(""))))
    early = F.coalesce(
        input_fault(),
        F.when(F.col("pa_id").isNull(), "AUTHOR_POSITION_NOT_FOUND")
        .when(~F.col("slot_order").eqNullSafe(F.col("author_order")), "AUTHOR_ORDER_MISMATCH")
        .when(~blank("doi") & (folded("doi") != folded("pub_doi")), "DOI_MISMATCH"),
    )
    key = ["spread", "pa_id", "source", "payload_sha256"]
    x = x.select("seq", "pa_id", "source", "payload_sha256", "status", "held", F.struct(*CONTENT).alias("content"), early.alias("early"))
    x = kept(x).withColumn("spread", F.when(F.col("early").isNotNull(), F.xxhash64("seq")).otherwise(F.lit(0)))
    first = x.where("early is null").groupBy(*key).agg(F.min("seq").alias("first_seq"), F.min_by("content", "seq").alias("first_content"))
    # a zero that isn't a constant: with one, Spark would join by the other three columns and shuffle all inputs once more
    old = existing.select((F.col("pa_id") - F.col("pa_id")).cast("long").alias("spread"), *key[1:], F.struct(*CONTENT).alias("old"))
    x = x.join(first, key, "left").join(old, key, "left")
    again = F.col("seq") != F.col("first_seq")
    outcome = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(again & F.col("content").eqNullSafe(F.col("first_content")), "DUPLICATE_INPUT").when(again, "DUPLICATE_KEY_DIFFERENT_CONTENT")
        .when(F.col("old").isNotNull(), F.when(F.col("old").eqNullSafe(F.col("content")), "REUSED").otherwise("EXISTING_DIFFERENT_CONTENT"))
        .when(F.col("held"), "WITHHELD_SOURCE_CONFLICT").otherwise("INSERTED")
    )
    return x.select("seq", outcome.alias("outcome"), "pa_id", "status")


def correction_plan(publications: DataFrame, raws: DataFrame, wrong: str) -> DataFrame:
    """(pub_id, outcome, new_title) for each publication whose title is `wrong` and each that a raw record belongs to: CORRECT
    with the title to write, or why it is skipped.

    publications: pub_id, eid, source_title; raws: pub_id, raw_id, raw_eid, payload_eid, raw_source, raw_source_title,
    validation, import_status, one row a link between a record and a publication. A publication with several links is skipped, as
    is one whose record belongs to other publications too.
    """
    text = lambda c: X.strip(F.coalesce(F.col(c), F.lit("")))
    per_raw = raws.groupBy("raw_id").agg(F.count(F.lit(1)).alias("raw_links"))
    fields = [c for c in raws.columns if c != "pub_id"]
    per_pub = raws.groupBy("pub_id").agg(F.count(F.lit(1)).alias("links"), F.min_by(F.struct(*fields), "raw_id").alias("r"))
    x = publications.join(per_pub, "pub_id", "left").select("pub_id", "eid", "source_title", "links", "r.*").join(per_raw, "raw_id", "left")
    x = x.withColumn("old", text("source_title")).withColumn("new", text("raw_source_title")).where((F.col("old") == wrong) | F.col("links").isNotNull())
    other_eid = lambda c: ~X.normalize_eid(F.col(c)).eqNullSafe(F.col("eid"))
    outcome = (
        F.when(F.col("links").isNull(), "NO_RAW_SOURCE").when(F.col("links") > 1, "PROVENANCE_NOT_1TO1")
        .when(F.col("old") != wrong, F.when((F.col("new") != "") & (F.col("old") == F.col("new")), "ALREADY_CORRECT").otherwise("NOT_WRONG_VALUE"))
        .when(F.col("raw_links") > 1, "PROVENANCE_NOT_1TO1").when(~F.col("import_status").eqNullSafe("APPLIED"), "IMPORT_NOT_APPLIED")
        .when(~F.col("validation").eqNullSafe("VALID"), "RAW_NOT_VALID")
        .when(other_eid("raw_eid") | (F.col("payload_eid").isNotNull() & other_eid("payload_eid")), "EID_MISMATCH")
        .when(text("raw_source") != F.col("old"), "STORED_NOT_PROVIDER_VALUE").when(F.col("new") == "", "SOURCE_TITLE_MISSING")
        .when(F.col("new") == F.col("old"), "NO_CHANGE").otherwise("CORRECT")
    )
    return x.select("pub_id", outcome.alias("outcome"), F.when(outcome == "CORRECT", F.col("new")).alias("new_title"))
