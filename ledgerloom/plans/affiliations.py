"""Affiliations of author positions: decisions, gaps, policies across sources and alignment of author lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import dealt

# Reasons for a gap, the one that governs first.
GAP_REASONS = (
    "ADMIN_MARKED_UNRESOLVED", "SOURCE_HAS_NO_AFFILIATION", "ID_CONFLICT", "ID_AMBIGUOUS", "POSITION_CLAIMED_BY_OTHER_ID",
    "ORDER_INCONSISTENT_WITH_VERIFIED_ID", "WITHHELD_SOURCE_CONFLICT", "OPENALEX_ENTITY_NAME_CONFLICT", "NAME_MISMATCH", "NO_RAW_AUTHOR_NAME",
    "AUTHOR_COUNT_MISMATCH", "NO_EXTERNAL_AUTHOR_LIST", "DUPLICATE_DOI_IN_SOURCE", "NO_EXTERNAL_WORK", "NOT_RECONCILED", "UNKNOWN",
)
TRUSTED = ("VERIFIED", "CORROBORATED")
CONFLICTS = ("ID_CONFLICT", "ID_AMBIGUOUS", "POSITION_CLAIMED_BY_OTHER_ID")
POSITION = ["pub_id", "author_order"]


def rank_of(status: Column) -> Column:
    return F.when(status == "VERIFIED", 2).when(status == "CORROBORATED", 1).otherwise(0)


def reason_rank(reason: Column) -> Column:
    out = F.lit(len(GAP_REASONS) - 1)
    for i, code in enumerate(GAP_REASONS):
        out = F.when(reason == code, i).otherwise(out)
    return out


def decide(positions: DataFrame, current: DataFrame, active: DataFrame) -> DataFrame:
    """Rows (pub_id, author_order, status, units, gap_reason, admin_reviewed) for every position.

    current: one resolution a source; active: overrides. Overrides with a text win, then units of trusted sources by status and
    source; else the first applicable reason of GAP_REASONS tells why there are none.
    """
    trusted = F.col("status").isin(*TRUSTED)
    has_unit = trusted & (F.col("presence") != "ABSENT")
    why = F.when(trusted, F.when(F.col("presence") == "ABSENT", "SOURCE_HAS_NO_AFFILIATION").otherwise("UNKNOWN")).otherwise(F.coalesce("reason", F.lit("UNKNOWN")))
    unit = F.when(has_unit, F.struct((-rank_of(F.col("status"))).alias("o"), F.col("source"), F.col("affiliation")))
    r = current.groupBy(*POSITION).agg(F.max(rank_of(F.col("status"))).alias("best"), F.array_sort(F.collect_list(unit)).alias("units"), F.min(reason_rank(why)).alias("why"))
    manual = F.when(F.col("confidence") == "CORROBORATED", F.struct("over_id", F.col("affiliation").alias("text")))
    o = active.groupBy(*POSITION).agg(F.array_sort(F.collect_list(manual)).alias("manual"), F.bool_or(F.col("confidence") == "UNRESOLVED").alias("marked"))
    x = positions.join(dealt(r), POSITION, "left").join(dealt(o), POSITION, "left")
    texts = F.when(F.size("manual") > 0, F.col("manual.text")).when(F.size("units") > 0, F.col("units.affiliation")).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("best") == 2, "VERIFIED").when(F.col("best") == 1, "CORROBORATED").when(F.col("best") == 0, "UNRESOLVED").otherwise("NOT_RECONCILED")
    reason = F.when(F.col("marked"), GAP_REASONS[0]).when(F.col("best").isNull(), "NOT_RECONCILED").otherwise(F.element_at(F.array(*map(F.lit, GAP_REASONS)), F.coalesce("why", F.lit(0)) + 1))
    x = x.select(*POSITION, status.alias("status"), texts.alias("units"), reason.alias("why"), F.col("marked").isNotNull().alias("admin_reviewed"))
    return x.select(*POSITION, "status", F.array_join("units", " | ").alias("units"), F.when(F.size("units") == 0, F.col("why")).alias("gap_reason"), "admin_reviewed")


def withhold(inputs: DataFrame, keys: list[str] = POSITION) -> DataFrame:
    """Where one source reports a contradiction of ids at a position, trusted links of the others there are withheld."""
    culprits = inputs.where(F.col("reason").isin(*CONFLICTS)).select(*keys).distinct().withColumn("culprit", F.lit(True))
    x = inputs.join(culprits, keys, "left")
    held = F.col("culprit").isNotNull() & F.coalesce(F.col("status").isin(*TRUSTED), F.lit(False))
    return x.withColumn("held", held).withColumn("reason", F.when(held, "WITHHELD_SOURCE_CONFLICT").otherwise(F.col("reason"))).withColumn("status", F.when(held, "UNRESOLVED").otherwise(F.col("status"))).drop("culprit")


def align(slots: DataFrame, externals: DataFrame, bridge: DataFrame, source: str) -> DataFrame:
    """Link author slots of papers with one source's author lists: (paper, author_order, scopus_id, status, reason, position).

    slots: paper, author_order, scopus_id, full_name; externals: paper, position, name, orcid, entity_name, entity_orcid;
    bridge: orcid, scopus_id. An ORCID that a registry ties to exactly one id of the paper verifies a slot; else place, equal list
    lengths and equal names corroborate it; else the first reason that applies is given.
    """
    publisher = source == "crossref"
    ids = slots.select("paper", "scopus_id").distinct()
    ties = externals.where(F.col("orcid").isNotNull() & F.lit(publisher)).join(bridge, "orcid").join(ids, ["paper", "scopus_id"]).select("paper", "position", "scopus_id").distinct()
    per_place = ties.groupBy("paper", "position").agg(F.count(F.lit(1)).alias("n"), F.first("scopus_id").alias("scopus_id"))
    ambiguous = per_place.where("n > 1").select("paper", "position", F.lit(True).alias("ambiguous"))
    claims = per_place.where("n = 1").groupBy("paper", "scopus_id").agg(F.min("position").alias("claimed"), F.count(F.lit(1)).alias("places"))
    first_order = slots.groupBy("paper", "scopus_id").agg(F.max("author_order").alias("own_order"))
    n_slots, n_ext = (d.groupBy("paper").agg(F.count(F.lit(1)).alias(n)) for d, n in ((slots, "n_slots"), (externals, "n_ext")))
    verified = claims.where("places = 1")
    consistent = verified.join(first_order, ["paper", "scopus_id"]).groupBy("paper").agg(F.bool_and(F.col("claimed") == F.col("own_order")).alias("in_order"))
    taken = verified.select("paper", F.col("claimed").alias("position"), F.lit(True).alias("taken"))
    at = externals.select("paper", F.col("position").alias("author_order"), F.col("name").alias("ext_name"), "entity_name", "entity_orcid", F.col("orcid").alias("ext_orcid"))
    x = slots.join(n_slots, "paper").join(n_ext, "paper", "left").join(claims, ["paper", "scopus_id"], "left").join(consistent, "paper", "left").join(at, ["paper", "author_order"], "left")
    for marks in (ambiguous, taken):
        x = x.join(marks.withColumnRenamed("position", "author_order"), ["paper", "author_order"], "left")
    same = F.col("n_slots") == F.col("n_ext")
    words = F.array_intersect(F.filter(X.name_tokens(F.col("ext_name")), lambda t: F.length(t) > 1), X.name_tokens(F.col("entity_name")))
    contradicts = F.lit(not publisher) & F.col("entity_name").isNotNull() & ~X.names_compatible("ext_name", "entity_name") & ~((F.col("entity_orcid") == F.col("ext_orcid")) & (F.size(words) > 0)).eqNullSafe(True)
    reason = (
        F.when(F.col("n_ext").isNull(), "NO_EXTERNAL_AUTHOR_LIST").when(F.col("places") == 1, None).when(F.col("places") > 1, "ID_CONFLICT").when(~same, "AUTHOR_COUNT_MISMATCH")
        .when(F.lit(not publisher) & (F.trim(F.coalesce("ext_name", F.lit(""))) == ""), "NO_RAW_AUTHOR_NAME").when(contradicts, "OPENALEX_ENTITY_NAME_CONFLICT")
        .when(F.col("ambiguous").isNotNull(), "ID_AMBIGUOUS").when(F.col("taken").isNotNull(), "POSITION_CLAIMED_BY_OTHER_ID").when(~F.coalesce("in_order", F.lit(True)), "ORDER_INCONSISTENT_WITH_VERIFIED_ID")
        .when(~X.names_match(F.col("full_name"), F.col("ext_name")), "NAME_MISMATCH")
    )
    status = F.when(F.col("reason").isNotNull(), "UNRESOLVED").when(F.col("places") == 1, "VERIFIED").otherwise("CORROBORATED")
    x = x.withColumn("reason", reason).withColumn("status", status)
    return x.select("paper", "author_order", "scopus_id", "status", "reason", F.when(F.col("status") == "VERIFIED", F.col("claimed")).when(F.col("status") == "CORROBORATED", F.col("author_order")).alias("position"))
