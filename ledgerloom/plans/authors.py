"""From author occurrences to authors, their name variants and their links with publications; conflicts are told, nothing is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

DISPLAY, FULL = "DISPLAY", "FULL_NAME"


def attributed(occurrences: DataFrame, provenance: DataFrame) -> DataFrame:
    """occurrences with pub_id; null where the raw row belongs to no publication, and then nothing is made of them."""
    return occurrences.join(provenance.select("raw_id", "pub_id"), "raw_id", "left")


def authors(occ: DataFrame, existing: DataFrame) -> DataFrame:
    """(scopus_id, action, preferred): CREATED, NAMED (an author known by the id only gets a name) or EXISTING.

    The preferred name is the first occurrence's that has one, its full one rather than the displayed; or the id. occ: seq (a total
    order), scopus_id, display, full_name; existing: scopus_id, preferred.
    """
    name = F.coalesce(F.nullif("full_name", F.lit("")), F.nullif("display", F.lit("")))
    seen = occ.groupBy("scopus_id").agg(F.min(F.when(name.isNotNull(), F.struct("seq", name.alias("name"))))["name"].alias("name"))
    x = seen.join(existing.select("scopus_id", F.lit(True).alias("known"), "preferred"), "scopus_id", "left")
    nameless = F.coalesce("preferred", F.lit("")).isin("") | (F.col("preferred") == F.col("scopus_id"))
    action = F.when(F.col("known").isNull(), "CREATED").when(nameless & F.col("name").isNotNull(), "NAMED").otherwise("EXISTING")
    return x.select("scopus_id", action.alias("action"), F.when(action == "EXISTING", F.col("preferred")).otherwise(F.coalesce("name", "scopus_id")).alias("preferred"))


def variants(occ: DataFrame, existing: DataFrame) -> DataFrame:
    """(scopus_id, kind, name, first_raw): forms of names that existing (scopus_id, kind, name) hasn't, with the row that had each first."""
    each = F.explode(F.array(F.struct(F.lit(DISPLAY).alias("kind"), F.col("display").alias("name")), F.struct(F.lit(FULL).alias("kind"), F.col("full_name").alias("name"))))
    forms = occ.select("seq", "raw_id", "scopus_id", each.alias("v")).select("seq", "raw_id", "scopus_id", "v.kind", "v.name").where("name <> ''")
    return forms.groupBy("scopus_id", "kind", "name").agg(F.min_by("raw_id", "seq").alias("first_raw")).join(existing.select("scopus_id", "kind", "name"), ["scopus_id", "kind", "name"], "left_anti")


def links(occ: DataFrame, existing: DataFrame) -> DataFrame:
    """(seq, pub_id, scopus_id, author_order, outcome, other): what becomes of each occurrence's link, as if they came one by one.

    CREATED; EXISTING, or AUTHOR_POSITION_DRIFT where the link has another place (other); AUTHOR_ORDER_MISSING;
    AUTHOR_ORDER_CONFLICT where another author has the place (other). existing: pub_id, scopus_id, author_order, with a pair and a
    place once. An occurrence is linked if no earlier one that is has its pair or its place, which is settled in rounds of joins on
    keys, so a publication with any number of occurrences is no task's alone.
    """
    pair, place = ["pub_id", "scopus_id"], ["pub_id", "author_order"]
    had = existing.select(*pair, F.col("author_order").alias("had_order"), F.lit(True).alias("had"))
    taken = existing.select(*place, F.col("scopus_id").alias("taken_by"))
    x = cut(occ.select("seq", *pair, "author_order").join(had, pair, "left").join(taken, place, "left"))
    open_ = F.col("had").isNull() & F.col("author_order").isNotNull() & F.col("taken_by").isNull()
    state = x.withColumn("creates", open_)
    while True:
        made = state.where("creates")
        by_pair = made.groupBy(*pair).agg(F.min(F.struct("seq", "author_order")).alias("p"))
        by_place = made.groupBy(*place).agg(F.min(F.struct("seq", "scopus_id")).alias("s"))
        told = x.join(by_pair, pair, "left").join(by_place, place, "left")
        before = lambda c: F.coalesce(F.col(f"{c}.seq") < F.col("seq"), F.lit(False))
        new = cut(told.withColumn("creates", open_ & ~before("p") & ~before("s")))
        moved = new.select("seq", "creates").join(state.select("seq", F.col("creates").alias("was")), "seq").where("creates <> was").limit(1).count()
        state = new
        if not moved:
            break
    linked_order = F.when(F.col("had"), F.col("had_order")).when(before("p"), F.col("p.author_order"))
    linked = F.col("had").isNotNull() | before("p")
    occupied = F.coalesce("taken_by", F.when(before("s"), F.col("s.scopus_id")))
    drift = linked_order.isNotNull() & F.col("author_order").isNotNull() & (linked_order != F.col("author_order"))
    outcome = F.when(linked, F.when(drift, "AUTHOR_POSITION_DRIFT").otherwise("EXISTING")).when(F.col("author_order").isNull(), "AUTHOR_ORDER_MISSING").when(occupied.isNotNull(), "AUTHOR_ORDER_CONFLICT").otherwise("CREATED")
    other = F.when(outcome == "AUTHOR_POSITION_DRIFT", linked_order.cast("string")).when(outcome == "AUTHOR_ORDER_CONFLICT", occupied)
    return state.select("seq", *pair, "author_order", outcome.alias("outcome"), other.alias("other"))


def orphans(occ: DataFrame) -> DataFrame:
    """(seq, raw_id, scopus_id, error) of occurrences whose raw row belongs to no publication."""
    return occ.where("pub_id is null").select("seq", "raw_id", "scopus_id", F.lit("PUBLICATION_PROVENANCE_MISSING").alias("error"))
