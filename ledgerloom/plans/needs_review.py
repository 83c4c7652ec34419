"""Author positions that a person should look at: what each source says of them, what was overridden, and a search among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

POSITION = ["pub_id", "author_order"]
#: Reasons by which sources contradict each other.
CONFLICTS = ("ID_CONFLICT", "ID_AMBIGUOUS", "POSITION_CLAIMED_BY_OTHER_ID")
ADJUSTED = "ADJUSTED"


def kinds(resolutions: DataFrame, texts: DataFrame) -> DataFrame:
    """(pub_id, author_order, kind, summaries) of positions that some source doesn't verify.

    resolutions: res_id, pub_id, author_order, source, status, reason, the current one of each source; texts: res_id, ord, raw_text, what
    the source's own words were, each shown once. summaries stand in the order of sources.
    """
    once = texts.where("raw_text <> ''").groupBy("res_id", "raw_text").agg(F.min("ord").alias("ord"))
    words = once.groupBy("res_id").agg(F.array_sort(F.collect_list(F.struct("ord", "raw_text"))).alias("t")).select("res_id", F.transform("t", lambda x: x["raw_text"]).alias("raw_affiliations"))
    x = resolutions.join(words, "res_id", "left").withColumn("raw_affiliations", F.coalesce("raw_affiliations", F.array().cast("array<string>")))
    said = lambda s: F.bool_or(F.col("status") == s)
    g = x.groupBy(*POSITION).agg(
        said("VERIFIED").alias("v"), said("UNRESOLVED").alias("u"), F.bool_and(F.col("status") == "UNRESOLVED").alias("only"), F.bool_and(F.col("status") == "VERIFIED").alias("fine"),
        F.coalesce(F.bool_or(F.col("reason").isin(*CONFLICTS)), F.lit(False)).alias("c"), F.array_sort(F.collect_list(F.struct("source", "status", "reason", "raw_affiliations"))).alias("summaries"),
    )
    kind = F.when(F.expr("(v and u) or c"), "CONFLICTING_SOURCES").when(F.col("only"), "UNRESOLVED").otherwise("LOW_CONFIDENCE")
    return g.where("not fine").select(*POSITION, kind.alias("kind"), "summaries")


def matches(query: str) -> Column:
    """Whether an item has the query in its ids, or in its folded name, ids and title as a whole or word by word."""
    raw = query.strip()
    folded = X.fold_text(raw)
    tokens = [t for t in (w.strip(",. ") for w in folded.split()) if t]
    target = F.concat_ws(" ", X.folded(F.coalesce("name", F.lit(""))), F.lower("scopus_id"), F.lower("eid"), X.folded(F.coalesce("title", F.lit(""))))
    has = lambda c, t: F.coalesce(F.contains(c, F.lit(t)), F.lit(False))
    every = F.lit(bool(tokens))
    for t in tokens:
        every = every & has(target, t)
    return has(F.lower("scopus_id"), raw.lower()) | has(F.lower("eid"), raw.lower()) | has(target, folded) | every


def list_items(positions: DataFrame, resolutions: DataFrame, texts: DataFrame, overrides: DataFrame, tied: DataFrame | None = None, query: str | None = None, kind: str | None = None) -> DataFrame:
    """(pub_id, author_order, eid, title, doi, scopus_id, name, kind, summaries, has_override, overrides).

    positions: pub_id, author_order, author_id, eid, title, doi, scopus_id, name; overrides: over_id, pub_id, author_order, state, affiliation,
    shown latest (by over_id) first; tied: author_id of authors tied to a person, if only theirs are wanted. kind: one of the kinds, or
    ADJUSTED for positions with an active override. Positions that no source was asked about aren't listed. Page by eid and author_order.
    """
    x = positions if tied is None else positions.join(tied.select("author_id").distinct(), "author_id", "left_semi")
    if query and query.strip():
        x = x.where(matches(query))
    over = overrides.groupBy(*POSITION).agg(F.bool_or(F.col("state") == "ACTIVE").alias("has_override"), F.sort_array(F.collect_list(F.struct("over_id", "state", "affiliation")), asc=False).alias("overrides"))
    x = x.join(kinds(resolutions, texts), POSITION).join(over, POSITION, "left").withColumn("has_override", F.coalesce("has_override", F.lit(False)))
    if kind:
        x = x.where("has_override") if kind == ADJUSTED else x.where(F.col("kind") == kind)
    return x.select(*POSITION, "eid", "title", "doi", "scopus_id", "name", "kind", "summaries", "has_override", "overrides")
