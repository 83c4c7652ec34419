"""From raw rows to publications, authors and links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.diff import changed_fields
from ..operators.latest import ranked


def normalize(raw: DataFrame, existing: DataFrame, fields: dict[str, Column] | None = None, links: DataFrame | None = None) -> DataFrame:
    """(raw_id, eid, outcome, changed): the first valid row of an EID makes a publication or is compared with the existing one, which is
    never overwritten; later rows of the EID only add provenance.

    raw: raw_id, row_number, eid_raw, validation and what fields use. fields: for each column of existing that is compared, the value that
    a raw row gives it, normalised as it is stored; changed maps those that differ to their old and new value. Without it the titles'
    normalised forms are compared. links: raw_id, eid of provenance that exists; a row linked to another publication is an error.
    """
    x = raw.withColumn("key", X.normalize_eid(F.col("eid_raw")))
    valid = (F.col("validation") == "VALID") & F.col("key").isNotNull()
    # invalid rows rank alone: without a key of their own they would all meet in one task
    x = x.withColumn("valid", valid).withColumn("group", F.when(F.col("valid"), F.col("key")).otherwise(F.concat(F.lit("\0"), F.col("raw_id").cast("string"))))
    x = ranked(x, ["group"], [F.asc("row_number"), F.asc("raw_id")], "k")
    pairs = fields or {"title": F.col("title_raw")}
    x = x.select("raw_id", "key", "valid", "k", F.struct(*[v.alias(f) for f, v in pairs.items()]).alias("new"))
    x = x.join(existing.select(F.col("eid").alias("key"), F.struct(*pairs).alias("old"), F.lit(True).alias("known")), "key", "left")
    if links is not None:
        x = x.join(links.select("raw_id", F.col("eid").alias("linked")), "raw_id", "left")
    form = (lambda c: c) if fields else X.normalize_title
    changed = changed_fields({f: (form(F.col(f"old.{f}")), form(F.col(f"new.{f}"))) for f in pairs})
    elsewhere = F.col("linked").isNotNull() & (F.col("linked") != F.col("key")) if links is not None else F.lit(False)
    outcome = (
        F.when(~F.col("valid"), "INVALID_EID").when(elsewhere, "NORMALIZATION_ERROR").when(F.col("k") > 1, "INTRA_DUPLICATE").when(F.col("known").isNull(), "NEW")
        .when(F.size(changed) == 0, "EXISTING_UNCHANGED").otherwise("EXISTING_METADATA_CHANGED")
    )
    return x.select("raw_id", F.when(F.col("valid"), F.col("key")).alias("eid"), outcome.alias("outcome"), F.when(outcome == "EXISTING_METADATA_CHANGED", changed).alias("changed"))


def provenance(normalized: DataFrame, links: DataFrame) -> DataFrame:
    """(raw_id, eid): links that a normalisation adds: each row that isn't refused belongs to its EID's publication, once."""
    return normalized.where("outcome not in ('INVALID_EID', 'NORMALIZATION_ERROR')").select("raw_id", "eid").join(links.select("raw_id"), "raw_id", "left_anti")


def author_occurrences(rows: DataFrame) -> DataFrame:
    """Rows (raw_id, author_order, scopus_id, name, full_name, error) of three parallel lists: authors, full_names, ids.

    Lists of different lengths give one row with an error. Positions with a missing, non-numeric or repeated id, or a full name
    whose id in brackets is another, have an error too.
    """
    lists = rows.select("raw_id", *[F.coalesce(X.split_semicolon(F.col(c)), F.array().cast("array<string>")).alias(c) for c in ("authors", "full_names", "ids")])
    even = (F.size("authors") == F.size("full_names")) & (F.size("authors") == F.size("ids"))
    zipped = F.arrays_zip("authors", "full_names", "ids")  # as long as the longest, so uneven lists have a first place too
    each = lists.select("raw_id", "ids", even.alias("even"), F.posexplode(F.when(even, zipped).otherwise(F.slice(zipped, 1, 1))).alias("pos", "a"))
    scopus_id, embedded = F.col("a.ids"), X.embedded_id(F.col("a.full_names"))
    before = F.array_position("ids", scopus_id) <= F.col("pos")  # an earlier place has the id
    error = (
        F.when(~F.col("even"), "AUTHOR_LIST_LENGTH_MISMATCH").when(scopus_id == "", "MISSING_SCOPUS_ID").when(~F.rlike(scopus_id, F.lit(r"^\d+$")), "NON_NUMERIC_SCOPUS_ID").when(before, "DUPLICATE_SCOPUS_ID_IN_PUBLICATION")
        .when(embedded.isNotNull() & (embedded != scopus_id), "AUTHOR_ID_MISMATCH")
    )
    own = lambda c: F.when(F.col("even"), c)
    return each.select("raw_id", own(F.col("pos") + 1).alias("author_order"), own(scopus_id).alias("scopus_id"), own(F.col("a.authors")).alias("name"), own(X.without_embedded_id(F.col("a.full_names"))).alias("full_name"), error.alias("error"))


class KnownList:
    """A person's list as it is gone through: keys that are there, and those of them that the list made or used."""

    def __init__(self, existing=()):
        self.there, self.met = set(existing), set()

    def step(self, doi: str | None, title: str | None) -> str:
        own = [x for x in (doi and f"doi:{doi}", title and f"t:{title}") if x]
        found = [x for x in own if x in self.there]
        if not found:
            self.there.update(own)
            self.met.update(own)
            return "create"
        if not self.met.isdisjoint(found):
            return "collapse"
        self.met.update(found)
        return "reuse_existing"


def known_plan(rows: list[tuple[int, str | None, str | None]], existing: set[str]) -> list[tuple[int, str]]:
    """Actions for (line, doi, title) in order: create, reuse a publication that was there before, or fold into one already met."""
    known = KnownList(existing)
    return [(line, known.step(doi, title)) for line, doi, title in rows]


def plan_known(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """known_plan() over each snapshot's rows (snapshot, line, doi, title), as what a row does depends on those before it.
    existing: (snapshot, key). A partition's snapshots are one sorted stream, each one's existing keys first; a task holds one
    snapshot's keys at a time, and a snapshot costs nothing beyond its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = object(), KnownList()
        for batch in batches:
            out = []
            for snapshot, listed, line, key, doi, title in zip(*(c.to_pylist() for c in batch.columns)):
                if snapshot != now:
                    now, known = snapshot, KnownList()
                if listed:
                    out.append((snapshot, line, known.step(doi, title)))
                else:
                    known.there.add(key)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["snapshot", "line", "action"])

    x = rows.select("snapshot", F.lit(True).alias("listed"), "line", F.lit(None).cast("string").alias("key"), X.doi_n0(F.col("doi")).alias("doi"), F.nullif(X.normalize_title_t0(F.col("title")), F.lit("")).alias("title"))
    x = x.unionByName(existing.select("snapshot", F.lit(False).alias("listed"), "key"), allowMissingColumns=True)
    return x.repartition("snapshot").sortWithinPartitions("snapshot", "listed", "line").mapInArrow(run, "snapshot long, line long, action string")
