"""Predicates of lists and searches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


@dataclass(frozen=True)
class PublicationFilter:
    """Parameters of a publication list; a blank one is absent."""

    q: str = ""
    year: int | None = None
    doc_type: str = ""
    stage: str = ""
    access: str = ""
    scopus_id: str = ""
    author_name: str = ""
    missing_doi: bool | None = None


def missing_doi(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def ilike_literal(c: Column, term: str) -> Column:
    """c holds term, whatever the case; no character of term is a wildcard."""
    return F.contains(F.lower(c), F.lit(term.strip().lower()))


def like_pattern(term: str) -> str:
    """A LIKE pattern for a literal substring, with backslash as escape character."""
    return "%" + "".join("\\" + ch if ch in "\\%_" else ch for ch in X.fold_text(term.strip())) + "%"


def all_of(*conditions: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def publications(pubs: DataFrame, links: DataFrame, authors: DataFrame, f: PublicationFilter) -> DataFrame:
    """Publications that fit all given parameters. The author conditions are joins with the distinct ids of fitting authors'
    publications, reduced before they are joined; a condition inside OR becomes a flag of a left join."""
    written = links.join(authors, "author_id")
    held = lambda cond: written.where(cond).select("pub_id").distinct()
    out, flag = pubs, None
    q = f.q.strip()
    if q:
        hit = held(X.contains_folded(F.col("name"), q) | ilike_literal(F.col("scopus_id"), q)).withColumn("by_author", F.lit(True))
        out = out.join(hit, "pub_id", "left")
        own = [X.contains_folded(F.col(c), q) for c in ("title", "source_title")] + [ilike_literal(F.col(c), q) for c in ("eid", "doi")]
        flag = any_of(*(F.coalesce(c, F.lit(False)) for c in own), F.col("by_author").isNotNull())
    equal = [F.col(c) == v for c, v in (("doc_type", f.doc_type), ("stage", f.stage), ("access", f.access)) if v.strip()]
    doi = None if f.missing_doi is None else missing_doi(F.col("doi")) if f.missing_doi else ~missing_doi(F.col("doi"))
    out = out.where(all_of(flag, None if f.year is None else F.col("year") == f.year, doi, *equal))
    if f.author_name.strip():
        out = out.join(held(X.contains_folded(F.col("name"), f.author_name)), "pub_id", "left_semi")
    if f.scopus_id.strip():
        out = out.join(held(ilike_literal(F.col("scopus_id"), f.scopus_id)), "pub_id", "left_semi")
    return out.select(*pubs.columns)


def tokens_all(text: str, columns: list[Column], most: int = 8) -> Column:
    """Every white-space token of text (the first `most`) stands in one of the columns."""
    return all_of(*(any_of(*(F.coalesce(X.contains_folded(c, t), F.lit(False)) for c in columns)) for t in text.split()[:most]))
