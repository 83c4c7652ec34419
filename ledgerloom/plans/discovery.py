"""Author profiles found through known publications, attributed by correspondence of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import spread_join

# Common name tokens that tell nothing about a person.
GENERIC = (
    "nguyen tran le pham hoang huynh phan vu vo dang bui do ho ngo duong dinh ly dao doan luong thai trinh cao truong ha van thi duc thanh huu ngoc quang minh xuan kim hai tien cong duy anh"
).split()


def surface(c):
    """struct(surname, tokens) of a name: words of two letters and more, of which the first is the surname's place."""
    words = F.filter(F.split(F.regexp_replace(X.name_n2(c), "[,-]", " "), " "), lambda w: F.length(w) >= 2)
    return F.struct(F.try_element_at(words, F.lit(1)).alias("surname"), F.array_distinct(words).alias("tokens"))


def corresponds(a, b):
    """Same surname and a further distinctive token; or the second holds the first's surname and all its distinctive tokens."""
    common = F.array(*map(F.lit, GENERIC))
    own = F.array(a["surname"])
    anchored = (a["surname"] == b["surname"]) & (F.size(F.array_except(F.array_except(F.array_intersect(a["tokens"], b["tokens"]), own), common)) > 0)
    distinctive = F.array_except(a["tokens"], common)
    permuted = (a["surname"] != b["surname"]) & (F.size(distinctive) > 0) & (F.size(F.array_except(distinctive, b["tokens"])) == 0) & F.array_contains(b["tokens"], a["surname"])
    return F.coalesce(anchored | permuted, F.lit(False))


def matching(people: DataFrame, authors: DataFrame, block: Sequence[str] = ()) -> DataFrame:
    """(lec_id, author_id) of people (lec_id, full_name) and authors (author_id, name) whose names correspond and whose block columns,
    if any are asked for, are equal.

    Nothing corresponds unless both names hold a distinctive word, so distinct names meet on such words only, not on common surnames,
    and are compared once, however many bear them. Those who bear one name are dealt to parts, as each may meet many authors.
    """
    words = lambda c: F.explode(F.array_except(F.col(f"{c}.tokens"), F.array(*map(F.lit, GENERIC))))
    a = people.select(*block, "full_name").distinct().withColumn("a", surface(X.strip_title(F.col("full_name")))).withColumn("word", words("a"))
    b = authors.select(*block, "name").distinct().withColumn("b", surface(F.col("name"))).withColumn("word", words("b"))
    pairs = a.join(b, [*block, "word"]).where(corresponds(F.col("a"), F.col("b"))).select(*block, "full_name", "name").distinct()
    return spread_join(people, pairs, [*block, "full_name"], "lec_id").join(authors, [*block, "name"]).select("lec_id", "author_id")


def discover(known: DataFrame, positions: DataFrame, people: DataFrame, authors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows (lec_id, author_id, pub_id, verdict): authors of a person's known publications who are no candidates yet.

    DISCOVERED if the names correspond, else UNATTRIBUTED, as every co-author stands on the same publication. known: lec_id, pub_id;
    positions: pub_id, author_id; people: lec_id, full_name; authors: author_id, name, one row for each form of an author's name, of which
    any may correspond; candidates: lec_id, author_id. Names are compared once a pair and form, not once a publication.
    """
    new = known.join(positions, "pub_id").select("lec_id", "author_id", "pub_id").distinct()
    new = new.join(candidates.select("lec_id", "author_id"), ["lec_id", "author_id"], "left_anti")
    names = people.select("lec_id", surface(X.strip_title(F.col("full_name"))).alias("a"))
    pairs = new.select("lec_id", "author_id").distinct().join(names, "lec_id").join(authors.select("author_id", surface(F.col("name")).alias("b")), "author_id")
    found = pairs.where(corresponds(F.col("a"), F.col("b"))).select("lec_id", "author_id", F.lit("DISCOVERED").alias("verdict")).distinct()
    return new.join(found, ["lec_id", "author_id"], "left").select("lec_id", "author_id", "pub_id", F.coalesce("verdict", F.lit("UNATTRIBUTED")).alias("verdict"))
