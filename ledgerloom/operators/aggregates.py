"""Counts, facets and checks over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled(df: DataFrame, key: str, vocabulary: list[str]) -> DataFrame:
    """Rows (key, n) for every word of a fixed vocabulary, with 0 where no row has it."""
    words = df.sparkSession.createDataFrame([(w,) for w in vocabulary], f"{key} string")
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return words.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def facet(df: DataFrame, name: str, column: str) -> DataFrame:
    """Rows (facet, value, n) of a column's values that aren't blank."""
    value = F.col(column).cast("string")
    return df.where(value.isNotNull() & (F.trim(value) != "")).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("facet"), "value", "n")


def facets(df: DataFrame, own: dict[str, Column], columns: dict[str, str]) -> DataFrame:
    """All facets in one pass over df: each counts the rows that fit every condition but its own. own: each facet's condition."""
    rows = []
    for name, column in columns.items():
        fits = F.lit(True)
        for other, condition in own.items():
            if other != name:
                fits = fits & F.coalesce(condition, F.lit(False))
        rows.append(F.struct(F.lit(name).alias("facet"), F.col(column).cast("string").alias("value"), fits.alias("fits")))
    x = df.select(F.inline(F.array(*rows))).where("fits and value is not null and trim(value) <> ''")
    return x.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def dense_years(df: DataFrame, year: str = "year") -> DataFrame:
    """Rows (year, n) from the least to the greatest year, with 0 for years that no row has."""
    counts = df.where(F.col(year).isNotNull()).groupBy(F.col(year).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    return span.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def ratio(a: Column, b: Column, digits: int = 3) -> Column:
    """a / b, half-even rounded; null if b is 0."""
    return F.bround(F.try_divide(a.cast("decimal(20,0)"), b.cast("decimal(20,0)")), digits).cast("double")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, digest) of a table whatever its rows' order: counts, and sums of each row's hash over 2 ** 32 parts, so that repeated
    rows count. Unlike a digest of sorted rows it needs no row together with another."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(":", *(part(i) for i in range(8))), 256).alias("digest"))
