"""What two versions of a row differ in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def changed_fields(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """A map from each field whose values differ, null being a value, to its old and new one as text; pairs: field to (old, new)."""
    entries = [F.when(~old.cast("string").eqNullSafe(new.cast("string")), F.struct(F.lit(name).alias("key"), F.struct(old.cast("string").alias("old"), new.cast("string").alias("new")).alias("value"))) for name, (old, new) in pairs.items()]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def names_of(changed: Column) -> Column:
    """The changed fields' names, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.map_keys(changed)), ",")
