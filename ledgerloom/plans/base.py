"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .standins import Relations, prelude

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(key: str, relations: str = "", sql: str | None = None):
    """Register f(relations) -> DataFrame under a key. sql continues the WITH clause of the named relations, or stands alone."""

    def add(f: Callable[[Relations], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            ORACLE_SQL[key] = text if not relations else prelude(*relations.split()) + (", " + text[1:] if text.startswith(",") else " " + text)
        return f

    return add


def fold_sql(expression: str) -> str:
    from ..functions.text import FOLD_FROM, FOLD_TO

    return f"translate(lower({expression}), '{FOLD_FROM}', '{FOLD_TO}')"
