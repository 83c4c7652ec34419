"""Export writers: ordered text in parts, made by the executors, that put together are one file."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

BOM = "﻿"


def csv_bytes(df: DataFrame) -> bytes:
    """One small CSV file as spreadsheets expect it: byte-order mark, CRLF, minimal quoting. Rows stream through the driver, a partition
    at a time; write_csv() has no such limit."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(df.columns)
    for row in df.toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])
    return b"\xef\xbb\xbf" + out.getvalue().encode("utf-8")


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def csv_cell(c: Column) -> Column:
    """A cell with minimal quoting; null is empty. What a spreadsheet would take for a formula is marked as text."""
    x = F.coalesce(X.cell_guard(c.cast("string")), F.lit(""))
    return F.when(F.rlike(x, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def _ordered_text(lines: DataFrame, first: str, last: str | None, path: str, sep: str, order: list[str]) -> None:
    """Write first, then `line` of lines by `order`, then last. Names of part files rise with their rows; each row is in one file.

    The two lines beside the rows are rows themselves, at the ends of the order, so that the writer's commit covers all or nothing.
    """
    spark = lines.sparkSession
    ends = spark.createDataFrame([(0, first)] + ([(2, last)] if last is not None else []), "__at int, line string")
    rows = lines.select(F.lit(1).alias("__at"), "line", *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)])
    keys = ["__at", *[f"__{i}" for i in range(len(order))], "line"]
    whole = rows.unionByName(ends, allowMissingColumns=True)
    whole.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line").write.option("lineSep", sep).text(path)


def write_csv(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None) -> None:
    """df's columns (all, or those named) as CSV in ordered parts under path: put together by name they are one file with a byte-order
    mark, one header and CRLF. Rows are sorted by range over the executors, so neither the driver nor a task holds the export."""
    columns = columns or [c for c in df.columns if c not in order] or df.columns
    header = io.StringIO()
    csv.writer(header, lineterminator="").writerow(columns)
    line = F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]) if len(columns) > 1 else F.when(csv_cell(F.col(columns[0])) == "", '""').otherwise(csv_cell(F.col(columns[0])))
    _ordered_text(df.select(line.alias("line"), *order), BOM + header.getvalue(), None, path, "\r\n", order)


def write_json_document(df: DataFrame, path: str, order: list[str], envelope: str, name: str, columns: list[str] | None = None) -> None:
    """One JSON object in ordered parts under path: the members of `envelope`, a JSON object, and `name`, the array of df's rows."""
    record = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})
    head = envelope.strip()[:-1].rstrip()
    first = head + ("," if head != "{" else "") + f'"{name}":[null'
    # a comma before each record, and a null that readers drop before the first, so that no record has to know whether it is one
    _ordered_text(df.select(F.concat(F.lit(","), record).alias("line"), *order), first, "]}", path, "\n", order)
