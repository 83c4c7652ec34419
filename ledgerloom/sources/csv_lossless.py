"""CSV files read without loss: values as they stand, wrong-width rows kept as errors, physical line numbers and row digests."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, row_number int, row_hash string, headers array<string>, row array<string>, error string"


def header_problem(headers: list[str]) -> str | None:
    """What is wrong with a header row; the EID column is mandatory, whatever its case."""
    names = [h.strip() for h in headers]
    if not any(names):
        return "MISSING_HEADER"
    if not all(names) or any("\0" in h for h in headers) or len(set(headers)) < len(headers):
        return "INVALID_CSV_HEADER"
    return None if "eid" in {n.casefold() for n in names} else "MISSING_EID_COLUMN"


def file_problem(content: bytes) -> tuple[list[str] | None, str | None]:
    """(headers, error) of a whole file, whose rows are read and not kept: what can't be read to its end has an error."""
    if not content:
        return None, "EMPTY_IMPORT_FILE"
    try:
        reader = csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", newline=""), strict=True)
        headers = next(reader, [])
        if problem := header_problem(headers):
            return headers, problem
        filled = 0
        for values in reader:
            filled += any(v.strip() for v in values)
        return headers, None if filled else "INVALID_CSV"
    except (UnicodeDecodeError, csv.Error):
        return None, "INVALID_CSV"


def parse(content: bytes) -> Iterator[tuple[int, str | None, list[str] | None, list[str] | None, str | None]]:
    """(row number, digest, headers, values, error) of each row that isn't blank; one row with an error, and no other, for a file
    that breaks anywhere.

    A file is read twice, first to its end without keeping rows; then by rows, so only its bytes are held.
    """
    headers, problem = file_problem(content)
    if problem:
        yield 0, None, headers, None, problem
        return
    reader = csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", newline=""), strict=True)
    next(reader)
    for values in reader:
        if any(v.strip() for v in values):
            text = json.dumps(values, ensure_ascii=False, separators=(",", ":"))
            yield reader.line_num, hashlib.sha256(text.encode()).hexdigest(), headers, values, None if len(values) == len(headers) else "COLUMN_COUNT_MISMATCH"


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA from files (path, content), as the binaryFile source gives them; a file is read by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = ((path, *x) for x in parse(bytes(content)))
                while part := list(islice(rows, 10_000)):
                    yield pd.DataFrame(part, columns=["path", "row_number", "row_hash", "headers", "row", "error"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse_files(spark.read.format("binaryFile").load(path))


def value_of(name: str):
    """A row's value under a header, whatever the header's case."""
    at = F.array_position(F.transform("headers", lambda h: F.lower(F.trim(h))), name.lower())
    return F.when(at > 0, F.try_element_at("row", at.cast("int")))


def duplicate_candidates(rows: DataFrame) -> DataFrame:
    """Mark rows whose digest or trimmed EID stands in an earlier row of their file."""
    good = rows.where("error is null").withColumn("eid", F.nullif(F.trim(value_of("eid")), F.lit("")))
    # rows without an EID have a window group each: together they would meet in one task
    own = F.coalesce(F.concat(F.lit("e"), "eid"), F.concat(F.lit("r"), F.col("row_number").cast("string")))
    seen = lambda key: F.row_number().over(Window.partitionBy("path", key).orderBy("row_number")) > 1
    return good.withColumn("own", own).withColumn("duplicate", seen("row_hash") | seen("own")).drop("own")
