"""The engine's functions for use in SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources import csv_lossless, documents
from . import text as X


class ParseCsv:
    """Rows of a CSV file's bytes."""

    def eval(self, content: bytes):
        for number, digest, _, values, error in csv_lossless.parse(bytes(content or b"")):
            yield number, digest, values, error


class ParseArtifact:
    """A claim artifact's canonical content, its digest, or what is wrong with it."""

    def eval(self, content: bytes):
        yield documents.artifact(bytes(content or b""))


def register(spark: SparkSession) -> list[str]:
    """Register all functions with a session; their names are returned."""
    scalars = {"fold_exact": X.fold_exact, "nfkc": X.nfkc, "nfkc_casefold": X.nfkc_casefold, "romanize": X.romanize, "names_compatible": X.names_compatible}
    for name, f in scalars.items():
        spark.udf.register(name, f)
    tables = {
        "parse_csv_lossless": udtf(ParseCsv, returnType="row_number int, row_hash string, row array<string>, error string"),
        "parse_claim_artifact": udtf(ParseArtifact, returnType="content string, content_sha256 string, error string"),
    }
    for name, f in tables.items():
        spark.udtf.register(name, f)
    return [*scalars, *tables]
