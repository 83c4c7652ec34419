"""From raw documents to token ids: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, copies, decontam, lines, quality
from ledgerloom.llm.common import delete, table, written_at


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose highest grade is likely enough, by a model fitted on the labelled ones."""
    return quality.keep_good(docs, quality.train(docs, quality.graded(table(spark, sf_dir, "labels"))))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, but for each template's first; copies, which the next stage judges, stay whole. n_chars follows the text."""
    out = lines.drop_recurring(docs, spare=0.8)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash trees and bands give the pairs, exact similarity of five-word shingles decides."""
    return copies.keep_firsts(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs, keep_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", tokenize),
]

#: Neither the fitted model nor the hash and rank-file stages can be put in SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet in the shared folder and read again; a stage's rows are deleted
    once the next one's are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs, path = written_at(stage(spark, docs, sf_dir), f"pipeline-stage{k}")
        if before:
            delete(spark, before)
        before = path
    return docs
