"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns
of documents. run() writes what a stage returns to the shared folder and gives the next one what it reads back, so that an
executor that is lost costs one stage at most; what a stage read is deleted once its own output stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import decontamination, packing, pii, quality_rules, simhash
from bitloom.llm.common import discard, read_table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or are depleted go; the others lose their boilerplate lines."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.filtered(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the names of their kinds."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their place in a training sequence."""
    return packing.query(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_duplicates", near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: SQL has no XXH64, expectation-maximisation or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
