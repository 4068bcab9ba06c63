"""A training corpus from raw documents: five stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.decontaminate import cleaned
from quern.llm.packing import packed
from quern.llm.quality import passing
from quern.llm.secret_scan import redacted
from quern.llm.simhash import one_of_each
from quern.llm.store import dropped, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or empty text has no words and goes; a text of any length is judged whole; repeated rows are judged alike.
    """
    return passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id; null ids come last.

    Near are texts whose fingerprints differ in three bits at most or that share 0.8 of their five-word
    shingles. Texts without words, null ones too, are one group; rows that repeat are one document; of rows that
    share the smallest id one stays.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go.

    A null text has no words and stays; without benchmark items nothing changes; repeated rows are cut alike.
    """
    return cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark.

    A null text has none and stays null; overlapping secrets get one mark; repeated rows are redacted alike.
    """
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's tokens in sequences of 2048.

    A null or empty text is its end token alone; a text beyond 2048 tokens is cut; repeated rows are packed each.
    """
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Suffix intervals, fingerprints and token ids are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        dropped(before)  # of the table that the stage read, if it was a stage's
    return last(spark, docs, sf_dir)
