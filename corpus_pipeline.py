"""Cleaning a document corpus for training, one stage after another.

Each stage takes all that the one before kept and returns documents again, with the columns of its input; the last
returns how often each remaining document is to be taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moniker.llm import decontamination, language, line_dedup, mixing, simhash
from moniker.llm.shared import table, written

#: No single SQL text can express the language models and the draw; tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language explains go."""
    return language.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document (or line) has go from the texts; every document stays."""
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; those left without words are one group."""
    return simhash.keep_one(docs, wordless=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which a window of benchmark text occurs, however long they are."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken so that the sources reach their targets."""
    return mixing.mix(docs, keep=("doc_id", "source"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
