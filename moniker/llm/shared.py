"""Helpers that every corpus operator shares: intermediate tables and row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir (tests on one machine).
FALLBACK_DIR = "/tmp/moniker-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The files replace the lineage: a lost executor costs a re-read, not a recomputation, and shuffle
    files behind ``df`` can be dropped.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> Column:
    """64-bit key that tells rows of one doc_id with different texts apart (null: a key of its own)."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\0null")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
