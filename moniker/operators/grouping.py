"""Grouping raw company strings by canonical key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import strip
from ..functions.variants import canonical_key


def group_companies(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """Columns org_key, spellings (raw, n) and first_row of ``rows`` (raw, ``order``).

    Blank strings and strings of legal forms only have no key. Spellings go by falling count, falling length, text;
    groups are in the order of their first row when sorted by first_row. Counting by (key, raw) comes first, so a key with
    very many rows is summed before it meets in one place.
    """
    raw = rows.select(strip(F.col("raw")).alias("raw"), F.col(order).alias("at")).where("raw <> ''")
    counted = raw.withColumn("org_key", canonical_key(F.col("raw"))).where("org_key <> ''").groupBy("org_key", "raw").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("a"), (-F.length("raw")).alias("b"), "raw", "n")))
    return counted.groupBy("org_key").agg(F.transform(ordered, lambda s: F.struct(s["raw"].alias("raw"), s["n"].alias("n"))).alias("spellings"), F.min("at").alias("first_row"))


def as_lines(groups: DataFrame) -> DataFrame:
    """Columns org_key, line (``la{...}`` cells), first_row."""
    return groups.select("org_key", F.array_join(F.transform("spellings", lambda s: F.concat(F.lit("la{"), s["raw"], F.lit("}"))), "\t").alias("line"), "first_row")


def summary(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: non-empty rows, distinct raw strings, organisations."""
    raw = rows.select(strip(F.col("raw")).alias("raw")).where("raw <> ''").agg(F.count("*").alias("n_rows"), F.count_distinct("raw").alias("n_raw"))
    return raw.crossJoin(groups.agg(F.count("*").alias("n_organisations")))
