"""Text corpora, a line a row, with line numbers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import strip


def numbered(df: DataFrame, name: str = "line_no") -> DataFrame:
    """``df`` with consecutive numbers from 0 in the order of its partitions.

    Two passes and no window over all rows: rows are counted by partition, and each partition is numbered from the
    sum of those before it. The driver holds a number for each partition.
    """
    cut = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = {r[0]: r[1] for r in cut.groupBy(part.alias("p")).count().collect()}
    begin, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        begin.append(total)
        total += sizes.get(p, 0)
    offsets = F.array(*map(F.lit, begin or [0])).cast("array<long>")
    return cut.withColumn(name, F.element_at(offsets, (part + 1).cast("int")) + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")


def _begins(sizes: DataFrame, *order: str) -> DataFrame:
    """``sizes`` (n) with the sum of n before each row; a row a range or file part, so one task orders them."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*order, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__begin"))


def positions(df: DataFrame, order: str, name: str = "position", width: int = 1 << 17) -> DataFrame:
    """``df`` with the place from 0 of each row by the integer column ``order`` (no nulls, no value twice).

    Rows are ranked within ranges of ``width`` values, so a task never holds more; of each range one number is summed.
    """
    cut = df.withColumn("__range", F.floor(F.col(order) / width))
    begins = _begins(cut.groupBy("__range").agg(F.count("*").alias("n")), "__range")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    out = cut.withColumn("__within", within).join(begins, "__range")
    return out.withColumn(name, F.col("__begin") + F.col("__within")).select(*df.columns, name)


def _in_file_order(spark: SparkSession, path: str, line: Column, keep: str = "true") -> DataFrame:
    """line_no, line of the lines of a file or folder that fit ``keep``, numbered by file name and place in the file.

    Spark deals the parts of files to tasks by size, so the numbers come from the parts' names and sizes, not from tasks.
    """
    raw = spark.read.text(path).select(line.alias("line"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"))
    cut = raw.where(keep).withColumn("__id", F.monotonically_increasing_id())
    parts = cut.groupBy("__file", "__at").agg(F.min("__id").alias("__first"), F.count("*").alias("n"))
    begins = parts.select("__file", "__at", "__first").join(_begins(parts, "__file", "__at"), ["__file", "__at"])
    return cut.join(begins, ["__file", "__at"]).select((F.col("__begin") + F.col("__id") - F.col("__first")).alias("line_no"), "line")


def read_raw(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """Lines of a text file (gzip by suffix) or folder with line_no; broken UTF-8 is replaced."""
    return _in_file_order(spark, path, F.make_valid_utf8("value")).withColumnRenamed("line", name)


def read_trimmed(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty trimmed lines, numbered anew; an error if there are none."""
    lines = _in_file_order(spark, path, strip(F.validate_utf8("value")), "line <> ''")
    if lines.isEmpty():
        raise ValueError(f"no text lines in {path}")
    return lines


def line_at(lines: DataFrame, index: int) -> DataFrame:
    """The line of one number, counted from the end if negative; an error beyond the ends."""
    n = lines.count() if index < 0 else None
    found = lines.where(F.col("line_no") == (index if n is None else n + index))
    if found.isEmpty():
        raise IndexError(index)
    return found


def read_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of a Parquet file, without null and empty texts."""
    return spark.read.parquet(path).select(F.col(column).alias("raw")).where("raw is not null and raw <> ''")


def write_lines(df: DataFrame, path: str, line: str = "line", order: str = "line_no", one_file: bool = False) -> None:
    """Lines in order as gzip text; in one file if asked for, else in files that sort by name."""
    out = df.orderBy(order).select(line)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("compression", "gzip").text(path)


def last_by_key(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Of the rows with the same key the one with the largest position."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), position).alias("r")).select(key, "r.*")


def read_checkpoint(spark: SparkSession, path: str, schema: T.StructType, key: str = "line_no") -> DataFrame:
    """Results written so far, the last of each key; torn lines are dropped."""
    rows = numbered(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path), "__at").where(F.col(key).isNotNull())
    return last_by_key(rows, key, "__at").drop("__at")


def write_meta(path: str, **values) -> None:
    """A small JSON file of counters beside a result."""
    with open(path, "w", encoding="utf-8") as out:
        json.dump(values, out, ensure_ascii=False, indent=2, sort_keys=True)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share; on one machine alone it may be a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/moniker-shared"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for what several later steps read."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out evenly over all cores (rows of equal ``by`` to one task), for rows that take long beside their size.

    Spark cuts files and shuffles into tasks by bytes, so millions of short rows may go to one task.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *by)
