"""Assembling data sets: cleaning, splits, leakage guards, unions, shards, manifests."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..schema import SCRIPTS

INCOMPLETE = "missing_tags"


def checked(lines: DataFrame, drop_incomplete: bool = False) -> DataFrame:
    """``lines`` (line) with ok, reason and complete (all scripts are there)."""
    out = lines.withColumn("__v", C.validate(F.col("line")))
    complete = F.col("__v.ok") & (F.size(C.missing_tags(F.col("__v.tags"))) == 0)
    out = out.withColumn("complete", complete).withColumn("reason", F.col("__v.reason"))
    if drop_incomplete:
        out = out.withColumn("reason", F.when(F.col("reason").isNull() & ~F.col("complete"), INCOMPLETE).otherwise(F.col("reason")))
    return out.withColumn("ok", F.col("reason").isNull()).drop("__v")


def clean_stats(lines: DataFrame) -> DataFrame:
    """Of ``checked`` lines: rows by reason (kept: ok), and how many of them are complete."""
    return lines.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), F.count_if("complete").alias("n_complete"))


def samples(lines: DataFrame, n: int = 5) -> DataFrame:
    """The first dropped non-empty lines, cut to 200 characters, tabs shown as bars."""
    return lines.where("reason is not null and reason <> 'empty_line'").orderBy("line_no").limit(n).select("line_no", "reason", F.translate(F.substring("line", 1, 200), "\t", "|").alias("sample"))


def evenly_picked(index: Column, total: int, size: int) -> Column:
    """Whether an index from 0 is one of ``size`` spread evenly over ``total``: floor(k * total / size) for some k."""
    if total <= 0 or size <= 0:
        return F.lit(False)
    k = F.call_function("div", index * size + (total - 1), F.lit(total))
    return (k < size) & (F.call_function("div", k * total, F.lit(size)) == index)


def hash_rank_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def hash_sample(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """``size`` rows, the least by a seeded hash of their key: no shuffle of all rows, the same again for the same keys."""
    return rows.orderBy(hash_rank_key(F.col(key), seed), key).limit(size)


def drawn_indices(n: int, size: int, seed: int) -> list[int]:
    """A seeded draw without replacement of indices below ``n``."""
    return random.Random(seed).sample(range(n), min(size, n))


def without(rows: DataFrame, others: DataFrame, on: str = "line") -> DataFrame:
    """Leakage guard: rows whose line is not among the others; repeats of the rest stay."""
    return rows.join(others.select(on).distinct(), on, "left_anti")


def overlap(rows: DataFrame, others: DataFrame, on: str = "line") -> DataFrame:
    return rows.join(others.select(on).distinct(), on, "left_semi")


def first_occurrences(rows: DataFrame, on: str = "line", order: str = "line_no") -> DataFrame:
    """The first row of each line."""
    rest = [c for c in rows.columns if c != on]
    return rows.groupBy(on).agg(F.min_by(F.struct(*rest), order).alias("r")).select("r.*", on).select(*rows.columns)


def pooled(*sources: DataFrame) -> DataFrame:
    """One after another, with the source's place."""
    out = None
    for k, rows in enumerate(sources):
        rows = rows.withColumn("source_rank", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def sharded(rows: DataFrame, index: str, size: int, prefix: str = "cluster") -> DataFrame:
    """With shard, position in it, and record key."""
    at = F.col(index)
    return rows.withColumns({"shard": F.floor(at / size).cast("long"), "position": F.pmod(at, F.lit(size)).cast("long"), "key": F.format_string(f"{prefix}-%09d", at)})


def manifest(records: DataFrame, size: int) -> DataFrame:
    """Records by shard with the first and last key."""
    return records.groupBy("shard").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), (F.count("*") == size).alias("full"))


def key_index(key: Column) -> Column:
    """Number of a record key: after the last hyphen, before the suffix."""
    return F.regexp_extract(F.regexp_replace(key, r"\.[^.]*$", ""), "([^-]*)$", 1).cast("long")


def in_range(key: Column, low: int, high: int) -> Column:
    """Half open."""
    return (key_index(key) >= low) & (key_index(key) < high)


def short_cells(cells: Column, most: int, n_tokens: Column | None = None) -> Column:
    """Cells whose text and tag fit ``most`` tokens: at least by bytes, else by ``n_tokens`` (tokens of each cell)."""
    fits = lambda c: F.octet_length(c["value"]) <= most - 1
    if n_tokens is None:
        return F.filter(cells, fits)
    return F.filter(cells, lambda c, i: fits(c) | (F.element_at(n_tokens, i + 1) + 1 <= most))


def alive(cells: Column) -> Column:
    return F.exists(cells, lambda c: c["tag"] == "la")


def over_caps(clusters: DataFrame, most_tokens: int, most_surfaces: int, n_tokens: Column) -> DataFrame:
    """Surfaces over the token cap and clusters over the surface cap."""
    return clusters.agg(
        F.coalesce(F.sum(F.size(F.filter(n_tokens, lambda n: n > most_tokens))), F.lit(0)).cast("long").alias("n_long_surfaces"),
        F.count_if(F.size(n_tokens) > most_surfaces).alias("n_large_clusters"),
    )


def rewritten(corpus: DataFrame, results: DataFrame) -> DataFrame:
    """The corpus in order with results (line_no, outcome, new_line): fixed lines replaced, dropped ones left out."""
    both = corpus.join(results.select("line_no", "outcome", "new_line"), "line_no", "left")
    return both.where("outcome is null or outcome <> 'dropped'").select("line_no", F.coalesce("new_line", "line").alias("line"))


def all_scripts(cells: Column) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, SCRIPTS)), F.transform(cells, lambda c: c["tag"]))) == 0


def rank_batches(shards: DataFrame, batch: int, ranks: int) -> DataFrame:
    """Most batches that any rank has, shards (shard, n) dealt in turn."""
    return shards.groupBy(F.pmod("shard", F.lit(ranks)).alias("rank")).agg(F.sum("n").alias("n")).agg(F.max(F.ceil(F.col("n") / batch)).alias("batches"))


def scheduler_steps(per_epoch: Column, epochs: Column, accumulate: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(per_epoch / accumulate) * F.greatest(F.lit(1), epochs)).cast("long")
