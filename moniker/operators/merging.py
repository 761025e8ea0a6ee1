"""Putting corpora together: old validation lines, held-out and test lines, the pool to train on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..sources.lines import positions
from .dataset import alive, drawn_indices, first_occurrences, hash_sample

#: In this order the sources follow one another in every split.
SOURCES = ("old_val", "inventor", "company")


def picked(rows: DataFrame, size: int, seed: int, exact: bool = True, key: str = "line_no") -> DataFrame:
    """``rows`` with ``picked``: a seeded draw of ``size`` rows without replacement.

    ``exact``: the places that Python's generator draws among the rows in order of ``key``; the driver holds them, so
    their number, a parameter, is all that goes there. Else the least by a hash of ``key``, the same wherever a row stands.
    """
    if size <= 0:
        return rows.withColumn("picked", F.lit(False))
    if exact:
        places = [(k,) for k in drawn_indices(rows.count(), size, seed)]
        chosen = rows.sparkSession.createDataFrame(places, "__place long").withColumn("picked", F.lit(True))
        out = positions(rows, key, "__place").join(chosen, "__place", "left")
    else:
        out = rows.join(hash_sample(rows.select(key), key, size, seed).withColumn("picked", F.lit(True)), key, "left")
    return out.select(*rows.columns, F.coalesce("picked", F.lit(False)).alias("picked"))


def _pruned(lines: DataFrame, prune: Callable[[Column], Column]) -> DataFrame:
    """line_no, raw, line, n_pruned, dead: lines without the cells that ``prune`` takes out; dead without a Latin one."""
    parsed = C.parse_lenient(F.col("line"))
    cells = F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.substring("line", 1, 120))))
    rows = lines.select("line_no", F.col("line").alias("raw"), cells.alias("c")).withColumn("kept", prune(F.col("c")))
    return rows.select("line_no", "raw", C.format_line(F.col("kept")).alias("line"), (F.size("c") - F.size("kept")).cast("long").alias("n_pruned"), (~alive(F.col("kept"))).alias("dead"))


def merged(
    old_val: DataFrame,
    inventors: DataFrame,
    companies: DataFrame,
    prune: Callable[[Column], Column],
    holdout: int,
    seed: int,
    test_inventors: int = 0,
    test_companies: int = 0,
    test_seed: int = 456,
    exact: bool = True,
) -> DataFrame:
    """Columns source, line_no, split (val, test, pool, dead, skipped), line, n_pruned of three sources (line_no, line).

    Old validation lines stay as they are, the first of equals; inventors' lines among them are skipped. Of the companies
    ``holdout`` lines go to validation, drawn from all; test lines are drawn from living companies that are not held out, and
    from all inventors not skipped. A line that pruning leaves without a Latin cell is dead, drawn or not.
    """
    val = first_occurrences(old_val.select("line_no", "line").where("line <> ''"))
    out = val.select(F.lit(SOURCES[0]).alias("source"), "line_no", F.lit("val").alias("split"), "line", F.lit(0).cast("long").alias("n_pruned"))

    seen = val.select(F.col("line").alias("seen"))
    people = inventors.select("line_no", F.regexp_replace("line", r"[\r\n]+$", "").alias("line"))
    skipped = people.join(seen, F.col("line") == F.col("seen"), "left_semi")
    out = out.unionByName(skipped.select(F.lit(SOURCES[1]).alias("source"), "line_no", F.lit("skipped").alias("split"), "line", F.lit(0).cast("long").alias("n_pruned")))
    fresh = picked(_pruned(people.join(seen, F.col("line") == F.col("seen"), "left_anti"), prune), test_inventors, test_seed, exact)
    split = F.when(F.col("dead"), "dead").when(F.col("picked"), "test").otherwise("pool")
    out = out.unionByName(fresh.select(F.lit(SOURCES[1]).alias("source"), "line_no", split.alias("split"), "line", "n_pruned"))

    firms = picked(_pruned(companies, prune), holdout, seed, exact).withColumnRenamed("picked", "held")
    free = picked(firms.where("not dead and not held").select("line_no"), test_companies, test_seed, exact)
    firms = firms.join(free, "line_no", "left")
    split = F.when(F.col("dead"), "dead").when(F.col("held"), "val").when(F.coalesce("picked", F.lit(False)), "test").otherwise("pool")
    return out.unionByName(firms.select(F.lit(SOURCES[2]).alias("source"), "line_no", split.alias("split"), "line", "n_pruned"))


def split_lines(rows: DataFrame, split: str) -> DataFrame:
    """Columns source_rank, line_no, line of one split, to be written in that order."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    return rows.where(F.col("split") == split).select(rank.alias("source_rank"), "line_no", "line")


def merge_counts(rows: DataFrame) -> DataFrame:
    """One row of fifteen counters over ``merged`` rows."""
    n = lambda condition: F.count_if(F.expr(condition))
    pruned = lambda source: F.coalesce(F.sum(F.when(F.col("source") == source, F.col("n_pruned"))), F.lit(0)).cast("long")
    return rows.agg(
        n("source = 'old_val'").alias("old_val"),
        n("source = 'company'").alias("company_lines"),
        pruned("company").alias("company_pruned_cells"),
        n("source = 'company' and split = 'dead'").alias("company_dead_dropped"),
        n("source = 'company' and split = 'val'").alias("company_holdout"),
        n("source = 'company' and split = 'pool'").alias("company_to_pool"),
        n("split = 'skipped'").alias("inventor_skipped_val"),
        pruned("inventor").alias("inventor_pruned_cells"),
        n("source = 'inventor' and split = 'dead'").alias("inventor_dead_dropped"),
        n("source = 'inventor' and split = 'pool'").alias("inventor_to_pool"),
        n("split = 'pool'").alias("pool_total"),
        n("split = 'val'").alias("val_total"),
        n("source = 'inventor' and split = 'test'").alias("test_inventor"),
        n("source = 'company' and split = 'test'").alias("test_company"),
        n("split = 'test'").alias("test_total"),
    )
