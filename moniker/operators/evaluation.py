"""Evaluation: weighted losses, spot checks, selectivity, decode diversity, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_loss(batches: DataFrame) -> DataFrame:
    """Cross-entropy by tokens, divergence by clusters, of ``batches`` (ce, kl, n_tok, n_cl); NaN without any."""
    mean = lambda x, n: F.coalesce(F.sum(F.col(x) * F.col(n)) / F.nullif(F.sum(n), F.lit(0)), F.lit(float("nan")))
    return batches.agg(mean("ce", "n_tok").alias("val_ce"), mean("kl", "n_cl").alias("val_kl"))


def spot_check(rows: DataFrame) -> DataFrame:
    """By tag: mean costs of held-out surfaces (primed, unprimed) and share of exact decodes."""
    return rows.groupBy("tag").agg(F.avg("nll_primed").alias("nll_primed"), F.avg("nll_unprimed").alias("nll_unprimed"), F.avg(F.col("matched").cast("int")).alias("match_rate"), F.count("*").alias("n"))


def split_inputs(records: DataFrame, n_inputs: int) -> DataFrame:
    """First cells as inputs, the rest held out; clusters without a rest are left out."""
    return records.where(F.size("cells") > F.greatest(F.lit(1), F.lit(n_inputs))).select("key", F.slice("cells", 1, n_inputs).alias("inputs"), F.slice("cells", n_inputs + 1, 1 << 20).alias("held_out"))


def at_shares(rows: DataFrame, value: str, shares: tuple[float, ...], cuts: int = 128) -> DataFrame:
    """One row: for each share q the value at place floor(q n) in order, the last at most (v0, v1, ...).

    Equal values are counted first. Approximate quantiles cut the values into ranges, whose counts tell which range holds
    a place; only those ranges are ordered, each in a task of its own.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    edges = rows.agg(F.percentile_approx(value, [k / cuts for k in range(1, cuts)], 8 * cuts).alias("edges"))
    cut = counts.join(F.broadcast(edges)).withColumn("range", F.size(F.filter("edges", lambda e: e < F.col("v")))).select("range", "v", "c")
    below = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = cut.groupBy("range").agg(F.sum("c").alias("n")).withColumn("begin", F.coalesce(F.sum("n").over(below), F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())
    wanted = ranges.withColumn("places", F.transform(F.array(*map(F.lit, shares)), lambda q: F.least(total - 1, F.floor(q * total)))).where(
        F.exists("places", lambda p: (p >= F.col("begin")) & (p < F.col("begin") + F.col("n")))
    )
    before = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.join(F.broadcast(wanted), "range").withColumn("at", F.col("begin") + F.coalesce(F.sum("c").over(before), F.lit(0)))
    holds = lambda k: (F.col("places")[k] >= F.col("at")) & (F.col("places")[k] < F.col("at") + F.col("c"))
    return placed.agg(*(F.max(F.when(holds(k), F.col("v"))).alias(f"v{k}") for k in range(len(shares))))


def selectivity(rows: DataFrame) -> DataFrame:
    """Mean margin of negatives over members, nearest-rank percentiles, share of positive margins; rows (own, other)."""
    margins = rows.select("own", "other", (F.col("other") - F.col("own")).alias("margin"))
    means = margins.agg(F.avg("own").alias("own_mean"), F.avg("other").alias("other_mean"), F.avg("margin").alias("margin_mean"), F.avg((F.col("margin") > 0).cast("int")).alias("positive"))
    places = at_shares(margins, "margin", (0.1, 0.5, 0.9)).toDF("margin_p10", "margin_p50", "margin_p90")
    return means.crossJoin(places).select("own_mean", "other_mean", "margin_mean", "margin_p10", "margin_p50", "margin_p90", "positive")


def selectivity_probe(members: DataFrame, negatives: DataFrame) -> DataFrame:
    """By company: mean cost of its held-out cells and of its negatives; members and negatives (key, nll).

    Companies of fewer than two held-out cells (four in all, two of them inputs) are left out. Goes into ``selectivity``.
    """
    own = members.groupBy("key").agg(F.avg("nll").alias("own"), F.count("*").alias("n")).where("n >= 2")
    return own.join(negatives.groupBy("key").agg(F.avg("nll").alias("other")), "key").select("key", "own", "other")


def stated(panel: DataFrame, most: int) -> DataFrame:
    """``panel`` as it is if it has ``most`` rows or fewer, else an error: what every row is held against must be a stated set."""
    n = panel.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a panel of more than {most} rows")
    return panel


def negatives(members: DataFrame, panel: DataFrame, size: int, seed: int, most: int = 4096) -> DataFrame:
    """For each key up to ``size`` cells of other keys: by a seeded hash of the pair, out of a panel of ``most`` cells at most."""
    cells = stated(panel, most).agg(F.collect_list(F.struct(F.col("key").alias("other_key"), F.col("value").alias("negative"))).alias("cells"))
    rank = lambda c: F.md5(F.concat_ws(":", F.lit(str(seed)), "key", c["other_key"], c["negative"]).cast("binary"))
    others = F.filter("cells", lambda c: c["other_key"] != F.col("key"))
    best = F.slice(F.array_sort(F.transform(others, lambda c: F.struct(rank(c).alias("r"), c["other_key"].alias("other_key"), c["negative"].alias("negative")))), 1, size)
    picked = members.select("key").distinct().join(F.broadcast(cells)).select("key", F.explode(best).alias("n"))
    return picked.select("key", "n.other_key", "n.negative")


def cross_entropy(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Mean cost of the labels that count, ``rows`` (label, nll, draw): by draw of noise first, then over the draws.

    A label of -100 is no label; NaN without any other.
    """
    keys = [by] if by else []
    draws = rows.groupBy(*keys, "draw").agg(F.avg(F.when(F.col("label") != -100, F.col("nll"))).alias("ce"))
    return draws.groupBy(*keys).agg(F.coalesce(F.avg("ce"), F.lit(float("nan"))).alias("ce"))


def bound(ce: Column, kl: Column, weight: float) -> Column:
    """The training loss: cost plus weighted divergence."""
    return ce + F.lit(weight) * kl


def cell_averages(cells: DataFrame) -> DataFrame:
    """Tokens and characters a cell on average, ``cells`` (value, ids)."""
    return cells.agg(F.avg(F.size("ids")).alias("tokens_per_cell"), F.avg(F.length("value")).alias("chars_per_cell"))


def decode_diversity(decodes: DataFrame) -> DataFrame:
    """By cluster: samples, distinct texts, entropy over its maximum (0 for one text); decodes (cluster, text)."""
    counts = decodes.groupBy("cluster", "text").agg(F.count("*").alias("c"))
    sums = counts.groupBy("cluster").agg(F.sum("c").alias("n"), F.count("*").alias("n_unique"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    entropy = F.log("n") - F.col("clogc") / F.col("n")
    return sums.select("cluster", "n", "n_unique", F.when(F.col("n_unique") > 1, entropy / F.log("n")).otherwise(0.0).alias("normalized_entropy"))


def final_metrics(history: DataFrame) -> DataFrame:
    """By run: the last row with a validation loss, the best one, and the last training loss; history (run, step, ...)."""
    return history.groupBy("run").agg(
        F.max_by("val_loss", F.when(F.col("val_loss").isNotNull(), F.col("step"))).alias("last_val_loss"),
        F.min("val_loss").alias("best_val_loss"),
        F.max_by("train_loss", F.when(F.col("train_loss").isNotNull(), F.col("step"))).alias("last_train_loss"),
        F.count("val_loss").alias("n_val"),
    )
