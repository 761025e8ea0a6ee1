"""Scoring, ranking and matching clusters, and statistics of posteriors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lines import spread
from .evaluation import stated


#: Rows of costs that a task gives on at once.
ROWS = 20_000


class Scorer(Protocol):
    """What a model must do: encode a cluster's surfaces, and give a surface's cost by token under an encoding."""

    def encode(self, surfaces: list[tuple[str, str]]) -> tuple[list[float], list[float]]: ...

    def nll(self, mean: list[float], tag: str | None, text: str) -> list[float]: ...


@lru_cache(1 << 14)
def _trigrams(text: str, dim: int) -> np.ndarray:
    out = np.zeros(dim)
    padded = f"^{text.lower()}$"
    for k in range(len(padded) - 2):
        out[zlib.crc32(padded[k : k + 3].encode()) % dim] += 1
    return out / max(1.0, np.linalg.norm(out))


class TrigramScorer:
    """A stand-in without a trained model: hashed character trigrams, cost by token from their distance."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _vector(self, text: str) -> np.ndarray:
        return _trigrams(text, self.dim)

    def encode(self, surfaces):
        v = np.stack([self._vector(t) for _, t in surfaces])
        return v.mean(0).tolist(), np.log(v.var(0) + 0.05).tolist()

    def nll(self, mean, tag, text):
        if not text:
            raise ValueError("a surface without tokens has no score")
        far = float(((self._vector(text) - np.asarray(mean)) ** 2).sum())
        return [far] * max(1, len(text.split()))


def _encoded(scorer: Scorer, surfaces, most: int) -> tuple[list[float], list[float]]:
    return scorer.encode([(s["tag"], s["text"]) for s in surfaces[:most]])


def posteriors(clusters: DataFrame, scorer: Scorer, most: int = 12) -> DataFrame:
    """Columns key, mean, logvar of ``clusters`` (key, surfaces); at most ``most`` surfaces are looked at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [_encoded(scorer, surfaces, most) for surfaces in pdf["surfaces"]]
            yield pd.DataFrame({"key": pdf["key"], "mean": [m for m, _ in pairs], "logvar": [v for _, v in pairs]})

    return clusters.where(F.size("surfaces") > 0).select("key", "surfaces").mapInPandas(run, "key string, mean array<double>, logvar array<double>")


def cross_scored(queries: DataFrame, panel: DataFrame, scorer: Scorer, primed: tuple[bool, ...] = (True,), most: int = 100_000, surfaces: int = 12) -> DataFrame:
    """Columns id, candidate, primed, nll_tok: cost by token of each candidate's surfaces under each query's encoding.

    The panel is what the query set is matched against, a stated set of ``most`` clusters at most (more are an error): every
    task has it, so a query is encoded and scored where it is, and only costs are shuffled. Costs are averaged by surface,
    then by candidate. Of a query's surfaces ``surfaces`` at most are looked at.
    """
    own: dict[str, list[tuple[str, str]]] = {}
    for r in stated(panel, most).select(F.col("key").alias("candidate"), F.explode("surfaces").alias("s")).select("candidate", "s.tag", "s.text").toLocalIterator():
        own.setdefault(r["candidate"], []).append((r["tag"], r["text"]))
    told = queries.sparkSession.sparkContext.broadcast(own)
    columns = ["id", "candidate", "primed", "cost", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, mine in zip(pdf["key"], pdf["surfaces"], strict=True):
                mean = np.asarray(_encoded(scorer, mine, surfaces)[0])
                for candidate, forms in told.value.items():
                    for p in primed:
                        costs = [scorer.nll(mean, t if p else None, x) for t, x in forms]
                        rows.append((key, candidate, p, sum(sum(c) / len(c) for c in costs), len(costs)))
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    asked = spread(queries.where(F.size("surfaces") > 0).select("key", "surfaces"))
    costs = asked.mapInPandas(run, "id string, candidate string, primed boolean, cost double, n long")
    return costs.groupBy("id", "candidate", "primed").agg((F.sum("cost") / F.sum("n")).alias("nll_tok"))


def ranked(scores: DataFrame, order: str, most: int = 10) -> DataFrame:
    """Columns id, rank, name, score, margin of ``scores`` (id, name, score, ``order``): the best first.

    The margin is the median of the other candidates' scores minus the own score; null for a lone candidate. Equal
    scores keep the order of ``order``.
    """
    at = Window.partitionBy("id").orderBy("score", order)
    best = scores.select("id", "name", "score", F.row_number().over(at).alias("rank")).where(F.col("rank") <= most)
    whole = scores.groupBy("id").agg(F.array_sort(F.collect_list("score")).alias("__s"))
    # the k-th of the others (from 1) is the k-th of all below the own rank, else the next one
    other = lambda k: F.when(k < F.col("rank"), F.get("__s", k - 1)).otherwise(F.get("__s", k))
    m = F.size("__s") - 1
    low, high = F.floor((m + 1) / 2).cast("int"), F.floor((m + 2) / 2).cast("int")
    median = F.when(m > 0, (other(low) + other(high)) / 2)
    return best.join(whole, "id").select("id", "rank", "name", "score", (median - F.col("score")).alias("margin"))


def kl_terms(mean: Column, logvar: Column) -> Column:
    """By dimension: divergence from a standard normal."""
    return F.zip_with(mean, logvar, lambda m, v: 0.5 * (m * m + F.exp(v) - 1 - v))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda a, x: a + x)


def lower_median(values: Column) -> Column:
    return F.element_at(F.array_sort(values), (F.floor((F.size(values) - 1) / 2) + 1).cast("int"))


def linear_quantile(values: Column, q: float) -> Column:
    """Between neighbours in order, as percentile() takes it."""
    ordered = F.array_sort(values)
    at = F.lit(q) * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    a, b = F.element_at(ordered, low + 1), F.element_at(ordered, F.least(low + 2, F.size(values)))
    return a + (b - a) * (at - low)


def posterior_stats(rows: DataFrame) -> DataFrame:
    """``rows`` (mean, logvar) with sum and mean divergence, variance statistics, the share of dimensions wider than the prior."""
    var = F.transform("logvar", F.exp)
    out = rows.withColumn("__var", var).withColumn("__kl", kl_terms(F.col("mean"), F.col("logvar")))
    n = F.size("mean")
    return out.select(
        *rows.columns,
        total(F.col("__kl")).alias("kl_sum"),
        (total(F.col("__kl")) / n).alias("kl_mean"),
        (total(F.col("__var")) / n).alias("var_mean"),
        lower_median(F.col("__var")).alias("var_p50"),
        linear_quantile(F.col("__var"), 0.9).alias("var_p90"),
        F.array_max("__var").alias("var_max"),
        total(F.col("__var")).alias("var_sum"),
        lower_median(F.transform("__var", F.sqrt)).alias("std_p50"),
        (F.size(F.filter("__var", lambda v: v > 1)) / n).alias("dims_over_prior"),
        n.alias("dim"),
    )


def pooled(surfaces: DataFrame, query: Column, cluster: str = "cluster") -> DataFrame:
    """Attention pooling: by cluster the softmax-weighted sum of ``vector``, weights from its product with ``query``.

    Columns cluster, dim, value. The largest score goes off first, as sums of exponentials would overflow.
    """
    score = total(F.zip_with("vector", query, lambda a, b: a * b)) / F.sqrt(F.size("vector"))
    scored = surfaces.select(cluster, "vector", score.alias("score"))
    top = scored.groupBy(cluster).agg(F.max("score").alias("top"))
    weighed = scored.join(top, cluster).withColumn("w", F.exp(F.col("score") - F.col("top")))
    long = weighed.select(cluster, "w", F.posexplode("vector").alias("dim", "x"))
    return long.groupBy(cluster, "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("value"))


def sampled(mean: Column, logvar: Column, noise: Column) -> Column:
    """Reparameterised draw from standard normal noise."""
    return F.zip_with(F.zip_with(mean, F.transform(logvar, lambda v: F.exp(0.5 * v)), lambda m, s: F.struct(m.alias("m"), s.alias("s"))), noise, lambda p, e: p["m"] + p["s"] * e)
