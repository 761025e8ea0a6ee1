"""Drawing tokens from logits, and repeated decodes of clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def draw_token(logits: np.ndarray, temperature: float, top_p: float | None, rng: np.random.Generator) -> int:
    """The likeliest at temperature 0; else a draw, cut to the nucleus of ``top_p`` that always holds the likeliest."""
    if temperature <= 0:
        return int(np.argmax(logits))
    z = np.asarray(logits, float) / temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    if top_p is not None and 0 < top_p < 1:
        order = np.argsort(-p, kind="stable")
        before = np.cumsum(p[order]) - p[order]
        out = order[(before > top_p) & (np.arange(len(p)) > 0)]
        p[out] = 0
        p /= p.sum()
    return int(rng.choice(len(p), p=p))


def decodes(clusters: DataFrame, step: Callable[[list[float], list[int]], np.ndarray], end: int, n: int, seed: int, temperature: float = 1.0, top_p: float | None = None, most: int = 64) -> DataFrame:
    """Columns cluster, sample, ids: ``n`` decodes of each cluster (cluster, mean, logvar), a token at a time by ``step``.

    Each sample has a generator of its own, seeded by cluster and place, so it comes out the same anywhere.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for pdf in batches:
            out = []
            for cluster, mean, logvar in zip(pdf["cluster"], pdf["mean"], pdf["logvar"], strict=True):
                for k in range(n):
                    rng = np.random.default_rng([seed, zlib.crc32(str(cluster).encode()), k])
                    z = np.asarray(mean) + np.exp(np.asarray(logvar) / 2) * rng.standard_normal(len(mean))
                    ids: list[int] = []
                    while len(ids) < most:
                        token = draw_token(step(z.tolist(), ids), temperature, top_p, rng)
                        if token == end:
                            break
                        ids.append(token)
                    out.append((str(cluster), k, ids))
            yield pd.DataFrame(out, columns=["cluster", "sample", "ids"])

    return clusters.select(F.col("cluster").cast("string").alias("cluster"), "mean", "logvar").mapInPandas(run, "cluster string, sample int, ids array<int>")
