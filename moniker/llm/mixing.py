"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source has the same wanted number of copies; its whole part is certain and the fraction a
probability. Two documents with fractions exchange word mass at random until one fraction is 0 or 1, which keeps
the words taken together and each document's expected copies. Leaves hold a few thousand documents of one
source; the one document that a leaf leaves open goes up a reduction tree of fan-in 64, and only the last one of
each source is rounded by itself. So a source misses its target by less than one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import table, text_key, written

WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
MOST = 3
LEAF = 4096
#: More sources than this are joined by shuffle.
BROADCAST_SOURCES = 100_000
FAN_IN = 64
_NEAR = 1e-9


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Words to take of each source: all words shared by weight, what is above ``most`` times a source's size reshared."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, active = float(sum(sizes.values())), list(names)
    while active:
        total = sum(weight[s] for s in active)
        above = [s for s in active if left * weight[s] / total > most * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in active}
        out |= {s: float(most * sizes[s]) for s in above}
        left -= sum(most * sizes[s] for s in above)
        active = [s for s in active if s not in above]
    return out


def pivotal(p: np.ndarray, size: np.ndarray, key: np.ndarray, seed: int, last: bool) -> np.ndarray:
    """Round fractions in turn, the one left open against the next; ``last`` also rounds the one that stays open.

    Sizes are given in falling order, so that long documents exchange with long ones and what stays open is short.
    """
    salted = tk.mix(key.astype(np.uint64)) + np.full(1, seed, np.uint64) * tk._K1
    draw, final = (tk.mix(salted + np.uint64(k)).astype(np.float64) / 2.0**64 for k in (1, 2))
    p, open_at = p.astype(np.float64), -1
    for i in range(len(p)):
        if not _NEAR < p[i] < 1 - _NEAR:
            p[i] = round(p[i])
            continue
        if size[i] == 0:
            p[i] = 0
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b = open_at, i
        up = min((1 - p[a]) * size[a], p[b] * size[b])  # words that may go from b to a
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        move = up if draw[b] * (up + down) < down else -down
        p[a] += move / size[a]
        p[b] -= move / size[b]
        open_at = -1
        for k in (a, b):
            if not _NEAR < p[k] < 1 - _NEAR:
                p[k] = round(p[k])
            else:
                open_at = k
    if last and open_at >= 0:
        p[open_at] = float(final[open_at] < p[open_at])
    return p


def _level(rows: DataFrame, last_level: bool, seed: int) -> DataFrame:
    """Round within each (source, node)."""

    def run(group: pa.Table) -> pa.Table:
        # long documents first, so that the one left open is short; equal keys are repeated rows, which are alike
        group = group.sort_by([("size", "descending"), ("key", "ascending")])
        p = pivotal(*(group.column(c).to_numpy() for c in ("p", "size", "key")), seed, last_level)
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p))

    return rows.groupBy("rank", "node").applyInArrow(run, rows.schema)


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), weights=WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """Columns ``keep`` of ``docs`` and size, source_size, target, copies, taken (``copies * size``).

    Null text has size 0 and null source is a source of its own, weighed last; documents without words are taken 0
    times. Repeated rows count as documents of their own. The draw hangs on doc_id and text only, so reruns agree
    however the rows are dealt. The driver holds one number for each source and nothing for each document.
    """
    sized = written(
        docs.select(
            *(F.col(c).alias(f"__{c}") for c in keep),
            F.col("source").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            F.xxhash64("doc_id", text_key()).alias("key"),
        ),
        "mix-sizes",
    )
    stats = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()}
    words = {s: r["words"] for s, r in stats.items()}
    wanted = targets(words, weights, most)
    leaves = {s: max(1, -(-r["docs"] // LEAF)) for s, r in stats.items()}
    shares = [(k, s, words[s], wanted[s], leaves[s]) for k, s in enumerate(wanted)]
    share = docs.sparkSession.createDataFrame(shares, "rank int, name string, source_size long, target double, leaves long")
    share = F.broadcast(share) if len(shares) <= BROADCAST_SOURCES else share
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sized.join(share, sized["source"].eqNullSafe(share["name"]))
        .withColumn("whole", F.least(F.floor(rate + _NEAR), F.lit(most)))
        .withColumn("p", F.when(F.col("whole") >= most, 0.0).otherwise(F.greatest(rate - F.col("whole"), F.lit(0.0))))
        .withColumn("node", F.expr("pmod(key, leaves)"))
        .drop("source", "name", "leaves")
    )
    is_open = (F.col("p") > _NEAR) & (F.col("p") < 1 - _NEAR)
    nodes, closed = max(leaves.values(), default=1), []
    while True:
        # every level draws anew: a document that stayed open has been drawn for before
        rows = written(_level(rows, nodes == 1, 1000 * seed + len(closed)), "mix-level")
        closed.append(rows.where(~is_open))
        if nodes == 1:
            break
        nodes = -(-nodes // FAN_IN)
        rows = rows.where(is_open).withColumn("node", F.floor(F.col("node") / FAN_IN))
    done = closed[0]
    for level in closed[1:]:
        done = done.unionByName(level)
    copies = (F.col("whole") + F.round("p")).cast("long")
    return done.select(*(F.col(f"__{c}").alias(c) for c in keep), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of op 9, and ``copies``: every row of ``documents``."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
