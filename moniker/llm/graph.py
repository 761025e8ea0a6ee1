"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Links that one task joins at most (16 bytes each); more are contracted as a table.
TASK_LINKS = 1 << 20


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links and the smallest node that it reaches.

    Each round hangs the larger root of a link under the smaller one, then points every node at its root.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = at.reshape(-1)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        high, low = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
        open_ = high != low
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        held = [[np.asarray(batch.column(c), np.int64) for c in ("a", "b")] for batch in batches]
        if held:
            node, root = joined(*(np.concatenate(side) for side in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

    return written(edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long"), "components")


def components(links: DataFrame) -> DataFrame:
    """Columns node, root: the smallest node that each linked node reaches; ``links`` has longs a and b.

    Alternating star contraction: larger neighbours, then smaller ones, move to the smallest of a node's
    neighbourhood, until nothing changes. Links stay a table throughout, written after each round; the driver sees a
    count and a checksum of them. As soon as a round has left TASK_LINKS or fewer, one task does the rest, as rounds of many
    near-empty tasks would cost more than the links are worth; the result is the same.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        if state[0] <= TASK_LINKS:
            return _in_one_task(edges)
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
