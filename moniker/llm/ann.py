"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised by themselves, so K centroids a half make K * K cells. A query adds up its
inner products with the halves' centroids and visits pairs of centroids from the largest sum on, found by a heap, until
the cells visited hold a calibrated share of all vectors. Their entries are reranked by the inner product itself.

Entries are dealt to shards by cell, large cells to several, and a query goes only to shards that hold cells it visits. A
task holds the entries of one shard and streams its queries through them, so what is shuffled are the entries, once for each
BLOCK queries, and the visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

NEIGHBOURS = 20
#: Centroids of a half, vectors that they are fitted on, rounds of fitting.
CENTROIDS = 64
SAMPLE = 16_384
ROUNDS = 8
#: Share of true neighbours wanted among the entries visited, by sample queries, and how many of those.
RECALL = 0.97
PROBES = 256
#: Entries of a shard, which a task holds, and queries that it streams through them before the shard is held once more.
SHARD = 8192
BLOCK = 1 << 20


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        at = nearest(x, centre)
        size = np.bincount(at, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, at, x)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (x @ centre.T - 0.5 * (centre * centre).sum(1)).argmax(1)


class MultiIndex:
    """Centroids of both halves, entries of each cell, and how many entries to visit."""

    def __init__(self, sample: np.ndarray):
        self.dim = sample.shape[1]
        self.half = self.dim // 2
        self.left = kmeans(sample[:, : self.half], CENTROIDS, 1)
        self.right = kmeans(sample[:, self.half :], CENTROIDS, 2)
        self.share = self._calibrate(sample)
        self.sizes = np.zeros(self.cells, np.int64)

    @property
    def cells(self) -> int:
        return len(self.left) * len(self.right)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.left) * len(self.right) + nearest(x[:, self.half :], self.right)

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return q[:, : self.half] @ self.left.T, q[:, self.half :] @ self.right.T

    def _calibrate(self, sample: np.ndarray) -> float:
        """Least share of entries, in the order of their cells, that holds RECALL of the probes' true neighbours."""
        probes = sample[:PROBES]
        a, b = self.scores(probes)
        cell = self.cell(sample)
        order = (a[:, :, None] + b[:, None, :]).reshape(len(probes), -1)[:, cell]
        true = probes @ sample.T
        own = np.arange(len(probes))
        true[own, own] = -np.inf
        k = min(NEIGHBOURS, len(sample) - 1)
        if k < 1:
            return 1.0
        top = np.argpartition(-true, k - 1, axis=1)[:, :k]
        place = np.empty(order.shape, np.int64)
        np.put_along_axis(place, np.argsort(-order, axis=1, kind="stable"), np.broadcast_to(np.arange(len(sample)), order.shape), 1)
        return float(np.quantile(np.take_along_axis(place, top, 1) + 1, RECALL) / len(sample))

    def visit(self, a: np.ndarray, b: np.ndarray, least: int) -> float:
        """The sum down to which cells are visited: pairs by falling sum until they hold ``least`` entries."""
        i, j = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[i].tolist(), b[j].tolist()
        sizes, width = self.sizes.reshape(len(a), len(b))[np.ix_(i, j)].tolist(), len(b)
        heap, have, last = [(-(a[0] + b[0]), 0, 0)], 0, np.inf
        while heap and have < least:
            last, x, y = heapq.heappop(heap)
            have += sizes[x][y]
            if y + 1 < width:
                heapq.heappush(heap, (-(a[x] + b[y + 1]), x, y + 1))
            if y == 0 and x + 1 < len(a):
                heapq.heappush(heap, (-(a[x + 1] + b[0]), x + 1, 0))
        return -last


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, all of the most frequent dimension."""
    x = F.col("embedding").cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(~F.exists("vector", bad) & F.exists("vector", lambda v: v != 0))
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["dim"] if sizes else 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest_neighbours(vectors: DataFrame, is_query, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found by inner product of each row with ``is_query``.

    A query's own id is no candidate. Ties go to the smaller vec_id. Vectors that are null, zero, of another dimension
    than most, or hold null or non-finite components take no part, nor do rows without an id; repeated rows count each.
    Every row is indexed; centroids and the share to visit come from a sample of about ``SAMPLE`` rows by hash of the id.
    Other columns are left out.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    total = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    key = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    share = min(1.0, SAMPLE / total)
    picked = rows.where(key < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * SAMPLE).select("vector").toArrow()
    dim = len(picked.column(0)[0].as_py()) if picked.num_rows else 0
    if dim < 2 or picked.num_rows < 2:
        picked = rows.limit(SAMPLE).select("vector").toArrow()
        dim = len(picked.column(0)[0].as_py())
    index = MultiIndex(_matrix(picked.column(0), dim))

    def encode(batches):
        for batch in batches:
            cell = index.cell(_matrix(batch.column("vector"), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], names=["vec_id", "vector", "cell"])

    coded = written(rows.mapInArrow(encode, "vec_id long, vector array<double>, cell long"), "ann-cells")
    for r in coded.groupBy("cell").count().collect():  # one number a cell: CENTROIDS squared at most
        index.sizes[r["cell"]] = r["count"]
    # shards: runs of cells with SHARD entries or so; a larger cell has several of its own
    parts = np.maximum(1, -(-index.sizes // SHARD))
    begins = np.zeros(index.cells, np.int64)
    shard, room = 0, 0
    for c in range(index.cells):
        if parts[c] > 1 or room + index.sizes[c] > SHARD:
            shard, room = shard + (room > 0), 0
        begins[c] = shard
        room += index.sizes[c]
        if parts[c] > 1:
            shard, room = shard + int(parts[c]), 0
    handle = spark.sparkContext.broadcast((index, begins, parts))
    blocks = max(1, -(-coded.where(is_query).count() // BLOCK))
    least = max(k + 1, int(np.ceil(index.share * total)))

    def route(batches):
        index, begins, parts = handle.value
        for batch in batches:
            x = _matrix(batch.column("vector"), dim)
            a, b = index.scores(x)
            for q in range(len(x)):
                down = index.visit(a[q], b[q], least)
                cells = np.flatnonzero(((a[q][:, None] + b[q][None]).ravel() >= down) & (index.sizes > 0))
                shards = np.unique(np.concatenate([np.arange(begins[c], begins[c] + parts[c]) for c in cells[parts[cells] > 1]] + [begins[cells]]))
                n = len(shards)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("vec_id")[q].as_py()] * n, pa.int64()), batch.column("vector").take(pa.array([q] * n)), pa.array([down] * n), pa.array(shards)],
                    names=["query_id", "vector", "down", "shard"],
                )

    def place(batches):
        _, begins, parts = handle.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            at = begins[cell] + np.abs(batch.column("part").to_numpy()) % parts[cell]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "vector", "cell")), pa.array(at)], names=["vec_id", "vector", "cell", "shard"])

    entries = coded.withColumn("part", F.shiftrightunsigned(F.xxhash64("vec_id", F.monotonically_increasing_id()), 1)).mapInArrow(place, "vec_id long, vector array<double>, cell long, shard long")
    entries = entries.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "vector", "cell", F.lit(0.0).alias("down"))
    queries = coded.where(is_query).select("vec_id", "vector").mapInArrow(route, "query_id long, vector array<double>, down double, shard long")
    queries = queries.select("shard", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), "vector", F.lit(0).cast("long").alias("cell"), "down")

    def best(asked: pa.RecordBatch, x: np.ndarray, ids: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
        index, _, _ = handle.value
        all_q, query_ids, down = _matrix(asked.column("vector"), dim), asked.column("id").to_numpy(), asked.column("down").to_numpy()
        for at in range(0, len(all_q), 256):
            out: list[list] = [[], [], []]
            q = all_q[at : at + 256]
            a, b = index.scores(q)
            reach = a[:, cell // len(index.right)] + b[:, cell % len(index.right)]
            near = q @ x.T
            near[(reach < down[at : at + 256, None] - 1e-9) | (query_ids[at : at + 256, None] == ids)] = -np.inf
            top = min(k, near.shape[1])
            edge = np.partition(near, near.shape[1] - top, axis=1)[:, near.shape[1] - top]
            for r in range(len(q)):
                some = np.flatnonzero((near[r] >= edge[r] - 1e-9) & (near[r] > -np.inf))
                score = (x[some] * q[r]).sum(1)
                first = np.lexsort((ids[some], -score))[:k]
                out[0] += [query_ids[at + r]] * len(first)
                out[1] += ids[some][first].tolist()
                out[2] += score[first].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard and block, entries before queries."""
        now, held, ready = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shard", "block", "kind")], 1)
            edge = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            for begin, end in zip([0, *edge], [*edge, len(keys)], strict=True):
                if begin == end:
                    continue
                part, (*own, kind) = batch.slice(begin, end - begin), keys[begin].tolist()
                if own != now:
                    now, held, ready = own, [], None
                if kind == 0:
                    held.append((_matrix(part.column("vector"), dim), part.column("id").to_numpy(), part.column("cell").to_numpy()))
                elif held:
                    ready = ready or tuple(np.concatenate(side) for side in zip(*held, strict=True))
                    yield from best(part, *ready)

    dealt = entries.unionByName(queries).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
    found = dealt.mapInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
