"""Shards as a resumable feed, and waves of work with checkpoints."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_order(shards: list[str], seed: int | None, epoch: int) -> list[str]:
    """The shards of an epoch in their seeded order."""
    out = list(shards)
    if seed is not None:
        random.Random(seed + epoch).shuffle(out)
    return out


def epoch_table(spark: SparkSession, shards: list[str], seed: int | None, epochs: int, reshuffle_each_epoch: bool = True) -> DataFrame:
    """Columns epoch, pos, shard. Without reshuffling every epoch repeats the first one's order."""
    rows = [(e, k, s) for e in range(epochs) for k, s in enumerate(epoch_order(shards, seed, e if reshuffle_each_epoch else 0))]
    return spark.createDataFrame(rows, "epoch int, pos int, shard string")


def feed(shards: list[str], seed: int | None = None, epoch: int = 0, done: int = 0, endless: bool = False) -> Iterator[str]:
    """Shards from ``done`` on; an endless feed then repeats the same order for ever."""
    order = epoch_order(shards, seed, epoch)
    yield from order[done:]
    while endless and order:
        yield from order


def rank_share(epochs: DataFrame, rank: int, world: int) -> DataFrame:
    """The shards of one rank: dealt in turn by place."""
    return epochs.where(F.pmod("pos", F.lit(world)) == rank)


class Progress:
    """Where a feed stands: whole epochs and shards of the next, checked against the feed it goes with."""

    def __init__(self, n_shards: int, shard_size: int, seed: int | None = None):
        self.n_shards, self.shard_size, self.seed = n_shards, shard_size, seed
        self.epochs, self.samples = 0, 0

    def advance(self, samples: int) -> None:
        self.samples += samples
        whole = self.n_shards * self.shard_size
        self.epochs, self.samples = self.epochs + self.samples // whole, self.samples % whole

    def state(self) -> dict:
        return {"seed": self.seed, "processed_epochs": self.epochs, "processed_samples": self.samples}

    def restore(self, state: dict) -> None:
        """A state with only a seed is one from before the first epoch's end."""
        if state.get("seed") != self.seed:
            raise ValueError(f"the state's seed {state.get('seed')} is not the feed's {self.seed}")
        samples = state.get("processed_samples", 0)
        if samples % self.shard_size:
            raise ValueError(f"{samples} samples are no whole number of shards of {self.shard_size}")
        self.epochs, self.samples = state.get("processed_epochs", 0), samples

    @property
    def shards(self) -> int:
        return self.samples // self.shard_size


def stream_records(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Shard files of a folder as a stream; the query's checkpoint holds its progress."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_waves(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, resolved: DataFrame | None = None, key: str = "line_no") -> None:
    """Work through what is there, a wave a batch, appending results; begun again, it goes on after the last whole wave.

    A wave that was cut short is done again; its rows carry the wave, so that the last of equals counts
    (``latest``). Keys in ``resolved`` are left out.
    """

    def wave(rows: DataFrame, number: int) -> None:
        if resolved is not None:
            rows = rows.join(resolved.select(key), key, "left_anti")
        work(rows).withColumn("wave", F.lit(number).cast("long")).write.mode("append").parquet(out)

    stream.writeStream.foreachBatch(wave).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(results: DataFrame, key: str = "line_no", order: str = "wave") -> DataFrame:
    rest = [c for c in results.columns if c != key]
    return results.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
