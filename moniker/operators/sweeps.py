"""Parameter sweeps: grids, names, metric histories."""

from __future__ import annotations

import copy
import itertools
import re
from collections.abc import Iterable, Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_combos(text: str, known: Iterable[str]) -> list[dict[str, float]]:
    """``a=1,b=2;a=3`` as a list of settings; keys must be known and settings not empty."""
    known, out = tuple(known), []
    for part in filter(None, map(str.strip, text.split(";"))):
        combo = {}
        for pair in part.split(","):
            key, _, value = (x.strip() for x in pair.partition("="))
            if key not in known:
                raise ValueError(f"unknown sweep key {key!r}, expected one of {', '.join(known)}")
            combo[key] = float(value)
        out.append(combo)
    return out


def grid(**values: Iterable[float]) -> list[dict[str, float]]:
    return [dict(zip(values, combo, strict=True)) for combo in itertools.product(*values.values())]


def combo_name(combo: Mapping[str, float]) -> str:
    return "-".join(f"{k}{combo[k]:g}" for k in sorted(combo))


def overlay(base: Mapping, overrides: Mapping[str, object]) -> dict:
    """A deep copy of ``base`` with dotted keys set."""
    out = copy.deepcopy(dict(base))
    for path, value in overrides.items():
        *parents, last = path.split(".")
        at = out
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def slug(name: str) -> str:
    """Fit for a path."""
    return re.sub(r"[^a-zA-Z0-9._-]+", "_", name).strip("_")[:96]


def sibling(path: str, ending: str) -> str:
    """``x.txt.gz`` as ``x.<ending>.txt.gz``."""
    p = PurePosixPath(path)
    suffix = ".txt.gz" if p.name.endswith(".txt.gz") else p.suffix
    return str(p.with_name(p.name[: len(p.name) - len(suffix)] + f".{ending}{suffix}"))


def read_history(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Metric rows (run, step, val_loss, train_loss, ...) of a CSV log with a header, in file order."""
    from ..sources.lines import numbered

    rows = spark.read.option("header", True).csv(path)
    numbers = [F.col(c).try_cast("double").alias(c) for c in rows.columns]
    return numbered(rows.select(*numbers), "step").withColumn("run", F.lit(run))


def append_results(results: DataFrame, folder: str) -> None:
    """Adds rows to a folder of CSV files with headers; columns in the order given."""
    results.write.mode("append").option("header", True).csv(folder)


def read_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(folder)


def history_lines(history: DataFrame) -> DataFrame:
    """run and a JSON list of its validation rows by step; history (run, step, val_loss, train_loss)."""
    rows = F.array_sort(F.collect_list(F.when(F.col("val_loss").isNotNull(), F.struct("step", "val_loss"))))
    return history.groupBy("run").agg(F.to_json(rows).alias("val_history"))
