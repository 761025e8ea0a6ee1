"""Stages that call a model: attempts, retries, merging and filtering over a table of responses.

The client is an interface. Without a service, ``Responses`` answers from a table (stage, key, attempt, raw_text), so
that every stage is a join and gives the same again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scripts, toolcalls
from ..functions.base import let
from ..functions.cells import merge_by_tag
from ..functions.names import title_name
from ..sources.lines import scratch, settled, spread
from . import prompts

# Sampling of each stage's attempts.
STAGES = (
    ("extract", 0, 0.0, 1.0, 256),
    ("extract", 1, 0.3, 0.9, 256),
    ("transliterate", 0, 0.2, 0.9, 1024),
    ("transliterate", 1, 0.7, 0.95, 512),
    ("alternatives", 0, 0.2, 0.9, 256),
    ("alternatives", 1, 0.5, 0.95, 256),
    ("judge", 0, 0.0, 1.0, 128),
    ("judge", 1, 0.3, 0.9, 128),
)


def stage_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAGES, "stage string, attempt int, temperature double, top_p double, max_tokens int")


class Client(Protocol):
    def answers(self, requests: DataFrame) -> DataFrame:
        """``requests`` (stage, key, attempt) with raw_text, null where there is none."""


class Responses:
    """Answers from a table."""

    def __init__(self, table: DataFrame):
        self.table = table

    def answers(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.table.select("stage", "key", "attempt", "raw_text"), ["stage", "key", "attempt"], "left")


class Service:
    """Answers from ``call(stage, key, attempt, prompt)``, tried again with growing pauses, in the tasks."""

    def __init__(self, call, tries: int = 5, pause: float = 1.0):
        self.call, self.tries, self.pause = call, tries, pause

    def answers(self, requests: DataFrame) -> DataFrame:
        import time

        def once(stage, key, attempt, prompt):
            for k in range(self.tries):
                try:
                    return self.call(stage, key, attempt, prompt)
                except OSError:
                    if k + 1 == self.tries:
                        return None
                    time.sleep(self.pause * 2**k)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(raw_text=[once(*r) for r in zip(pdf["stage"], pdf["key"], pdf["attempt"], pdf["prompt"], strict=True)])

        said = requests.select("stage", "key", "attempt", "prompt")
        told = said.mapInPandas(run, said.withColumn("raw_text", F.lit("")).schema).drop("prompt")
        # written, so that what reads an answer twice does not ask twice
        path = scratch(requests.sparkSession, "answers")
        told.write.parquet(path)
        return requests.join(requests.sparkSession.read.schema(told.schema).parquet(path), ["stage", "key", "attempt"], "left")


def first_call(raw_text: Column) -> Column:
    return F.get(toolcalls.calls(F.coalesce(raw_text, F.lit(""))), 0)


def read_call(raw_text: Column, parse) -> Column:
    """``parse`` of the first call, which is taken out of the text once."""
    return let(first_call(raw_text), lambda call: parse(call))  # a second parameter of parse is not the place


def attempted(client: Client, rows: DataFrame, stage: str, parse, attempts: int = 2) -> DataFrame:
    """``rows`` (key, perhaps label) with result and attempt: each attempt asks for what is still without a result.

    Every answer is read once, by all cores, and what it says is written.
    """
    about = [c for c in ("key", "label") if c in rows.columns]
    left, done = rows.select(*about).distinct(), None
    for k in range(attempts):
        asked = client.answers(prompts.prompted(left.select(F.lit(stage).alias("stage"), *about, F.lit(k).alias("attempt"))))
        parsed = settled(spread(asked).select(*about, "attempt", read_call(F.col("raw_text"), parse).alias("result")), stage)
        found = parsed.where("result is not null").select("key", "attempt", "result")
        done = found if done is None else done.unionByName(found)
        left = parsed.where("result is null").select(*about)
    return rows.join(done, "key", "left")


def extracted(client: Client, rows: DataFrame) -> DataFrame:
    """Outcome (extract_name, not_a_person_name, incomplete_name, malformed) and variants of each key."""
    out = attempted(client, rows, "extract", toolcalls.extraction)
    return out.select(*rows.columns, F.coalesce("result.outcome", F.lit("malformed")).alias("outcome"), "result.variants")


def transliterated(client: Client, rows: DataFrame, passes: tuple[str, ...] = ("transliterate_a", "transliterate_b", "transliterate_c"), chinese=("", "")) -> DataFrame:
    """Forms by script of each key: passes merged, expanded within scripts, forms of another script left out."""
    merged = None
    for stage in passes:
        part = attempted(client, rows.select("key"), stage, toolcalls.emitted_scripts).select("key", F.coalesce("result", F.create_map().cast("map<string,array<string>>")).alias(stage))
        merged = part if merged is None else merged.join(part, "key")
    forms = F.col(passes[0])
    for stage in passes[1:]:
        forms = merge_by_tag(forms, F.col(stage))
    wide = F.transform_values(forms, lambda tag, values: F.array_distinct(F.flatten(F.transform(values, lambda v: scripts.expand(v, tag, chinese)))))
    fit = F.transform_values(wide, lambda tag, values: F.filter(values, lambda v: scripts.in_script(v, tag)))
    return rows.join(merged.select("key", F.map_filter(fit, lambda _, v: F.size(v) > 0).alias("forms")), "key", "left")


def judged(client: Client, rows: DataFrame) -> DataFrame:
    """Scripts in which a company name plausibly occurs; rows without an answer keep null."""
    return attempted(client, rows, "judge", toolcalls.plausible_scripts).withColumnRenamed("result", "scripts").drop("attempt")


def audited(client: Client, rows: DataFrame) -> DataFrame:
    """``rows`` (key, given, family) with outcome clean, fixed or dropped, fixed names and drop_reason.

    A fix that is the same name in title case is none; an unusable one, and no usable answer, drops the row.
    """

    def parse(call):
        text = lambda k: F.coalesce(call["args"][k], F.lit(""))
        return F.when(call["name"].isin("clean", "unrecoverable", "fix"), F.struct(call["name"].alias("verdict"), text("given").alias("given"), text("family").alias("family")))

    from ..functions.names import is_usable

    out = attempted(client, rows, "audit", parse)
    r = F.col("result")
    same = (title_name(r["given"]) == title_name(F.col("given"))) & (title_name(r["family"]) == title_name(F.col("family")))
    outcome = (
        F.when(r.isNull() | (r["verdict"] == "unrecoverable"), "dropped")
        .when((r["verdict"] == "clean") | same, "clean")
        .when(is_usable(r["given"], r["family"]), "fixed")
        .otherwise("dropped")
    )
    out = out.withColumn("outcome", outcome)
    fixed = F.col("outcome") == "fixed"
    return out.select(
        *rows.columns,
        "outcome",
        F.when(fixed, r["given"]).alias("fixed_given"),
        F.when(fixed, r["family"]).alias("fixed_family"),
        F.when(F.col("outcome") == "dropped", "audit_unrecoverable_or_invalid").alias("drop_reason"),
    )
