"""Clusters in JSON lines and in shards."""

from __future__ import annotations

import gzip
import io
import json
import re
import tarfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.base import strip
from ..schema import RECORD, SCRIPTS
from .lines import read_raw, spread

_SURFACE = "struct<tag:string,text:string>"


def read_clusters(spark: SparkSession, path: str, key_field: str = "id", strict: bool = True) -> DataFrame:
    """Clusters with line_no, key, surfaces (tag, text) and error.

    A surface is an object with tag and text, or a text that takes the line's own ``tag``. A missing key becomes
    ``line-N``. Blank lines and lines without surfaces are left out. Lines with an error raise one if ``strict``,
    else they come back with it.
    """
    lines = read_raw(spark, path, "value").where(strip(F.col("value")) != "").withColumn("n", F.col("line_no") + 1)
    parsed = lines.withColumn("j", F.try_parse_json("value"))
    shared = F.try_variant_get("j", "$.tag", "string")
    raw = F.from_json(F.get_json_object("value", "$.surfaces"), "array<string>")
    surfaces = F.transform(
        raw,
        lambda s: F.when(s.startswith("{"), F.from_json(s, _SURFACE)).otherwise(F.struct(shared.alias("tag"), s.alias("text"))),
    )
    key = F.coalesce(F.nullif(strip(F.coalesce(F.get_json_object("value", f"$.{key_field}"), F.lit(""))), F.lit("")), F.concat(F.lit("line-"), F.col("n")))
    known = F.forall("surfaces", lambda s: F.coalesce(s["tag"].isin(*SCRIPTS), F.lit(False)) & s["text"].isNotNull())
    error = (
        F.when(F.col("j").isNull(), F.concat(F.lit("line "), F.col("n"), F.lit(": invalid JSON")))
        .when(raw.isNull(), F.concat(F.lit("line "), F.col("n"), F.lit(": no surfaces")))
        .when(~known, F.concat(F.lit("line "), F.col("n"), F.lit(": unknown tag or no text")))
    )
    out = parsed.withColumn("surfaces", surfaces).select("line_no", key.alias("key"), "surfaces", error.alias("error"))
    if strict:
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).cast("string"))
    return out.where("error is not null or size(surfaces) > 0")


def expand_braces(pattern: str) -> list[str]:
    """``a-{000000..000002}.tar`` as its names."""
    found = re.search(r"\{(\d+)\.\.(\d+)\}", pattern)
    if not found:
        return [pattern]
    low, high = found.groups()
    return [pattern[: found.start()] + str(k).zfill(len(low)) + pattern[found.end() :] for k in range(int(low), int(high) + 1)]


def write_shards(records: DataFrame, path: str) -> None:
    """Records (shard, position, key, tags, cells) as tar.gz blobs by shard, ``blob`` files of Parquet, a row a shard."""

    def pack(pdf):
        parts, size = [], 0
        for r in pdf.sort_values("position").itertuples():
            data = r.body.encode()
            info = tarfile.TarInfo(f"{r.key}.json")
            info.size = len(data)
            parts.append(info.tobuf() + data + bytes(-len(data) % tarfile.BLOCKSIZE))
            size += len(parts[-1])
        # two empty blocks end an archive, which is filled up to whole records
        end = 2 * tarfile.BLOCKSIZE
        blob = gzip.compress(b"".join(parts) + bytes(end + -(size + end) % tarfile.RECORDSIZE))
        return pdf.iloc[:1].assign(blob=[blob], n=[len(pdf)])[["shard", "n", "blob"]]

    body = F.to_json(F.struct("tags", "cells"), {"ignoreNullFields": "false"}).alias("body")
    spread(records.select("shard", "position", "key", body), "shard").groupBy("shard").applyInPandas(pack, "shard long, n long, blob binary").write.mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Records (shard, position, key, tags, cells) of ``write_shards``' blobs, or of tar.gz files in a folder."""
    try:
        blobs = spark.read.parquet(path).select("shard", "blob")
    except Exception:
        blobs = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path).select(F.regexp_extract("path", r"(\d+)\.tar\.gz$", 1).cast("long").alias("shard"), F.col("content").alias("blob"))

    def unpack(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                rows = []
                with tarfile.open(fileobj=io.BytesIO(r.blob), mode="r:gz") as tar:
                    for k, member in enumerate(m for m in tar if m.isfile()):
                        rows.append((r.shard, k, member.name.rpartition(".")[0], tar.extractfile(member).read().decode()))
                yield pd.DataFrame(rows, columns=["shard", "position", "key", "body"])

    rows = blobs.mapInPandas(unpack, "shard long, position long, key string, body string")
    return rows.withColumn("r", F.from_json("body", RECORD)).select("shard", "position", "key", "r.tags", "r.cells")


def verified_shards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """``manifest`` (shard, n, ...) with n_read, the members that the shards at ``path`` hold; an error where they differ."""
    read = read_shards(spark, path).groupBy("shard").agg(F.count("*").alias("n_read"))
    both = manifest.join(read, "shard", "full_outer")
    wrong = F.concat(F.lit("shard "), F.col("shard"), F.lit(" holds "), F.coalesce("n_read", F.lit(0)), F.lit(" members, not "), F.coalesce("n", F.lit(0)))
    return both.withColumn("n_read", F.when(F.col("n").eqNullSafe(F.col("n_read")), F.col("n_read")).otherwise(F.raise_error(wrong).cast("long")))


def offsets(manifest: DataFrame) -> DataFrame:
    """shard, begin, end: record numbers of each shard, end exclusive; a row a shard, summed in one task."""
    upto = F.sum("n").over(Window.orderBy("shard"))
    return manifest.select("shard", (upto - F.col("n")).alias("begin"), upto.alias("end"))


def shard_pattern(split: str, n_shards: int) -> str | None:
    """File name pattern of a split's shards, none without shards."""
    return f"{split}/shard-{{000000..{n_shards - 1:06d}}}.tar.gz" if n_shards else None


def write_tables(folder: str, manifest: DataFrame, frequency: DataFrame) -> None:
    """offsets.json (record numbers where shards begin and the last ends) and char_frequencies.json (letters by script).

    ``frequency`` (tag, letter, n) holds a row a letter of an alphabet, ``manifest`` a row a shard.
    """
    ends = [r["end"] for r in offsets(manifest).orderBy("shard").toLocalIterator()]
    by_tag: dict[str, list] = {}
    for r in frequency.orderBy("tag", F.desc("n"), "letter").toLocalIterator():
        by_tag.setdefault(r["tag"], []).append([r["letter"], r["n"]])
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "offsets.json").write_text(json.dumps([0, *ends]), encoding="utf-8")
    (out / "char_frequencies.json").write_text(json.dumps(by_tag, ensure_ascii=False), encoding="utf-8")


def read_frequencies(folder: str) -> dict[str, list[tuple[str, int]]]:
    """Letters and counts by script as ``write_tables`` leaves them; an error without the file."""
    at = Path(folder) / "char_frequencies.json"
    if not at.is_file():
        raise FileNotFoundError(f"{at} is not there: build the shards first")
    return {t: [(c, n) for c, n in pairs] for t, pairs in json.loads(at.read_text(encoding="utf-8")).items()}


def first_records(records: DataFrame, n: int) -> DataFrame:
    """The first records of the first shard."""
    return records.join(records.agg(F.min("shard").alias("shard")), "shard").orderBy("position").limit(n)


def checked_records(records: DataFrame) -> DataFrame:
    """Records, with an error for lists of different length, none at all, or blank cells."""
    fine = (F.size("tags") == F.size("cells")) & (F.size("tags") > 0) & F.forall("cells", lambda c: strip(c) != "")
    return records.where(F.when(F.coalesce(fine, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("bad record "), F.col("key"))).cast("boolean")))
