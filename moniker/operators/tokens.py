"""Byte-level BPE: chunks, training, encoding, decoding, checks."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCRIPTS
from ..sources.lines import spread

#: Bytes of a block of a checksum: what a task holds of them at once is a batch of blocks.
BLOCK = 1 << 13
SPECIALS = ("[pad]", "[unk]", "[bos]", "[eos]", "[mask]", *(f"[{t}]" for t in SCRIPTS))
CHUNK = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """A printable character for every byte: its own if it has one, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        out.setdefault(b, chr(256 + b - sum(1 for x in own if x < b)))
    return out


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


class Vocabulary:
    """Pieces with ids and merges in order."""

    def __init__(self, merges: list[tuple[str, str]], specials: tuple[str, ...] = SPECIALS):
        self.specials, self.merges = specials, merges
        letters = byte_letters()
        self.letter, self.byte = letters, {c: b for b, c in letters.items()}
        pieces = [*specials, *(letters[b] for b in sorted(letters, key=lambda b: letters[b])), *(a + b for a, b in merges)]
        self.ids = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
        self.pieces = list(self.ids)
        self.rank = {pair: k for k, pair in enumerate(merges)}

    def encode_chunk(self, chunk: str) -> list[int]:
        """Merges by rank, the leftmost of equals first, until none applies."""
        parts = [self.letter[b] for b in chunk.encode()]
        while len(parts) > 1:
            best = min((self.rank.get(pair, len(self.rank)), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == len(self.rank):
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] for p in parts]

    def decode(self, ids: list[int], skip_specials: bool = True) -> str:
        out = bytearray()
        for i in ids:
            piece = self.pieces[i]
            if piece in self.specials:
                out += b"" if skip_specials else piece.encode()
            else:
                out += bytes(self.byte[c] for c in piece)
        return out.decode("utf-8", "replace")

    def id_of(self, piece: str) -> int:
        return self.ids.get(piece, self.ids["[unk]"])


def train(texts: DataFrame, column: str, size: int, specials: tuple[str, ...] = SPECIALS) -> Vocabulary:
    """Merges of the most frequent pair, over and over, until the vocabulary has ``size`` pieces.

    Chunks are counted once in the cluster; what goes round in the driver is the table of distinct chunks, whose
    pairs are kept up to date by the chunks that each merge touches. Ties go to the smaller pair.
    """
    counted = texts.select(F.explode(chunks(F.col(column))).alias("chunk")).groupBy("chunk").count()
    letters = byte_letters()
    words = [([letters[b] for b in r["chunk"].encode()], r["count"]) for r in counted.orderBy("chunk").toLocalIterator()]
    pairs: dict[tuple[str, str], int] = {}
    where: dict[tuple[str, str], set[int]] = {}

    heap: list[tuple[int, tuple[str, str]]] = []

    def add(k: int, sign: int) -> None:
        parts, n = words[k]
        for pair in zip(parts, parts[1:], strict=False):
            pairs[pair] = pairs.get(pair, 0) + sign * n
            touched.add(pair)
            if sign > 0:
                where.setdefault(pair, set()).add(k)

    def settle() -> None:
        """Counts that changed go on the heap; older entries of the pair no longer agree and are skipped."""
        for pair in touched:
            if pairs.get(pair, 0) > 0:
                heapq.heappush(heap, (-pairs[pair], pair))
        touched.clear()

    touched: set[tuple[str, str]] = set()
    for k in range(len(words)):
        add(k, 1)
    settle()
    merges: list[tuple[str, str]] = []
    while len(specials) + 256 + len(merges) < size and heap:
        n, best = heapq.heappop(heap)
        if pairs.get(best) != -n:
            continue
        merges.append(best)
        for k in where.pop(best):
            add(k, -1)
            parts, n = words[k]
            merged, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == best:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            words[k] = (merged, n)
            add(k, 1)
        pairs.pop(best, None)
        settle()
    return Vocabulary(merges, specials)


def encoded(texts: DataFrame, key: str, column: str, vocabulary: Vocabulary) -> DataFrame:
    """Columns key, ids. Each distinct text is encoded once, each of its chunks once in a batch, and joined back; none: no ids."""
    handle = texts.sparkSession.sparkContext.broadcast(vocabulary)
    distinct = spread(texts.select(F.col(column).alias("__text")).where("__text is not null").distinct()).select("__text", chunks(F.col("__text")).alias("__chunks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[str, list[int]] = {}
            ids = []
            for of in pdf["__chunks"]:
                for c in of:
                    if c not in known:
                        known[c] = handle.value.encode_chunk(c)
                ids.append([i for c in of for i in known[c]])
            yield pd.DataFrame({"__text": pdf["__text"], "ids": ids})

    known = distinct.mapInPandas(run, "__text string, ids array<int>")
    none = F.array().cast("array<int>")
    return texts.select(key, F.col(column).alias("__text")).join(known, "__text", "left").select(key, F.coalesce("ids", none).alias("ids"))


def decoded(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    handle = rows.sparkSession.sparkContext.broadcast(vocabulary)
    return rows.withColumn("decoded", F.pandas_udf(lambda s: s.map(lambda x: handle.value.decode(list(x))), "string")(ids))


def padded(ids: Column, length: int, pad: int) -> Column:
    """Cut or filled to ``length``."""
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def verified(rows: DataFrame) -> DataFrame:
    """By tag of ``rows`` (tag, value, ids, decoded, unk): cells, tokens, longest, round-trip failures."""
    return rows.groupBy("tag").agg(
        F.count("*").alias("cells"), F.sum(F.size("ids")).alias("tokens"), F.max(F.size("ids")).alias("longest"), F.count_if(~F.col("value").eqNullSafe(F.col("decoded"))).alias("failures")
    )


def vocabulary_checksum(rows: DataFrame) -> DataFrame:
    """md5 over piece and id of all rows (piece, id), in order of the pieces.

    The rows are ordered in ranges and put together to blocks in the tasks of these. The digest goes from one byte to the
    next, so one task takes the blocks in, sorted outside of memory where they are many; no row goes to the driver.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            text = "".join(batch.column(0).drop_null().to_pylist()).encode()
            cut = [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(cut), pa.int64()), pa.array(range(at, at + len(cut)), pa.int64()), pa.array(cut, pa.binary())], ["part", "at", "block"])
            at += len(cut)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = hashlib.md5()
        for batch in batches:
            for block in batch.column(0):
                out.update(block.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([out.hexdigest()])], ["checksum"])

    ordered = rows.orderBy("piece", "id").select(F.concat("piece", F.col("id").cast("string")).alias("text"))
    cut = ordered.mapInArrow(blocks, "part long, at long, block binary").repartition(1).sortWithinPartitions("part", "at")
    told = cut.select("block").mapInArrow(digest, "checksum string")
    return told.agg(F.coalesce(F.max("checksum"), F.lit(hashlib.md5().hexdigest())).alias("checksum"))


def vocabulary_rows(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    return spark.createDataFrame(list(enumerate(vocabulary.pieces)), "id int, piece string").select("piece", "id")


def vocabulary_report(rows: DataFrame, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """One row of ``rows`` (piece, id): number of pieces, specials that are not there, longer pieces with a brace in them.

    Such pieces tell that the vocabulary was trained on whole lines instead of their values.
    """
    braced = F.when(F.col("piece").rlike("[{}]") & (F.length("piece") > 1), F.col("piece"))
    special = F.when(F.col("piece").isin(*specials), F.col("piece"))
    return rows.agg(
        F.count("*").alias("vocab_size"),
        F.array_except(F.array(*map(F.lit, specials)), F.collect_set(special)).alias("missing_specials"),
        F.array_sort(F.collect_list(braced)).alias("pieces_with_braces"),
    )


def usable_vocabulary(rows: DataFrame) -> DataFrame:
    """``rows`` (piece, id) if they hold the pad, begin and end tokens and one for each script, else an error naming the rest."""
    needed = ("[pad]", "[bos]", "[eos]", *(f"[{t}]" for t in SCRIPTS))
    missing = vocabulary_report(rows, needed).first()["missing_specials"]
    if missing:
        raise ValueError("the vocabulary lacks " + ", ".join(missing))
    return rows


def save_vocabulary(vocabulary: Vocabulary, folder: str) -> None:
    """vocab.json (piece to id), merges.txt (a pair a line, in order) and special_tokens.json."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "vocab.json").write_text(json.dumps(vocabulary.ids, ensure_ascii=False), encoding="utf-8")
    (out / "merges.txt").write_text("".join(f"{a} {b}\n" for a, b in vocabulary.merges), encoding="utf-8")
    (out / "special_tokens.json").write_text(json.dumps(list(vocabulary.specials)), encoding="utf-8")


def load_vocabulary(folder: str) -> Vocabulary:
    """What ``save_vocabulary`` wrote; an error if the pieces' ids differ from those the merges give."""
    at = Path(folder)
    merges = [tuple(x.split(" ")) for x in (at / "merges.txt").read_text(encoding="utf-8").split("\n") if x]
    out = Vocabulary(merges, tuple(json.loads((at / "special_tokens.json").read_text(encoding="utf-8"))))
    if out.ids != json.loads((at / "vocab.json").read_text(encoding="utf-8")):
        raise ValueError(f"pieces and merges in {folder} don't agree")
    return out


def prompt_fits(n_ids: Column, new: Column | int, most: int = 4096) -> Column:
    """Whether a prompt and the tokens asked for fit the model's window."""
    return n_ids + new <= most


def input_tokens(prefix: Column, ids: Column, most: int, end: int | None = None) -> Column:
    """Tag and tokens cut to ``most``; an end token comes after the cut."""
    cut = F.slice(F.concat(F.array(prefix), ids), 1, most)
    return cut if end is None else F.concat(cut, F.array(F.lit(end)))
