"""Substring dedup: words that lie in a window of words that also starts earlier in the corpus.

1. Every window has an anchor, the least hash of its short word runs, so equal windows have equal anchors. Anchors are
   counted over the whole corpus; what repeats goes into a bit table whose size is bounded. It only spares work:
   windows whose anchor occurs once have no second occurrence.
2. The other windows of a batch of documents are a shard: an FM-index over them, through which the documents are
   streamed backwards, gives each window's matches of full length, and so its first occurrence in the shard. Later
   ones are settled there. A passage thus leaves a shard once, however many of its documents hold it.
3. The first occurrences are dealt out by anchor, and indexes of the same kind over them settle what remains.
4. The covered intervals go back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .fm_index import FMIndex
from .shared import table, text_key, written

WINDOW = 20
#: Words of a run that anchors are taken from.
RUN = 6
#: Windows of one indexed piece.
PIECE = 45
#: Text of a shard, in bytes, and words of a shard of first occurrences.
SHARD_BYTES = 4 << 20
SHARD_WORDS = 200_000
#: Bits for each repeated anchor in the table, and the table's most bits (as a power of two).
BITS_EACH = 32
MOST_BITS = 28
_NO_ID = (1 << 63) - 1


def anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window its first word, the place of its anchor (the leftmost of equals) and the anchor."""
    run = min(RUN, window)
    g = tk.windows(h, run)
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    place = np.arange(len(g), dtype=np.uint64)
    bits = np.uint64(max(1, int(len(g)).bit_length()))
    low = (g >> bits << bits) | place
    span, have = window - run + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(n)
    end = np.repeat(first[1:], np.diff(first))[:n]
    start = start[start + window <= end]
    at = at[start]
    return start, at, g[at]


def anchor_counts(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for batch in tk.slices(whole):
                w = tk.words(batch.column("text"))
                _, at, key = anchors(tk.hashes(w), w.first, window)
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                key, n = np.unique(key[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def repeated_bits(counts: DataFrame) -> tuple[np.ndarray, int]:
    """Bit table of the anchors that occur more than once, by their leading bits, and how many bits lead."""
    repeated = written(counts.where("n > 1").select("anchor"), "anchors")
    bits = min(MOST_BITS, max(10, (repeated.count() * BITS_EACH).bit_length()))
    place = F.shiftrightunsigned("anchor", 64 - bits)
    word = repeated.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {64 - bits}) & 63 as int))")).alias("bits"))
    rows = word.toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out, bits


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one after another."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _runs(position: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings (places in the arrays) and sizes of runs of consecutive positions with equal others."""
    if not len(position):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(position), bool)
    new[1:] = np.diff(position) != 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(position)))


def first_occurrence(h: np.ndarray, start: np.ndarray, rank: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window (ascending first words) the least rank of the equal windows, and the place of one that has it.

    ``rank`` orders the windows; those of rows that repeat have equal ranks.
    """
    begin, size = _runs(start)
    pieces = -(-size // PIECE)
    offset = _ranges(np.zeros(len(size), np.int64), pieces) * PIECE
    piece_begin = np.repeat(begin, pieces) + offset  # place in start
    piece_size = np.minimum(np.repeat(size, pieces) - offset, PIECE)
    words = _ranges(start[piece_begin], piece_size + window - 1)
    _, code = np.unique(h[words], return_inverse=True)
    n = len(piece_begin)
    width = piece_size + window  # with the piece's own end symbol
    text_begin = np.cumsum(width) - width
    symbols = np.zeros(int(width.sum()), np.int64)
    symbols[text_begin + width - 1] = np.arange(n)
    inner = np.ones(len(symbols), bool)
    inner[text_begin + width - 1] = False
    symbols[inner] = code + n
    index = FMIndex(symbols, n + int(code.max()) + 1, window)
    _, block = index.matches(symbols, text_begin, text_begin + width - 1)
    place = _ranges(text_begin, piece_size)  # of each window, in their order
    ranks = np.full(len(symbols), np.iinfo(np.int64).max)
    ranks[place] = rank
    least = np.minimum.reduceat(ranks[index.places], index.block_begin)
    owner = np.zeros(len(least), np.int64)
    block = block[place]
    lead = np.flatnonzero(rank == least[block])[::-1]
    owner[block[lead]] = lead
    return least[block], owner[block]


_SCHEMA = "doc long, key long, start long, n long, anchor long, text string"


def _batch(doc, key, start, n, anchor=None, text=None) -> pa.RecordBatch:
    size = len(start)
    anchor = pa.nulls(size, pa.int64()) if anchor is None else pa.array(anchor.view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(key), pa.array(start), pa.array(n), anchor, pa.nulls(size, pa.string()) if text is None else text],
        names=["doc", "key", "start", "n", "anchor", "text"],
    )


def _order(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Dense ranks by document and start; equal pairs are equal."""
    order = np.lexsort((start, doc))
    new = np.concatenate([[0], np.cumsum((np.diff(doc[order]) != 0) | (np.diff(start[order]) != 0))])
    rank = np.empty(len(doc), np.int64)
    rank[order] = new
    return rank


def settle_shards(docs: DataFrame, bits: np.ndarray, lead: int, window: int) -> DataFrame:
    """Of each shard the windows that repeat in it (runs, without anchor) and the first occurrences (with text)."""
    handle = docs.sparkSession.sparkContext.broadcast(bits)
    shift = np.uint64(64 - lead)

    def shard(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bits = handle.value
        w = tk.words(batch.column("text"))
        h = tk.hashes(w)
        start, at, key = anchors(h, w.first, window)
        place = key >> shift
        some = np.flatnonzero((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
        if not len(some):
            return
        start, at, key = start[some], at[some], key[some]
        row = np.searchsorted(w.first, start, "right") - 1
        doc, own = batch.column("doc").to_numpy()[row], batch.column("key").to_numpy()[row]
        inner = start - w.first[row]
        rank = _order(doc, inner)
        least, owner = first_occurrence(h, start, rank, window)
        gone = np.flatnonzero(least < rank)
        begin, size = _runs(start[gone])
        if len(begin):
            k = gone[begin]
            yield _batch(doc[k], own[k], inner[k], size)
        stay = np.flatnonzero((least == rank) & (owner == np.arange(len(rank))))
        begin, size = _runs(start[stay], at[stay])
        k = stay[begin]
        a, b = w.start[start[k]], w.end[start[k] + size + window - 2]
        data = w.data[_ranges(a, b - a)]
        offsets = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32)
        text = pa.StringArray.from_buffers(len(k), pa.py_buffer(offsets), pa.py_buffer(data))
        yield _batch(doc[k], own[k], inner[k], size, key[k], text)

    def run(batches):
        for whole in batches:
            for batch in tk.slices(whole, most=SHARD_BYTES):
                yield from shard(batch)

    return docs.mapInArrow(run, _SCHEMA)


def settle_firsts(firsts: DataFrame, window: int) -> DataFrame:
    """Runs of windows among the shards' first occurrences that are not the corpus's first."""

    def settle(doc, key, start, text: pa.Array) -> Iterator[pa.RecordBatch]:
        w = tk.words(text)
        h = tk.hashes(w)
        at = np.arange(len(h))
        row = w.row()
        fits = at + window <= w.first[1:][row]
        at, row = at[fits], row[fits]
        if not len(at):
            return
        inner = start[row] + at - w.first[:-1][row]
        rank = _order(doc[row], inner)
        least, _ = first_occurrence(h, at, rank, window)
        gone = np.flatnonzero(least < rank)
        begin, size = _runs(at[gone])
        if len(begin):
            k = gone[begin]
            yield _batch(doc[row[k]], key[row[k]], inner[k], size)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.column("n").to_numpy().sum() + (window - 1) * b.num_rows for b in held) < SHARD_WORDS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            anchor = rows.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                yield from parts(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield from parts(pa.Table.from_batches(held))

    def parts(rows: pa.Table):
        rows = rows.combine_chunks()
        text = pa.concat_arrays(rows.column("text").chunks) if rows.num_rows else pa.array([], pa.string())
        yield from settle(rows.column("doc").to_numpy(), rows.column("key").to_numpy(), rows.column("start").to_numpy(), text)

    return firsts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _SCHEMA)


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Columns doc, key, start, n: runs of n windows from word ``start`` on that also start earlier."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), text_key().alias("key"), "text").where("text is not null")
    bits, lead = repeated_bits(anchor_counts(rows, window))
    settled = written(settle_shards(rows, bits, lead, window), "substring-shards")
    later = settle_firsts(settled.where("anchor is not null"), window)
    return settled.where("anchor is null").unionByName(later).select("doc", "key", "start", "n")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, kept (its words joined by a space), n_words, n_removed, spans of each row of ``docs``.

    Words are runs of anything but ASCII white space, unchanged. A word goes if a window of ``window`` words that
    covers it has an equal window that starts earlier: in a smaller doc_id, or before it in the same document. Null
    text has no words. Null doc_ids come last. Rows that repeat as a whole (doc_id and text) start together, so neither
    removes the other; other columns are left out. ``spans`` are the word ranges removed, [start, end).
    """
    gone = covered(docs, window).groupBy("doc", "key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), text_key().alias("key"))
    both = rows.join(gone, ["doc", "key"], "left").select("doc_id", "text", F.col("runs.start").alias("start"), F.col("runs.n").alias("n"))

    def run(batches):
        for whole in batches:
            for batch in tk.slices(whole):
                w = tk.words(batch.column("text"))
                starts, sizes = batch.column("start"), batch.column("n")
                row = np.repeat(np.arange(batch.num_rows), starts.value_lengths().fill_null(0).to_numpy())
                mark = np.zeros(len(w.start) + 1, np.int64)
                begin = w.first[row] + starts.flatten().to_numpy()
                np.add.at(mark, begin, 1)
                np.subtract.at(mark, begin + sizes.flatten().to_numpy() + window - 1, 1)
                gone = np.cumsum(mark[:-1]) > 0
                text, a, b = w.spaced()
                keep = np.repeat(~gone, b - a + 1)
                left = np.frombuffer(text, np.uint8)[keep]
                size = np.add.reduceat(np.append((b - a + 1) * ~gone, 0), w.first[:-1]) * (w.count > 0) if len(w.count) else np.zeros(0, np.int64)
                ends = np.cumsum(size)
                kept = [left[e - s : e - (s > 0)].tobytes().decode("utf-8", "replace") for s, e in zip(size, ends, strict=True)]
                spans = [_spans(gone[x:y]) for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
                n_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(w.count, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(spans, kind)],
                    names=["doc_id", "kept", "n_words", "n_removed", "spans"],
                )

    return both.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept string, n_words long, n_removed long, spans array<struct<start:long,end:long>>")


def _spans(gone: np.ndarray) -> list[dict]:
    if not gone.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, i, hash(array_to_string(w[i : i + 19], ' ')) AS a, md5(array_to_string(w[i : i + 19], ' ')) AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT r, i FROM (SELECT r, i, rank() OVER (PARTITION BY a, s ORDER BY doc_id, i) AS nth FROM p) WHERE nth > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS j FROM later),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
