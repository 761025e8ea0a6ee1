"""Benchmark decontamination with suffix arrays over the training text.

Every batch of documents is a shard. The shard's words become ids of the benchmark's vocabulary. Of the runs of benchmark words in
which leading words of a window occur a whole suffix array is built, by doubling. Every benchmark suffix is looked up in it by binary
search: the range that its first window has holds all verbatim occurrences. An occurrence that no earlier word continues is followed to
its end, which gives the longest verbatim matches and their places. Documents are then marked or removed.

Nothing is shuffled: documents stay where they are read, the benchmark goes to them. It is the stated
query set: its blocks of at most ``BLOCK_BYTES`` are broadcast, and a shard is searched block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .fm_index import suffix_array
from .shared import table

WINDOW = 13
#: Bytes of benchmark text in one broadcast.
BLOCK_BYTES = 16 << 20
#: Words that a position must share with the benchmark before it enters the suffix array.
LEAD = 4


class Suffixes:
    """The benchmark side: vocabulary, word ids, where windows begin, hashes of their leading words."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW):
        w = tk.words(pa.array(texts, pa.string()), tk.ALNUM, lower=True)
        h = tk.hashes(w)
        self.items, self.window = [str(x) for x in ids], window
        self.vocabulary, code = np.unique(h, return_inverse=True)
        self.code = code.astype(np.uint32) + 1  # 0: not in the benchmark
        row = w.row()
        self.first, self.last = w.first[:-1][row], w.first[1:][row]  # of the item that a word is in
        size = np.minimum(window, w.count)[row]
        at = np.flatnonzero(np.arange(len(row)) + size <= self.last)
        self.item = row
        #: by window length: where the windows begin
        self.groups = {int(n): at[size[at] == n] for n in np.unique(size[at])}
        self.lead = {n: np.unique(_fold(self.code[g[:, None] + np.arange(min(n, LEAD))])) for n, g in self.groups.items()}


def _fold(codes: np.ndarray) -> np.ndarray:
    out = codes[:, 0].astype(np.uint64)
    for k in range(1, codes.shape[1]):
        out = tk.join_hash(out, codes[:, k].astype(np.uint64))
    return out


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


class Shard:
    """Suffix array over a batch of documents, searched with benchmark suffixes."""

    def __init__(self, w: tk.Words, suffixes: Suffixes, hashed: np.ndarray):
        self.w, self.suffixes = w, suffixes
        vocabulary = suffixes.vocabulary
        self.code = np.zeros(len(hashed) + 1, np.uint32)
        if len(vocabulary):
            # most words are no benchmark words: a small table of hash bits sorts them out first
            sieve = np.zeros(1 << 20, bool)
            sieve[vocabulary >> np.uint64(44)] = True
            maybe = np.flatnonzero(sieve[hashed >> np.uint64(44)])
            at = np.minimum(np.searchsorted(vocabulary, hashed[maybe]), len(vocabulary) - 1)
            hit = vocabulary[at] == hashed[maybe]
            self.code[maybe[hit]] = at[hit] + 1
        row = w.row()
        self.first, self.last = w.first[:-1][row], w.first[1:][row]  # of the row that a word is in

    def positions(self, n: int) -> np.ndarray:
        """Suffixes of n words or more whose leading words begin a benchmark window."""
        q = min(n, LEAD)
        p = np.flatnonzero(self.code[:-1])
        p = p[p + n <= self.last[p]]
        for k in range(1, n):  # every one of the n words must be a benchmark word
            p = p[self.code[p + k] > 0]
        if not len(p):
            return p
        return p[_member(self.suffixes.lead[n], _fold(self.code[p[:, None] + np.arange(q)]))]

    def places(self, candidates: np.ndarray) -> np.ndarray:
        """For each word its place in the order of all suffixes of the runs of benchmark words that hold a candidate.

        A suffix ends with its run; of equal ones the earlier is the lesser.
        """
        known = self.code[:-1] > 0
        new = known.copy()
        new[1:] &= ~known[:-1] | (self.first[1:] != self.first[:-1])
        run = np.cumsum(new) - 1
        wanted = np.zeros(len(known), bool)
        wanted[run[candidates]] = True  # by run
        at = np.flatnonzero(known & wanted[np.maximum(run, 0)])
        run = np.unique(run[at], return_inverse=True)[1]
        n = int(run[-1]) + 1
        symbols = np.empty(len(at) + n, np.int64)
        own = np.arange(len(at)) + run  # an end symbol of its own after each run
        symbols[own] = np.unique(self.code[at], return_inverse=True)[1] + n
        symbols[np.append(np.flatnonzero(np.diff(run)), len(at) - 1) + np.arange(n) + 1] = np.arange(n)
        order = np.empty(len(symbols), np.int64)
        order[suffix_array(symbols)] = np.arange(len(symbols))
        out = np.full(len(known), -1, np.int64)
        out[at] = order[own]
        return out

    def matches(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(document position, benchmark position, words) of every occurrence of a window."""
        begin = {n: self.positions(n) for n in self.suffixes.groups}
        every = np.concatenate([np.zeros(0, np.int64), *begin.values()])
        if not len(every):
            return
        places = self.places(every)
        for n, query in self.suffixes.groups.items():
            array = begin[n][np.argsort(places[begin[n]])]  # the suffix array's entries of n words or more
            key = _packed(self.code[array[:, None] + np.arange(n)])
            wanted = _packed(self.suffixes.code[query[:, None] + np.arange(n)])
            low, high = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
            for many in _chunks(high - low):
                size = high[many] - low[many]
                row = np.repeat(many, size)
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[many], size)
                yield array[at], query[row], n

    def longest(self, p: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The occurrences that no equal word precedes, and how many words they are equal for: ``n`` or more."""
        s = self.suffixes
        inner = (p > self.first[p]) & (q > s.first[q]) & (self.code[p - 1] == s.code[q - 1])
        p, q = p[~inner], q[~inner]
        size, live = np.full(len(p), n, np.int64), np.arange(len(p))
        while len(live):
            live = live[(p[live] + size[live] < self.last[p[live]]) & (q[live] + size[live] < s.last[q[live]])]
            live = live[self.code[p[live] + size[live]] == s.code[q[live] + size[live]]]
            size[live] += 1
        return p, q, size


def _chunks(size: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Queries with results, so many at a time that their results fit in memory."""
    some = np.flatnonzero(size > 0)
    while len(some):
        n = max(1, int(np.searchsorted(np.cumsum(size[some]), most, "right")))
        yield some[:n]
        some = some[n:]


def _packed(codes: np.ndarray) -> np.ndarray:
    """Rows of ids as fixed-length byte strings that sort as the rows do."""
    return np.ascontiguousarray(codes.astype(">u4")).view(f"S{4 * codes.shape[1]}").ravel()


def blocks(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast handles of the benchmark's blocks, none of which holds more text than asked for (or one item)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    out = []
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        out.append(spark.sparkContext.broadcast(Suffixes([r[0] for r in rows], [r[1] for r in rows], window)))
    return out


def _search(batch_text: pa.Array, handles: list, spans: bool) -> tuple[tk.Words, np.ndarray, list[set], list[list], np.ndarray]:
    w = tk.words(batch_text, tk.ALNUM, lower=True)
    hashed, row = tk.hashes(w), w.row()
    cover = np.zeros(len(hashed) + 1, np.int64)
    items: list[set] = [set() for _ in range(len(w.first) - 1)]
    found: list[list] = [[] for _ in items]
    most = np.zeros(len(items), np.int64)
    for handle in handles:
        s = handle.value
        shard = Shard(w, s, hashed)
        for position, query, n in shard.matches():
            np.add.at(cover, position, 1)
            np.subtract.at(cover, position + n, 1)
            for r, k in np.unique(np.stack([row[position], s.item[query]]), axis=1).T:
                items[r].add(s.items[k])
            p, q, size = shard.longest(position, query, n)
            np.maximum.at(most, row[p], size)
            if spans:
                for p, q, m in zip(p, q, size, strict=True):
                    r = row[p]
                    found[r].append({"start": int(p - w.first[r]), "n_words": int(m), "item_id": s.items[s.item[q]], "item_start": int(q - s.first[q])})
        if len(handles) > 1:
            handle.__dict__.pop("_value", None)  # one block in memory at a time
    return w, np.cumsum(cover[:-1]) > 0, items, found, most


SPANS = "array<struct<start:long,n_words:long,item_id:string,item_start:long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, spans: bool = True) -> DataFrame:
    """``docs`` with what each document shares with the benchmark.

    Adds ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``item_ids`` (sorted as strings), ``longest`` (words of the longest match; 0 without) and
    ``spans``: the longest verbatim matches by place (word offsets in document and item). A window is ``window``
    consecutive words of an item; a shorter item is one window, an item without words none.

    Null or empty text has no words; null item ids or texts are left out of the benchmark; repeated rows get equal
    results; rows with a null doc_id are searched as any other. Columns of the same names in ``docs`` are replaced.
    """
    handles = blocks(docs.sparkSession, benchmark, window, block_bytes)
    added = {"n_words": "long", "n_hit": "long", "item_ids": "array<string>", "longest": "long", "spans": SPANS}
    if not spans:
        del added["spans"]
    docs = docs.drop(*added)
    kept = [f.name for f in docs.schema.fields]
    schema = docs.select("*", *(F.lit(None).cast(t).alias(c) for c, t in added.items())).schema

    def run(batches):
        for whole in batches:
            for batch in tk.slices(whole):
                w, hit, items, found, most = _search(batch.column("text"), handles, spans)
                n_hit = np.diff(np.append(0, np.cumsum(hit))[w.first])
                columns = [batch.column(c) for c in kept]
                columns += [pa.array(w.count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(most)]
                if spans:
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())]))
                    columns.append(pa.array([sorted(x, key=lambda y: (y["start"], y["item_id"], y["item_start"])) for x in found], kind))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])

    return docs.mapInArrow(run, schema)


def is_contaminated(share: int = 20):
    """At least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int | None = None) -> DataFrame:
    """Drop the documents in which a window of the benchmark occurs; with ``share`` only those where at least one word in
    so many is hit. Columns as in ``docs``.

    Null and empty texts stay, so does everything if the benchmark has no words; null ids don't matter, repeated rows go
    or stay together, clashing column names are kept apart.
    """
    named = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c.lower() in ("n_words", "n_hit", "item_ids", "longest")}
    marked = contamination(docs.withColumnsRenamed(named), benchmark, window, spans=False)
    affected = F.col("n_hit") > 0 if share is None else is_contaminated(share)
    return marked.where(~affected).drop("n_words", "n_hit", "item_ids", "longest").withColumnsRenamed({v: k for k, v in named.items()}).select(*docs.columns)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = contamination(docs, table(spark, sf_dir, "benchmark"), spans=False)
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
        "longest",
    )


#: Windows are compared as word strings; a document word is hit if a window that covers it occurs.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS b, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT b, i AS j, item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT b, item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT pos.r, pos.i, pos.n, win.item_id, win.b, win.j FROM pos JOIN win USING (n, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
isl AS (SELECT r, b, j - i AS d, n, i - row_number() OVER (PARTITION BY r, b, j - i ORDER BY i) AS g FROM occ),
lon AS (SELECT r, max(c) AS longest FROM (SELECT r, count(*) + min(n) - 1 AS c FROM isl GROUP BY r, b, d, g) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r) LEFT JOIN lon USING (r)
"""
