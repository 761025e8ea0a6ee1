"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. For radius r every bit position gets a vector of r + 1 bits, and each of the
2^(r+1) - 1 non-zero vectors v makes a mask of the positions whose vector has odd overlap with v. Any r differing
positions leave some v that is orthogonal to all of theirs, and under its mask the two fingerprints are equal: every pair
within the radius meets in some table, none is left to chance.

Work goes by distinct fingerprints, so copies cost one row however many there are. A bucket is searched for its
connected groups and gives one link a member, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import components
from .shared import table, written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: A bucket with more fingerprints is dealt out anew by another family of masks.
BUCKET = 8192
#: Fingerprints that more than one in so many documents have are joined by broadcast: at most this many.
HOT = 200


def masks(radius: int, family: int = 0) -> np.ndarray:
    """The tables' masks; families differ in how positions get their vectors."""
    size = (1 << (radius + 1)) - 1
    deal = np.random.default_rng(1000 + family).permutation(max(64, size))
    vector = deal[:64] % size + 1
    out = [sum(1 << i for i in range(64) if int(vector[i] & v).bit_count() & 1) for v in range(1, size + 1)]
    return np.array(out, np.uint64)


def shingle_hashes(w: tk.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every row's shingles, repeats included, and the row offsets into them."""
    text, start, end = w.spaced()
    count = w.count
    n = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], n)
    last = np.minimum(at + size, np.repeat(w.first[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(start[at].tolist(), end[last].tolist(), strict=True)
    return np.fromiter((digest(text[a:b], SEED) for a, b in pairs), np.uint64, len(at)), first


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the bits that over half of its hashes have; zero without hashes."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, first[:-1][some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * sums > n[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by its fingerprint ``fp`` (64 bits as a long; null and wordless texts: 0)."""
    rest = [c for c in docs.columns if c not in (text, "fp")]
    rows = docs.select(*rest, F.col(text).alias("__text"))
    schema = rows.select(*rest, F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for whole in batches:
            for batch in tk.slices(whole, "__text", 1 << 20):
                w = tk.words(batch.column("__text"), lower=True)
                fp = majority(*shingle_hashes(w, size))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fp.view(np.int64))], names=[*rest, "fp"])

    return rows.mapInArrow(run, schema)


def groups(fp: np.ndarray, radius: int, level: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (member, one of its group) that connect all of ``fp`` (distinct) that are within ``radius`` of each other."""
    if len(fp) > BUCKET and level <= 4:
        for mask in masks(radius, level):
            key = fp & mask
            order = np.argsort(key, kind="stable")
            edge = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(order, edge):
                if len(part) > 1:
                    yield from groups(fp[part], radius, level + 1) if len(part) < len(fp) else _search(fp[part], radius)
        return
    yield from _search(fp, radius)


def _search(fp: np.ndarray, radius: int, places: bool = False, also=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of each member to one that it is near to, as values or places; what a group has found leaves the rest.

    ``also`` says of pairs of places within the radius which are near indeed.
    """
    rest = np.arange(len(fp))
    while len(rest) > 1:
        rest, queue = rest[1:], [rest[:1]]
        while queue and len(rest):
            step = max(1, (1 << 20) // len(rest))
            front = queue.pop()
            if len(front) > step:
                queue.append(front[step:])
                front = front[:step]
            near = np.bitwise_count(fp[rest, None] ^ fp[None, front]) <= radius
            if also is not None:
                i, j = np.nonzero(near)
                near[i, j] = also(rest[i], front[j])
            hit = near.any(1)
            if hit.any():
                found, by = rest[hit], front[near[hit].argmax(1)]
                rest = rest[~hit]
                queue.append(found)
                yield (found, by) if places else (fp[found], fp[by])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect the fingerprints of column ``fp`` within ``radius`` bits of each other."""
    tables = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(int(m.astype(np.int64)))).alias("bits")) for k, m in enumerate(masks(radius))))
    rows = distinct.select("fp", F.explode(tables).alias("t")).select("t.k", "t.bits", "fp")

    def run(batches):
        for _, rows in _buckets(batches, ("k", "bits", "fp"), 2):
            for a, b in groups(np.ascontiguousarray(rows[:, 2]).view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    dealt = rows.repartition("k", "bits").sortWithinPartitions("k", "bits", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def classes(fps: DataFrame, radius: int = RADIUS, order: Column | None = None) -> DataFrame:
    """Columns fp, n (rows), root (a fingerprint that names the class), component_id: smallest doc_id reachable from it.

    ``fps`` has doc_id and fp. Null ids don't count; a group with no other has a null component_id.
    """
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "simhash-distinct")
    joined = components(links(distinct, radius))
    labelled = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "doc_id", "n", F.coalesce("root", "fp").alias("root"))
    linked = labelled.join(joined.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "root", "left").select("fp", "n", "root", F.coalesce("least", "doc_id").alias("component_id"))


def with_class(fps: DataFrame, of: DataFrame) -> DataFrame:
    """Join the classes back: the few fingerprints that very many rows have by broadcast, the others by shuffle."""
    total = fps.count()
    is_hot = F.col("n") * HOT > max(total, HOT * HOT)
    hot = F.broadcast(of.where(is_hot).drop("n"))
    return fps.join(hot, "fp").unionByName(fps.join(hot.select("fp"), "fp", "left_anti").join(of.where(~is_hot).drop("n"), "fp"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text).

    Texts without words, null or empty, have fingerprint zero and are linked like any other; short texts are one
    shingle. Repeated rows share their class; a null doc_id is kept but names no class. Other columns are left out.
    """
    fps = written(fingerprints(docs.select("doc_id", "text"), size), "simhash-fingerprints")
    of = written(classes(fps, radius), "simhash-classes")
    return with_class(fps, of.drop("root")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The stage compares shingles of five words: near-duplicates have this Jaccard similarity or more.
STAGE_SHINGLE = 5
SIMILARITY = 0.8
#: Classes of words that fingerprints are taken of, the coarse ones they add up to, and the words a class must have.
FINE, COARSE = 12, 3
CLASS_WORDS = 3
#: Bits in which class fingerprints may differ to meet, and those of the shingles to be compared: at a similarity of 0.8
#: two fingerprints of 64 bits differ in 9.7 on average, with a deviation of 2.9.
CLASS_RADIUS = 1
WHOLE_RADIUS = 20
#: Texts of so many words (or 3, 9, 27 ... times as many) have so many classes (times as many) more, in which fingerprints
#: must be equal to meet; those with a fifth less have them too, as near-duplicates may.
LONG, LONG_CLASSES, LEVELS = 600, 36, 10
#: 64-bit words of the parities that a node carries into its buckets, and into those of prefixes.
PARITY, WIDE_PARITY = 4, 16
#: Pairs with one partner in common that a task compares, and rows to drop whose ids are broadcast (8 bytes each) at most.
SPREAD = 1024
BROADCAST_NODES = 1 << 20


def _signs(h: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` groups (ascending in ``group``) how often each bit is set in its hashes, and their number."""
    sums, count = np.zeros((n, 64), np.int32), np.bincount(group, minlength=n)
    if len(h):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        sums[group[begin]] = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    return sums, count


def _classes(low: np.ndarray, row: np.ndarray, n: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by bit and words of each row's classes; distinct words (48 bits of hash) by row, ascending."""
    group = row * classes + ((low * np.uint64(classes)) >> np.uint64(48)).astype(np.int64)
    sums, count = _signs(tk.mix(low), group, n * classes)
    return sums.reshape(n, classes, 64), count.reshape(n, classes)


def _print(sums: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.packbits(2 * sums > count[..., None], axis=-1, bitorder="little").view("<u8")[..., 0]


def class_fingerprints(w: tk.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Fingerprints of each row's distinct words: FINE by class, COARSE by joined classes, one of all; their words; and the
    keys of the further classes of long texts.

    A few changed words leave most classes as they are, so near-duplicates meet in some of them.
    """
    n = len(w.first) - 1
    packed = np.unique((w.row().astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    low, row = packed & np.uint64((1 << 48) - 1), (packed >> np.uint64(48)).astype(np.int64)
    sums, count = _classes(low, row, n, FINE)
    joined = sums.reshape(n, COARSE, FINE // COARSE, 64).sum(2), count.reshape(n, COARSE, FINE // COARSE).sum(2)
    sums = np.concatenate([sums, joined[0], sums.sum(1, keepdims=True)], 1)
    count = np.concatenate([count, joined[1], count.sum(1, keepdims=True)], 1)
    more: list[list[np.ndarray]] = [[] for _ in range(n)]
    begin, size = np.searchsorted(row, np.arange(n)), np.bincount(row, minlength=n)
    for level in range(LEVELS):
        classes = LONG_CLASSES * 3**level
        for r in np.flatnonzero(w.count >= 0.8 * LONG * 3**level):
            own = low[begin[r] : begin[r] + size[r]]
            fp, held = _classes(own, np.zeros(len(own), np.int64), 1, classes)
            sure = np.flatnonzero(held[0] >= CLASS_WORDS)
            more[r].append(tk.join_hash(_print(fp, held)[0][sure], (sure + (level + 1) * (1 << 20)).astype(np.uint64)))
    return _print(sums, count), count, [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in more]


def shingle_sets(w: tk.Words, h: np.ndarray, size: int = STAGE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, ascending, 32 bits of hash each, and the row of each; a shorter text is one shingle."""
    count = w.count
    at = np.arange(max(0, len(h) - size + 1))
    inside = at + size <= np.repeat(w.first[1:], count)[: len(at)]
    value, row = [tk.windows(h, size)[inside]], [w.row()[: len(at)][inside]]
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        value.append(tk.windows(h, k)[w.first[:-1][short]])
        row.append(short)
    packed = np.unique((np.concatenate(row).astype(np.uint64) << np.uint64(32)) | (np.concatenate(value) >> np.uint64(32)))
    return packed & np.uint64(0xFFFFFFFF), (packed >> np.uint64(32)).astype(np.int64)


def parities(own: np.ndarray, row: np.ndarray, n: int, words: int) -> np.ndarray:
    """For each of ``n`` rows in ``words`` of 64 bits whether an odd number of its shingles has each place.

    Two rows differ in no more bits than they have shingles of their own, so this rules out pairs, and never a true one.
    """
    width = 64 * words
    place = row * width + (tk.mix(own + tk._K1) % np.uint64(width)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=n * width) & 1).astype(bool).reshape(n, width), axis=1, bitorder="little").view("<u8").reshape(n, words)


def _may(n: np.ndarray, parity: np.ndarray, least: float):
    """Whether pairs of rows, with ``n`` shingles and these parities, can have the similarity."""
    most = (1 - least) / (1 + least)

    def may(i, j):
        apart = most * (n[i] + n[j]) + 1e-9  # shingles that only one of them may have
        out = np.abs(n[i] - n[j]) <= apart
        some = np.flatnonzero(out)
        for at in range(0, len(some), 1 << 18):
            k = some[at : at + (1 << 18)]
            out[k] = np.bitwise_count(parity[i[k]] ^ parity[j[k]]).sum(1, dtype=np.int64) <= apart[k]
        return out

    return may


def sketched(docs: DataFrame, text: str, size: int = STAGE_SHINGLE) -> DataFrame:
    """``docs`` with a number for each row, ``classes`` (a fingerprint for each class, null for one with few words), ``more``
    (keys of a long text's further classes), ``whole`` (the fingerprint of the shingles), ``parity`` and ``shingles`` (their
    set, four bytes each, ascending). ``classes`` and ``whole`` are null without words."""
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    added = {"classes": "array<long>", "more": "array<long>", "whole": "long", "parity": "array<long>", "shingles": "binary"}
    schema = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in added.items())).schema

    def lists(parts: np.ndarray, size, **kwargs) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(parts.view(np.int64), mask=kwargs.get("inner")), mask=kwargs.get("mask"))

    def run(batches):
        for whole in batches:
            for batch in tk.slices(whole, text, 1 << 20):
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    m = part.num_rows
                    w = tk.words(part.column(text), lower=True)
                    h = tk.hashes(w)
                    fp, count, more = class_fingerprints(w, h)
                    sure = count >= CLASS_WORDS
                    sure[:, -1] = count[:, -1] > 0
                    own, row = shingle_sets(w, h, size)
                    sums, n = _signs(tk.mix(own), row, m)
                    none = pa.array(n == 0)
                    offsets = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
                    sets = pa.BinaryArray.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets), pa.py_buffer(own.astype("<u4").tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *part.columns,
                            lists(fp.ravel(), np.full(m, fp.shape[1]), inner=~sure.ravel(), mask=none),
                            lists(np.concatenate([np.zeros(0, np.uint64), *more]), [len(x) for x in more]),
                            pa.array(_print(sums, n).view(np.int64), mask=n == 0),
                            lists(parities(own, row, m, PARITY).ravel(), np.full(m, PARITY)),
                            sets,
                        ],
                        names=schema.names,
                    )

    return rows.mapInArrow(run, schema)


def candidates(sketches: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of nodes that meet in a class, have fingerprints of their shingles near each other, and parities that
    allow for the similarity; ``sketches`` (node, classes, more, whole, parity, n).

    Of each connected group in a bucket as many pairs come out as it has nodes, each pair near by itself.
    """
    own = masks(CLASS_RADIUS)
    keys = lambda fp, slot: [F.when(fp.isNotNull(), F.xxhash64(slot, F.lit(k), fp.bitwiseAND(F.lit(int(m.astype(np.int64)))))) for k, m in enumerate(own)]
    every = F.concat("more", F.flatten(F.transform("classes", lambda fp, slot: F.array(*keys(fp, slot)))))
    columns = ("whole", "node", "n", *(f"p{k}" for k in range(PARITY)))
    rows = sketches.select(F.explode(every).alias("key"), "whole", "node", "n", *(F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(PARITY))).where("key is not null")

    def meet(batches):
        for _, rows in _buckets(batches, ("key", *columns), 1):
            node, near = rows[:, 2], _may(rows[:, 3], rows[:, 4:].view(np.uint64), least)
            for a, b in _search(np.ascontiguousarray(rows[:, 1]).view(np.uint64), WHOLE_RADIUS, places=True, also=near):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b]))], names=["a", "b"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "whole", "node")
    return dealt.mapInArrow(meet, "a long, b long").where("a <> b").distinct()


def _buckets(batches, columns, by):
    """Runs of sorted rows with equal first ``by`` columns, of two rows or more, each as one array."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], 1)
        edge = np.flatnonzero((np.diff(rows[:, :by], axis=0) != 0).any(1)) + 1
        begin = np.concatenate([[0], edge])
        if held and len(rows) and (held[-1][-1, :by] != rows[0, :by]).any():
            if sum(map(len, held)) > 1:
                yield 0, np.concatenate(held)
            held = []
        if not len(edge):  # one bucket so far
            held += [rows] * bool(len(rows))
            continue
        first = np.concatenate([*held, rows[: edge[0]]])
        if len(first) > 1:
            yield 0, first
        end = np.append(edge, len(rows))
        for k in np.flatnonzero(end - begin > 1):
            if 0 < k < len(begin) - 1:
                yield begin[k], rows[begin[k] : end[k]]
        held = [rows[edge[-1] :]]
    if held and sum(map(len, held)) > 1:
        yield 0, np.concatenate(held)


def similar(shingles: DataFrame, pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets of word shingles (node, shingles) have a Jaccard similarity of ``least`` or more.

    A node that very many pairs have as ``b`` is dealt to several tasks, SPREAD pairs or so to each.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts"))
    left = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    left = left.join(shingles.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    right = parts.join(shingles.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    right = right.select("b", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def compare(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = []
            for k in range(batch.num_rows):
                p, q = (np.frombuffer(side[k].as_buffer(), "<u4") for side in (x, y))
                if min(len(p), len(q)) < least * max(len(p), len(q)) - 1e-9:
                    keep.append(False)
                    continue
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common >= least * (len(p) + len(q) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return left.join(right, ["b", "part"]).select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def prefixes(shingles: DataFrame, rest: DataFrame, least: float) -> DataFrame:
    """For each node of ``rest`` (node, cluster) its size, its prefix and its wide parity.

    Sets with a Jaccard similarity of ``least`` share one of the n - ceil(least n) + 1 shingles of each that are rarest in
    the cluster; of these the prefix holds those that another node of the cluster has as well.
    """

    def sets(batch):
        n = np.array([len(x.as_buffer()) // 4 for x in batch.column("shingles")], np.int64)
        return np.frombuffer(b"".join(x.as_buffer() for x in batch.column("shingles")), "<u4").astype(np.uint64), np.repeat(np.arange(len(n)), n), n

    def apart(batches):
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                own, row, n = sets(batch)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(row)) for c in ("cluster", "node")), pa.array(n[row]), pa.array(own.astype(np.int64))], names=["cluster", "node", "n", "s"]
                )

    def wide(batches):
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                own, row, n = sets(batch)
                out = parities(own, row, len(n), WIDE_PARITY).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(out), pa.list_(pa.int64()))], names=["node", "parity"])

    held = written(rest.join(shingles, "node").select("cluster", "node", "shingles"), "simhash-rest")
    each = held.mapInArrow(apart, "cluster long, node long, n long, s long")
    shared = each.groupBy("cluster", "s").agg(F.count("*").alias("c")).where("c > 1")
    of = each.join(shared, ["cluster", "s"]).groupBy("cluster", "node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("own"))
    room = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1 - (F.col("n") - F.size("own"))
    prefix = F.when(room > 0, F.slice("own", F.lit(1), F.greatest(room, F.lit(1)).cast("int"))["s"]).otherwise(F.array().cast("array<long>"))
    return of.select("cluster", "node", "n", prefix.alias("prefix")).join(held.mapInArrow(wide, "node long, parity array<long>"), "node")


def posted(rows: DataFrame, least: float, every: bool = False) -> DataFrame:
    """Pairs (a, b) of ``rows`` (cluster, node, root, n, prefix, parity) that share a prefix shingle, can be similar by size and
    parity, and are not linked yet (other roots): of each group that is so connected in a bucket one pair a node, or ``every`` one."""
    columns = ("cluster", "s", "node", "root", "n", *(f"p{k}" for k in range(WIDE_PARITY)))

    def pairs(batches):
        for _, rows in _buckets(batches, columns, 2):
            node, root, near = rows[:, 2], rows[:, 3], _may(rows[:, 4], rows[:, 5:].view(np.uint64), least)
            if every:
                step = max(1, (1 << 20) // len(rows))
                for at in range(0, len(rows), step):
                    a, b = np.nonzero((root[at : at + step, None] != root) & (node[at : at + step, None] > node))
                    fits = near(a + at, b)
                    yield pa.RecordBatch.from_arrays([pa.array(node[a[fits] + at]), pa.array(node[b[fits]])], names=["a", "b"])
            else:
                _, state = np.unique(root, return_inverse=True)
                for a, b in _search(np.zeros(len(rows), np.uint64), 0, places=True, also=lambda i, j: (state[i] == state[j]) | near(i, j)):
                    new = root[a] != root[b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])[new]), pa.array(np.minimum(node[a], node[b])[new])], names=["a", "b"])

    dealt = rows.select("cluster", F.explode("prefix").alias("s"), "node", "root", F.col("n").cast("long").alias("n"), *(F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(WIDE_PARITY)))
    dealt = dealt.repartition("cluster", "s").sortWithinPartitions("cluster", "s")
    return dealt.mapInArrow(pairs, "a long, b long").distinct()


def settled(rows: DataFrame, pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Components (node, root) by true similarity, searched for among all nodes that ``pairs`` connect.

    ``pairs`` give a node one partner a bucket, which need not be its true one: where a pair proves not to be similar,
    all nodes that it is connected with are searched by their prefixes, one pair a node at first; if one of
    these is not similar either, all pairs of theirs that their parities allow for.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    shingles = written(rows.select(F.col("row").alias("node"), "shingles").join(ids.hint("merge"), "node", "left_semi"), "simhash-shingles")
    links = written(similar(shingles, pairs, least), "simhash-links")
    joined, tried = components(links), pairs  # a tried pair of unlinked nodes is not similar
    failed = written(pairs.join(links, ["a", "b"], "left_anti"), "simhash-failed")
    if failed.isEmpty():
        return joined
    clusters = components(pairs).withColumnRenamed("root", "cluster")
    # what is one already needs no search, and two nodes have one pair, which has been compared
    state = clusters.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")).groupBy("cluster")
    open_ = state.agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("size > 2 and low <> high").select("cluster")
    clusters = written(clusters.join(open_, "cluster", "left_semi"), "simhash-open")
    if clusters.isEmpty():
        return joined
    prefixed = written(prefixes(shingles, clusters, least), "simhash-prefixes")
    for every in (False, True):
        state = prefixed.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
        asked = written(posted(state, least, every), "simhash-posted")
        found = written(similar(shingles, asked.join(tried, ["a", "b"], "left_anti"), least), "simhash-links")
        links = links.unionByName(found)
        if not found.isEmpty():
            joined = components(links)
        if asked.join(found, ["a", "b"], "left_anti").isEmpty():
            break
        tried = tried.unionByName(asked)
    return joined


def keep_one(docs: DataFrame, size: int = STAGE_SHINGLE, least: float = SIMILARITY, wordless: bool = False) -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the smallest doc_id stays, columns as they are.

    Texts are near-duplicates if they are equal, or if their sets of ``size``-word shingles (A-Z lower-cased, 32 bits of
    hash a shingle) have a Jaccard similarity of ``least`` or more; candidates come from covering tables over fingerprints of
    word classes and are near in the fingerprint of their shingles, and all that they connect are searched for true partners.
    Equal texts are told by two 64-bit hashes. Texts without words (null and empty ones too)
    are in no class and all stay, or with ``wordless`` are one class. A row without an id only stays if its class has none with one; of rows with that same
    id one stays.
    """
    named = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    text, doc = named["text"], named["doc_id"]
    keyed = docs.withColumnsRenamed(named).withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)})
    rows = written(sketched(keyed, text, size), "simhash-rows")
    # copies are one node from here on: the row of theirs that would stay
    order = F.struct(F.col(doc).isNull().alias("no_id"), F.col(doc).alias("doc_id"), F.col("row").alias("row"))
    has_word = F.col("classes").isNotNull()
    nodes = written(rows.where(has_word).groupBy("h1", "h2").agg(F.min(order).alias("best")).select("best"), "simhash-nodes")
    sketches = rows.select(F.col("row").alias("node"), "classes", "more", "whole", "parity", (F.octet_length("shingles") / 4).cast("long").alias("n"))
    sketches = sketches.join(nodes.select(F.col("best.row").alias("node")), "node", "left_semi")
    joined = settled(rows, written(candidates(sketches, least), "simhash-candidates"), least)
    classed = nodes.join(joined, F.col("best.row") == F.col("node"), "left").select(F.coalesce("root", F.col("best.row")).alias("root"), "best")
    stay = classed.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    none = rows.where(~has_word)
    if wordless:
        none = none.join(F.broadcast(none.agg(F.min(order).alias("best")).select(F.col("best.row").alias("row"))), "row", "left_semi")
    gone = written(rows.select("row").join(none.select("row").unionByName(stay), "row", "left_anti"), "simhash-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone
    return rows.join(gone, "row", "left_anti").select(*(F.col(v).alias(c) for c, v in named.items()))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of op 8: all of ``documents``, any text, null ids and texts as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
