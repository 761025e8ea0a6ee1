"""Language-model scoring by logistic context mixing, and by word frequencies.

Texts are predicted bit by bit. For each context (the last two to five bytes; the last six of the word so far, or at its
beginning of the word before) a hashed table of counts, gathered from all texts learned from, predicts the next bit. The table has a row for each
distinct (context, half byte) of these texts, however many there are, and check bits, so that a context never seen is told
from those seen. What a pair of counts is worth is learned for each context, online, and so are the weights that mix the
predictions in the logistic domain, by a gate (which bit it is, how many contexts are known); a last table refines the
probability adaptively by what was actually seen at such predictions. The bits of a text add up to its score.

All texts learned from are learned from: each task does so online over its own, leaving the bit at hand out of the counts, and what the tasks
have learned is averaged by how much each has seen. Then the model is frozen: the score of a text hangs on nothing but the model and
the text, so rows can be scored anywhere and again, and equal contexts are mixed once a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .language import remainder
from .shared import table, text_key, written

ORDERS = (2, 3, 4, 5)
CONTEXTS = len(ORDERS) + 1
#: Last bytes of a word, or of its beginning so far, that are a context.
PREFIX = 6
#: Slots of the table for each row.
ROOM = 1.6
#: Leading bits of a row's key that name a block, which is sent and summed at once.
BLOCK_BITS = 10
#: Keys that a task holds before it sums those that are equal.
HELD = 1 << 21
#: Distinct runs of a step of learning.
STEP = 4096
#: Text whose runs are told apart at once, in bytes: the more, the fewer distinct ones there are to mix.
SLICE = 3 << 20
#: The same when counting, where what has been counted is held beside it.
COUNT_SLICE = 2 << 20
#: Groups in which the tasks' results are added before the driver gets them.
GROUPS = 16
#: Counts are told apart exactly up to this sum; above, sums by these bounds and chances by this many levels of their logit.
EXACT = 5
SUMS, CHANCES = np.array([13, 41, 201]), 58
#: Most frequent words whose counts are broadcast (16 bytes each); the rest is joined.
FREQUENT = 1 << 20
#: Hash that stands for the end of a text among the words.
END = np.uint64(0xE2D0E2D0E2D0E2D1)

_BUCKETS, _RANGE = 24, 8.0


_BASE = 0x9E3779B97F4A7C15 | 1
_SPAN = 1 << 16
_UP, _DOWN = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * _SPAN, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of every text, and a zero byte after each: it and the five before it, the hash of its word context, and the row."""
    raw, off = tk.buffers(texts)
    n = len(off) - 1
    size = np.diff(off)
    gaps = np.zeros(len(raw) + 6 * n, bool)  # five zeros before and one after each text
    begin = np.cumsum(size + 6) - (size + 6)
    for k in range(5):
        gaps[begin + k] = True
    ends = begin + size + 5
    gaps[ends] = True
    out = np.zeros(len(gaps), np.uint8)
    out[~gaps] = raw
    m = len(out)
    code = np.zeros(max(0, m - 5), np.uint64)
    for k in range(6):
        code <<= np.uint64(8)
        code |= out[k : m - 5 + k]
    gaps[ends] = False
    inner = ~gaps[5:]  # what is predicted: bytes and ends
    code = code[inner]
    word = np.empty(len(code), np.uint64)
    at = 0
    for first in range(0, m, _SPAN):  # the word contexts, in parts that overlap by what a context may reach back
        low, high = max(0, first - 2 * PREFIX), min(m, first + _SPAN)
        part = _words(out[low:high], low == 0)[first - low :]
        part = part[inner[max(0, first - 5) : high - 5]] if first else part[5:][inner[: high - 5]]
        word[at : at + len(part)] = part
        at += len(part)
    row = np.repeat(np.arange(n, dtype=np.int32), size + 1)
    return code, word, row


def _words(out: np.ndarray, begins: bool) -> np.ndarray:
    """For each byte the hash of the last PREFIX bytes of its word so far, as a difference of sums; at a word's beginning
    that of the word right before; else 0. Right from byte 2 * PREFIX on, or everywhere if text ``begins`` here."""
    m = len(out)
    apart = ~tk.NON_SPACE[out] | (out == 0)
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum((out.astype(np.uint64) + np.uint64(1)) * _UP[:m], out=sums[1:])
    where = np.arange(m)
    since = np.zeros(m, np.int64)
    np.maximum.accumulate(np.where(apart[:-1], where[1:], 0), out=since[1:])
    first = since == where
    np.maximum(since, where - PREFIX, out=since)
    word = (sums[:m] - sums[since]) * _DOWN[since] + np.uint64(1)
    starts = np.flatnonzero(first)
    before = starts[starts > 0] - 1
    word[starts[starts == 0]] = 0
    word[before + 1] = np.where(first[before], np.uint64(0), word[before] * tk._K3)
    return word


def distinct(code: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of one of each distinct (code, word), which of them each is, and how often they occur."""
    bits = np.uint64(max(1, len(code).bit_length()))
    key = tk.join_hash(code, word)
    key >>= bits
    key <<= bits
    key |= np.arange(len(code), dtype=np.uint64)
    key.sort()
    order = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    key >>= bits
    own = code[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    which = np.empty(len(key), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], which, np.diff(np.append(np.flatnonzero(new), len(key)))


def _contexts(code: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """Hash of each context of the last byte."""
    own = [tk.mix(((code >> np.uint64(8)) & np.uint64((1 << (8 * o)) - 1)) * np.uint64(8) + np.uint64(o)) for o in ORDERS]
    return [*own, tk.mix(word + tk._K1)]


def _together(code: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Sorting by it puts runs with equal contexts together: first by the last byte known, then by the one before and so on."""
    return (code >> np.uint64(8)).byteswap() | ((word & np.uint64(0xFFFF)) << np.uint64(8)) | (code & np.uint64(255))


def _changes(x: np.ndarray) -> np.ndarray:
    """Whether each differs from the one before; the first does."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _row_keys(context: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
    """Key of the row of the upper half byte, or, after ``high``, of the lower; the last four bits are zero."""
    return (context if high is None else tk.mix(context + (high + np.uint64(1)) * tk._K1)) & ~np.uint64(15)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


def count_halves(code: np.ndarray, word: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What distinct runs say: keys (row and half byte) and how often."""
    high, low = (code >> np.uint64(4)) & np.uint64(15), code & np.uint64(15)
    keys, counts = [], []
    for context in _contexts(code, word):
        key, n = _summed([_row_keys(context) | high, _row_keys(context, high) | low], [times, times])
        keys.append(key)
        counts.append(n)
    return np.concatenate(keys), np.concatenate(counts)


def _states(counts: np.ndarray) -> np.ndarray:
    """For each row of 16 counts the states of its nodes 1 to 15."""
    out = np.zeros((len(counts), 16), np.uint8)
    for depth in range(4):
        sides = counts.reshape(len(counts), 1 << depth, 2, 8 >> depth).sum(3)
        out[:, 1 << depth : 2 << depth] = state_of(sides[:, :, 0], sides[:, :, 1])
    return out


_FEW = (EXACT + 1) * (EXACT + 2) // 2


def state_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A byte for counts of zeros and ones; 0 if there are none."""
    total = zeros + ones
    level = np.clip(np.rint((np.log((ones + 0.4) / (zeros + 0.4)) + _RANGE) * ((CHANCES - 1) / (2 * _RANGE))), 0, CHANCES - 1).astype(np.int64)
    return np.where(total <= EXACT, total * (total + 1) // 2 + ones, _FEW + np.searchsorted(SUMS, total, "right") * CHANCES + level).astype(np.uint8)


_PAIRS = [(n - k, k) for n in range(EXACT + 1) for k in range(n + 1)]
#: What a state says before anything has been learned, and the state after one zero, or one, has been left out of it (if exact).
_START = np.zeros(256)
_START[:_FEW] = [np.log((b + 0.4) / (a + 0.4)) for a, b in _PAIRS]
_START[_FEW : _FEW + (len(SUMS) + 1) * CHANCES] = np.tile(np.linspace(-_RANGE, _RANGE, CHANCES), len(SUMS) + 1)
_LESS = np.tile(np.arange(256), (2, 1))
_LESS[0, :_FEW] = [state_of(np.array(max(a - 1, 0)), np.array(b)) for a, b in _PAIRS]
_LESS[1, :_FEW] = [state_of(np.array(a), np.array(max(b - 1, 0))) for a, b in _PAIRS]


class Mixer:
    """States by row, their worth by context, weights by gate, refinement by node and prediction.

    Made of ``blocks`` of sorted keys and their counts, in order, ``size`` rows in all. A row stands in the first free slot
    from its home on, with 16 bits of its key as check (0: free); a row that is not there is mistaken for another of its
    neighbourhood once in 65,536 times a slot looked at.
    """

    def __init__(self, blocks, size: int):
        self.slots = int(ROOM * size) + 1
        self.check = np.zeros(self.slots + size + 1, np.uint16)
        self.place = np.zeros(len(self.check), np.uint32)
        known, free = {bytes(16): 0}, 0  # rows with equal states, as most are, are one
        for key, n in blocks:
            row = key >> np.uint64(4)
            first = np.flatnonzero(np.diff(row, prepend=~row[:1]))
            counts = np.zeros((len(first), 16), np.int64)
            counts[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row)))), (key & np.uint64(15)).astype(np.int64)] = n
            key = key[first] & ~np.uint64(15)
            home, step = self.home(key), np.arange(len(key))
            at = np.maximum(np.maximum.accumulate(home - step), free) + step
            states, which = np.unique(_states(counts).view("V16").ravel(), return_inverse=True)
            self.check[at], self.place[at] = self.mark(key), np.array([known.setdefault(x.tobytes(), len(known)) for x in states], np.uint32)[which]
            free = int(at[-1]) + 1
        used = max(free, self.slots) + 1  # one that is free ends every search
        self.check, self.place = self.check[:used].copy(), self.place[:used].copy()
        self.state = np.frombuffer(b"".join(known), np.uint8)
        self.worth = np.repeat(_START[None], CONTEXTS, 0)
        self.weights = np.full((8 * (CONTEXTS + 1), CONTEXTS + 1), 0.25)
        self.refined = np.repeat(_squash(np.linspace(-_RANGE, _RANGE, _BUCKETS))[None], 256, 0)

    def home(self, key: np.ndarray) -> np.ndarray:
        return (((key >> np.uint64(32)) * np.uint64(self.slots)) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def mark(key: np.ndarray) -> np.ndarray:
        return np.maximum(((key >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint16), np.uint16(1))

    def slot(self, key: np.ndarray) -> np.ndarray:
        """Where the states of each row begin: zeros, if it isn't there."""
        at, mark = self.home(key), self.mark(key)
        got = self.check[at]
        far = np.flatnonzero((got != mark) & (got != 0))
        while len(far):
            at[far] += 1
            got = self.check[at[far]]
            far = far[(got != mark[far]) & (got != 0)]
        return self.place[at].astype(np.int64) * 16

    def _slots(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        """``slot`` of each; equal keys that stand together are looked up once."""
        out = []
        for key in keys:
            new = _changes(key)
            out.append(self.slot(key[new])[np.cumsum(new) - 1])
        return out

    def mixed(self, states: list[np.ndarray], node: np.ndarray, k: int, worth, weights, refined):
        """Probability of a one, and all that learning needs."""
        x = [own[state] for own, state in zip(worth, states, strict=True)]
        gate = (7 - k) * (CONTEXTS + 1) + sum((state != 0).astype(np.int64) for state in states)
        weight = weights[gate]
        dot = weight[:, -1] * np.float32(0.3)
        for j, v in enumerate(x):
            dot += weight[:, j] * v
        np.clip(dot, -_RANGE, _RANGE, out=dot)
        at = (dot + np.float32(_RANGE)) * np.float32((_BUCKETS - 1) / (2 * _RANGE))
        low = np.minimum(at.astype(np.int64), _BUCKETS - 2)
        part = at - low
        place = node * _BUCKETS + low
        seen = refined[place] * (1 - part) + refined[place + 1] * part
        p = _squash(dot)
        return np.clip((p + seen) / 2, 1e-5, 1 - 1e-5), p, x, gate, place, part

    def _bits(self, code: np.ndarray, word: np.ndarray):
        """For each bit from the upper on: its place, the bits, their nodes in the byte, and the states of the contexts."""
        contexts, node = _contexts(code, word), np.ones(len(code), np.int64)
        high = (code >> np.uint64(4)) & np.uint64(15)
        for k in range(7, -1, -1):
            if k == 7:
                slots = [self.slot(_row_keys(c)) for c in contexts]
            elif k == 3:
                slots = [self.slot(_row_keys(c, high)) for c in contexts]
            bit = ((code >> np.uint64(k)) & np.uint64(1)).astype(np.int64)
            inner = node if k > 3 else (1 << (3 - k)) | (node & ((1 << (3 - k)) - 1))
            yield k, bit, node, [self.state[s + inner] for s in slots]
            node = 2 * node + bit

    def learned(self, parts) -> list[np.ndarray] | None:
        """What ``parts`` of distinct runs (code, word, times) teach, online: sums that can be added to those of others."""
        worth, weights, refined = self.worth.copy(), self.weights.copy(), self.refined.ravel().copy()
        ones, total = np.zeros((CONTEXTS, 256)), np.zeros((CONTEXTS, 256))
        ones_at, total_at = np.zeros(256 * _BUCKETS), np.zeros(256 * _BUCKETS)
        start, seen, step = _squash(self.worth), np.zeros(len(weights)), 0
        begin = self.refined.ravel()
        for code, word, times in parts:
            order = np.random.default_rng(5).permutation(len(code))
            for first in range(0, len(order), STEP):
                some = order[first : first + STEP]
                n = times[some].astype(np.float64)
                rate = 0.1 / (1 + step / 40) + 0.01
                for k, bit, node, states in self._bits(code[some], word[some]):
                    states = [_LESS[bit, state] for state in states]
                    _, p, x, gate, place, part = self.mixed(states, node, k, worth, weights, refined)
                    error, size = n * (bit - p), np.bincount(gate, n, len(weights))
                    for j, v in enumerate([*x, np.full(len(n), 0.3)]):
                        weights[:, j] += rate * np.bincount(gate, error * v, len(weights)) / np.maximum(size, 1e-9)
                    seen += size
                    for j, state in enumerate(states):
                        ones[j] += np.bincount(state, n * bit, 256)
                        total[j] += np.bincount(state, n, 256)
                    for at, share in ((place, 1 - part), (place + 1, part)):
                        ones_at += np.bincount(at, n * bit * share, len(ones_at))
                        total_at += np.bincount(at, n * share, len(total_at))
                step += 1
                chance = (ones + 2 * start) / (total + 2)
                worth = np.log(chance / (1 - chance))
                worth[:, 0] = 0
                refined = (ones_at + 8 * begin) / (total_at + 8)
        return [weights * seen[:, None], seen, ones, total, ones_at, total_at] if step else None

    def settle(self, sums: list[np.ndarray] | None) -> None:
        """Take what has been learned, all tasks' sums added, and keep what scoring needs."""
        if sums is not None:
            weights, seen, ones, total, ones_at, total_at = sums
            self.weights = np.where(seen[:, None] > 0, weights / np.maximum(seen, 1e-9)[:, None], self.weights)
            chance = (ones + 2 * _squash(self.worth)) / (total + 2)
            self.worth = np.log(chance / (1 - chance))
            self.refined = ((ones_at + 8 * self.refined.ravel()) / (total_at + 8)).reshape(256, _BUCKETS)
        self.worth[:, 0] = 0
        weights = self.weights.reshape(8, CONTEXTS + 1, CONTEXTS + 1)  # bit, contexts known, input
        #: by bit and context, for contexts known and state: what the context adds to the logit; and what the bias does
        self.adds = (weights[:, :, :-1, None] * self.worth[None, None]).transpose(0, 2, 1, 3).astype(np.float32).reshape(8, CONTEXTS, -1).copy()
        self.bias = (0.3 * weights[:, :, -1]).astype(np.float32)
        self.refine = self.refined.astype(np.float32).ravel()

    def cost(self, code: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run after the others."""
        out = np.empty(len(code), np.float32)
        order = np.argsort(_together(code, word))
        for first in range(0, len(code), 1 << 15):  # small enough for the processor's cache
            part = order[first : first + (1 << 15)]
            out[part] = self._cost(code[part], word[part])
        return out

    def _cost(self, code: np.ndarray, word: np.ndarray) -> np.ndarray:
        """``cost`` of runs in the order of ``_together``: those with equal contexts and upper bits share the next bit's prediction."""
        scale = np.float32((_BUCKETS - 1) / (2 * _RANGE))
        byte, other = (code & np.uint64(255)).astype(np.int64), _changes(word)
        every = np.ones(len(code), np.float64)
        for k in range(7, -1, -1):
            new = other | _changes(code >> np.uint64(k + 1))
            one = np.flatnonzero(new)
            if k == 7:
                contexts = _contexts(code[one], word[one])
                slots, of = self._slots([_row_keys(c) for c in contexts]), np.cumsum(new) - 1
            elif k == 3:
                high = (code[one] >> np.uint64(4)) & np.uint64(15)
                row = of[one]
                slots, of = self._slots([_row_keys(c[row], high) for c in contexts]), np.cumsum(new) - 1
            node = (byte[one] | 256) >> (k + 1)
            inner = node if k > 3 else (1 << (3 - k)) | (node & ((1 << (3 - k)) - 1))
            row = of[one]
            states = [self.state[s[row] + inner] for s in slots]
            known = np.zeros(len(one), np.int16)
            for state in states:
                known += state != 0
            dot = self.bias[7 - k].take(known)
            known <<= 8
            for j, state in enumerate(states):
                dot += self.adds[7 - k, j].take(known + state)
            np.clip(dot, -_RANGE, _RANGE, out=dot)
            at = (dot + np.float32(_RANGE)) * scale
            low = np.minimum(at.astype(np.int32), _BUCKETS - 2)
            at -= low
            place = node * _BUCKETS + low
            seen = self.refine.take(place)
            seen += at * (self.refine.take(place + 1) - seen)
            np.exp(-dot, out=dot)
            dot += 1
            np.divide(np.float32(1), dot, out=dot)
            dot += seen
            dot *= np.float32(0.5)
            np.clip(dot, np.float32(1e-5), np.float32(1 - 1e-5), out=dot)
            dot = np.repeat(dot, np.diff(np.append(one, len(code))))
            every *= np.where((byte >> k) & 1, dot, 1 - dot)
        return -np.log2(every)

    def bits(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text, its end included."""
        out = np.zeros(len(texts))
        code, word, row = _runs(texts)
        for at in range(0, len(code), 1 << 22):
            part = slice(at, at + (1 << 22))
            one, which, _ = distinct(code[part], word[part])
            out += np.bincount(row[part], self.cost(code[part][one], word[part][one])[which], len(texts))
        return out


def _squash(x):
    return 1 / (1 + np.exp(-x))


def _pack(*columns: np.ndarray) -> bytes:
    """The first, sorted, as differences, and the others, in planes of bytes; compressed."""
    wide = np.stack([np.diff(columns[0], prepend=np.uint64(0)), *(c.astype(np.uint64) for c in columns[1:])], 1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide.astype("<u8").view(np.uint8).T).tobytes())


def _unpack(body: bytes, columns: int = 2) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(8 * columns, -1)
    wide = np.ascontiguousarray(planes.T).view("<u8")
    return [np.cumsum(wide[:, 0], dtype=np.uint64), *(wide[:, k].copy() for k in range(1, columns))]


class _Held:
    """Rows of a key, values that hang on it, and a count, which are summed by key whenever too many are held."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held > max(HELD, 2 * len(self.parts[0][0])):
            self.parts = [self.summed()]
            self.held = len(self.parts[0][0])

    def summed(self) -> tuple[np.ndarray, ...]:
        key, *values, n = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        return (key[first], *(v[order[first]] for v in values), np.add.reduceat(n[order], first) if len(first) else n)


def _blocks(key: np.ndarray, *columns: np.ndarray):
    """Sorted rows in parts by the leading bits of the key, packed."""
    edge = np.append(np.searchsorted(key, np.arange(1 << BLOCK_BITS, dtype=np.uint64) << np.uint64(64 - BLOCK_BITS)), len(key))
    for k in np.flatnonzero(np.diff(edge)):
        part = slice(edge[k], edge[k + 1])
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([_pack(key[part], *(c[part] for c in columns))], pa.binary())], names=["block", "body"])


_BLOCK = "block long, body binary"


def _added(rows: DataFrame, columns: int) -> DataFrame:
    """The blocks with equal rows summed."""

    def add(group: pa.Table) -> pa.Table:
        held = _Held()
        for x in group.column("body"):
            held.add(*_unpack(x.as_py(), columns))
        return pa.table([group.column("block").slice(0, 1).combine_chunks(), pa.array([_pack(*held.summed())], pa.binary())], names=["block", "body"])

    return rows.groupBy("block").applyInArrow(add, _BLOCK)


def all_runs(texts: DataFrame) -> DataFrame:
    """Blocks (block, body) of the distinct runs of all texts: key, code, word, times; summed by task, then by block."""

    def count(batches):
        held = _Held()
        for whole in batches:
            for batch in tk.slices(whole, most=COUNT_SLICE):
                code, word, _ = _runs(batch.column("text"))
                for at in range(0, len(code), 1 << 22):
                    c, w = code[at : at + (1 << 22)], word[at : at + (1 << 22)]
                    one, _, times = distinct(c, w)
                    held.add(tk.join_hash(c[one], w[one]), c[one], w[one], times.astype(np.uint64))
        if held.parts:
            yield from _blocks(*held.summed())

    return _added(texts.select("text").mapInArrow(count, _BLOCK), 4)


def half_counts(runs: DataFrame) -> DataFrame:
    """Blocks (block, body) of what the runs say: key (row and half byte) and count."""

    def count(batches):
        held = _Held()
        for batch in batches:
            for x in batch.column("body"):
                _, code, word, times = _unpack(x.as_py(), 4)
                held.add(*count_halves(code, word, times))
        if held.parts:
            yield from _blocks(*held.summed())

    return _added(runs.mapInArrow(count, _BLOCK), 2)


def table_of(counts: list[bytes]) -> Mixer:
    """The mixer of all blocks, in order."""
    size = 0
    for x in counts:
        row = _unpack(x)[0] >> np.uint64(4)
        size += int((np.diff(row, prepend=~row[:1]) != 0).sum())
    return Mixer((_unpack(x) for x in counts), size)


def fit(texts: DataFrame) -> Mixer:
    """A mixer of all ``texts``: their counts, and weights, worth and refinement learned online over all of them. Null texts don't count.

    Runs that are equal are gathered first, with how often they occur, and learned from as often; what goes through the network
    is the distinct ones.
    """
    spark = texts.sparkSession
    runs = written(all_runs(texts.select("text").where("text is not null")), "lm-runs")
    blocks = written(half_counts(runs), "lm-counts").toArrow().sort_by("block")
    mixer = table_of([x.as_py() for x in blocks.column("body")])
    del blocks
    handle = spark.sparkContext.broadcast(mixer)
    shapes = [mixer.weights.shape, (len(mixer.weights),), (CONTEXTS, 256), (CONTEXTS, 256), (256 * _BUCKETS,), (256 * _BUCKETS,)]

    def learn(batches):
        parts = (_unpack(x.as_py(), 4)[1:] for batch in batches for x in batch.column("body"))
        sums = handle.value.learned(parts)
        if sums is not None:
            every = np.concatenate([x.ravel() for x in sums])
            yield pa.RecordBatch.from_arrays([pa.array([int(sums[1].sum()) % GROUPS]), pa.array([every.tobytes()], pa.binary())], names=["part", "sums"])

    def add(group: pa.Table) -> pa.Table:
        every = sum(np.frombuffer(x.as_py()) for x in group.column("sums"))
        return pa.table([group.column("part").slice(0, 1).combine_chunks(), pa.array([every.tobytes()], pa.binary())], names=["part", "sums"])

    got = runs.mapInArrow(learn, "part long, sums binary").groupBy("part").applyInArrow(add, "part long, sums binary").orderBy("part").collect()
    handle.unpersist()
    sums = None
    if got:
        every = sum(np.frombuffer(r["sums"]) for r in got)
        edge = np.cumsum([0] + [int(np.prod(x)) for x in shapes])
        sums = [every[a:b].reshape(x) for a, b, x in zip(edge[:-1], edge[1:], shapes, strict=True)]
    mixer.settle(sums)
    return mixer


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of an end for each row, and the row of each."""
    w = tk.words(column, lower=True)
    n = len(w.first) - 1
    return np.concatenate([tk.hashes(w), np.full(n, END)]), np.concatenate([w.row(), np.arange(n)])


def word_counts(texts: DataFrame) -> DataFrame:
    """Columns word (hash), c: occurrences in all texts, ends included."""

    def run(batches):
        for whole in batches:
            for batch in tk.slices(whole):
                word, n = np.unique(_tokens(batch.column("text"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))


def score(docs: DataFrame, learn_from: Column, frequent: int = FREQUENT) -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score, bits and score.

    Learns from the rows where ``learn_from`` holds. ``base_score`` adds up log10((c + 0.5) / (N + 0.5 (V + 1))) over
    the text's words (A-Z lower-cased) and its end; ``bits`` is what the mixer takes for the text's bytes and end, and ``score`` the
    same as log10 probability. Null text counts as empty and is still one token. Repeated rows are scored each;
    columns named as an added one are replaced.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "bits", "score"]
    docs = docs.drop(*added)
    rest = [c for c in docs.columns if c != "text"]
    training = docs.where(learn_from).select("text")
    words = written(word_counts(training), "lm-words")
    total, kinds = words.agg(F.sum("c"), F.count("*")).first()
    total = total or 0
    norm = total + 0.5 * (kinds + 1)
    # the least count of which no more than ``frequent`` words have as much or more
    least, room = 1, frequent
    for r in words.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
        if r["count"] > room:
            least = r["c"] + 1
            break
        room -= r["count"]
    often = words.where(F.col("c") >= least).toArrow()
    hashed, c = often.column("word").to_numpy().view(np.uint64), often.column("c").to_numpy()
    order = np.argsort(hashed)
    handle = docs.sparkSession.sparkContext.broadcast((hashed[order], np.log10((c[order] + 0.5) / norm), fit(training)))
    rare = words.where(F.col("c") < least)

    def run(batches):
        known, logs, mixer = handle.value
        for whole in batches:
            for batch in tk.slices(whole, most=SLICE):
                h, row = _tokens(batch.column("text"))
                n = batch.num_rows
                if len(known):
                    order = np.argsort(h)
                    h, row = h[order], row[order]
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[at] == h
                    sums = np.bincount(row[hit], logs[at[hit]], n)
                else:
                    hit, sums = np.zeros(len(h), bool), np.zeros(n)
                tokens, sure = np.bincount(row, minlength=n), np.bincount(row[hit], minlength=n)
                ids = batch.column("row").to_numpy()
                none = lambda kind, size: pa.nulls(size, kind)
                own = [batch.column(f"__{c}") for c in rest]
                yield pa.RecordBatch.from_arrays(
                    [*own, batch.column("row"), pa.array(tokens.astype(np.int64)), pa.array(sure.astype(np.int64)), pa.array(sums), pa.array(mixer.bits(batch.column("text"))), none(pa.int64(), n), none(pa.int64(), n)],
                    names=names,
                )
                word, at = h[~hit], row[~hit]
                order = np.lexsort((word, at))
                word, at = word[order], at[order]
                first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (at[1:] != at[:-1])])) if len(word) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(word)))
                m = len(first)
                yield pa.RecordBatch.from_arrays(
                    [*(none(x.type, m) for x in own), pa.array(ids[at[first]]), none(pa.int64(), m), none(pa.int64(), m), none(pa.float64(), m), none(pa.float64(), m), pa.array(word[first].view(np.int64)), pa.array(times.astype(np.int64))],
                    names=names,
                )

    rows = docs.select(*(F.col(c).alias(f"__{c}") for c in rest), "text", F.monotonically_increasing_id().alias("row"))
    kinds_out = {"row": "long", "n_tokens": "long", "n_known": "long", "sums": "double", "bits": "double", "word": "long", "n": "long"}
    names = [*(f"__{c}" for c in rest), *kinds_out]
    schema = T.StructType([T.StructField(f"__{c}", docs.schema[c].dataType) for c in rest] + [T.StructField(c, T.LongType() if k == "long" else T.DoubleType()) for c, k in kinds_out.items()])
    parts = written(rows.mapInArrow(run, schema), "lm-parts")
    there = F.coalesce(F.col("c"), F.lit(0))
    joined = parts.where("word is not null").join(rare, "word", "left").select("row", F.when(there > 0, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * F.log10((there + 0.5) / norm)).alias("sums"))
    joined = joined.groupBy("row").agg(F.sum("n_known").alias("more_known"), F.sum("sums").alias("more"))
    whole = parts.where("word is null").join(joined, "row", "left")
    return whole.select(
        *(F.col(f"__{c}").alias(c) for c in rest),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "bits",
        (F.col("bits") * -float(np.log10(2))).alias("score"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of op 7: every row of ``documents``; a null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder(5) == 1, F.lit(False)).alias("held_out"))
    return score(docs, ~F.col("held_out")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
