"""Vectorised word splitting and hashing over Arrow string columns.

Everything works on the UTF-8 bytes of a whole batch at once. The word classes used by the operators
are byte classes: all bytes of a multi-byte character are word bytes, so no decoding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
#: `[^\x20\x09-\x0D]+`
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _K1 + b + _K2)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has at most ``most`` bytes of text, or a single row."""
    sizes = np.diff(buffers(batch.column(column))[1])
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 65536]), most, "right")))
        yield batch.slice(at, n)
        at += n


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the row offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(off):
        off = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


@dataclass
class Words:
    data: np.ndarray  #: bytes, lower-cased if asked for
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: for each row the index of its first word; one more entry at the end

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each: the bytes, and each word's start and end in them."""
        length = self.end - self.start
        start = np.cumsum(length + 1) - (length + 1)
        out = np.full(int(length.sum() + len(length)), 0x20, np.uint8)
        inside = np.ones(len(out), bool)
        inside[start + length] = False
        within = np.zeros(len(self.data) + 1, np.int32)
        within[self.start] += 1  # starts are distinct, and so are ends
        within[self.end] -= 1
        out[inside] = self.data[np.cumsum(within[:-1]) > 0]
        return out.tobytes(), start, start + length


def words(column: pa.Array, kind: np.ndarray = NON_SPACE, lower: bool = False) -> Words:
    """Maximal runs of word bytes of each row; a word never crosses rows."""
    data, off = buffers(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(off), np.int64))
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = off[:-1][off[:-1] < n]
    begins[edge] = inside[edge]
    edge = off[1:][off[1:] > 0] - 1
    ends[edge] = inside[edge]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, off))


def hashes(w: Words) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    return span_hashes(w.data, w.start, w.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = end - start
    out = mix((lanes[start] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * _K1)
    more = np.flatnonzero(length > 8)
    at = 8
    while len(more):
        part = lanes[start[more] + at] & _MASK[np.minimum(length[more] - at, 8)]
        out[more] = mix((out[more] * _K1) ^ part)
        at += 8
        more = more[length[more] > at]
    return out


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive entries (positions over row ends included)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, step, power = None, 0, h, 1
    left = size
    while left:
        if left & 1:
            part = step[have : have + n]
            out = part if out is None else join_hash(out, part)
            have += power
        left >>= 1
        if left:
            step = join_hash(step[:-power], step[power:])
            power *= 2
    return out if size > 1 else out.copy()
