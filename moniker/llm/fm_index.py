"""FM-index: Burrows-Wheeler transform in a wavelet matrix of packed bits, searched backwards."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; the symbols are dense and every suffix is distinct."""
    n = len(symbols)
    rank, step = symbols.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Rank queries on a sequence of symbols in one packed bit vector a level."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels):
            bit = (now >> (self.levels - 1 - level)) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            word = np.zeros(len(bit) // 64 + 1, np.uint64)
            word.view(np.uint8)[: len(packed)] = packed
            self.words.append(word)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word[:-1]), dtype=np.int64)]))
            self.zeros.append(len(bit) - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` goes through all levels on the way of ``symbol``."""
        at = at.copy()
        for level in range(self.levels):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)
            up = (symbol >> (self.levels - 1 - level)) & 1 == 1
            at = np.where(up, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Index of pieces of text given as dense symbols; each piece ends with a symbol that occurs once.

    ``depth`` is the length of match that counts: an interval never stands for more than so many symbols.
    """

    def __init__(self, symbols: np.ndarray, size: int, depth: int):
        self.size, self.depth = size, depth
        self.places = suffix_array(symbols)
        self.bwt = WaveletMatrix(symbols[self.places - 1], size)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        every = np.arange(size)
        self.base = self.bwt.follow(every, np.zeros(size, np.int64))
        # neighbours that share fewer than depth symbols bound the blocks that intervals of that depth are
        ends = np.zeros(len(symbols), bool)
        a, b = self.places[1:], self.places[:-1]
        same = np.arange(len(a))
        for k in range(depth):
            inside = (a[same] + k < len(symbols)) & (b[same] + k < len(symbols))
            same = same[inside]
            same = same[symbols[a[same] + k] == symbols[b[same] + k]]
        ends[1:] = True
        ends[0] = True
        ends[same + 1] = False
        self.block_begin = np.flatnonzero(ends)
        self.block = np.cumsum(ends) - 1

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the matches with ``symbol`` before them; empty if there are none."""
        shift = self.less[symbol] - self.base[symbol]
        return self.bwt.follow(symbol, low) + shift, self.bwt.follow(symbol, high) + shift

    def matches(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the texts ``symbols[begin:end]``, which the index holds too.

        All texts are read backwards together. Where ``depth`` symbols match, the longer match gives way to the block
        of all places that share its first ``depth`` symbols. Returns for each position of ``symbols`` the length
        matched (``depth`` at most) and the block.
        """
        length, block = np.zeros(len(symbols), np.int32), np.full(len(symbols), -1, np.int64)
        order = np.argsort(begin - end, kind="stable")  # longest first
        begin, end = begin[order], end[order]
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(self.places), np.int64)
        have = np.zeros(len(begin), np.int32)
        live, step = len(begin), 1
        while live:
            live = int(np.searchsorted(begin - end, -step, "right"))
            if not live:
                break
            at = end[:live] - step
            lo, hi = self.extend(symbols[at], low[:live], high[:live])
            have[:live] = np.minimum(have[:live] + 1, self.depth)
            full = np.flatnonzero(have[:live] == self.depth)
            inside = self.block[lo[full]]
            lo[full] = self.block_begin[inside]
            hi[full] = np.append(self.block_begin, len(self.places))[inside + 1]
            low[:live], high[:live] = lo, hi
            length[at] = have[:live]
            block[at[full]] = inside
            step += 1
        return length, block
