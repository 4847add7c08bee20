"""An FM-index over integer sequences: suffix order, Burrows-Wheeler transform, wavelet matrix, backward search.

All searches of a batch advance together, a symbol at a time, so that the index is read with vector
operations. The bit rows of the wavelet matrix are packed into 64-bit words with a running count for each.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `text` by their suffixes, compared to at least `depth` symbols (prefix doubling)."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while step < depth and n:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[0] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=fresh[1:])
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        step *= 2
    return order


class Bits:
    """A bit row with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class FMIndex:
    """`text`: symbols 0 (a separator) to sigma - 1; patterns of at most `depth` symbols can be searched."""

    def __init__(self, text: np.ndarray, depth: int = 64):
        self.n, self.depth = len(text), depth
        sigma = int(text.max()) + 1 if len(text) else 1
        self.levels = max(1, int(sigma - 1).bit_length())
        order = suffix_order(text, depth)
        last = text[order - 1].astype(np.int64)  # the symbol before each suffix, in suffix order
        self.first = np.zeros(sigma + 1, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.first[1:])
        self.rows, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bits = (last >> level) & 1
            self.rows.append(Bits(bits.astype(np.uint8)))
            self.zeros.append(int(len(bits) - bits.sum()))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        self.base = self._walk(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, row, zeros in zip(reversed(range(self.levels)), self.rows, self.zeros):
            ones = row.rank(at)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of symbol + pattern, from the ranges of the patterns."""
        both = self._walk(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        shift = self.first[symbols] - self.base[symbols]
        return both[: len(lo)] + shift, both[len(lo) :] + shift

    def repeated_windows(self, text: np.ndarray, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
        """For windows start[k] + 0..count[k]-1 of `text` (the indexed one): does the window occur twice or more?

        Returns one flag for each window, in order. A window is matched from its last symbol backward. If the
        match becomes unique at s, every window that starts at or before s and ends no earlier is unique as
        well, so the search goes on after s.
        """
        offset = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(int(offset[-1]), dtype=bool)
        lane = np.arange(len(start))
        window = np.zeros(len(start), dtype=np.int64)
        at = start + length - 1
        lo, hi = np.zeros(len(start), dtype=np.int64), np.full(len(start), self.n, dtype=np.int64)
        while len(lane):
            lo, hi = self.extend(text[at], lo, hi)
            begin = start[lane] + window
            unique = hi - lo < 2
            found = ~unique & (at == begin)
            out[offset[lane[found]] + window[found]] = True
            # on to the window after the place that is unique, or after this one
            window = np.where(unique, at - start[lane] + 1, window + found)
            done = unique | found
            at = np.where(done, start[lane] + window + length - 1, at - 1)
            lo, hi = np.where(done, 0, lo), np.where(done, self.n, hi)
            live = window < count[lane]
            if not live.all():
                lane, window, at, lo, hi = lane[live], window[live], at[live], lo[live], hi[live]
        return out
