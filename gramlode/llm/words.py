"""Vectorised word splitting and hashing over Arrow string columns.

The Arrow operators of this subpackage see a batch of texts as one byte buffer.
Everything here works on such buffers with numpy, a bounded slice at a time, so
that memory does not follow the size of a batch or of a single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.ones(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Byte classes: words of `[^\x20\x09-\x0D]+`.
SPACE_WORDS = _SPACE
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = True
_ALNUM[0x80:] = True
#: Byte classes: words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower case.
ALNUM_WORDS = _ALNUM
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLOCK = 1 << 19
_TABLES: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> list[np.ndarray]:
    if not _TABLES:
        up = np.full(_BLOCK + 1, _R, dtype=np.uint64)
        up[0] = 1
        down = np.full(_BLOCK + 1, np.uint64(pow(int(_R), -1, 1 << 64)), dtype=np.uint64)
        down[0] = 1
        _TABLES.extend((np.cumprod(up), np.cumprod(down)))
    return _TABLES


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, by a polynomial over prefix sums."""
    up, down = _powers()
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        base = int(starts[k])
        stop = int(np.searchsorted(ends, base + _BLOCK, side="right"))
        if stop <= k:  # one word longer than a block
            total, scale = 0, 1
            for at in range(base, int(ends[k]), _BLOCK):
                part = buf[at : min(at + _BLOCK, int(ends[k]))].astype(np.uint64) + np.uint64(1)
                total = (total + int(np.sum(part * up[: len(part)], dtype=np.uint64)) * scale) % (1 << 64)
                scale = scale * int(up[_BLOCK]) % (1 << 64)
            out[k] = total
            k += 1
            continue
        top = int(ends[stop - 1])
        sums = np.zeros(top - base + 1, dtype=np.uint64)
        np.cumsum((buf[base:top].astype(np.uint64) + np.uint64(1)) * up[: top - base], out=sums[1:])
        a, b = starts[k:stop] - base, ends[k:stop] - base
        out[k:stop] = (sums[b] - sums[a]) * down[a]
        k = stop
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Texts:
    """Words of consecutive texts: hashes, byte ranges in `buf`, and for text d the words first[d]:first[d+1]."""

    def __init__(self, texts: pa.Array, classes: np.ndarray, lower: bool):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        if not len(texts):
            offsets, data = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
        else:
            raw = texts.buffers()
            offsets = np.frombuffer(raw[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, dtype=np.uint8)
            data = data[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
        if texts.null_count:  # a null may have bytes below it
            empty = texts.is_null().to_numpy(zero_copy_only=False)
            if (np.diff(offsets)[empty] > 0).any():
                texts = texts.fill_null("")
                self.__init__(pa.array(texts.to_pylist(), pa.string()), classes, lower)
                return
        self.buf = LOWER[data] if lower else data
        inside = classes[self.buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        first[cuts] = inside[cuts]
        self.starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = cuts[cuts > 0]
        last[cuts - 1] = inside[cuts - 1]
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.offsets = offsets
        self.hashes = hash_words(self.buf, self.starts, self.ends)
        self.n_words = np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def words(self, a: int, b: int) -> list[bytes]:
        data = self.buf
        return [data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b])]


class Windows:
    """Hashes of runs of consecutive words, built from powers of two that are kept."""

    def __init__(self, hashes: np.ndarray):
        self.levels = [hashes]

    def of(self, length: int) -> np.ndarray:
        """One hash for each start at which `length` values are left."""
        n = len(self.levels[0]) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out, at, bit = None, 0, 0
        while length >> bit:
            if bit == len(self.levels):
                half, step = self.levels[-1], 1 << (bit - 1)
                self.levels.append(mix(half[: max(0, len(half) - step)] * np.uint64(0xA0761D6478BD642F) + half[step:]))
            if length >> bit & 1:
                part = self.levels[bit][at : at + n]
                out = part if out is None else mix(out * np.uint64(0xE7037ED1A0B428DB) + part)
                at += 1 << bit
            bit += 1
        return out


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Positions at which a window of `length` words stays inside its text."""
    n = int(first[-1])
    ok = np.zeros(n + 1, dtype=np.int32)
    sizes = np.diff(first)
    whole = sizes >= length
    np.add.at(ok, first[:-1][whole], 1)
    np.add.at(ok, first[1:][whole] - length + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:n]) > 0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about `most` bytes, or a single longer text."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
