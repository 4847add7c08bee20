"""Packed exchange: values of many texts travel to buckets of a hash and back in a few binary rows.

One row holds what a slice of texts has for one bucket, so rows stay few, values take their own bytes
only, and the number of buckets follows the size of the corpus while the memory of a bucket does not. A slice
sends no row to a bucket for which it has nothing, so rows are never more than values.

Nulls don't reach this module: ids and texts are filled before. Empty tables make no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text for one bucket.
BUCKET_BYTES = 12 << 20


def bucket_bits(docs: DataFrame, text: str = "text", per: int = BUCKET_BYTES, least: int = 5) -> int:
    """Bits of a bucket number so that a bucket holds the values of about `per` bytes of text."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(least, int(np.ceil(np.log2(max(1, total / per)))))


def bucket_count(docs: DataFrame, text: str = "text", per: int = BUCKET_BYTES, least: int = 8) -> int:
    """Number of buckets so that each holds the values of about `per` bytes of text."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(least, -(-total // per))


def bucket_of(values: np.ndarray, n: int) -> np.ndarray:
    """A bucket below n (less than 2^32) from the high bits of 64-bit hashes."""
    return ((values >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """(key, rows) for rows that come sorted by `key`."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != at:
                yield at, held
                held = []
            at = row[key]
            held.append(row)
    if held:
        yield at, held


def dealt(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a key in one task, one after the other."""
    return df.repartition(key).sortWithinPartitions(key, *order)


def ranges(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of the runs of an ascending array: work and messages follow the data, not the number of buckets."""
    edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, dtype=np.int64)
    return [(int(keys[a]), int(a), int(z)) for a, z in zip(edges[:-1], edges[1:])]


def squeeze(values: np.ndarray) -> bytes:
    """An array as its compressed byte planes: small and slowly changing numbers take few bytes."""
    import zstandard

    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()) if len(values) else b""


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    if not data:
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending 64-bit values, which compress better; np.cumsum undoes it."""
    return np.diff(ascending, prepend=np.zeros(1, dtype=ascending.dtype))
