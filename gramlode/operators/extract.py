"""From samples to postings (ngram, fid)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.workers import reachable

#: Bytes of samples whose grams a task holds at a time.
PART_BYTES = 4 << 20
#: Share of the samples, and most postings of them, that say where the ranges of a sorted write begin.
BOUNDS_SHARE, BOUNDS_ROWS = 0.01, 200_000
_OUT = pa.schema([("ngram", pa.int64()), ("fid", pa.int64())])


def _keys(data: np.ndarray, omit_zero: bool) -> np.ndarray:
    """Distinct gram keys of one piece of a sample."""
    d = data.astype(np.uint32)
    keys = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]
    if omit_zero:
        zero = data == 0
        keys = keys[~(zero[:-3] | zero[1:-2] | zero[2:-1] | zero[3:])]
    return np.unique(keys)


def _extract(omit_zero: bool):
    def run(batches):
        for batch in batches:
            held: list[tuple[int, np.ndarray]] = []
            size = 0
            for fid, content in zip(batch.column("fid").to_pylist(), batch.column("content")):
                data = np.frombuffer(content.as_buffer() or b"", dtype=np.uint8)
                if len(data) < 4:  # too short for a gram
                    continue
                keys = np.zeros(0, dtype=np.uint32)
                for at in range(0, len(data) - 3, PART_BYTES):  # pieces overlap by three bytes
                    keys = np.union1d(keys, _keys(data[at : at + PART_BYTES + 3], omit_zero)) if len(data) > PART_BYTES else _keys(data, omit_zero)
                held.append((fid, keys))
                size += len(keys)
                if size > 1 << 19:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    return run


def _batch(held) -> pa.RecordBatch:
    keys = np.concatenate([k for _, k in held]).astype(np.int64)
    fids = np.repeat(np.array([f for f, _ in held], dtype=np.int64), [len(k) for _, k in held])
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fids)], schema=_OUT)


def postings(samples: DataFrame, omit_zero: bool = False) -> DataFrame:
    """(ngram, fid), once for each sample that has the gram. omit_zero leaves out grams with a zero byte."""
    spark = reachable(samples.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PART_BYTES))
    rows = samples.where(F.octet_length("content") >= 4).select("fid", "content")
    return rows.mapInArrow(_extract(omit_zero), "ngram long, fid long")


def grouped_postings(found: DataFrame, width: int) -> DataFrame:
    """(ngram, gid): file ids folded by a prime of the gram's last byte; ids that meet are one entry."""
    from gramlode.functions.encoding import build_primes

    primes = build_primes(width)
    table = F.array(*(F.lit(p).cast("long") for p in primes))
    p = F.get(table, F.col("ngram").bitwiseAND(F.lit(255)).cast("int") % F.lit(len(primes)))
    return found.select("ngram", F.pmod("fid", p).alias("gid")).distinct()


def bounds(samples: DataFrame, partitions: int, omit_zero: bool = False) -> list[tuple[int, int]]:
    """Where each but the first of `partitions` ranges of (ngram, fid) begins, from a bounded sample of the postings.

    The ranges only balance the tasks; what is in the postings doesn't depend on them.
    """
    some = postings(samples.sample(BOUNDS_SHARE, 1), omit_zero).limit(BOUNDS_ROWS)
    rows = sorted((r[0], r[1]) for r in some.collect())
    return sorted({rows[len(rows) * k // partitions] for k in range(1, partitions)}) if rows else [((k << 32) // partitions, 0) for k in range(1, partitions)]


def ranged_postings(samples: DataFrame, partitions: int, omit_zero: bool = False) -> DataFrame:
    """`postings` in ranges of (ngram, fid), a task each, with one extraction: a range partitioner would run it twice."""
    starts = bounds(samples, partitions, omit_zero)
    grams = np.array([g for g, _ in starts], dtype=np.int64)
    fids = np.array([f for _, f in starts], dtype=np.int64)

    def run(batches):
        for batch in batches:
            g, f = (batch.column(k).to_numpy() for k in range(2))
            low, high = np.searchsorted(grams, g, side="left"), np.searchsorted(grams, g, side="right")
            part = low.copy()
            for k in np.flatnonzero(high > low):  # a gram that begins a range: its ids decide
                part[k] = low[k] + np.searchsorted(fids[low[k] : high[k]], f[k], side="right")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part, pa.int32())], names=["ngram", "fid", "_part"])

    marked = postings(samples, omit_zero).mapInArrow(run, "ngram long, fid long, _part int")
    return marked.repartitionById(len(starts) + 1, F.col("_part")).drop("_part")
