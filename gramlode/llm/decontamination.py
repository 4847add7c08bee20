"""Benchmark decontamination with a broadcast set of normalised test n-grams.

A benchmark of up to `block_words` words is hashed on the driver and broadcast: one pass over the documents without a
shuffle, in which word windows are looked up by hash, every hit is verified on the words themselves, and covered
words are counted.

A larger benchmark stays a table of windows. Documents are filtered by a broadcast bitmap of window hashes of at most
MOST_BITS bits; the windows that pass are joined with the table on hash and words, and come back to their documents by
a 64-bit hash of the text.

Defined results: a null or wordless text has no words and no hits; an item without words has no
window; repeated rows are judged one by one; further columns pass through `decontaminate`
unchanged, except that a column named like one of RESULT is replaced.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, session, spread, stored, tidy
from .words import ALNUM_WORDS, Texts, Windows, slices, window_starts

WINDOW = 13
#: Words of benchmark items in one broadcast: about 40 MB with hashes and words.
BLOCK_WORDS = 500_000
#: Bits of the bitmap for a larger benchmark, 128 MB; 16 for each window as long as that is less.
MOST_BITS = 1 << 30
#: A document is contaminated if SHARE times its covered words are at least its words.
SHARE = 20
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_STATE = [T.StructField("_words", T.LongType()), T.StructField("_from", T.ArrayType(T.LongType())), T.StructField("_to", T.ArrayType(T.LongType())), T.StructField("_items", T.ArrayType(T.LongType()))]
RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"]


class Block:
    """Window hashes of some items by length, sorted, with the words and items of each window."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        texts = Texts(pa.array([t for _, t in items], pa.string()), ALNUM_WORDS, lower=True)
        by: dict[int, dict[int, dict[tuple, set]]] = {}
        windows = Windows(texts.hashes)
        for d, (item, _) in enumerate(items):
            a, b = int(texts.first[d]), int(texts.first[d + 1])
            length = min(window, b - a)
            if not length:
                continue
            hashes = windows.of(length)
            for i in range(a, b - length + 1):
                by.setdefault(length, {}).setdefault(int(hashes[i]), {}).setdefault(tuple(texts.words(i, i + length)), set()).add(item)
        self.lengths = {n: (np.array(sorted(found), dtype=np.uint64), {h: [(w, sorted(s)) for w, s in x.items()] for h, x in found.items()}) for n, found in by.items()}


def _windows(window: int):
    """(item, length, hash, words) of the windows of benchmark items."""

    def run(batches):
        for batch in slices(batches, "text"):
            texts = Texts(batch.column("text"), ALNUM_WORDS, lower=True)
            windows, rows = Windows(texts.hashes), []
            for d, item in enumerate(batch.column("item_id").to_pylist()):
                a, z = int(texts.first[d]), int(texts.first[d + 1])
                length = min(window, z - a)
                if length:
                    hashes = windows.of(length)[a : z - length + 1].view(np.int64).tolist()
                    rows += [(item, length, h, b" ".join(texts.words(i, i + length))) for i, h in zip(range(a, z), hashes)]
            columns = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["item", "length", "hash", "words"])

    return run


def _bitmap(bits: int):
    def run(batches):
        out = np.zeros(1 << bits - 3, dtype=np.uint8)
        for batch in batches:
            _set(out, bits, batch.column("hash").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    return run


def _set(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> None:
    at = hashes >> np.uint64(64 - bits)
    np.bitwise_or.at(bitmap, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _pass_filter(shared, bits: int, lengths: list[int]):
    """(key, length, start, hash, words) of the windows of documents that the bitmap lets pass."""

    def run(batches):
        bitmap = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in slices(batches, "text"):
            texts = Texts(batch.column("text"), ALNUM_WORDS, lower=True)
            windows, keys, rows = Windows(texts.hashes), batch.column("_key").to_pylist(), []
            for length in lengths:
                at = window_starts(texts.first, length)
                hashes = windows.of(length)[at]
                slot = hashes >> np.uint64(64 - bits)
                found = (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                doc = np.searchsorted(texts.first, at[found], side="right") - 1
                rows += [(keys[d], length, i - int(texts.first[d]), h, b" ".join(texts.words(i, i + length))) for d, i, h in zip(doc.tolist(), at[found].tolist(), hashes[found].view(np.int64).tolist())]
            columns = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["_key", "length", "start", "hash", "words"])

    return run


def _count_words(text: str):
    def run(batches):
        for batch in slices(batches, text):
            texts = Texts(batch.column(text), ALNUM_WORDS, lower=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts.n_words, pa.int64())], names=[*batch.schema.names, "_words"])

    return run


def _joined(docs: DataFrame, benchmark: DataFrame, text: str, window: int) -> DataFrame:
    """`docs` with _from, _to, _items and _words, for a benchmark that is too large to broadcast."""
    spark = docs.sparkSession
    table = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(tidy(_windows(window)), "item long, length int, hash long, words binary"), "benchmark-windows")
    lengths = sorted(r[0] for r in table.select("length").distinct().collect())  # at most `window` of them
    bits = min(MOST_BITS.bit_length() - 1, max(16, (16 * table.count() - 1).bit_length()))
    whole = np.zeros(1 << bits - 3, dtype=np.uint8)
    for r in table.coalesce(16).mapInArrow(tidy(_bitmap(bits)), "bits binary").toLocalIterator():  # one bitmap at a time
        whole |= np.frombuffer(r["bits"], dtype=np.uint8)
    shared = spark.sparkContext.broadcast(whole.tobytes())
    texts = docs.select(F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("text"))
    found = texts.mapInArrow(tidy(_pass_filter(shared, bits, lengths)), "_key long, length int, start long, hash long, words binary").distinct()
    hits = spread(found, table.groupBy("length", "hash", "words").agg(F.collect_set("item").alias("items")).withColumnRenamed("length", "_length").withColumnRenamed("words", "_window"), "hash", "_key")
    hits = hits.where((F.col("length") == F.col("_length")) & (F.col("words") == F.col("_window")))
    one = hits.groupBy("_key").agg(F.collect_list("start").alias("_from"), F.collect_list(F.col("start") + F.col("length")).alias("_to"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items"))
    one = stored(one.join(texts.groupBy("_key").agg(F.count("*").alias("_copies")), "_key"), "benchmark-hits")
    none = F.array().cast("array<long>")
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.xxhash64(F.col(text)).alias("_key"))
    joined = lookup(packed, one, "_key", "_copies").select("_doc.*", *(F.coalesce(c, none).alias(c) for c in ("_from", "_to", "_items")))
    fields = [*docs.schema.fields, *_STATE[1:], _STATE[0]]
    return joined.mapInArrow(tidy(_count_words(text)), T.StructType(fields))


def _pass(block, text: str):
    def run(batches):
        by = block.value.lengths
        for batch in slices(batches, text):
            texts = Texts(batch.column(text), ALNUM_WORDS, lower=True)
            windows, hits = Windows(texts.hashes), []
            for length, (keys, known) in by.items():
                hashes = windows.of(length)
                at = window_starts(texts.first, length)
                found = hashes[at]
                place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                for i in at[keys[place] == found].tolist():
                    words = tuple(texts.words(i, i + length))
                    for of, items in known[int(hashes[i])]:
                        if of == words:
                            hits.append((i, length, items))
            hits.sort(key=lambda x: x[0])
            doc = np.searchsorted(texts.first, [h[0] for h in hits], side="right") - 1 if hits else []
            starts, ends, items = ([[] for _ in range(len(batch))] for _ in range(3))
            held = [set() for _ in range(len(batch))]
            for (i, length, of), d in zip(hits, doc):
                i -= int(texts.first[d])
                if ends[d] and i <= ends[d][-1]:
                    ends[d][-1] = max(ends[d][-1], i + length)
                else:
                    starts[d].append(i)
                    ends[d].append(i + length)
                held[d].update(of)
            items = [sorted(x) for x in held]
            arrays = [pa.array(texts.n_words, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (starts, ends, items))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "_words", "_from", "_to", "_items"])

    return run


def _digest(batches):
    """Merge the spans and sum them up."""
    for batch in batches:
        spans, n_hit, n_items, sha = [], [], [], []
        for a, b, items in zip(*(batch.column(c).to_pylist() for c in ("_from", "_to", "_items"))):
            merged: list[dict] = []
            for s, e in sorted(zip(a, b)):
                if merged and s <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], e)
                else:
                    merged.append({"start": s, "end": e})
            names = sorted(map(str, set(items)))
            spans.append(merged)
            n_hit.append(sum(x["end"] - x["start"] for x in merged))
            n_items.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        keep = [n for n in batch.schema.names if n not in ("_words", "_from", "_to", "_items")]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in keep), batch.column("_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 and SHARE * h >= w for h, w in zip(n_hit, batch.column("_words").to_pylist())], pa.bool_()), pa.array(spans, span)],
            names=[*keep, *RESULT],
        )


def judge(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with RESULT: hit_spans are ranges of normalised words covered by benchmark windows."""
    spark = session(docs.sparkSession)
    out = docs.drop(*(c for c in docs.columns if c in RESULT))
    plain = list(out.schema.fields)
    size = benchmark.agg(F.coalesce(F.sum(F.floor(F.length("text") / 2) + 1), F.lit(0))).first()[0]
    if size <= block_words:
        items = [(r[0], r[1]) for r in benchmark.select("item_id", "text").collect()]  # at most block_words words
        block = spark.sparkContext.broadcast(Block(items, window))
        out = out.mapInArrow(tidy(_pass(block, text)), T.StructType(plain + _STATE))
    else:
        out = _joined(out, benchmark, text, window)
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType(), SPAN)
    return out.select(*(f.name for f in plain), *(f.name for f in _STATE)).mapInArrow(tidy(_digest), T.StructType(plain + [T.StructField(n, k) for n, k in zip(RESULT, kinds)]))


def _cut(batches):
    """Texts without the source ranges from the first to the last character of each hit span."""
    for batch in slices(batches, "text"):
        texts, out = Texts(batch.column("text"), ALNUM_WORDS, lower=True), []
        for d, (whole, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("hit_spans").to_pylist())):
            if spans:
                raw, at, parts, base = whole.encode(), 0, [], int(texts.offsets[d])
                for s in spans:
                    parts.append(raw[at : int(texts.starts[texts.first[d] + s["start"]]) - base])
                    at = int(texts.ends[texts.first[d] + s["end"] - 1]) - base
                whole = b"".join([*parts, raw[at:]]).decode()
            out.append(whole)
        k = batch.schema.get_field_index("text")
        yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """Remove contaminated documents, or ("spans") only the covered text of every document."""
    found = judge(docs, benchmark)
    if remove == "spans":
        found = found.mapInArrow(tidy(_cut), found.schema)
    elif remove == "documents":
        found = found.where(~F.col("contaminated"))
    else:
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    return found.select(*docs.columns) if not set(docs.columns) & set(RESULT) else found.drop("hit_spans")
