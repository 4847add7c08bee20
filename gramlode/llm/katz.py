"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights, any order.

A token's probability after its context h of k - 1 tokens, with h' the context without its first token, is

    p(w | h) = d_k(r) r / c(h)       for an n-gram seen r > 0 times
             = alpha(h) p(w | h')    else, if h was seen
             = p(w | h')             for a context that was never seen

down to p(w) = (c + 0.5) / (N + 0.5 (V + 1)), which leaves 0.5 for all unknown words together. d_k(r) is the Katz
discount from the counts of counts of order k for r <= CUTOFF and 1 above, and alpha(h) such that the sum over
all words and the unknown one is 1. A context without discounted mass gets one more count in its denominator.
A context reaches back to the start of its text and no further.

The model is two tables in the shared folder, written once and read by `Model.score` for other documents: words by
hash bucket, and n-grams by shard of the word before the last, so that all contexts that a token backs off through
are in one shard and the recursion needs no further exchange. The corpus is never gathered:

1. `_send`: each slice of texts sends its distinct words with training counts to buckets of their hash and keeps
   its token sequence. `_count` adds up, numbers the words by falling count and answers; `_states` keeps a slice.
2. `_ask`: each slice sends its distinct n-grams, as word numbers with training counts, to their shards. `_gather`
   writes the shard's n-gram table, and where in it each slice's n-grams are.
3. `_answer` computes every probability of a shard by the recursion above; `_sum` adds them up by document.

A word with HOT_TOKENS tokens or more is split: its n-grams go to shards by the two words before the last, and
their counts as bigrams are added up over the shards (`_hot_bigrams`).

Words are told apart by 64-bit hashes (V distinct words collide with a chance of V^2 / 2^65), n-grams exactly.

Defined results: a null or empty text is the end token alone; a null id counts as training; repeated rows are
counted each time; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, stored, tidy
from .exchange import bucket_bits, dealt, grouped, ranges, squeeze, steps, unsqueeze
from .words import SPACE_WORDS, Texts, mix, slices

ORDER = 3
CUTOFF = 5
#: Training tokens of a word from which on its n-grams are split over shards.
HOT_TOKENS = 2_000_000
SLICE_BYTES = 6 << 20
SHARD_BYTES = 16 << 20
FOLDS, HELD_OUT = 5, 1
END = np.uint64(0x2545F4914F6CDD1D)
#: Numbers of no word (before the start), of the start, of all words that training has not seen; then the words.
NONE, START, UNKNOWN, FIRST = 0, 1, 2, 3
#: Hot contexts whose sums are broadcast; more of them are joined by a shuffle.
MOST_BROADCAST = 100_000

_ROW = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("stats", pa.list_(pa.int64()))])
_DDL = "bucket long, slice long, a binary, b binary, c binary, stats array<long>"


def _batch(rows, schema=_ROW):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, compressed one by one."""
    parts = [squeeze(a.astype("<i8")) for a in arrays]
    return np.array([len(parts), *map(len, parts)], "<i4").tobytes() + b"".join(parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i4", 1)[0])
    ends = 4 + 4 * n + np.cumsum([0, *np.frombuffer(data, "<i4", n, 4)])
    return [unsqueeze(data[a:z], "<i8") for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]


def held_out(ids: list) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids], dtype=bool)


def tokens_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end after each text, first token of each text)."""
    n = len(texts.n_words)
    first = texts.first + np.arange(n + 1)
    out = np.full(int(first[-1]), END, dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[first[1:] - 1] = False
    out[inside] = texts.hashes
    return out, first


def _send(bits: int, learn: bool):
    """Words of a slice by bucket of their hash; a negative bucket keeps its tokens and documents."""

    def run(batches):
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, -1
        for batch in slices(batches, "text", SLICE_BYTES):
            k += 1
            ids = batch.column("doc_id")
            held = held_out(ids.to_pylist())
            train = ~held & learn
            tokens, first = tokens_of(Texts(batch.column("text"), SPACE_WORDS, lower=True))
            words, at = np.unique(tokens, return_inverse=True)
            counts = np.bincount(at, weights=np.repeat(train, np.diff(first)), minlength=len(words)).astype(np.int64)
            meta = _pack(first, held, train, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))
            rows = [(-1 - base - k, base + k, squeeze(at.astype("<u4")), meta, b"", [int(train.sum())])]
            rows += [(b, base + k, _pack(steps(words[i:j]).view(np.int64), counts[i:j]), b"", b"", []) for b, i, j in ranges(words >> np.uint64(64 - bits))]
            yield _batch(rows)

    return run


def _count(bits: int, hot_tokens: int):
    """Numbers and counts of words back to their slices; per bucket a row of slice -1 with its table and N, V, words and tokens that are hot."""

    def run(batches):
        for bucket, rows in grouped(batches, "bucket"):
            if bucket < 0:
                for r in rows:
                    yield _batch([tuple(r.values())])
                continue
            parts = [_unpack(r["a"]) for r in rows]
            keys = [np.cumsum(p[0].view(np.uint64), dtype=np.uint64) for p in parts]
            words, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(words), dtype=np.int64)
            np.add.at(total, at, np.concatenate([p[1] for p in parts]))
            number = np.empty(len(words), dtype=np.int64)
            number[np.argsort(-total, kind="stable")] = np.arange(len(words), dtype=np.int64) * (1 << bits) + bucket + FIRST
            known, hot = total > 0, total >= hot_tokens
            number[~known] = UNKNOWN
            out = [(bucket, -1, _pack(steps(words[known]).view(np.int64), total[known]), b"", b"", [int(total.sum()), int(known.sum()), int(hot.sum()), int(total[hot].sum())])]
            k = 0
            for r, x in zip(rows, keys):
                mine = at[k : k + len(x)]
                k += len(x)
                if r["slice"] >= 0:
                    out.append((bucket, r["slice"], _pack(number[mine], total[mine]), b"", b"", []))
            yield _batch(out)

    return run


def _states(batches):
    """One row per slice: its tokens, documents, and its words' numbers and counts. Slice -1: the rows of `_count`."""
    for s, rows in grouped(batches, "slice"):
        if s < 0:
            yield _batch([tuple(r.values()) for r in rows])
            continue
        own = next(r for r in rows if r["bucket"] < 0)
        answers = [_unpack(r["a"]) for r in sorted(rows, key=lambda r: r["bucket"]) if r["bucket"] >= 0]
        yield _batch([(-1, s, own["a"], own["b"], _pack(*map(np.concatenate, zip(*answers))), own["stats"])])


def discounts(n: list[int]) -> np.ndarray:
    """d(0) to d(CUTOFF), from the number of n-grams seen 1, 2, ... CUTOFF + 1 times; 1 where an estimate is not in (0, 1)."""
    out = np.ones(CUTOFF + 1)
    if n[0] and n[CUTOFF]:
        common = (CUTOFF + 1) * n[CUTOFF] / n[0]
        for r in range(1, CUTOFF + 1):
            if n[r - 1] and common != 1:
                d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
                out[r] = d if 0 < d < 1 else 1.0
    return out


@dataclass
class Constants:
    """Totals of the training tokens, documents, hot words and their tokens, and the discounts of orders 2, 3, ..."""

    n: int
    v: int
    documents: int
    bits: int
    order: int
    hot_tokens: int
    hot_shards: int
    hot_words: int
    d: list[np.ndarray] = field(default_factory=list)

    @property
    def total(self) -> float:
        return self.n + 0.5 * (self.v + 1)

    def p(self, c):
        return (c + 0.5) / self.total


def weight(mass, lower, total):
    """(denominator, alpha) of contexts: the discounted mass, the lower-order mass of seen words, the count."""
    denominator = np.where(mass < total * (1 - 1e-12), total, total + 1.0)
    left = np.where(total > 0, 1 - mass / np.maximum(denominator, 1), 1.0)
    return denominator, left / np.where(total > 0, 1 - lower, 1.0)


class Entries:
    """Distinct n-grams of a slice by shard, and for each token its n-gram (-1: nothing before it is known)."""

    def __init__(self, r: dict, const: Constants):
        at = unsqueeze(r["a"], "<u4")
        self.first, held, train, self.ids, nulls = _unpack(r["b"])
        self.held, self.nulls, train = held.astype(bool), nulls.astype(bool), train.astype(bool)
        numbers, counts = _unpack(r["c"])
        self.counts = counts[at]
        # the slice's numbers in ascending order stand for the words: few bits, and sorted alike everywhere
        known, place = np.unique(np.concatenate([[NONE, START, UNKNOWN], numbers]), return_inverse=True)
        token = place[3:][at]
        total = np.zeros(len(known), dtype=np.int64)
        total[place[3:]] = np.where(numbers == UNKNOWN, 0, counts)
        total[START] = const.documents
        n = len(token)
        since = np.arange(n) - np.repeat(self.first[:-1], np.diff(self.first))
        history = []
        for k in range(1, const.order):
            h = np.full(n, NONE, dtype=np.int64)
            h[k:] = token[: n - k]
            h[since < k] = NONE
            h[since == k - 1] = START
            if history:  # beyond an unknown word nothing is known
                h[(history[-1] == NONE) | (history[-1] == START) | (h == UNKNOWN)] = NONE
            history.append(h)
        sent = history[0] != UNKNOWN
        self.of_token = np.full(n, -1, dtype=np.int64)
        key, span = np.zeros(int(sent.sum()), dtype=np.int64), 1
        for x in (*history, token):
            if span >= (1 << 62) // len(known):
                key, span = np.unique(key, return_inverse=True)[1], len(key)
            key, span = key * len(known) + x[sent], span * len(known)
        _, lead, self.of_token[sent] = np.unique(key, return_index=True, return_inverse=True)
        lead = np.flatnonzero(sent)[lead]
        times = np.bincount(self.of_token[sent], weights=np.repeat(train, np.diff(self.first))[sent], minlength=len(lead)).astype(np.int64)
        # two columns of words before the last always, so that hot words can be split
        self.h, self.w, self.times, self.c1 = [known[h[lead]] for h in history], known[token[lead]], times, total[token[lead]]
        near = mix(self.h[0].astype(np.uint64))
        self.shard = (near >> np.uint64(64 - const.bits)).astype(np.int64)
        if const.hot_shards:
            hot = total[history[0][lead]] >= const.hot_tokens
            further = self.h[1] if len(self.h) > 1 else np.zeros_like(self.w)
            second = np.where(further == NONE, self.w, further).astype(np.uint64)
            salted = mix(near + second * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(const.hot_shards)
            self.shard = np.where(hot, (1 << const.bits) + salted.astype(np.int64), self.shard)
        self.order = np.argsort(self.shard, kind="stable")
        self.ranges = ranges(self.shard[self.order])


def pack_entries(h: list[np.ndarray], w: np.ndarray, c1: np.ndarray, times: np.ndarray) -> bytes:
    """n-grams in ascending order: words before the last (nearest first), last word with its count, training count."""
    words, lead, at = np.unique(w, return_index=True, return_inverse=True)
    return _pack(np.diff(words, prepend=0), np.diff(c1[lead], prepend=0), at, times, *(np.diff(x, prepend=0) for x in h))


def unpack_entries(data: bytes):
    words, c1, at, times, *h = _unpack(data)
    return [np.cumsum(x) for x in h], np.cumsum(words)[at], np.cumsum(c1)[at], times


def _ask(const: Constants):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                e = Entries(r, const)
                rows = []
                for b, i, j in e.ranges:
                    mine = e.order[i:j]
                    rows.append((b, r["slice"], pack_entries([h[mine] for h in e.h], e.w[mine], e.c1[mine], e.times[mine]), b"", b"", []))
                yield _batch(rows)

    return run


def _levels(h: list[np.ndarray], w: np.ndarray):
    """For orders 2, 3, ...: (order, context of each entry, its n-gram, a first entry of each n-gram, takes part) of sorted entries."""
    w = np.unique(w, return_inverse=True)[1]
    size = int(w.max()) + 1 if len(w) else 1
    fresh = np.zeros(len(w), dtype=bool)
    fresh[:1] = True
    for k, x in enumerate(h):
        fresh[1:] |= x[1:] != x[:-1]
        context = np.cumsum(fresh) - 1
        _, lead, pair = np.unique(context * size + w, return_index=True, return_inverse=True)
        yield k + 2, context, pair, lead, x != NONE


_SHARD = pa.schema([("bucket", pa.int64()), ("grams", pa.binary()), ("stats", pa.list_(pa.int64())), ("slices", pa.list_(pa.int64())), ("places", pa.list_(pa.binary())), ("hot", pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64()), ("c1", pa.int64()), ("r", pa.int64())])))])
_SHARD_DDL = "bucket long, grams binary, stats array<long>, slices array<long>, places array<binary>, hot array<struct<h long, w long, c1 long, r long>>"


def _one_list(kind: pa.ListType, columns: list[np.ndarray]) -> pa.ListArray:
    """One row with a list of structs, from their columns."""
    fields = [kind.value_type.field(k) for k in range(kind.value_type.num_fields)]
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kind)


def _gather(const: Constants):
    """One row per shard: its n-grams with their training counts, counts of counts by order, places of each slice's n-grams."""

    def run(batches):
        for bucket, rows in grouped(batches, "bucket"):
            parts = [unpack_entries(r["a"]) for r in rows]
            sizes = [len(p[1]) for p in parts]
            h = [np.concatenate([p[0][k] for p in parts]) for k in range(const.order - 1)]
            w, c1, times = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
            del parts
            order = np.lexsort((w, *reversed(h)))
            fresh = np.ones(len(w), dtype=bool)
            fresh[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in (w, *h)])
            place = np.empty(len(w), dtype=np.int64)
            place[order] = np.cumsum(fresh) - 1
            lead = order[fresh]
            r = np.zeros(len(lead), dtype=np.int64)
            np.add.at(r, place, times)
            h, w, c1 = [x[lead] for x in h], w[lead], c1[lead]
            is_hot = bucket >= 1 << const.bits
            stats, hot = [], []
            for k, _, pair, first, part in _levels(h, w):
                seen = np.bincount(pair, weights=r, minlength=len(first)).astype(np.int64)
                if k == 2 and is_hot:  # only a part of their bigrams' counts
                    hot = [h[0][first], w[first], c1[first], seen]
                    seen = seen[:0]
                else:
                    seen = seen[part[first]]
                stats += np.bincount(np.minimum(seen, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist()
            places, k = [], 0
            for n in sizes:
                places.append(squeeze(np.diff(place[k : k + n], prepend=0).astype("<i4")))
                k += n
            asked = [(x["slice"], p) for x, p in zip(rows, places) if x["slice"] >= 0]
            plain = _batch([(bucket, pack_entries(h, w, c1, r), stats, [s for s, _ in asked], [p for _, p in asked], [])], _SHARD)
            yield plain.set_column(5, _SHARD.field(5), _one_list(_SHARD.field(5).type, hot)) if hot else plain

    return run


def probabilities(h: list[np.ndarray], w: np.ndarray, c1: np.ndarray, r: np.ndarray, const: Constants, bigrams: np.ndarray | None = None) -> np.ndarray:
    """p(w | h) of the sorted distinct n-grams of a shard; `bigrams` gives those of order 2 where the shard has only a part of them."""
    p = const.p(c1)
    for k, context, pair, lead, part in _levels(h, w):
        if k == 2 and bigrams is not None:
            p = bigrams[pair]
            continue
        seen = np.bincount(pair, weights=r, minlength=len(lead)).astype(np.int64)
        of, d = context[lead], const.d[k - 2]
        discounted = np.where(seen <= CUTOFF, d[np.minimum(seen, CUTOFF)], 1.0) * seen
        mass, total = np.bincount(of, weights=discounted), np.bincount(of, weights=seen)
        denominator, alpha = weight(mass, np.bincount(of, weights=np.where(seen > 0, p[lead], 0.0)), total)
        value = np.where(seen > 0, discounted / denominator[of], np.where(total[of] > 0, alpha[of], 1.0) * p[lead])
        p = np.where(part, value[pair], p)
    return p


def _answer(const: Constants):
    """For each slice the log10 probabilities of its n-grams: distinct values, and which of them."""

    def run(batches):
        for batch in batches:
            for k, row in enumerate(batch.drop_columns(["bigrams"]).to_pylist()):
                h, w, c1, r = unpack_entries(row["grams"])
                bigrams, found = None, batch.column("bigrams")[k]
                if found.is_valid:
                    # by context and word, as `_levels` orders them
                    hs, ws, ps = (found.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                    bigrams = ps[np.lexsort((ws, hs))]
                value = np.log10(probabilities(h, w, c1, r, const, bigrams))
                for s, places in zip(row["slices"], row["places"]):
                    distinct, at = np.unique(value[np.cumsum(unsqueeze(places, "<i4"), dtype=np.int64)], return_inverse=True)
                    yield _batch([(row["bucket"], s, squeeze(distinct.astype("<f8")), squeeze(at.astype("<u4")), b"", [])])

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_OUT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sum(const: Constants):
    def run(batches):
        for _, rows in grouped(batches, "slice"):
            e = Entries(next(r for r in rows if r["bucket"] < 0), const)
            answers = {r["bucket"]: r for r in rows if r["bucket"] >= 0}
            value = np.empty(len(e.w) + 1)
            for b, i, j in e.ranges:
                value[e.order[i:j]] = unsqueeze(answers[b]["a"], "<f8")[unsqueeze(answers[b]["b"], "<u4")]
            plain = np.log10(const.p(e.counts))
            score = np.where(e.of_token < 0, plain, value[e.of_token])
            doc = np.repeat(np.arange(len(e.ids)), np.diff(e.first))
            add = lambda x: np.bincount(doc, weights=x, minlength=len(e.ids))  # noqa: B023, E731
            columns = [pa.array(e.ids, mask=e.nulls), e.held, np.diff(e.first), add(e.counts > 0).astype(np.int64), np.full(len(e.ids), const.n), add(plain), add(score)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT.types)], schema=_OUT)

    return run


def _hot_bigrams(shards: DataFrame, const: Constants) -> tuple[DataFrame, list[int]]:
    """(h, w, c1, r) of the bigrams after hot words, added up over their shards; their counts of counts."""
    rows = shards.where(F.size("hot") > 0).select(F.explode("hot").alias("x")).select("x.*")
    found = stored(rows.groupBy("h", "w").agg(F.max("c1").alias("c1"), F.sum("r").alias("r")), "hot-bigrams")
    counts = dict(found.where(F.col("r").between(1, CUTOFF + 1)).groupBy("r").count().collect())  # at most CUTOFF + 1 rows
    return found, [counts.get(r, 0) for r in range(1, CUTOFF + 2)]


def _with_bigrams(shards: DataFrame, found: DataFrame | None, const: Constants) -> DataFrame:
    """`shards` with the order-2 probabilities of those that have only a part of their bigrams' counts."""
    none = F.lit(None).cast("array<struct<h: long, w: long, p: double>>").alias("bigrams")
    if found is None:
        return shards.select("bucket", "grams", "slices", "places", none)
    low = (F.col("c1") + 0.5) / F.lit(const.total)
    d = F.element_at(F.array(*(F.lit(float(x)) for x in const.d[0])), F.least("r", F.lit(CUTOFF)).cast("int") + 1)
    discounted = F.when(F.col("r") <= CUTOFF, d).otherwise(F.lit(1.0)) * F.col("r")
    rows = found.select("h", "w", "r", low.alias("low"), discounted.alias("discounted"))
    sums = rows.groupBy("h").agg(F.sum("discounted").alias("mass"), F.sum(F.when(F.col("r") > 0, F.col("low")).otherwise(0.0)).alias("lower"), F.sum("r").alias("total"))
    denominator = F.when(F.col("mass") < F.col("total") * (1 - 1e-12), F.col("total")).otherwise(F.col("total") + 1)
    sums = sums.where("total > 0").select("h", denominator.alias("denominator"), ((1 - F.col("mass") / denominator) / (1 - F.col("lower"))).alias("alpha"))
    sums = F.broadcast(sums) if const.hot_words <= MOST_BROADCAST else sums
    value = F.when(F.col("r") > 0, F.col("discounted") / F.col("denominator")).otherwise(F.coalesce("alpha", F.lit(1.0)) * F.col("low"))
    value = rows.join(sums, "h", "left").select("h", "w", value.alias("p"))
    parts = shards.where(F.size("hot") > 0)
    asked = parts.select("bucket", F.explode("hot").alias("x")).select("bucket", "x.h", "x.w").join(value, ["h", "w"])
    back = asked.groupBy("bucket").agg(F.collect_list(F.struct("h", "w", "p")).alias("bigrams"))  # no more than the shard has
    plain = shards.where(F.size("hot") == 0).select("bucket", "grams", "slices", "places", none)
    return plain.unionByName(parts.join(back, "bucket").select("bucket", "grams", "slices", "places", "bigrams"))


@dataclass
class Model:
    """A trained model: `words` (by bucket) and `grams` (by shard) are tables in the shared folder."""

    const: Constants
    words: DataFrame
    grams: DataFrame

    def score(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The columns of `score` for other documents; nothing is learned from them, whatever their ids."""
        return _run(docs, key, text, self.const.order, self)[0]


def _run(docs: DataFrame, key: str, text: str, order: int, model: Model | None) -> tuple[DataFrame, Model]:
    if order < 2:
        raise ValueError("order must be 2 or more")
    session(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bits = model.const.bits if model else bucket_bits(docs, per=SHARD_BYTES, least=3)
    sent = docs.mapInArrow(tidy(_send(bits, model is None)), _DDL)
    if model:
        sent = sent.unionByName(model.words)
    counted = dealt(sent, "bucket").mapInArrow(tidy(_count(bits, HOT_TOKENS)), _DDL)
    # the rows of the words' table are spread over the tasks by their bucket
    counted = counted.withColumn("_task", F.when(F.col("slice") < 0, F.col("bucket")).otherwise(F.col("slice")))
    kept = stored(counted.repartition("_task").sortWithinPartitions("slice", "bucket").drop("_task").mapInArrow(tidy(_states), _DDL), "katz-slices")
    words, states = kept.where("slice < 0"), kept.where("slice >= 0")
    if model:
        const = model.const
    else:
        n, v, hot_words, hot = (x or 0 for x in words.agg(*(F.sum(F.get("stats", F.lit(k))) for k in range(4))).first())
        documents = states.agg(F.sum(F.get("stats", F.lit(0)))).first()[0] or 0
        hot += documents if documents >= HOT_TOKENS else 0
        const = Constants(n, v, documents, bits, order, HOT_TOKENS, -(-hot * (1 << bits) // max(n, 1)), hot_words + 1)
    asked = states.mapInArrow(tidy(_ask(const)), _DDL)
    if model:
        asked = asked.unionByName(model.grams)
    shards = stored(dealt(asked, "bucket").mapInArrow(tidy(_gather(const)), _SHARD_DDL), "katz-shards")
    found, hot_counts = _hot_bigrams(shards, const) if const.hot_shards else (None, [0] * (CUTOFF + 1))
    if not model:
        k = CUTOFF + 1
        sums = [x or 0 for x in shards.agg(*(F.sum(F.get("stats", F.lit(i))) for i in range(k * (order - 1)))).first()]
        sums[:k] = [a + b for a, b in zip(sums[:k], hot_counts)]
        const.d = [discounts(sums[i : i + k]) for i in range(0, len(sums), k)]
    answers = _with_bigrams(shards, found, const).mapInArrow(tidy(_answer(const)), _DDL)
    out = dealt(answers.unionByName(states), "slice", "bucket").mapInArrow(tidy(_sum(const)), _OUT_DDL)
    empty, no = F.lit(b""), F.array().cast("array<long>")
    grams = shards.select("bucket", F.lit(-1).cast("long").alias("slice"), F.col("grams").alias("a"), empty.alias("b"), empty.alias("c"), no.alias("stats"))
    return out, model or Model(const, words, grams)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> Model:
    """The model of the training documents of `docs`."""
    return _run(docs, key, text, order, None)[1]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10."""
    return _run(docs, key, text, order, None)[0]
