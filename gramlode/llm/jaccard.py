"""N-gram Jaccard self-join with adaptive multi-match prefixes.

1. Every text becomes its set of 5-word shingles, as 64-bit hashes. Shingles travel to buckets of their
   hash, where their document frequency (over different sets) is counted; what is shared by two sets
   or more comes back. Equal sets meet in the same way and are one class, represented by its smallest id.
2. Shingles are ordered by frequency. Sets with a Jaccard similarity of 0.75 share one of the first
   n - ceil(0.75 n) + 1 shingles, and with a prefix longer by k shingles they share k + 1. A set whose prefix
   has no shared shingle is linked with no other text. For the others, the prefix is lengthened up to
   MAX_MATCHES as long as the estimated cost of scanning and verifying its candidates falls.
3. Candidates with the required number of matches are verified on the whole sets (`linkage.link`). The
   leader of a bucket is the set with the fewest shingles of its own, as the original of many near copies is.

Defined results: null, empty and wordless texts have no shingles and form components of their own; a
row with a null id links with nothing and has a null component; repeated rows are one class; other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linkage
from .common import discard, lookup, session, spread, stored, tidy
from .exchange import bucket_count, bucket_of, dealt, grouped, ranges
from .words import SPACE_WORDS, Texts, Windows, mix, slices, window_starts

WORDS = 5
#: Similarity as a fraction of integers: 75 / 100.
NUM, DEN = 75, 100
MAX_MATCHES = 4
#: Verifying a candidate costs about as much as scanning this many list entries.
VERIFY_COST = 20
SLICE_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20


def shingles(texts: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each text, sorted by both."""
    at = window_starts(texts.first, words)
    values = Windows(texts.hashes).of(words)[at] if len(at) else np.zeros(0, dtype=np.uint64)
    docs = np.searchsorted(texts.first, at, side="right") - 1
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < words))
    if len(short):
        whole = [int(Windows(texts.hashes[texts.first[d] : texts.first[d + 1]]).of(int(texts.n_words[d]))[0]) for d in short]
        values, docs = np.concatenate([values, np.array(whole, dtype=np.uint64)]), np.concatenate([docs, short])
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    return docs[fresh], values[fresh]


def signatures(docs: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each document's set; 0 for an empty one."""
    out = np.zeros(n, dtype=np.uint64)
    np.add.at(out, docs, mix(values * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)))
    sizes = np.bincount(docs, minlength=n)
    return np.where(sizes > 0, mix(out + sizes.astype(np.uint64)) | np.uint64(1), np.uint64(0))


_ROW = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("counts", pa.binary()), ("sigs", pa.binary()), ("tokens", pa.binary())])


def _send(buckets: int, key: str, text: str):
    """Rows (bucket, slice, ...): shingles and set signatures of a slice by bucket; a negative bucket keeps the slice's ids."""

    def run(batches):
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, -1
        for batch in slices(batches, text, SLICE_BYTES):
            k += 1
            ids, nulls = batch.column(key).fill_null(0).to_numpy(zero_copy_only=False), batch.column(key).is_null().to_numpy(zero_copy_only=False)
            texts = Texts(batch.column(text), SPACE_WORDS, lower=True)
            docs, values = shingles(texts)
            sigs, sizes = signatures(docs, values, len(ids)), np.bincount(docs, minlength=len(ids))
            sigs[nulls] = 0
            meta = np.stack([ids.astype("<i8"), sigs.view("<i8"), sizes.astype("<i8"), nulls.astype("<i8")])
            rows = [(-1 - base - k, base + k, b"", b"", meta.tobytes())]
            # equal sets of the slice travel once, as the row of the smallest id
            order = np.lexsort((ids, sigs))
            once = order[(sigs[order] != 0) & np.concatenate([[True], sigs[order][1:] != sigs[order][:-1]])[: len(order)]]
            sent = np.zeros(len(ids), dtype=bool)
            sent[once] = True
            mine = sent[docs]
            docs, values = docs[mine], values[mine]
            bucket = bucket_of(values, buckets)
            order = np.lexsort((docs, bucket))
            docs, values, bucket = docs[order], values[order], bucket[order]
            of_sig = bucket_of(sigs[once], buckets)
            once, of_sig = once[np.argsort(of_sig, kind="stable")], np.sort(of_sig)
            spans, of_sigs = {b: (a, z) for b, a, z in ranges(bucket)}, {b: (a, z) for b, a, z in ranges(of_sig)}
            for b in sorted({*spans, *of_sigs}):
                a, z = spans.get(b, (0, 0))
                own, counts = np.unique(docs[a:z], return_counts=True)
                s = once[slice(*of_sigs.get(b, (0, 0)))]
                wide = "<u2" if len(ids) <= 1 << 16 and (not len(counts) or counts.max() < 1 << 16) else "<u4"
                head = np.array([len(own), len(s), int(wide[2])], dtype="<i4").tobytes()
                rows.append((b, base + k, head + own.astype(wide).tobytes() + counts.astype(wide).tobytes(), s.astype("<i4").tobytes() + sigs[s].astype("<u8").tobytes() + ids[s].astype("<i8").tobytes() + sigs[own].astype("<u8").tobytes(), values[a:z].astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW.types)], schema=_ROW)

    return run


def _count(buckets: int):
    """Per bucket: shingles that two sets or more have, with their frequency, and the smallest id of each set."""

    def run(batches):
        for bucket, rows in grouped(batches, "bucket"):
            if bucket < 0:
                out = [(bucket, r["slice"], b"", b"", r["tokens"]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ROW.types)], schema=_ROW)
                continue
            parts = []
            for r in rows:
                n, m, wide = np.frombuffer(r["counts"], "<i4", 3).tolist()
                own, counts = np.frombuffer(r["counts"], f"<u{wide}", 2 * n, 12).reshape(2, n)
                s, set_sig, ids = np.frombuffer(r["sigs"], "<i4", m), np.frombuffer(r["sigs"], "<u8", m, 4 * m), np.frombuffer(r["sigs"], "<i8", m, 12 * m)
                parts.append((own, counts, np.frombuffer(r["sigs"], "<u8", n, 20 * m), s, set_sig, ids, np.frombuffer(r["tokens"], "<u8")))
            tokens = np.concatenate([p[6] for p in parts])
            sig = np.concatenate([np.repeat(p[2], p[1]) for p in parts])
            order = np.lexsort((sig, tokens))
            t, g = tokens[order], sig[order]
            fresh = np.ones(len(t), dtype=bool)
            fresh[1:] = t[1:] != t[:-1]
            other = fresh.copy()
            other[1:] |= g[1:] != g[:-1]
            group = np.cumsum(fresh) - 1
            df = np.empty(len(t), dtype=np.int64)
            df[order] = np.bincount(group, weights=other)[group] if len(t) else 0
            del t, g, fresh, other, group, order
            sets, ids = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
            smallest = {}
            for x, i in zip(sets.tolist(), ids.tolist()):
                smallest[x] = min(i, smallest.get(x, i))
            at, out = 0, []
            for r, (own, counts, _, s, set_sig, _, mine) in zip(rows, parts):
                d = df[at : at + len(mine)]
                at += len(mine)
                keep = d >= 2
                who = np.repeat(own, counts)[keep].astype("<i4")
                value = mine[keep].astype("<u8")
                first = np.array([smallest[x] for x in set_sig.tolist()], dtype="<i8")
                head = np.array([len(who), len(s)], dtype="<i4").tobytes()
                out.append((bucket, r["slice"], head + who.tobytes() + s.tobytes(), first.tobytes() + d[keep].astype("<i4").tobytes(), value.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ROW.types)], schema=_ROW)

    return run


def allowed(n: int) -> int:
    """How many of its n shingles a set can lack in another that it is linked with."""
    return n - -(-NUM * n // DEN)


def prefix_length(n: int, unique: int, df: np.ndarray) -> tuple[int, int]:
    """(shared shingles in the prefix, matches required) with the least estimated cost; df ascending, of the shared ones."""
    best = None
    for matches in range(1, MAX_MATCHES + 1):
        length = allowed(n) + matches
        if length > n:
            break
        shared = max(0, length - unique)
        lists = int(df[:shared].sum())
        # at most lists / matches sets have that many entries in the lists
        cost = lists + VERIFY_COST * lists / matches
        if best is None or cost < best[0]:
            best = (cost, shared, matches)
    return best[1:]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class_id", pa.int64()), ("sig", pa.int64()), ("tokens", pa.list_(pa.int64())), ("n_prefix", pa.int32()), ("matches", pa.int32())])


def _collect(batches):
    """Per document: class, and for representatives with candidates their shared shingles in order, and the prefix."""
    for _, rows in grouped(batches, "slice"):
        meta = next(np.frombuffer(r["tokens"], "<i8").reshape(4, -1) for r in rows if r["bucket"] < 0)
        ids, sigs, sizes, nulls = meta
        first = ids.copy()
        known = {}
        who, values, df = [], [], []
        for r in rows:
            if r["bucket"] < 0:
                continue
            n, m = np.frombuffer(r["counts"], "<i4", 2).tolist()
            who.append(np.frombuffer(r["counts"], "<i4", n, 8))
            s = np.frombuffer(r["counts"], "<i4", m, 8 + 4 * n)
            values.append(np.frombuffer(r["tokens"], "<u8"))
            known.update(zip(sigs[s].tolist(), np.frombuffer(r["sigs"], "<i8", m).tolist()))
            df.append(np.frombuffer(r["sigs"], "<i4", n, 8 * m))
        for k, x in enumerate(sigs.tolist()):
            first[k] = known.get(x, ids[k])
        who, values, df = (np.concatenate([np.zeros(0, dtype=t), *x]) for t, x in (("<i4", who), ("<u8", values), ("<i4", df)))
        order = np.lexsort((values, df, who))
        who, values, df = who[order], values[order], df[order]
        edges = np.searchsorted(who, np.arange(len(ids) + 1))
        out = []
        for k in range(len(ids)):
            a, z, n = int(edges[k]), int(edges[k + 1]), int(sizes[k])
            tokens, length, matches = None, None, None
            if a < z and first[k] == ids[k] and n - (z - a) <= allowed(n):
                length, matches = prefix_length(n, n - (z - a), df[a:z])
                tokens = values[a:z].view("<i8")
            out.append((None if nulls[k] else int(ids[k]), n, None if nulls[k] else int(first[k]), int(sigs[k]), tokens, length, matches))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT.types)], schema=_OUT)


def profile(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id, and tokens, n_prefix, matches of representatives that may have links; stored."""
    session(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    buckets = bucket_count(docs, per=BUCKET_BYTES)
    rows = "bucket long, slice long, counts binary, sigs binary, tokens binary"
    sent = docs.mapInArrow(tidy(_send(buckets, "doc_id", "text")), rows)
    counted = dealt(sent, "bucket").mapInArrow(tidy(_count(buckets)), rows)
    out = "doc_id long, n_shingles long, class_id long, sig long, tokens array<long>, n_prefix int, matches int"
    return stored(dealt(counted, "slice").mapInArrow(tidy(_collect), out), "profiles")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row."""
    found = profile(docs, key, text)
    # sets are told apart by their signatures: an id can have several texts
    sets = stored(found.where("tokens is not null").dropDuplicates(["sig"]).select("sig", "n_shingles", "tokens", "n_prefix", "matches"), "sets")
    keys = sets.select(F.explode(F.slice("tokens", 1, F.col("n_prefix"))).alias("key"), F.col("sig").alias("id"), (F.col("n_shingles") - F.size("tokens")).alias("own_shingles"), F.size("tokens").cast("long").alias("shared"), F.col("n_shingles").alias("n"), "matches")

    def verifier(ids: DataFrame):
        return verify

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("sig").alias("a"), F.col("n_shingles").alias("na"), F.col("tokens").alias("ta"))
        b = sets.select(F.col("sig").alias("b"), F.col("n_shingles").alias("nb"), F.col("tokens").alias("tb"))
        both = spread(spread(pairs, b, "b", "a"), a, "a", "b", counted=pairs).select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("i"))
        union = F.col("na") + F.col("nb") - F.col("i")
        return both.select("a", "b", (DEN * F.col("i") >= NUM * union).alias("linked"), F.col("i").alias("common"))

    def admit(x: str, y: str):
        # an intersection is no larger than the shared shingles of either side: (DEN + NUM) i >= NUM (n + m)
        return (DEN + NUM) * F.least(f"{x}.shared", f"{y}.shared") >= NUM * (F.col(f"{x}.n") + F.col(f"{y}.n"))

    def apart(x: str, y: str):
        # what both have of the leader, and what both have besides
        most = F.least(f"{x}.common", f"{y}.common") + F.least(F.col(f"{x}.shared") - F.col(f"{x}.common"), F.col(f"{y}.shared") - F.col(f"{y}.common"))
        return (DEN + NUM) * most < NUM * (F.col(f"{x}.n") + F.col(f"{y}.n"))

    def once(x: str, y: str):
        # enough matches in the prefixes, and the key is the least of them
        both = F.array_intersect(f"{x}.prefix", f"{y}.prefix")
        return (F.array_min(both) == F.col(f"{x}.key")) & (F.size(both) >= F.least(f"{x}.matches", f"{y}.matches"))

    linked = linkage.link(keys, verifier, admit, ["own_shingles", "shared", "n", "matches"], apart, once)
    discard(sets)
    sizes = found.groupBy("sig").agg(F.count("*").alias("_rows"), F.min("class_id").alias("_class"))
    classes = linked.select(F.col("id").alias("sig"), F.col("component").alias("_set")).join(sizes, "sig")
    first = classes.groupBy("_set").agg(F.min("_class").alias("component"))
    classes = stored(spread(classes, first, "_set", "sig").select("sig", "component", "_rows"), "linked-classes")
    rows = lookup(found.select("doc_id", "n_shingles", "class_id", "sig"), classes, "sig", "_rows")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that have a smaller id in their component. Rows that repeat a kept id all stay, and rows with a null id."""
    one = join(docs, key, text).where("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(one, key, "left_semi")
    nulls = docs.where(F.col(key).isNull())
    return kept.unionByName(nulls).select(*docs.columns)
