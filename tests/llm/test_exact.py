"""Operators with exact contracts against plain Python."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gramlode.llm import decontamination, jaccard, katz, quality, substring_dedup
from gramlode.llm.fm_index import FMIndex, suffix_order
from gramlode.llm.linkage import components
from gramlode.llm.words import ALNUM_WORDS, SPACE_WORDS, Texts, Windows, window_starts

SPLIT = re.compile(rb"[^\x20\x09-\x0d]+")


def words_of(text, lower=False):
    raw = (text or "").encode()
    return SPLIT.findall(raw.lower() if lower else raw)


def by_id(df, *columns):
    rows = [tuple(r) for r in df.select("doc_id", *columns).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


# --- words


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t日-1", max_size=30)), max_size=12))
@settings(max_examples=60, deadline=None)
def test_texts(rows):
    for classes, pattern, lower in ((SPACE_WORDS, rb"[^\x20\x09-\x0d]+", False), (ALNUM_WORDS, rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", True)):
        whole = Texts(pa.array(["pad pad", *rows], pa.string()).slice(1), classes, lower)
        want = [re.findall(pattern, (t or "").encode().lower() if lower else (t or "").encode()) for t in rows]
        assert [whole.words(a, b) for a, b in zip(whole.first[:-1], whole.first[1:])] == want
        flat = [w for t in want for w in t]
        assert len(set(whole.hashes.tolist())) == len(set(flat)) and len({(h, w) for h, w in zip(whole.hashes.tolist(), flat)}) == len(set(flat))
        for n in (1, 2, 3, 5, 7):
            found = Windows(whole.hashes).of(n)
            at = window_starts(whole.first, n)
            assert list(at) == [i for a, b in zip(whole.first[:-1], whole.first[1:]) for i in range(a, b - n + 1)]
            assert len(set(found[at].tolist())) == len({tuple(flat[i : i + n]) for i in at})


def test_long_words():
    long = "a" * (3 << 19)
    h = Texts(pa.array([f"x {long} {long}b {long}"]), SPACE_WORDS, False).hashes
    assert h[1] == h[3] and len(set(h.tolist())) == 3


# --- op6


def test_quality(spark, docs, texts, empty):
    got = by_id(quality.rules(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        cover = {i + j for x in at.values() if len(x) > 1 for i in x for j in range(3)}
        full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(cover))
        assert got[k][:5] == want
        assert got[k][5] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (got[k][5] and got[k][6])
    assert quality.rules(empty).count() == 0


def test_quality_lines(spark):
    prose = " ".join(["word"] + [f"w{k}" for k in range(59)]) + "."
    rows = [
        (0, prose + "\nHome | News | Sport | More\n" + prose.replace("w", "v"), True), (1, "\n".join(f"Home | a{k} | b{k} | c{k} | d{k}" for k in range(30)), False), (2, " ".join(f"x{k}***" for k in range(60)) + ".", False),
        (3, "\n".join(f"line without its end number {k} and some more words" for k in range(12)), False), (4, prose + "\nAll rights reserved.", True),
    ]
    docs = spark.createDataFrame([(k, t, len(t), "keep") for k, t, _ in rows], "doc_id long, text string, n_chars long, cleaned string")
    assert {k for k, (kept,) in by_id(quality.rules(docs), "kept").items() if kept} == {k for k, _, keep in rows if keep}
    clean = by_id(quality.clean(docs), "text", "n_chars", "cleaned")
    assert clean[0] == (prose + "\n" + prose.replace("w", "v"), 2 * len(prose) + 1, "keep") and clean[4][0] == prose
    assert quality.clean(docs).columns == docs.columns


# --- op7


def links(texts, lower=True):
    sets = []
    for t in texts:
        w = words_of(t, lower)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def test_jaccard(docs, texts, empty):
    assert by_id(jaccard.join(docs), "n_shingles", "component_id") == links(texts)
    assert jaccard.join(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_near_groups(spark, seed):
    """Variants around one text: chains, stragglers and pairs that fail, in one bucket."""
    r = random.Random(seed)
    base = [f"b{k}" for k in range(70)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = r.choice(["x", "y", f"z{r.randrange(1000)}"])
        if r.random() < 0.3:
            w = w[r.randrange(12) :]
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert by_id(jaccard.join(docs), "n_shingles", "component_id") == links(texts)


def test_jaccard_rows(spark):
    """Equal rows, null ids and ids that come twice."""
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f"), (3, None), (7, "x")], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.join(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, None), (9, 2, 5), (3, 0, 3), (7, 1, 7)], key=repr)
    kept = sorted((r.doc_id for r in jaccard.keep_one(docs).collect()), key=repr)
    assert kept == [3, 5, 5, 7, None]


def test_jaccard_ids_with_two_texts(spark):
    """Texts under one id are sets of their own, and both find their links."""
    a, b = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (3, b + " more"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.join(docs).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (3, 1)]
    assert sorted((r.doc_id or 0, r.text) for r in jaccard.keep_one(docs).collect()) == [(0, a), (1, a), (1, b)]


def test_blocks_of_a_bucket(spark, monkeypatch):
    """A bucket that is compared block by block gives the same components."""
    from gramlode.llm import linkage

    monkeypatch.setattr(linkage, "BLOCK", 3)
    n = 40
    keys = spark.createDataFrame([(k % 2, k, k) for k in range(n)] + [(5, 3, 3), (5, 4, 4)], "key long, id long, rank long")
    verify = lambda pairs: pairs.withColumn("linked", __import__("pyspark").sql.functions.expr("abs(a - b) = 4 or (a + b) = 7"))
    got = {r.id: r.component for r in linkage.link(keys, lambda ids: verify, lambda x, y: __import__("pyspark").sql.functions.lit(True), ["rank"]).collect()}
    assert got == {k: (0 if k % 4 == 0 else 1 if k % 4 == 1 else 2 if k % 4 == 2 else 0) for k in range(n)}


def test_pairs_take_one_exchange(spark, monkeypatch):
    """Both sides of the join of a bucket's members are dealt by the cell alone, so one exchange serves both."""
    import re

    from gramlode.llm import linkage
    from pyspark.sql import functions as F

    plans, stored = [], linkage.stored

    def seen(df, name):
        if name == "rest":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(linkage, "stored", seen)
    keys = spark.createDataFrame([(k % 4, k, 0) for k in range(40)], "key long, id long, rank int")
    verify = lambda pairs: pairs.select("a", "b", (F.col("a") % 8 == F.col("b") % 8).alias("linked"))
    got = {x.id: x.component for x in linkage.link(keys, lambda ids: verify, lambda x, y: F.lit(True), ["rank"]).collect()}
    assert all(got.get(k, k) == k % 8 for k in range(40))
    dealt = re.findall(r"hashpartitioning\(_cell#\d+L?([^)]*)\)", plans[0])
    assert dealt and all(re.fullmatch(r", \d+", x) for x in dealt)


def test_prefix_is_long_enough():
    for n in range(1, 60):
        assert jaccard.allowed(n) == n - math.ceil(0.75 * n)
        for unique in range(n):
            shared, matches = jaccard.prefix_length(n, unique, np.arange(2, 2 + n - unique))
            assert shared == max(0, min(n, jaccard.allowed(n) + matches) - unique) and 1 <= matches <= jaccard.MAX_MATCHES


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = [tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(dict(got)) and dict(got) == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# --- op9


def without_repeats(texts, n=substring_dedup.WINDOW):
    split = [words_of(t) for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = {}
    for k, w in enumerate(split):
        gone = {i + j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(n)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(docs, texts, empty):
    assert by_id(substring_dedup.dedup(docs), "n_words", "n_removed", "kept_sha256") == without_repeats(texts)
    assert substring_dedup.dedup(empty).count() == 0


def test_substrings_repeated_rows(spark):
    """A row that stands twice, in two slices or in one, beside a document that shares only a part of its text."""
    r = random.Random(23)
    prose = lambda n: " ".join(f"v{r.randrange(5000)}" for _ in range(n))
    rows = []
    for k in range(24):
        whole = prose(120)
        part = " ".join(whole.split()[17 + k : 17 + k + 40])
        rows += [(k if k % 3 else None, whole), (100 + k, f"{prose(50)} {part} {prose(50)}")]
    left = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    twice = left.where("doc_id < 100 or doc_id is null")
    want = Counter((i, *v) for i, v in zip([i for i, _ in rows] + [i for i, _ in rows if i is None or i < 100], without_repeats([t for _, t in rows] + [t for i, t in rows if i is None or i < 100]).values()))
    for docs in (left.unionByName(twice), left.unionByName(twice).coalesce(1)):
        got = Counter(tuple(x) for x in substring_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
        assert got == want


def test_one_plan(spark):
    """Plans of a repeated row, in both orders and one of them empty: each segment keeps its largest fate."""
    full, other, bare = (False, [0, 40], [5, 6], [1, 2], [-7, 8]), (False, [0, 40], [5, 6], [2, 1], [-7, 8]), (True, [], [], [], [])
    kind = "row long, whole boolean, start array<int>, count array<int>, fate array<int>, anchor array<long>"
    for plans, fate in (([full, other], [2, 2]), ([other, full], [2, 2]), ([bare, full], [1, 2]), ([full, bare], [1, 2])):
        (got,) = substring_dedup.one_plan(spark.createDataFrame([(1, *p) for p in plans], kind)).collect()
        assert tuple(got) == (1, bare in plans, [0, 40], [5, 6], fate, [-7, 8])


def test_substrings_hot_anchors(docs, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", 1)
    monkeypatch.setattr(substring_dedup, "fates", lambda *a, f=substring_dedup.fates: f(*a))
    rows = pa.array(texts, pa.string())
    t = Texts(rows, SPACE_WORDS, False)
    seg = substring_dedup.Segments(t)
    fate = substring_dedup.fates(seg.anchor, seg.content, seg.own)
    assert substring_dedup.HOT in fate
    windows = Counter(seg.window_hash.tolist())
    for k in np.flatnonzero(fate == 0):  # nothing that repeats is called unique
        assert all(windows[h] == 1 for h in seg.window_hash[seg.begin[k] : seg.begin[k] + seg.count[k]].tolist())


@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(2, 6))
@settings(max_examples=60, deadline=None)
def test_fm_index(symbols, n):
    text = np.array([*symbols, 0], dtype=np.int64)
    order = suffix_order(text, 64)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i : i + 64].tolist())
    index = FMIndex(text)
    count = max(0, len(symbols) - n + 1)
    if count:
        found = index.repeated_windows(text, np.array([0]), np.array([count]), n)
        seen = Counter(tuple(symbols[i : i + n]) for i in range(count))
        assert found.tolist() == [seen[tuple(symbols[i : i + n])] > 1 for i in range(count)]


# --- op10


def test_decontamination(spark, docs, texts, empty):
    long = words_of(texts[10])
    items = [(1, b" ".join(long[5:25]).decode()), (2, "one, TWO three!"), (10, "one"), (4, ""), (5, None), (6, "日本"), (7, "not there at all in any of the texts so nothing is hit by it")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    norm = lambda t: pattern.findall((t or "").encode().lower())
    want = {}
    for k, t in enumerate(texts):
        w, hit, of = norm(t), set(), set()
        for item, x in items:
            x = norm(x)
            n = min(13, len(x))
            grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    of.add(item)
        want[k] = (len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(map(str, of))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    for block in (500_000, 10):  # one broadcast, or several
        got = by_id(decontamination.judge(docs, bench, block_words=block), *decontamination.RESULT[:5])
        assert got == want
    kept = decontamination.decontaminate(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {k for k, x in want.items() if not x[4]}
    assert decontamination.judge(empty, bench).count() == 0
    assert not any(r.n_hit for r in decontamination.judge(docs, bench.limit(0)).collect())
    plain = spark.createDataFrame([(0, "Before one; two-three after.")], "doc_id long, text string")
    only = spark.createDataFrame([(2, "one two three")], "item_id long, text string")
    assert decontamination.decontaminate(plain, only, "spans").first().text == "Before  after."


# --- op8


def direct_katz(rows, order):
    """log10 p of each row (id, tokens, held) and the probability function, computed directly from dictionaries."""
    counts = {k: defaultdict(Counter) for k in range(1, order + 1)}
    for _, w, held in rows:
        if not held:
            padded = ["START", *w]
            for i in range(1, len(padded)):
                for k in range(1, min(order, i + 1) + 1):
                    counts[k][tuple(padded[i - k + 1 : i])][padded[i]] += 1
    uni = counts[1][()]
    n, v = sum(uni.values()), len(uni)
    d = {}
    for k in range(2, order + 1):
        seen = Counter(r for c in counts[k].values() for r in c.values())
        d[k] = katz.discounts([seen[r] for r in range(1, katz.CUTOFF + 2)])
    cached = {}

    def context(h):
        if h not in cached:
            k = len(h) + 1
            c = counts[k][h]
            total, mass = sum(c.values()), sum((d[k][r] if r <= katz.CUTOFF else 1) * r for r in c.values())
            total += mass >= total * (1 - 1e-12)
            cached[h] = c, total, (1 - mass / total) / (1 - sum(p(w, h[1:]) for w in c))
        return cached[h]

    def p(w, h):
        if not h:
            return (uni[w] + 0.5) / (n + 0.5 * (v + 1))
        if h not in counts[len(h) + 1]:
            return p(w, h[1:])
        c, total, alpha = context(h)
        r = c[w]
        return (d[len(h) + 1][r] if r <= katz.CUTOFF else 1) * r / total if r else alpha * p(w, h[1:])

    scores = {}
    for k, w, _ in rows:
        padded = ["START", *w]
        scores[k] = sum(math.log10(p(padded[i], tuple(padded[max(0, i - order + 1) : i]))) for i in range(1, len(padded)))
    return scores, p, counts, n


def katz_rows(texts):
    return [(k, [*words_of(t, True), "END"], zlib.crc32(str(k).encode()) % 5 == 1) for k, t in enumerate(texts)]


def same_scores(got, rows, scores, counts, n):
    uni = counts[1][()]
    assert len(got) == len(rows)
    for k, w, held in rows:
        assert got[k][:4] == (held, len(w), sum(x in uni for x in w), n)
        assert got[k][4] == pytest.approx(sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (len(uni) + 1))) for x in w))
        assert got[k][5] == pytest.approx(scores[k])


COLUMNS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz(docs, texts, empty, order):
    rows = katz_rows(texts)
    scores, p, counts, n = direct_katz(rows, order)
    # the probabilities of all words and the unknown one are 1 after every context
    for k in range(2, order + 1):
        for h in list(counts[k])[:400]:
            assert sum(p(w, h) for w in counts[1][()]) + p("never seen", h) == pytest.approx(1)
    same_scores(by_id(katz.score(docs, order=order), *COLUMNS), rows, scores, counts, n)
    assert katz.score(empty, order=order).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_katz_hot_words(docs, texts, monkeypatch, order):
    """Words that are split over shards score as others do."""
    monkeypatch.setattr(katz, "HOT_TOKENS", 40)
    rows = katz_rows(texts)
    scores, _, counts, n = direct_katz(rows, order)
    same_scores(by_id(katz.score(docs, order=order), *COLUMNS), rows, scores, counts, n)


@pytest.mark.parametrize("hot", [40, 10**9])
def test_katz_model(spark, docs, texts, monkeypatch, hot):
    """A model's tables score other documents, and the same ones alike."""
    monkeypatch.setattr(katz, "HOT_TOKENS", hot)
    model = katz.fit(docs)
    rows = katz_rows(texts)
    scores, p, _, n = direct_katz(rows, 3)
    again = by_id(model.score(docs), "train_tokens", "score")
    assert all(again[k] == (n, pytest.approx(scores[k])) for k in scores)
    new = ["w1 w2 w3 something new", "", None, "W1 w2"]
    got = by_id(model.score(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string")), "score")
    for k, t in enumerate(new):
        w = ["START", *words_of(t, True), "END"]
        assert got[k][0] == pytest.approx(sum(math.log10(p(w[i], tuple(w[max(0, i - 2) : i]))) for i in range(1, len(w))))


def test_katz_messages_follow_the_data(texts):
    """A slice sends no more rows than it has words or n-grams, however many buckets there are."""
    from pyspark import TaskContext

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array([t or "" for t in texts])})
    TaskContext.get, saved = staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()), TaskContext.get
    try:
        sizes = {}
        for bits in (5, 16, 40):
            sent = [r for b in katz._send(bits, True)(iter([batch])) for r in b.to_pylist()]
            counted = [r for b in katz._count(bits, 1 << 40)(iter([pa.RecordBatch.from_pylist(sorted(sent, key=lambda r: r["bucket"]), katz._ROW)])) for r in b.to_pylist()]
            state = [r for b in katz._states(iter([pa.RecordBatch.from_pylist(sorted(counted, key=lambda r: r["slice"]), katz._ROW)])) for r in b.to_pylist() if r["slice"] >= 0]
            const = katz.Constants(1, 1, 1, bits, 3, 1 << 40, 0, 0)
            asked = [r for b in katz._ask(const)(iter([pa.RecordBatch.from_pylist(state, katz._ROW)])) for r in b.to_pylist()]
            words = len({w for t in texts for w in words_of(t, True)}) + 1
            sizes[bits] = len(asked), sum(len(r["a"]) for r in asked)
            assert len(sent) <= words + 1 and len(asked) <= words + 1
        assert sizes[40][1] < 4 * sizes[5][1]
    finally:
        TaskContext.get = saved


def test_plain_names():
    json.dumps(decontamination.RESULT)
