"""Extraction, lookups, grouping, merging and sources against plain Python on small corpora."""

import gzip
import random

import pytest

from gramlode.functions.encoding import build_primes, grams, query_primes, widen
from gramlode.operators.extract import postings
from gramlode.operators.index import Index, MergedIndex, merge
from gramlode.operators import lookup
from gramlode.sources.samples import files, from_table, path_list, with_fids
from gramlode.streaming.append import append_batch, open_parts

EDGE = [b"", b"abc", b"abcd", b"abcde", b"\0" * 9, bytes(range(256)), b"a" * 50, b"abcdXbcde", "größe".encode(), b"abcd"]


def corpus(seed=1, n=60):
    r = random.Random(seed)
    return EDGE + [bytes(r.choice(b"abcdeABx\0") for _ in range(r.randrange(40))) for _ in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(k, f"p{k}", bytearray(d)) for k, d in enumerate(data)], "fid long, path string, content binary").repartition(3)


def ids(df):
    rows = [r[0] for r in df.select("fid").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def data():
    return corpus()


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    return Index.build(frame(spark, data), str(tmp_path_factory.mktemp("index")))


def test_extract(spark, data):
    want = {(g, k) for k, d in enumerate(data) for g in grams(d)}
    got = [tuple(r) for r in postings(frame(spark, data)).collect()]
    assert len(got) == len(want) and set(got) == want
    clean = {(g, f) for g, f in want if 0 not in g.to_bytes(4, "big")}
    assert {tuple(r) for r in postings(frame(spark, data), omit_zero=True).collect()} == clean


def test_extract_long_sample(spark, monkeypatch):
    import gramlode.operators.extract as x

    long = bytes(random.Random(2).randrange(256) for _ in range(3 * 1024))
    assert set(map(int, x._keys(__import__("numpy").frombuffer(long, "u1"), False))) == grams(long)
    got = postings(frame(spark, [long * 3000])).count()
    assert got == len(grams(long * 2))


def test_lookups(index, data):
    sets = [grams(d) for d in data]
    for text in (b"abcd", b"abcde", b"aaaaaa", b"zzzz", "größe", b"bcdeabcd"):
        keys = grams(text)
        assert ids(index.get_posting_list(text)) == {k for k, s in enumerate(sets) if keys <= s}
        for n in range(1, len(keys) + 1):
            assert ids(index.match_posting_lists(text, n)) == {k for k, s in enumerate(sets) if len(keys & s) >= n}
        third = grams(text, 3)
        assert ids(index.get_posting_list_n3(text)) == {k for k, s in enumerate(sets) if third <= {g >> 8 for g in s}}
    assert ids(index.get_posting_list(b"abc")) == set()
    assert ids(index.match_posting_lists({b"abcd"}, 2)) == set()
    assert index.get_posting_list_n3(b"ab") is None
    assert {tuple(r) for r in index.get_posting_list_size().collect()} == {(g, sum(g in s for s in sets)) for g in set().union(*sets)}


def test_many_grams(index, data, monkeypatch):
    monkeypatch.setattr(lookup, "LISTED", 1)
    keys = grams(b"abcde")
    assert ids(index.get_posting_list(b"abcde")) == {k for k, d in enumerate(data) if keys <= grams(d)}


@pytest.mark.parametrize("tau", [None, 0, 2, 100])
def test_grouped(index, data, tau):
    sets = [grams(d) for d in data]
    for width in (11, 4):
        primes = query_primes(width)
        for text in (b"abcde", b"abcd", b"zzzz"):
            keys = grams(text)
            if max(g & 255 for g in keys) >= len(primes):
                continue
            lists = {g: {k for k, s in enumerate(sets) if g in s} for g in keys}
            small = {g for g in keys if tau is None or len(lists[g]) <= tau}
            want = {f for f in range(len(data)) if all(f % primes[g & 255] in {x % primes[g & 255] for x in lists[g]} for g in small) and all(f in lists[g] for g in keys - small)}
            got = ids(index.get_posting_list(text, width, tau))
            assert got == want and ids(index.get_posting_list(text)) <= got
    assert index.get_posting_list(b"abc", 11, tau) is None


def test_grouped_postings(index, data):
    primes = build_primes(8)
    want = {(g, k % primes[(g & 255) % len(primes)]) for k, d in enumerate(data) for g in grams(d)}
    got = [tuple(r) for r in index.grouped(8).collect()]
    assert len(got) == len(want) and set(got) == want


def test_merge(spark, tmp_path, data):
    a, b, c = data[:20], data[20:25], data[25:]
    parts = [Index.build(frame(spark, x), str(tmp_path / f"i{k}")) for k, x in enumerate((a, b, c))]
    lazy, whole = MergedIndex(parts), Index.build(frame(spark, a + b + c), str(tmp_path / "whole"))
    written = merge(parts, str(tmp_path / "merged"))
    rows = lambda i: {tuple(r) for r in i.postings.collect()}
    assert rows(lazy) == rows(whole) == rows(written)
    assert lazy.numsamples == written.numsamples == len(data)
    assert ids(lazy.get_posting_list(b"abcd")) == ids(whole.get_posting_list(b"abcd"))
    assert ids(lazy.get_posting_list_n3(b"abcd")) == ids(whole.get_posting_list_n3(b"abcd"))
    assert ids(lazy.get_posting_list(b"abcd", 11)) == ids(whole.get_posting_list(b"abcd", 11))
    again = merge(parts, str(tmp_path / "merged"))  # takes the place of the first
    assert rows(again) == rows(whole)


def test_fid_to_path(spark, index):
    fids = spark.createDataFrame([(0,), (3,), (10**6,)], "fid long")
    assert {tuple(r) for r in index.fid2path(fids).collect()} == {(0, "p0"), (3, "p3")}


def test_files(spark, tmp_path):
    data = {"a.bin": b"hello world", "b.bin": b"", "c/d.bin": bytes(range(200))}
    for name, d in data.items():
        (tmp_path / "plain" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "plain" / name).write_bytes(d)
        (tmp_path / "packed" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "packed" / name).write_bytes(gzip.compress(d[:5]) + gzip.compress(d[5:]))
    (tmp_path / "list.txt").write_text("\n".join(data) + "\n")
    paths = path_list(spark, str(tmp_path / "list.txt"))
    assert {tuple(r) for r in paths.collect()} == set(enumerate(data))
    assert path_list(spark, str(tmp_path / "list.txt"), 2).count() == 2
    want = {(k, n, d) for k, (n, d) in enumerate(data.items())}
    for kind in ("plain", "packed"):
        got = files(spark, paths, str(tmp_path / kind), gzip=kind == "packed")
        assert {(r.fid, r.path, bytes(r.content)) for r in got.collect()} == want


def test_from_table_and_ids(spark):
    rows = spark.createDataFrame([(0, "é"), (1, None)], "id long, t string")
    assert {(r.fid, bytes(r.content)) for r in from_table(rows, "id", "t").collect()} == {(0, "é".encode()), (1, b"")}
    named = spark.createDataFrame([(f"n{k:03d}",) for k in range(50)], "path string").repartition(5)
    got = {(r.fid, r.path) for r in with_fids(named, "path").collect()}
    assert got == {(k, f"n{k:03d}") for k in range(50)}


def test_append_stream(spark, tmp_path):
    step = append_batch(str(tmp_path / "parts"))
    batches = [[("a", b"abcdef"), ("b", b"xyzw")], [("c", b"abcd"), ("d", b"")]]
    for number, rows in enumerate([*batches, batches[1]]):  # the last batch comes again
        step(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary"), min(number, 1))
    whole = open_parts(spark, str(tmp_path / "parts"), 2)
    assert whole.numsamples == 4
    assert {r.path for r in whole.fid2path(whole.get_posting_list(b"abcd")).collect()} == {"a", "c"}


def test_wide(spark, tmp_path, data):
    index = Index.build(frame(spark, [widen(d) for d in data]), str(tmp_path / "wide"))
    keys = grams(widen(b"abcd"))
    assert ids(index.get_posting_list(widen(b"abcd"))) == {k for k, d in enumerate(data) if keys <= grams(widen(d))}


def test_empty(spark, tmp_path):
    index = Index.build(frame(spark, [b""]).limit(0), str(tmp_path / "none"))
    assert index.numsamples == 0 and ids(index.get_posting_list(b"abcd")) == set()


def test_many_ids(spark):
    """Dense and unique, with ranges whose bounds are drawn from a sample."""
    n = 400_000
    rows = spark.range(n).selectExpr("concat('p', hash(id), '-', id) AS path").repartition(7)
    numbered = with_fids(rows, "path")
    assert numbered.selectExpr("count(DISTINCT fid)", "min(fid)", "max(fid)", "count(*)").first() == (n, 0, n - 1, n)
    assert numbered.selectExpr("path", "fid", "lag(path) OVER (ORDER BY fid) AS before").where("before > path").count() == 0


def test_path_list_splits(spark, tmp_path):
    lines = [f"file-{k}" + "x" * (k % 50) for k in range(5000)] + ["", "last  "]
    (tmp_path / "list.txt").write_text("\r\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = {(r.fid, r.path) for r in path_list(spark, str(tmp_path / "list.txt")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(k, x.rstrip()) for k, x in enumerate(lines)}


def test_long_path_list(spark, tmp_path, monkeypatch):
    from gramlode.sources import samples

    (tmp_path / "a").write_bytes(b"abcd")
    paths = spark.createDataFrame([(0, "a"), (1, "not there")], "fid long, path string")
    for most in (0, 10):
        monkeypatch.setattr(samples, "LISTED", most)
        assert {(r.fid, bytes(r.content)) for r in files(spark, paths, str(tmp_path)).collect()} == {(0, b"abcd"), (1, b"")}


def test_ranges(spark, data):
    from gramlode.operators.extract import ranged_postings

    big = frame(spark, data * 30)
    want = {(g, k) for k, d in enumerate(data * 30) for g in grams(d)}
    import gramlode.operators.extract as x

    old, x.BOUNDS_SHARE = x.BOUNDS_SHARE, 0.5
    try:
        ranged = ranged_postings(big, 5)
        parts = ranged.selectExpr("spark_partition_id() AS p", "*").collect()
    finally:
        x.BOUNDS_SHARE = old
    assert len(parts) == len(want) and {(r.ngram, r.fid) for r in parts} == want
    spans = {p: [(r.ngram, r.fid) for r in parts if r.p == p] for p in {r.p for r in parts}}
    assert len(spans) == 5 and all(max(spans[p]) < min(spans[p + 1]) for p in range(4)) and max(map(len, spans.values())) < len(want) / 2


def test_merge_into_an_input(spark, tmp_path, data):
    a, b = (Index.build(frame(spark, x), str(tmp_path / n)) for n, x in (("a", data[:20]), ("b", data[20:])))
    want = {tuple(r) for r in MergedIndex([a, b]).postings.collect()}
    whole = merge([a, b], str(tmp_path / "a"), pieces=3)
    assert {tuple(r) for r in whole.postings.collect()} == want
    assert whole.numsamples == len(data) and whole.paths.count() == len(data)
    assert {tuple(r) for r in a.postings.collect()} == {r for r in want if r[1] < 20}  # readers of the old version go on
    from gramlode.operators import index as module

    module.vacuum(spark, str(tmp_path / "a"))
    assert {tuple(r) for r in Index.open(spark, str(tmp_path / "a")).postings.collect()} == want


def test_merge_goes_on(spark, tmp_path, data, monkeypatch):
    """After a crash nothing is lost, and whole pieces are not written again."""
    from gramlode.operators import index as module

    parts = [Index.build(frame(spark, x), str(tmp_path / f"i{k}")) for k, x in enumerate((data[:30], data[30:]))]
    target, calls, write = str(tmp_path / "t"), [], module.write_sorted
    Index.build(frame(spark, data[:3]), target)

    def crash(rows, path):
        calls.append(path)
        if len(calls) == 3:
            raise OSError("lost")
        write(rows, path)

    monkeypatch.setattr(module, "write_sorted", crash)
    with pytest.raises(OSError):
        merge(parts, target, pieces=4)
    assert Index.open(spark, target).numsamples == 3
    whole = merge(parts, target, pieces=4)
    assert len(calls) == 5  # two whole ones, the lost one, and then two
    assert {tuple(r) for r in whole.postings.collect()} == {tuple(r) for r in MergedIndex(parts).postings.collect()}


def test_command_line(spark, tmp_path, capsys):
    from gramlode.__main__ import main

    for name, body in (("x", b"some text"), ("y", b"more text, some")):
        (tmp_path / name).write_bytes(body)
    (tmp_path / "list").write_text("x\ny\n")
    (tmp_path / "rules").write_text('rule r { strings: $a = "some" condition: $a at 0 }')
    call = lambda *x: (main([str(y) for y in x]), capsys.readouterr().out)[1].split()
    assert call("build", "-r", tmp_path / "list", "-w", tmp_path / "i", "--root", tmp_path) == ["2"]
    assert call("merge", tmp_path / "m", tmp_path / "i", tmp_path / "i") == ["4"]
    assert sorted(call("query", tmp_path / "i", "some")) == ["0", "1", "x", "y"]
    assert call("query", tmp_path / "i", "more") == ["1", "y"]
    assert call("scan", tmp_path / "i", tmp_path / "rules", "-r", tmp_path / "list", "--root", tmp_path) == ["r", "0", "x"]
