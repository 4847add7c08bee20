"""Operators on texts, pages, archives and lines."""

import base64
import gzip
import hashlib
import random

import pytest

from gramlode.llm import html_text, line_dedup, linkage, pieces, pii, warc

# --- op1


def test_pieces_equal_the_library(docs, texts, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r.doc_id: r for r in pieces.round_trip(docs).collect()}
    for k, t in enumerate(texts):
        assert got[k].ids == library.encode(t or "") and got[k].n_pieces == len(got[k].ids) and got[k].round_trip
    assert pieces.round_trip(empty).count() == 0
    both = pieces.decode(pieces.encode(docs))
    assert both.columns == [*docs.columns, "ids", "decoded"]
    assert {r.doc_id: r.decoded for r in both.collect()} == {k: t or "" for k, t in enumerate(texts)}
    model, r = pieces.load(pieces.default_model()), random.Random(4)
    for _ in range(1500):
        t = "".join(r.choice("ab ▁.,\nté日x=-_0😀") for _ in range(r.randrange(30)))
        ids = model.encode([t])[0].tolist()
        assert ids == library.encode(t) and model.decode(ids) == library.decode(ids)


def test_unigram_best_path():
    """The unigram search against all segmentations."""

    model = pieces.Model.__new__(pieces.Model)
    model.bpe, model.prefix, model.squeeze, model.bytes, model.unknown = False, False, False, {}, 0
    model.pieces = ["<unk>", "a", "b", "ab", "aba", "ba", "bb"]
    model.scores = [0.0, -2.0, -2.5, -3.0, -4.9, -3.1, -9.0]
    model.ids = {p: k for k, p in enumerate(model.pieces) if k}
    model.longest, model.penalty, model._pairs, model.texts = 3, -19.0, {}, list(model.pieces)
    model.endings = model._suffix_table()

    def best(w):
        if not w:
            return 0.0
        return max(best(w[:-n]) + (model.scores[model.ids[w[-n:]]] if w[-n:] in model.ids else model.penalty) for n in range(1, min(3, len(w)) + 1) if w[-n:] in model.ids or n == 1)

    words = sorted({"".join(w) for n in range(1, 7) for w in __import__("itertools").product("abc", repeat=n)})[:500]
    for w, ids in zip(words, model.encode_words(words)):
        path = __import__("numpy").frombuffer(ids, "i4").tolist()
        assert sum(model.scores[i] if i else model.penalty for i in path) == pytest.approx(best(w))


# --- op2


def test_html():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Top</header><nav><a>menu</a></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>A &amp; B&nbsp;c</h1><p>One <b>bold
    text</b><br>more<p>Two<!-- no --> &#233;&copy<div class=ad>buy</div><ul><li>x<li>y</ul><form>f<input></form><aside>side</aside>
    <section id="comments"><p>first!</p></section></article><footer>&copy; us</footer></body></html>"""
    assert html_text.extract_group([page]) == ["A & B c\n\nOne bold text more\n\nTwo é©\n\nx\n\ny"]
    assert html_text.extract_group(["", "plain &lt;text&gt;", "<p>a</p><p"]) == ["", "plain <text>", "a"]


def test_html_repeats():
    menu = "home news sport weather travel money culture future shop more"
    own = [" ".join(f"{w}{k}" for w in "all of these words are on this page only".split()) for k in range(4)]
    pages = [f"<body><div>{menu}</div><div>{t}</div></body>" for t in own]
    assert html_text.extract_group(pages) == own
    assert html_text.extract_group([pages[0], pages[0]]) == [f"{menu}\n\n{own[0]}"] * 2  # a copy is no repetition
    shared = "this paragraph is quoted by two articles and so has to stay in both of them"
    out = html_text.extract_group([f"<article><p>{shared}</p><p>own {k}</p></article>" for k in range(2)])
    assert all(shared in t for t in out)


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p>One <svg class="i"/> two.</p><p>Three</p></article>', "One two.\n\nThree"), ('<article><p>One <svg><path d="x"/><text>icon</text></svg> two.</p></article>', "One two."),
        ("<article><p>One <svg><path>two.</p><p>Three</p></article>", "One\n\nThree"), ("<article><p>One<object><p>gone</object></p><p>Three</p></article>", "One\n\nThree"),
        ("<article><object-x>stays</object-x><p>and this</p></article>", "stays\n\nand this"), ("<article><p>a</p><noscript>b<p>c</p></noscript><p>d</p></article>", "a\n\nd"), ("<article><p>a</p><script>b", "a"),
        ('<article><p class="side-by-side">x</p><p class="form-of-words">y</p><p id="share-price">z</p></article>', "x\n\ny\n\nz"), ('<article><p>x</p><div class="share-buttons">a</div><div id="siteFooter">b</div><div class="x ad">c</div><div class="ad-1">d</div></article>', "x"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 10 + "</article> after", "deep"), ("<article><p>a < b && c > d</p><p>x <unknown y='>'>z</p></article>", "a < b && c > d\n\nx z"),
    ],
)
def test_html_broken_pages(page, want):
    assert html_text.extract_group([page]) == [want]


def test_html_long_page():
    body = "".join(f"<p>paragraph {k} of a long page</p>" for k in range(60_000))
    text = html_text.extract_group([f"<html><body><nav>menu</nav><article>{body}</article></body></html>"])[0]
    assert text.count("\n\n") == 59_999 and text.endswith("paragraph 59999 of a long page")


def host_texts(streams):
    """Brute force: words outside every run that enough distinct pages (lists of blocks) of the host have."""
    distinct = {tuple(p) for p in streams}
    least = min(html_text.SHARED_PAGES, len(distinct))
    runs = {}
    for p in distinct:
        w = " ".join(p).split(" ")
        for k in range(len(w) - html_text.RUN + 1):
            runs.setdefault(tuple(w[k : k + html_text.RUN]), set()).add(p)
    out = []
    for p in streams:
        w, gone, at, kept = " ".join(p).split(" "), set(), 0, []
        for k in range(len(w) - html_text.RUN + 1):
            if len(distinct) > 1 and len(runs[tuple(w[k : k + html_text.RUN])]) >= least:
                gone.update(range(k, k + html_text.RUN))
        for block in p:
            words = block.split(" ")
            stay = [x for k, x in enumerate(words, at) if k not in gone]
            at += len(words)
            if stay:
                kept.append(" ".join(stay))
        out.append("\n\n".join(kept))
    return out


def test_html_hosts(spark, monkeypatch):
    """Pages without articles against brute force, a host in many groups, copies of pages, and clashing names."""
    monkeypatch.setattr(html_text, "GROUP_BYTES", 3000)
    r = random.Random(5)
    phrases = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(4, 20))) for _ in range(12)]
    pages, streams = [], {}
    for k in range(160):
        host = r.choice((0, 0, 0, 1, 2, 3 + k))  # one large host, and some of one page
        p = [" ".join(x for x in (r.choice(phrases), *(f"{c}{r.randrange(30)}" for c in "xyzxyz"[: r.randrange(7)])) if x) for _ in range(r.randrange(1, 6))]
        for page in {k, k + 1000} if k % 9 == 0 else {k}:
            pages.append((page, f"http://h{host}.example/{page}", "<body>" + "".join(f"<div>{x}</div>" for x in p) + "</body>", "s", "t"))
            streams.setdefault(host, []).append((page, p))
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string, stream string, text string").repartition(5)).collect()}
    want = {page: t for found in streams.values() for (page, _), t in zip(found, host_texts([p for _, p in found]))}
    assert got == want
    for found in streams.values():  # the same in one place
        assert html_text.extract_group(["".join(f"<div>{x}</div>" for x in p) for _, p in found]) == [want[page] for page, _ in found]


def test_html_table(spark):
    rows = [(k, f"http://h{k % 3}.example/x", f"<article><p>text {k}</p></article>", "z") for k in range(30)] + [(100, None, None, "z"), (101, "http://h1.example", "", "z"), (5, "http://h2.example/x", "<article><p>text 5</p></article>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _host string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == sorted([(k, f"text {k}", 5 + len(str(k))) for k in range(30)] + [(100, "", 0), (101, "", 0), (5, "text 5", 6)])
    assert html_text.extract(pages.limit(0)).count() == 0


# --- op3


def group_lines(texts, key=lambda w: " ".join(w)):
    import re

    out, first = {}, {}
    for k, t in enumerate(texts):
        for pos, line in enumerate((t or "").split("\n")):
            w = [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", line.lower()) if x]
            if w and first.setdefault(key(w), (k, pos)) != (k, pos):
                out.setdefault(k, []).append(pos)
    return out


def test_equal_lines(docs, texts, empty):
    got = {r.doc_id: r for r in line_dedup.judge(docs).collect()}
    assert len(got) == len(texts)
    for k, gone in group_lines(texts).items():  # equal lines go at least
        assert set(gone) <= set(got[k].removed)
    assert all(r.n_lines == len((texts[k] or "").split("\n")) and r.n_removed == len(r.removed) for k, r in got.items())
    assert line_dedup.judge(empty).count() == 0


def test_fuzzy_lines(spark):
    """All pairs by brute force over the operator's own fingerprints: links are those within the bits and edits."""
    r = random.Random(5)
    base = [[f"{r.choice('abcdefgh')}{r.randrange(90)}" for _ in range(r.randrange(8, 60))] for _ in range(12)]
    lines = []
    for w in base:
        for _ in range(8):
            x = list(w)
            for _ in range(r.randrange(0, 4)):
                x[r.randrange(len(x))] = f"n{r.randrange(300)}"
            lines.append(" ".join(x))
    r.shuffle(lines)
    lines.append(" ".join(f"long{k % 700}" for k in range(1500)))
    lines.append(" ".join(f"long{k % 700}" for k in range(1499)) + " other")
    docs = spark.createDataFrame([(k, "\n".join(lines[k * 7 : k * 7 + 7])) for k in range(-(-len(lines) // 7))], "doc_id long, text string")
    prints = {(x.doc_id, x.pos): x for x in line_dedup.fingerprints(docs).collect()}
    at = [(k // 7, k % 7) for k in range(len(lines))]
    codes = [w.split(" ") for w in lines]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            x, y = prints[at[a]], prints[at[b]]
            able = min(x.n, y.n) >= line_dedup.LEAST_WORDS and min(x.balanced, y.balanced) >= line_dedup.LEAST_BALANCED
            near = able and (x.sim ^ y.sim).bit_count() <= line_dedup.BITS_APART
            if lines[a] == lines[b] or near and edits(codes[a], codes[b]) <= max(len(codes[a]), len(codes[b])) // 10:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    want = {at[k] for k in range(len(lines)) if find(k) != k}
    got = {(x.doc_id, pos) for x in line_dedup.judge(docs).collect() for pos in x.removed}
    assert got == want and any(lines[k] != lines[find(k)] for k in range(len(lines)))
    assert prints[at[-1]].n == 1500
    kept = {x.doc_id: x.text.split("\n") for x in line_dedup.dedup(docs).collect()}
    assert sum(map(len, kept.values())) == len(lines) - len(want)


@pytest.mark.parametrize("crowd", [2, 16])
def test_lines_around_one_passage(spark, monkeypatch, crowd):
    """Lines that share a long passage meet by their rarest runs; the links are those of all pairs by brute force."""
    monkeypatch.setattr(linkage, "CROWD", crowd)
    r = random.Random(3)
    some = lambda n: [f"{r.choice('abcdef')}{r.randrange(400)}" for _ in range(n)]
    passages, lines = [some(50), some(25)], []
    for k in range(60):
        base = some(r.randrange(0, 130)) + passages[k % 2] + some(r.randrange(0, 40))
        for _ in range(r.choice([1, 1, 2, 3, 5])):
            z = list(base)
            for _ in range(r.randrange(0, max(1, len(z) // 8))):
                z[r.randrange(len(z))] = some(1)[0]
            lines.append(z if r.random() < 0.7 else z[:-1])
    lines = [" ".join(x) for x in lines]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id for x in line_dedup.judge(docs).collect() if x.n_removed}
    assert got == gone_by_edits(lines) and got


def test_parities_hold_back_long_lines(spark, monkeypatch):
    """Long lines that share a passage and nothing else meet in a bucket, but no pair of them is compared as a candidate."""
    r = random.Random(23)
    passage = [f"passage{k}" for k in range(200)]
    lines = [" ".join(passage + [f"x{r.randrange(10**6)}" for _ in range(200)]) for _ in range(14)]
    lines += [lines[3].replace("passage7 ", "other ", 1), lines[9].replace("passage11 passage12 ", "passage11 ", 1)]
    compared, stored = [], linkage.stored

    def counting(df, name):
        out = stored(df, name)
        if name == "rest":
            compared.append(out.count())
        return out

    monkeypatch.setattr(linkage, "stored", counting)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id for x in line_dedup.judge(docs).collect() if x.n_removed}
    assert got == gone_by_edits(lines) == {14, 15}
    assert sum(compared) <= 2


def rows_stored(monkeypatch, name):
    """Gets the rows of the table that line_dedup stores under `name`."""
    rows, stored = [], line_dedup.stored

    def counting(df, called):
        out = stored(df, called)
        if called == name:
            rows.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", counting)
    return rows


def test_lines_without_partner_are_not_read(spark, monkeypatch):
    """Of many lines with a run in common, only those that lengths and parities let be linked are read a second time."""
    r = random.Random(29)
    lines = [" ".join(["extraordinarily", "incomprehensible", "characteristics"] + [f"{r.choice('abcd')}{r.randrange(10**6)}" for _ in range(20 + k)]) for k in range(24)]
    lines += [lines[5].replace("characteristics", "other"), lines[17] + " more"]
    read = rows_stored(monkeypatch, "candidate-lines")
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id for x in line_dedup.judge(docs).collect() if x.n_removed}
    assert got == gone_by_edits(lines) == {24, 25}
    assert read == [4]


def test_equal_buckets_are_one(spark, monkeypatch):
    """Two near lines have many keys in common and meet once."""
    line = [f"some{k}" for k in range(60)]
    lines = [" ".join(line), " ".join([*line[:30], "other", *line[31:]])]
    rows = rows_stored(monkeypatch, "shared-keys")
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [x.doc_id for x in line_dedup.judge(docs).collect() if x.n_removed] == [1]
    assert rows == [2]


@pytest.mark.parametrize("scan, crowd", [(1, 64), (3, 3)])
def test_large_buckets_keep_their_lines(spark, monkeypatch, scan, crowd):
    """Above the limit on looking for partners all lines of a bucket go on; the links are those of all pairs."""
    monkeypatch.setattr(line_dedup, "SCAN", scan)
    monkeypatch.setattr(linkage, "CROWD", crowd)
    r = random.Random(31)
    some = lambda n: [f"{r.choice('abcdef')}{r.randrange(300)}" for _ in range(n)]
    passage, lines = some(20), []
    for _ in range(25):
        base = some(r.randrange(0, 60)) + passage + some(r.randrange(0, 20))
        for _ in range(r.choice([1, 2, 4])):
            z = list(base)
            for _ in range(r.randrange(0, max(1, len(z) // 8))):
                z[r.randrange(len(z))] = some(1)[0]
            lines.append(" ".join(z))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id for x in line_dedup.judge(docs).collect() if x.n_removed}
    assert got == gone_by_edits(lines) and got


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def gone_by_edits(lines):
    """The lines that go if all pairs within the edit bound are links, by brute force."""
    words, at = [x.split(" ") for x in lines], list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            most = max(len(words[a]), len(words[b])) // 10
            if at[a] != at[b] and abs(len(words[a]) - len(words[b])) <= most and word_edits(words[a], words[b]) <= most:
                at = [min(at[a], at[b]) if x in (at[a], at[b]) else x for x in at]
    return {k for k, x in enumerate(at) if x != k}


def test_all_near_lines(spark):
    """Every pair within the edit bound is a link, whatever the SimHashes: substituted, dropped and added words, up to the full tenth."""
    r = random.Random(17)
    lines, fresh = [], iter(range(100_000))
    for n in (9, 10, 10, 11, 17, 18, 19, 20, 28, 29, 30, 39, 60, 100, 199):
        base = [f"{r.choice('abcdefgh')}{r.randrange(900)}" for _ in range(n)]
        lines.append(" ".join(base))
        for kind in ("change", "drop", "add", "mixed", "spread"):
            x = list(base)
            for e in range((n + (kind in ("add", "mixed"))) // 10 or 1):
                at = e * 10 + 4 if kind == "spread" else r.randrange(len(x))
                how = r.choice(("change", "drop", "add")) if kind == "mixed" else kind
                x[min(at, len(x) - 1) : min(at, len(x) - 1) + (how != "add")] = [] if how == "drop" else [f"new{next(fresh)}"]
            lines.append(" ".join(x))
    want = gone_by_edits(lines)
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    assert {x.doc_id for x in line_dedup.judge(docs).collect() if x.n_removed} == want and len(want) > 50


def test_unbalanced_near_lines(spark):
    """Lines of 11 distinct words, and lines in which a few words dominate, are linked as others are."""
    lines = []
    for k in range(12):
        x = [f"p{k}x{j}" for j in range(11)] if k % 2 else [("and", "or", f"q{k}")[min(j, 37 - j) % 3] for j in range(38)]
        lines += [" ".join(x), " ".join([*x[:5], f"other{k}", *x[6:]])]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    want = gone_by_edits(lines)
    assert {x.doc_id for x in line_dedup.judge(docs).collect() if x.n_removed} == want and len(want) >= 12


def test_fingerprint_bits(spark):
    """The packed counters against one count per bit."""
    from pyspark.sql import functions as F

    r = random.Random(6)
    texts = [" ".join(f"v{r.randrange(50)}" for _ in range(n)) for n in (1, 2, 8, 53, 199, 200, 201, 400, 950)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = spark.createDataFrame([(f"v{k}",) for k in range(50)], "w string").select("w", F.xxhash64("w").alias("x"))
    hashes = {x.w: x.x % (1 << 64) for x in words.collect()}
    for x in line_dedup.fingerprints(docs).collect():
        w = [hashes[y] for y in texts[x.doc_id].split()]
        sums = [sum(h >> b & 1 for h in w) for b in range(63)]
        assert x.n == len(w) and x.sim == sum((2 * s > len(w)) << b for b, s in enumerate(sums))
        assert x.balanced == sum(abs(2 * s - len(w)) <= len(w) // 4 for s in sums)


# --- op4


@pytest.mark.parametrize(
    "text, base, all_spans",
    [
        ("mail a.b@c-d.co.uk, or x@y", "email:5:18", "email:5:18"), ("a@b.c@d.e @f.g", "email:0:5", "email:0:5"), ("1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004", "ip:0:7,ip:8:15,ip:26:42", None), ("4111 1111-1111 1111 4111111111111112", "card:0:19" if False else "", None),
        ("pay 4111-1111 1111 1111.", "card:4:23", "card:4:23"), ("+1 (555) 555-1234 and +12", "phone:0:17", "phone:0:17"), ("", "", ""), ("nothing here", "", ""),
        ("john [at] example (dot) com", "", "email:0:27"), ("write to john dot doe at example dot com please", "", "email:9:40"), ("look at the dot in it", "", ""), ("jоhn@example.com", "email:2:16", "email:0:16,email:2:16"), ("４１１１ １１１１ １１１１ １１１１", "", "card:0:19"),
        ("plus one five five five one two three four five six seven", "", "phone:0:57"), ("192 dot one six eight dot one dot one", "", "ip:0:37"), ("jo​hn@exa​mple.com", "", "email:0:18"), ("one of them, two of us at home", "", ""), ("4111 1111 1111 111l ok 4O12 8888 8888 1881", None, None),
    ],
)
def test_pii(spark, text, base, all_spans):
    found = pii.base_spans(text)
    if base is not None:
        assert pii._joined(found) == base
    spans = sorted({*found, *pii.disguised_spans(text, found)}, key=lambda x: (x[0], pii.KINDS.index(x[2]), x[1]))
    if all_spans is not None:
        assert pii._joined(spans) == all_spans
    assert set(found) <= set(spans)


def test_pii_table(spark, docs, empty):
    rows = [(0, "mail a@b.co and john [at] example [dot] com"), (1, None), (2, ""), (3, "x" * 200_000 + "@" + "1." * 1000 + " 4" * 3000), (4, "card 4111111111111111")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0].n_email, got[0].spans) == (1, "email:5:11,email:16:43")
    assert got[0].base_sha256 == hashlib.sha256(b"email:5:11").hexdigest()
    assert got[1].spans == got[2].spans == "" and got[4].n_card == 1
    assert pii.redact(rows[0][1], got[0].spans) == "mail [email] and [email]"
    assert pii.find_pii(docs).count() == docs.count() and pii.find_pii(empty).count() == 0


def test_pii_gate(spark):
    """Whatever the transducers find is found in the table too: no row with a disguise stops at the linear scan."""
    texts = [
        "+1 415–555–0123", "+49 30 1234 5678", "4111\u00a01111\u00a01111\u00a01111", "+49\u00a030\u00a01234\u00a05678", "4111‐1111‑1111–1111", "192.168.one.one", "one.168.1.1", "plus four nine 30 1234 5678",
        "john‑doe@example.com", "1.2.3\u2003dot\u20034", "plus\u2009one\u2009five five five five one two three four five six",
    ]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hidden = 0
    for k, text in enumerate(texts):
        base = pii.base_spans(text)
        more = pii.disguised_spans(text, base)
        hidden += bool(more)
        assert got[k] == pii._joined(sorted({*base, *more}, key=lambda x: (x[0], pii.KINDS.index(x[2]), x[1]))), text
    assert hidden == len(texts) - 1  # the second is plain


# --- op5


def test_arc_versions():
    blocks = [b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nab\n\nc", b"", b"filedesc: no\nhttp://x 1 2 3 4\n"]
    for version in (1, 2):
        data = warc.arc_head("f.arc", version=version) + b"".join(warc.arc_block(f"http://a/{k} b", "20010203", x, version) for k, x in enumerate(blocks))
        got = list(warc.arc_records(data))
        assert [(r["url"], r["block"]) for r in got] == [(f"http://a/{k} b", x) for k, x in enumerate(blocks)]
        whole = b"".join(warc.convert(r) for r in got)
        records = list(warc.warc_records(whole))
        assert [b for _, b in records] == blocks
        assert records[0][0]["WARC-Date"] == "2001-02-03T00:00:00Z" and records[0][0]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"ab\n\nc").digest()).decode()
        assert [f["WARC-Type"] for f, _ in records] == ["response", "resource", "resource"]
    for bad in (b"http://a 0 0 0 99\nshort", b"one two\nx", b"no line end"):
        with pytest.raises(ValueError):
            list(warc.arc_records(bad))


def test_arc_files_and_export(spark, tmp_path):
    data = warc.arc_head("f.arc") + warc.arc_block("http://a", "20010203040506", b"HTTP/1.0 200 OK\r\nX-Page-Id: 4\r\n\r\nhello")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.arc").write_bytes(data)
    (tmp_path / "in/b.arc.gz").write_bytes(gzip.compress(data[:70]) + gzip.compress(data[70:]))
    parts = warc.arc_files(spark, str(tmp_path / "in"))
    got = warc.read_back(parts).collect()
    assert {(r.page_id, r.payload_bytes, r.record_type, r.warc_date) for r in got} == {(4, 5, "response", "2001-02-03T04:05:06Z")} and len(got) == 2
    warc.export(parts, f"file://{tmp_path}/out")
    files = sorted((tmp_path / "out").iterdir())
    assert [f.name for f in files] == ["a-00000.warc.gz", "b-00000.warc.gz"]
    assert len(list(warc.warc_records(gzip.decompress(files[0].read_bytes())))) == 1


def test_archive(spark):
    rows = [(k, f"http://h/{k} é", f"<p>{k % 4}</p>" * (k % 5)) for k in range(40)] + [(50, None, None), (51, "", ""), (7, "http://h/7 é", "<p>3</p><p>3</p>"), (39, "again", "<p>3</p>" * 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    most = {}
    for p, _, h in rows:
        most[h or ""] = max(p, most.get(h or "", p))
    want = sorted((p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if most[h or ""] == p else "revisit", None if most[h or ""] == p else most[h or ""]) for p, _, h in rows)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_back(warc.archive(pages)).collect()), key=lambda x: (x[0], x[1]))
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    assert all(r.record_type == "response" for r in warc.read_back(warc.archive(pages, least_bytes=1000)).collect())
    assert warc.read_back(warc.archive(pages.limit(0))).count() == 0


# --- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    prose = lambda n: " ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(400)}" for _ in range(n))
    item = prose(30)
    texts = [f"{prose(40)}.\n{prose(40)}." for _ in range(20)]
    texts += [texts[0], texts[1].replace(" ", "  ", 1), f"{prose(40)} {item}.", "short", None, " ".join(["junk"] * 80) + "."]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(20)) and all(x.round_trip for x in out.values())
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    for _, stage in corpus_pipeline.STAGES:  # empty tables
        assert stage(spark, step.limit(0), str(tmp_path)).count() == 0


# --- op4, properties


def contract_spans(text):
    """The contract's patterns as they are written, with their checks."""
    import re

    def luhn(d):
        s = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in s) % 10 == 0

    digits = lambda x: "".join(re.findall("[0-9]", x))
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(digits(x)) <= 15),
    }
    found = [(m.start(), m.end(), kind) for kind, (pattern, ok) in kinds.items() for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(found, key=lambda x: (x[0], pii.KINDS.index(x[2]), x[1]))


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(9)
    parts = ["a", "b.c", "@", ".", "-", " ", "1", "22", "255", "256", "+", "+49", "(", ")", "4111 1111 1111 1111", "378282246310005", "x@y.z", "..", "é", "%", "0"]
    for _ in range(30_000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert pii.base_spans(text) == contract_spans(text), text


def test_gate_lets_every_disguise_pass():
    """The scan of a batch gives what the transducers give without a gate, on random disguised text."""
    import pyarrow as pa

    r = random.Random(10)
    parts = ["john", "doe", " at ", " dot ", "(at)", "[dot]", "example", "com", "one", "two", "three", " ", "-", ".", " ", "–", "‑", "４", "1", "9", "O", "l", "plus", "+", "о", "​", "{ . }", " ", "zero", "192", "4111"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 16))) for _ in range(20_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    got = [x for b in pii._scan("doc_id", "text")(iter([batch])) for x in b.column("spans").to_pylist()]
    for text, spans in zip(texts, got):
        base = pii.base_spans(text)
        assert spans == pii._joined(sorted({*base, *pii.disguised_spans(text, base)}, key=lambda x: (x[0], pii.KINDS.index(x[2]), x[1]))), text
