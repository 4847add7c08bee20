"""Main text of web pages: structure per page, and suffix arrays per host for what its pages repeat.

Each page becomes blocks of text. Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and
styles are left out by element, role, class or id. Of a page that marks its article, that is the text, and nothing
else is taken away: articles of one host quote each other, and whole paragraphs recur between them.

On the other pages repetition decides. The token streams of a host's distinct pages are dealt into groups of about
GROUP_BYTES. In each group they are concatenated, and their suffixes sorted to RUN tokens by prefix doubling; equal
neighbours give the runs and how many distinct pages have each. These counts are added up over all groups of a host,
so the result doesn't depend on the groups. A run that SHARED_PAGES distinct pages of the host have (or all of its
two) is boilerplate: words that lie in one go, unique runs stay. Equal pages are one page here.

A host with a large share of the pages has many groups, and copies of a page travel once. No page is dropped and no
text is cut off. Runs are told apart by 64-bit hashes.

Defined results: a null or empty html gives an empty text; null URLs form a host of their own; repeated rows
each give a row and count as one page for repetition; an element without an end lasts until the one around it ends, a
script or style until the page does; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, session, stored, tidy
from .exchange import grouped
from .words import SPACE_WORDS, Texts, Windows, mix, slices, window_starts

GROUP_BYTES = 8 << 20
#: Tokens of a run, a power of two, and distinct pages of a host that make one boilerplate.
RUN = 8
SHARED_PAGES = 3

# Element names and the words of class, id and role that mark what is not main text.
CODE = ("script", "style")
RAW = ("textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp")
EXCLUDED = frozenset("head nav header footer aside form menu dialog select button canvas audio video map datalist fieldset template svg math object".split()) | set(CODE) | set(RAW)
#: Elements that end at once with "/>".
FOREIGN = frozenset(("svg", "math"))
EXCLUDED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo banner cookie cookies consent notice notices alert popup modal overlay sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs pagination header masthead footer comment comments disqus respond newsletter subscribe subscription signup login share sharing social related recommended widget search form toolbar complementary contentinfo".split()
)
#: Words that name the place or form of what stands beside them in a class or id, as in "site-header" or "share-buttons".
PLACE_WORDS = frozenset("site page main top bottom left right center inner outer primary secondary global mobile desktop sticky fixed container wrapper wrap box bar block area section list items item links link button buttons panel slot unit row col column group content region zone module component inline js is has the".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind ends an open element of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(CODE)})(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)|<({'|'.join(RAW)})(?=[\s/>])[^>]*+>.*?</\2\s*>|<(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^>]*+>", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


def _marked(attributes: str) -> bool:
    if not attributes.strip():
        return False
    if _HIDDEN.search(attributes):
        return True
    return any(_ruled(name) for m in _NAMES.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split())


def _ruled(name: str) -> bool:
    """A class, id or role that is such a word, or is made of such words and of PLACE_WORDS and numbers."""
    words = [w.lower() for w in _SPLIT.split(name) if w]
    return not EXCLUDED_WORDS.isdisjoint(words) and all(w in EXCLUDED_WORDS or w in PLACE_WORDS or w.isdigit() for w in words)


def blocks(page: str) -> tuple[list[tuple[str, bool]], bool]:
    """(text, inside an article) of each block that structure does not rule out; whether an article is marked."""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, excluded, article; of itself or an element around it
    parts: list[str] = []
    excluded = article = found = False
    at = 0

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, article))
            parts.clear()

    def state():
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    for m in _TOKEN.finditer(page):
        if not excluded and m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[4] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        elif name in VOID:
            if not excluded:
                parts.append(" ")
            continue
        if m[3]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    excluded, article = state()
                    break
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            if name not in ("address",) and stack and stack[-1][0] == "p":
                stack.pop()
            while stack and stack[-1][0] in CLOSES.get(name, ()):
                stack.pop()
            excluded, article = state()
        ruled = name in EXCLUDED and not (name == "header" and article) or name not in ("body", "html", "article", "main") and _marked(m[5])
        inside = name in ("article", "main") or 'role="main"' in m[5]
        if name in BLOCKS or ruled:
            if not (m[5].endswith("/") and name in FOREIGN):
                stack.append((name, excluded or ruled, article or inside and not excluded))
                excluded, article = state()
                found |= article and not excluded
    if not excluded and at < len(page):
        rest = page[at:]
        cut = re.search(r"<[/!?a-zA-Z][^>]*\Z", rest)  # a tag that the end of the page cuts off
        parts.append(rest[: cut.start()] if cut else rest)
    flush()
    return out, found


def repeated_runs(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of texts that have it) of each distinct run of RUN words, from the sorted suffixes of all texts."""
    starts = window_starts(texts.first, RUN)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    n, owner = len(texts.hashes), texts.doc_of_word()
    rank, step = np.unique(texts.hashes, return_inverse=True)[1].astype(np.int64), 1
    while step < RUN:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1]
        step *= 2
    order = starts[np.lexsort((owner[starts], rank[starts]))]  # the suffixes, sorted to their first RUN tokens
    fresh, other = np.ones(len(order), dtype=bool), np.ones(len(order), dtype=bool)
    fresh[1:] = rank[order[1:]] != rank[order[:-1]]
    other[1:] = fresh[1:] | (owner[order[1:]] != owner[order[:-1]])
    return Windows(texts.hashes).of(RUN)[order[fresh]], np.bincount(np.cumsum(fresh) - 1, weights=other).astype(np.int64)


def unique_text(found: list[str], texts: Texts, k: int, shared: np.ndarray) -> str:
    """The blocks of the text with number k without the words that lie in a shared run (sorted hashes)."""
    a, n = int(texts.first[k]), int(texts.n_words[k])
    runs = Windows(texts.hashes[a : a + n]).of(RUN)
    cover = np.zeros(n + 1, dtype=np.int64)
    if len(shared) and len(runs):
        at = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, runs), len(shared) - 1)] == runs)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + RUN, -1)
    free, kept, at = np.cumsum(cover)[:n] == 0, [], 0
    for block in found:
        words = block.split(" ")
        mine = free[at : at + len(words)]
        at += len(words)
        if mine.any():
            kept.append(block if mine.all() else " ".join(w for w, f in zip(words, mine) if f))
    return "\n\n".join(kept)


def _streams(pages: list[list[str]]) -> Texts:
    return Texts(pa.array([" ".join(p) for p in pages], pa.string()), SPACE_WORDS, lower=False)


def extract_group(pages: list[str]) -> list[str]:
    """The main text of each page of one host, in one place."""
    parsed = [blocks(p) for p in pages]
    open_pages = {tuple(t for t, _ in found) for found, article in parsed if not article}
    shared = np.zeros(0, dtype=np.uint64)
    if len(open_pages) > 1:
        runs, n = repeated_runs(_streams([list(p) for p in open_pages]))
        shared = np.sort(runs[n >= min(SHARED_PAGES, len(open_pages))])
    out = []
    for found, article in parsed:
        texts = [t for t, inside in found if inside or not article]
        out.append("\n\n".join(texts) if article else unique_text(texts, _streams([texts]), 0, shared))
    return out


_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.int64()), ("text", pa.string()), ("blocks", pa.list_(pa.string())), ("stream", pa.int64())])
_PARSED_DDL = "page_id long, url string, host long, text string, blocks array<string>, stream long"


def _parse(batches) -> Iterator[pa.RecordBatch]:
    """The text of pages with an article, the blocks of others with a hash of host and words."""
    for batch in slices(batches, "html"):
        rows = []
        for page, url, html, host in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "host"))):
            found, article = blocks(html or "")
            texts = [t for t, inside in found if inside or not article]
            rows.append((page, url, host, "\n\n".join(texts) if article or not texts else None, None if article or not texts else texts))
        joined = Texts(pa.array(["\n".join(r[4] or ()) for r in rows], pa.string()), np.ones(256, dtype=bool), lower=False)  # one word each
        hashes = np.zeros(len(rows), dtype=np.uint64)
        hashes[joined.n_words > 0] = joined.hashes
        stream = mix(hashes + mix(np.array([r[2] for r in rows], dtype=np.int64).view(np.uint64))).view(np.int64)
        columns = [*zip(*rows), stream]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PARSED.types)], schema=_PARSED)


def _count(batches) -> Iterator[pa.RecordBatch]:
    """(run, group, n): how many distinct pages of a group have each run; runs of different hosts differ."""
    for group, rows in grouped(batches, "group"):
        runs, n = repeated_runs(_streams([r["blocks"] for r in rows]))
        host = np.int64(rows[0]["host"]).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(mix(runs + mix(host[None])).view(np.int64)), pa.array(np.full(len(runs), group)), pa.array(n), pa.array(np.full(len(runs), rows[0]["least"]))], names=["run", "group", "n", "least"])


def _strip(batches) -> Iterator[pa.RecordBatch]:
    """(stream, text) of the pages of a group; its first rows are the shared runs."""
    for _, rows in grouped(batches, "group"):
        pages = [r for r in rows if r["blocks"] is not None]
        texts = _streams([r["blocks"] for r in pages])
        host = np.int64(pages[0]["host"]).view(np.uint64)
        wanted = np.array(sorted({x for r in rows for x in r["runs"] or ()}), dtype=np.int64)
        runs = np.unique(Windows(texts.hashes).of(RUN)) if len(wanted) else np.zeros(0, dtype=np.uint64)
        shared = runs[np.isin(mix(runs + mix(host[None])).view(np.int64), wanted)]
        out = [unique_text(r["blocks"], texts, k, shared) for k, r in enumerate(pages)]
        yield pa.RecordBatch.from_arrays([pa.array([r["stream"] for r in pages], pa.int64()), pa.array(out, pa.string())], names=["stream", "text"])


def _without_boilerplate(open_pages: DataFrame) -> DataFrame:
    """(stream, text, copies) of the distinct pages that mark no article."""
    copies = open_pages.groupBy("stream").agg(F.count("*").alias("copies"))
    distinct = stored(open_pages.select("host", "stream", "blocks").dropDuplicates(["stream"]), "html-streams")
    size = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b))
    hosts = distinct.groupBy("host").agg(F.count("*").alias("pages"), F.ceil(F.sum(size) / GROUP_BYTES).alias("groups"))
    hosts = hosts.select("host", "pages", F.greatest("groups", F.lit(1)).alias("groups"), F.least("pages", F.lit(SHARED_PAGES)).alias("least"))
    dealt = lookup(distinct, hosts, "host", "pages").withColumn("group", F.xxhash64("host", F.pmod("stream", "groups")))
    dealt = stored(dealt.repartition("group").sortWithinPartitions("group", "stream"), "html-groups")
    alone = F.col("least") < 2  # the only page of its host
    runs = dealt.where(~alone).select("group", "host", "blocks", "least").repartition("group").sortWithinPartitions("group").mapInArrow(tidy(_count), "run long, group long, n long, least long")
    runs = stored(runs, "html-runs")
    shared = runs.groupBy("run").agg(F.sum("n").alias("n"), F.first("least").alias("least")).where("n >= least").select("run")
    lists = runs.join(shared, "run").groupBy("group").agg(F.collect_list("run").alias("runs"))  # no more than the group has
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    pages = dealt.select("group", "host", "stream", "blocks", none("array<long>", "runs"))
    rows = lists.select("group", none("long", "host"), none("long", "stream"), none("array<string>", "blocks"), "runs").unionByName(pages)
    texts = rows.repartition("group").sortWithinPartitions("group", "stream").mapInArrow(tidy(_strip), "stream long, text string")
    return stored(texts.join(copies, "stream"), "html-texts")


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by an empty line) and n_chars of every page."""
    session(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", F.xxhash64(host_of(F.col("url"))).alias("host"))
    parsed = stored(rows.mapInArrow(tidy(_parse), _PARSED_DDL), "html-blocks")
    out, rest = parsed.where("text is not null").select("page_id", "url", "text"), parsed.where("text is null")
    if not rest.isEmpty():
        out = out.unionByName(lookup(rest.select("page_id", "url", "stream"), _without_boilerplate(rest), "stream", "copies").select("page_id", "url", "text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
