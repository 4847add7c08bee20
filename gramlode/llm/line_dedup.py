"""Fuzzy removal of repeated lines, in DataFrame expressions only.

Lines are normalised to lower-case words (ASCII punctuation as separators). Equal normalised lines are one
class. Two classes are linked if the edit distance of their words is at most a tenth of the longer line's words.
Words stand for it as characters, by a hash of CODES values. Of each connected group the first line by doc_id and
line number stays; all its other occurrences go.

Every pair within that bound is compared. An edit changes at most GRAM of a line's runs of GRAM words, so with k
edits all but GRAM k runs of the longer line are in both. In any fixed order of the runs the first GRAM k + 1 of each
line then have one in common: these are the join keys, and long words, which are rare, come first in the order. Keys
travel with their line's hash only, and those of a single line go no further. Lines that meet are compared if their
lengths allow it, and so do their parities, those in 256 bits for all but the leaders of a bucket. A line that no other
line of its bucket can be linked to by lengths and parities leaves the bucket before any text is read again; buckets of
over SCAN lines keep all of theirs. Where very many lines meet, because they have a passage in common, their runs are
counted and the rarest come first: what many of them share is then seldom among the first runs.

Blocks of SimHash bits are not the keys, because they lose most such pairs: two lines of 10 to 40 words that differ in
one word agree within 3 of 63 bits in 1 to 19 of 100 cases. `fingerprints` gives the SimHash of lines; links don't
depend on it. Its sums are kept as seven counters of 9 bits in a long, nine longs for up to CHUNK words, which the map
side adds up before the shuffle; lines with more words have several such rows, added up by bit.

Defined results: null and empty texts have one line without words; lines without words always stay. Rows with
equal id and text are one document and lose the same lines, so both keep their first occurrence; further
columns pass through `dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import linkage
from .common import discard, let, lookup, session, spread, stored

#: Limits on the SimHashes of linked lines, which at these values exclude none.
BITS_APART, LEAST_BALANCED = 63, 0
#: A line of fewer words can't be within a tenth of its words of another.
LEAST_WORDS = 8
#: Percent of its characters that a document can lose in the pipeline: near duplicates share three quarters.
MOST_LOST = 75
#: Words of a run, bits of a key that hold its hash, and the length from which words count as equally long.
GRAM, HASH_BITS, LONGEST = 3, 55, 42
#: Characters that words become for the edit distance: all from U+10000 on, a power of two of them.
CODES = 1 << 20
#: 63 bits as 9 longs of 7 counters; a counter of 9 bits takes up to CHUNK words, a quarter more for comparisons.
_LANES, _WIDTH, CHUNK = 7, 9, 200
_ONES = sum(1 << _WIDTH * k for k in range(_LANES))
#: ASCII without letters and digits, one by one: Java looks such a class up in a table, and tests ranges one after the other.
SEPARATORS = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
#: Lines of a bucket up to which each looks for one that it can be linked to; the square of it bounds the work on a bucket.
SCAN = 4096


def normal_words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), SEPARATORS), "")


def codes(words: Column) -> Column:
    """A number below CODES for each word."""
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(CODES - 1)))


def coded(codes: Column) -> Column:
    """A string with a character for each code, from U+10000 on: in UTF-16 two units of ten bits each, eight hex digits."""
    units = F.transform(codes, lambda c: F.hex(F.shiftleft(c, 6).bitwiseAND(F.lit(0x3FF0000)) + c.bitwiseAND(F.lit(0x3FF)) + F.lit(0xD800DC00)))
    return F.decode(F.unhex(F.array_join(units, "")), "UTF-16BE")


def row_key(docs: DataFrame, key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, pos, words) of every line. (No filter here: it would split each line a second time.)"""
    # what is computed once a document stands below the explode
    cut = docs.select(F.col(key).alias("doc_id"), row_key(docs, key, text).alias("row"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("all"))
    split = cut.select("doc_id", "row", F.posexplode("all").alias("pos", "line"))
    return split.select("doc_id", "row", "pos", normal_words(F.col("line")).alias("words"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, pos, h, n, sim, balanced) of every line with words.

    n: words; balanced: sums of the SimHash that are at most a quarter of n from zero.
    """
    whole = lines(docs, key, text).select("doc_id", "row", "pos", "words", F.xxhash64("words").alias("h"))  # once a line, so below the explode
    words = whole.select("doc_id", "row", "pos", "h", F.posexplode("words").alias("at", "word"))
    hashed = words.select("doc_id", "row", "pos", "h", F.expr(f"cast(at div {CHUNK} as int)").alias("chunk"), F.xxhash64("word").alias("x"))
    line = ["doc_id", "row", "pos", "h"]
    sums = [F.sum(F.shiftrightunsigned("x", j).bitwiseAND(F.lit(_ONES))).alias(f"s{j}") for j in range(_WIDTH)]
    chunks = hashed.groupBy(*line, "chunk").agg(F.count("*").alias("n"), *sums)

    def bits(above: Column) -> Column:
        """A bit for each counter c with 2 c > above: the top bit of 2 c + 2^8 - 1 - above, for all counters at once."""
        level = (F.lit((1 << _WIDTH - 1) - 1) - above) * F.lit(_ONES)
        found = [F.shiftleft(F.shiftrightunsigned(F.col(f"s{j}") * 2 + level, _WIDTH - 1).bitwiseAND(F.lit(_ONES)), j) for j in range(_WIDTH)]
        out = found[0]
        for b in found[1:]:
            out = out.bitwiseOR(b)
        return out

    n, quarter = F.col("n"), F.expr("n div 4")
    last = (F.col("chunk") == 0) & (n < CHUNK)
    balanced = (F.bit_count(bits(n - quarter - 1)) - F.bit_count(bits(n + quarter))).cast("long")
    counters = F.when(~last, F.array(*(f"s{j}" for j in range(_WIDTH))))  # for lines of several chunks only
    chunks = stored(chunks.select(*line, "n", bits(n).alias("sim"), balanced.alias("balanced"), counters.alias("counters")), "chunks")
    short = chunks.where("counters is null").drop("counters")
    by_bit = chunks.where("counters is not null").select(*line, "n", F.posexplode("counters").alias("j", "s")).select(*line, "n", "j", F.posexplode(F.array(*(F.shiftright("s", _WIDTH * k).bitwiseAND(F.lit((1 << _WIDTH) - 1)) for k in range(_LANES)))).alias("k", "c"))
    summed = by_bit.groupBy(*line, "j", "k").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    bit = F.when(F.col("c") * 2 > n, F.expr(f"shiftleft(1L, j + {_WIDTH} * k)")).otherwise(F.lit(0).cast("long"))
    near = F.count_if(F.abs(F.col("c") * 2 - n) <= quarter)
    long = summed.groupBy(*line).agg(F.first("n").alias("n"), F.bit_or(bit).alias("sim"), near.alias("balanced")).select(*line, "n", "sim", "balanced")
    return short.unionByName(long)


def run_sums(numbers: Column) -> Column:
    """The sums of all runs of GRAM numbers. (Never null, which lets Spark sort them as longs.)"""
    first = F.slice(numbers, 1, F.size(numbers) - (GRAM - 1))
    return F.transform(first, lambda x, i: F.coalesce(sum((F.get(numbers, i + k) for k in range(1, GRAM)), x), F.lit(0).cast("long")))


def first_runs(n: Column) -> Column:
    """How many of a line's runs, in any fixed order, two lines within the edit bound need to have one in common."""
    # a longer line may allow one edit more; it is at least 10 - n % 10 words longer then, and has as many runs more
    return F.floor(n / 10).cast("int") * GRAM + 1 + F.greatest(F.lit(0), n % 10 + (GRAM - 10))


def gram_keys(words: Column) -> Column:
    """The first runs of a line: lines within the edit bound have one in common.

    A run's key is the sum of its words' numbers, which are the word's hash less its length in higher bits: the order of the
    words in a run doesn't count, and no word is hashed for more than one run.
    """
    n = F.size(words)
    numbers = F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 66 - HASH_BITS) - F.shiftleft(F.least(F.octet_length(w), F.lit(LONGEST)).cast("long"), HASH_BITS))
    return F.slice(F.sort_array(let(numbers, run_sums)), 1, first_runs(n))


def rare_keys(lines: DataFrame) -> DataFrame:
    """(key, id): the first runs of coded lines (id, line), those in the fewest lines first, without those of a single line."""
    numbers = F.transform(F.split("line", ""), lambda c: F.shiftrightunsigned(F.xxhash64(c), 3))
    runs = lines.select("id", F.length("line").alias("n"), F.explode(let(numbers, run_sums)).alias("run"))
    runs = stored(runs.groupBy("id", "n", "run").agg(F.count("*").cast("int").alias("times")), "line-runs")
    counted = runs.groupBy("run").agg(F.count("*").alias("lines")).where("lines > 1")
    shared = stored(counted.select("*", F.col("lines").alias("_rows")), "run-counts")  # `lookup` reads it three times
    marked = lookup(runs, shared, "run", "_rows").where("lines is not null")
    whole = marked.groupBy("id", "n").agg(F.sum("times").alias("known"), F.sort_array(F.collect_list(F.struct("lines", "run", "times"))).alias("runs"))
    # runs of this line alone come before all others
    left = (first_runs(F.col("n")) - (F.col("n") - (GRAM - 1) - F.col("known"))).cast("int")
    ordered = F.flatten(F.transform("runs", lambda r: F.array_repeat(r["run"], r["times"])))
    keys = whole.withColumn("_left", left).where("_left > 0").select(F.explode(F.array_distinct(F.slice(ordered, 1, F.col("_left")))).alias("key"), "id")
    out = stored(keys, "rare-keys")
    discard(runs, shared)
    return out


def flips(n: Column, m: Column) -> Column:
    """The most bits in which the parities of linked lines of n and m words differ: an added or dropped word flips one, a changed one two."""
    return 2 * F.floor(F.greatest(n, m) / 10) - F.abs(n - m)


def parity(words: Column) -> Column:
    """64 bits, of which each word flips one: k edits change at most 2 k of them. (A shift counts modulo 64.)"""
    return F.aggregate(words, F.lit(0).cast("long"), lambda x, w: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(w))))


#: Columns of a coded line's parities in 256 bits: with 64, lines of many words that are far apart often seem near.
_WIDE = [f"wide{j}" for j in range(4)]


def wide_parity(codes: Column) -> list[Column]:
    """The columns _WIDE of a line's codes: each flips one of their bits, so k edits change at most 2 k of them."""
    places = F.transform(codes, lambda c: F.hash(c).bitwiseAND(F.lit(64 * len(_WIDE) - 1)))

    def lane(j: int) -> Column:
        mine = lambda x, p: F.when(F.shiftright(p, 6) == j, x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), p))).otherwise(x)
        return let(places, lambda a: F.aggregate(a, F.lit(0).cast("long"), mine))

    return [lane(j).alias(c) for j, c in enumerate(_WIDE)]


def admit(x: str, y: str) -> Column:
    """Whether the lengths and parities of two lines (n, parity) let them be linked."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (F.abs(n - m) <= F.floor(F.greatest(n, m) / 10)) & (F.bit_count(F.col(f"{x}.parity").bitwiseXOR(F.col(f"{y}.parity"))) <= flips(n, m))


def with_partners(keys: DataFrame) -> DataFrame:
    """The rows of keys (key, id, rank, n, parity, _crowd) that `admit` lets be linked to another of their key, and all of a crowd."""
    few = keys.where("not _crowd").drop("_crowd")
    x, y = few.alias("x"), few.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & admit("x", "y")
    return x.join(y, same, "left_semi").unionByName(keys.where("_crowd").drop("_crowd"))


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, removed): line numbers that go, for every row key with any."""
    session(docs.sparkSession)
    # one pass over the words: a filter before the table is written would split each line a second time
    words, n = F.col("words"), F.size("words")
    whole = lines(docs, key, text).select("doc_id", "row", "pos", F.xxhash64("words").alias("h"), n.alias("n"), parity(words).alias("parity"), F.when(n >= LEAST_WORDS, gram_keys(words)).alias("keys"))
    every = stored(whole, "lines-and-keys")
    found = every.where("n > 0")
    keyed = stored(found.groupBy("h").agg(F.min(F.struct("doc_id", "pos", "row")).alias("first"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.count("*").alias("count"), F.first("keys").alias("keys")), "keyed-classes")
    found = stored(found.select("doc_id", "row", "pos", "h"), "lines")
    discard(every)
    # keys leave with nothing but the class; most are in one class only and go no further
    dealt = keyed.where("keys is not null").select(F.explode("keys").alias("key"), "h").repartition("key")
    shared = dealt.groupBy("key").agg(F.min("h").alias("_lo"), F.max("h").alias("_hi")).where("_lo < _hi").select("key")
    met = dealt.join(shared.hint("shuffle_hash"), "key").dropDuplicates(["key", "h"])
    # near lines have many keys in common: a hash of all members is the bucket's name from here on, so that equal buckets are
    # one. Should two others get one name, their members only meet once more.
    bucket = Window.partitionBy("key")
    met = met.select(F.bit_xor("h").over(bucket).alias("name"), "h", (F.count("*").over(bucket) > SCAN).alias("_crowd"))
    met = stored(met.dropDuplicates().withColumnRenamed("name", "key"), "shared-keys")
    classes = stored(keyed.drop("keys"), "line-classes")
    discard(keyed)
    # the most frequent class of a bucket leads: of many variants it is the one that they vary
    keys = met.join(classes, "h").select("key", F.col("h").alias("id"), (-F.col("count")).alias("rank"), "n", "parity", "_crowd")
    keys = stored(with_partners(keys), "partners")
    discard(met)

    texts: DataFrame | None = None

    def verifier(ids: DataFrame):
        at = classes.join(ids, classes["h"] == ids["id"]).groupBy(F.col("first.row").alias("row")).agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "h")).alias("at"))
        whole = docs.select(row_key(docs, key, text).alias("row"), F.col(text).alias("_text"))
        picked = whole.join(at, "row").select(let(F.split("_text", "\n"), lambda a: F.transform("at", lambda p: F.struct(p["h"].alias("h"), F.get(a, p["pos"]).alias("line")))).alias("got"))
        facts = lambda c: F.struct(coded(c).alias("line"), *wide_parity(c))
        nonlocal texts
        texts = stored(picked.select(F.explode("got").alias("g")).select("g.h", let(codes(normal_words(F.col("g.line"))), facts).alias("f")).select("h", "f.*"), "candidate-lines")

        def verify(pairs: DataFrame) -> DataFrame:
            a, b = texts.select(F.col("h").alias("a"), F.col("line").alias("la")), texts.select(F.col("h").alias("b"), F.col("line").alias("lb"))
            edits = F.expr("levenshtein(la, lb, cast(greatest(length(la), length(lb)) div 10 as int))")
            return spread(spread(pairs, b, "b", "a"), a, "a", "b", counted=pairs).select("a", "b", (edits >= 0).alias("linked")).dropDuplicates(["a", "b"])

        return verify

    fresh: DataFrame | None = None

    def refine(ids: DataFrame) -> DataFrame:
        nonlocal fresh
        fresh = rare_keys(texts.select(F.col("h").alias("id"), "line").join(ids, "id", "left_semi"))
        return fresh

    def sketch() -> DataFrame:
        return texts.select(F.col("h").alias("id"), *_WIDE)

    def alike(x: str, y: str) -> Column:
        apart = [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in _WIDE]
        return sum(apart[1:], apart[0]) <= flips(F.col(f"{x}.n"), F.col(f"{y}.n"))

    def once(x: str, y: str) -> Column:
        return F.col(f"{x}.key") == F.array_min(F.array_intersect(f"{x}.prefix", f"{y}.prefix"))

    linked = linkage.link(keys, verifier, admit, ["rank", "n", "parity"], once=once, refine=refine, sketch=sketch, alike=alike)
    discard(keys, texts, *(() if fresh is None else (fresh,)))
    grouped = classes.join(linked.withColumnRenamed("id", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    grouped = stored(grouped.select("h", "component", "first", "count"), "line-groups")
    keep = grouped.groupBy("component").agg(F.min("first").alias("keep"), F.sum("count").alias("rows")).where("rows > 1").select("component", "keep")
    shared = stored(grouped.select("h", "component", "count").join(keep, "component").select("h", "keep", "count"), "line-keepers")
    marked = lookup(found.select("doc_id", "row", "pos", "h"), shared, "h", "count")
    gone = marked.where(F.col("keep").isNotNull() & ~F.struct("doc_id", "pos", "row").eqNullSafe(F.col("keep")))
    return gone.groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, removed: line numbers from 0) of every row."""
    gone = removed(docs, key, text)
    rows = docs.select(F.col(key).alias("doc_id"), row_key(docs, key, text).alias("row"), F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).cast("long").alias("n_lines"))
    numbers = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.join(gone, "row", "left").select("doc_id", "n_lines", F.size(numbers).cast("long").alias("n_removed"), numbers.alias("removed"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", most_lost: int = 100) -> DataFrame:
    """The documents without the lines that go (n_chars follows); a document none of whose lines is left goes too.

    So does one that loses more than `most_lost` percent of its characters, if that is under 100.
    """
    gone = removed(docs, key, text).select(F.col("row").alias("_row"), F.col("removed").alias("_removed"))
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), row_key(docs, key, text).alias("_row"))
    joined = packed.join(gone, "_row", "left")
    kept = F.when(F.col("_removed").isNull(), F.col(f"_doc.{text}")).otherwise(
        F.array_join(F.filter(F.split(F.col(f"_doc.{text}"), "\n"), lambda x, i: ~F.array_contains("_removed", i)), "\n")
    )
    out = joined.select("_doc.*", kept.alias("_kept"), F.col("_removed").isNotNull().alias("_changed"))
    enough = F.length("_kept") * 100 >= F.length(text) * (100 - most_lost)
    out = out.where(~F.col("_changed") | (F.col("_kept").rlike(r"[^\x20\x09-\x0D]") & enough))
    columns = [F.col("_kept").alias(c) if c == text else F.when(F.col("_changed"), F.length("_kept").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)
