"""Line-first quality rules in DataFrame expressions only: no shuffle, no Python on the executors.

Every line is judged by itself; failing lines go, and a document goes if it loses too much text or fails
a base rule. Words are runs of characters other than space and U+0009 to U+000D.

Defined results: a null, empty or blank text has no words, fails the base rules and is not kept; its
cleaned text is empty. Rows are judged one by one, so repeated rows stay repeated. `clean` passes further
columns through and leaves alone any that are named like its own intermediate ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document that loses more than this share of the characters of its lines goes.
MAX_LOST_PERCENT = 50
#: Lines of this many words or more must end like a sentence.
LONG_LINE_WORDS = 8

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# What a line of prose may end with, separators of navigation, and phrases of page furniture.
SENTENCE_END = "[.!?…:;,\"'”’»)\\]。！？]$"
NAVIGATION = r"^[^|»›•·>]*([|»›•·>][^|»›•·>]*){3,}$"
BOILERPLATE = r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|enable javascript|javascript is disabled|click here|sign (up|in) (now|here|to)|log in to|subscribe to our|lorem ipsum)\b"
PUNCTUATION_RUN = r"[#*$%&|<>=_~^+]{3}"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated(w: Column) -> Column:
    """Words that lie in a window of three words which occurs twice or more."""

    def marked(s: Column) -> Column:
        # s: (h, i) sorted by hash; starts of windows that have an equal neighbour, in text order
        def equal(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
            after = F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            return F.when(i > 0, before | after).otherwise(after)

        return F.sort_array(F.transform(F.filter(s, equal), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(g: Column) -> Column:
        rows = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(rows, lambda s: let(marked(s), covered)))

    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(windows, count).cast("long")


def line_fails(line: Column) -> Column:
    trimmed = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return let(
        trimmed,
        lambda x: (
            ((F.size(F.split(x, SPACE)) >= LONG_LINE_WORDS) & ~x.rlike(SENTENCE_END))
            | x.rlike(NAVIGATION)
            | (F.length(F.regexp_replace(x, PUNCTUATION_RUN, "")) * 10 < F.length(x) * 8)
            | x.rlike(BOILERPLATE)
        ),
    )


def rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, cleaned, and the counts and verdicts of each row)."""
    blank = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]")
    whole = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(F.col(key), F.col(text)).select(
        F.col(key),
        F.col(text),
        let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated(w).alias("n_repeat_words"))).alias("_w"),
        let(
            F.split(whole, "\n"),
            lambda a: let(
                F.filter(a, lambda x: ~blank(x)),
                lambda full: let(
                    F.filter(full, lambda x: ~line_fails(x)),
                    lambda good: F.struct(
                        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                        F.array_join(good, "\n").alias("cleaned"),
                        F.length(F.array_join(full, "")).alias("before"),
                        F.length(F.array_join(good, "")).alias("after"),
                    ),
                ),
            ),
        ).alias("_l"),
        F.length(F.translate(whole, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    failed = (F.col("_w.n_words") < MIN_WORDS) | (100 * F.col("_w.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_w.n_words"))
    lost = (F.col("_l.before") - F.col("_l.after")) * 100 > F.col("_l.before") * MAX_LOST_PERCENT
    return facts.select(
        key, text, F.col("_l.cleaned").alias("cleaned"), F.col("_w.n_words").alias("n_words"), "word_chars", "n_symbols",
        F.col("_l.n_dup_lines").alias("n_dup_lines"), F.col("_w.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & ~lost).alias("kept"),
    )


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with their cleaned texts, other columns as they are (n_chars follows the text)."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    judged = rules(packed, "_row", "_text").where("kept")
    out = judged.select("_row.*", F.col("cleaned").alias("_cleaned"))
    columns = [F.col("_cleaned").alias(text) if c == text else F.length("_cleaned").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)
