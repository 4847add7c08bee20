"""Lookups in postings: plans over (ngram, fid) that read the wanted grams only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.functions.encoding import gram_key, grams, query_primes

#: Up to so many grams are listed in the filter; more are a join behind a range filter.
LISTED = 2000
#: The same for ranges of grams.
LISTED_RANGES = 200
#: The largest number of query grams that is broadcast (16 bytes each).
BROADCAST = 1 << 20

Grams = bytes | str | Iterable[bytes | int]


def keys_of(wanted: Grams, size: int = 4) -> set[int]:
    """Gram keys of a text, or of a set of grams."""
    if isinstance(wanted, (bytes, str)):
        return grams(wanted, size)
    return {g if isinstance(g, int) else gram_key(g) for g in wanted}


def reading(postings: DataFrame, keys: set[int]) -> DataFrame:
    """The postings of some grams. The filter reaches the scan, whose files are sorted by gram."""
    if len(keys) <= LISTED:
        return postings.where(F.col("ngram").isin(sorted(keys)))
    table = postings.sparkSession.createDataFrame([(k,) for k in sorted(keys)], "ngram long")
    table = F.broadcast(table) if len(keys) <= BROADCAST else table
    return postings.where(F.col("ngram").between(min(keys), max(keys))).join(table, "ngram", "left_semi")


def posting_list(postings: DataFrame, gram: bytes | int) -> DataFrame:
    """(fid) of the samples that have one gram."""
    return reading(postings, keys_of([gram])).select("fid")


def sizes(postings: DataFrame, wanted: Grams | None = None) -> DataFrame:
    """(ngram, n): samples per gram, of all grams or of the wanted ones that occur."""
    rows = postings if wanted is None else reading(postings, keys_of(wanted))
    return rows.groupBy("ngram").agg(F.count("*").alias("n"))


def at_least(postings: DataFrame, wanted: Grams, matches: int) -> DataFrame:
    """(fid) of the samples that have at least `matches` of the grams. Fewer than one match is no condition: no sample."""
    keys = keys_of(wanted)
    if not keys or matches < 1 or matches > len(keys):
        return postings.select("fid").limit(0)
    found = reading(postings, keys)
    return found.groupBy("fid").agg(F.count("*").alias("n")).where(F.col("n") >= matches).select("fid")


def all_of(postings: DataFrame, wanted: Grams) -> DataFrame:
    """(fid) of the samples that have every gram of a text or set; a text shorter than a gram gives none."""
    keys = keys_of(wanted)
    return at_least(postings, keys, len(keys))


def _ranges(trigrams: set[int]) -> Column:
    out = F.lit(False)
    for g in sorted(trigrams):
        out = out | F.col("ngram").between(g << 8, g << 8 | 255)
    return out


def all_of_trigrams(postings: DataFrame, wanted: Grams) -> DataFrame | None:
    """(fid) of the samples that have every 3-gram of a text or set as the start of a gram; None without any.

    A 3-gram at the very end of a sample starts no gram and isn't found.
    """
    keys = keys_of(wanted, 3)
    if not keys:
        return None
    each = reading_trigrams(postings, keys)
    return each.groupBy("fid").agg(F.count("*").alias("n")).where(F.col("n") == len(keys)).select("fid")


def reading_trigrams(postings: DataFrame, keys: set[int]) -> DataFrame:
    """(third, fid) of some 3-grams, once for each sample."""
    third = F.shiftright("ngram", 8)
    if len(keys) <= LISTED_RANGES:
        found = postings.where(_ranges(keys))
    else:
        table = postings.sparkSession.createDataFrame([(k,) for k in sorted(keys)], "third long")
        table = F.broadcast(table) if len(keys) <= BROADCAST else table
        found = postings.where(F.col("ngram").between(min(keys) << 8, max(keys) << 8 | 255)).join(table, third == F.col("third"), "left_semi")
    return found.select(third.alias("third"), "fid").distinct()


def grouped_all_of(postings: DataFrame, wanted: Grams, numsamples: int, width: int, tau: int | None = None) -> DataFrame | None:
    """(fid) of a conjunctive lookup with lists of at most tau entries folded by a prime; None without any gram.

    A folded list stands for every id with one of its remainders, so the result can be larger than
    the exact one. Longer lists are taken as they are.
    """
    keys = keys_of(wanted)
    if not keys:
        return None
    primes = query_primes(width)
    n = {r["ngram"]: r["n"] for r in sizes(postings, keys).toLocalIterator()}  # one number per query gram
    folded = {k for k in keys if tau is None or n.get(k, 0) <= tau}
    exact = all_of(postings, keys - folded) if keys - folded else None
    if not folded:
        return exact
    if any(k not in n for k in folded):
        return postings.select("fid").limit(0)
    # ids of the rarest gram's remainders; then each gram keeps those that have one of its remainders
    order = sorted(folded, key=lambda k: (n[k], k))
    p = primes[order[0] & 255]
    found = _remainders(postings, order[0], p).where(F.col("gid") < numsamples)
    found = found.select(F.explode(F.sequence("gid", F.lit(numsamples - 1).cast("long"), F.lit(p).cast("long"))).alias("fid"))
    if exact is not None:
        found = found.join(exact, "fid", "left_semi")
    for gram in order[1:]:
        p = primes[gram & 255]
        rest = _remainders(postings, gram, p)
        # at most p of them
        found = found.join(F.broadcast(rest) if p <= BROADCAST else rest, F.pmod("fid", F.lit(p)) == F.col("gid"), "left_semi")
    return found


def _remainders(postings: DataFrame, gram: int, p: int) -> DataFrame:
    return reading(postings, {gram}).select(F.pmod("fid", F.lit(p)).alias("gid")).distinct()
