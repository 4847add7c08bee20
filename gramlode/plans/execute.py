"""Plans of many rules as one query: one read of the postings, one join with the terms, one shuffle by sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.operators import lookup
from gramlode.operators.index import Index
from gramlode.operators.lookup import BROADCAST, reading, reading_trigrams

from .planner import LOWER_BOUND, All, Leaf, plans, terms
from .planner import Any as AnyOf
from .rules import Rule, parse

_TERMS = "rule string, expr_id int, string_id int, variant_id int, slot int, ngram long, slots int, n int"
_SLOT = ["rule", "expr_id", "string_id", "variant_id", "slots", "n", "fid"]


def formula(node, leaf) -> Column:
    if isinstance(node, bool):
        return F.lit(node)
    if isinstance(node, All | AnyOf):
        parts = [formula(p, leaf) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node, All) else out | p
        return out
    return leaf(node)


def _hits(spark: SparkSession, index: Index, rows: list[tuple], size: int) -> DataFrame:
    """(rule, expr_id, ..., slot, fid): which samples have which gram of which rule."""
    table = spark.createDataFrame(rows, _TERMS)
    table = F.broadcast(table) if len(rows) <= BROADCAST else table
    keys = {r[5] for r in rows}
    found = reading(index.postings, keys) if size == 4 else reading_trigrams(index.postings, keys).withColumnRenamed("third", "ngram")
    return found.join(table, "ngram").select(*_SLOT, "slot")


def _grouped_hits(spark: SparkSession, index: Index, found: dict[str, object], width: int, tau: int | None) -> DataFrame | None:
    """The same with a literal for a slot, looked up in lists folded by primes; literals without regard to case aren't folded."""
    out = []
    for rule, tree in found.items():
        leaves: dict[Leaf, int] = {}

        def walk(x):
            if isinstance(x, All | AnyOf):
                for p in x.parts:
                    walk(p)
            elif isinstance(x, Leaf):
                leaves.setdefault(x, len(leaves))  # noqa: B023

        walk(tree)
        for x, expr in leaves.items():
            for s, string in enumerate(x.strings):
                for v, variant in enumerate(string.variants):
                    for slot, literal in enumerate(sorted(variant, key=lambda y: (y.text, y.nocase))):
                        if literal.nocase:
                            grams, _ = terms(Leaf(1, (type(string)((frozenset({literal}),)),)))
                            hits = _hits(spark, index, [(rule, 0, 0, 0, r["slot"], r["ngram"], r["slots"], 1) for r in grams], 4)
                            fids = hits.groupBy("fid", "slots").agg(F.count_distinct("slot").alias("_n")).where("_n = slots").select("fid")
                        else:
                            fids = lookup.grouped_all_of(index.postings, literal.text, index.numsamples, width, tau)
                        values = dict(zip(_SLOT, (rule, expr, s, v, len(variant), x.n)))
                        out.append(fids.select(*(F.lit(values[c]).alias(c) for c in _SLOT[:-1]), "fid", F.lit(slot).alias("slot")))
    whole = None
    for part in out:
        whole = part if whole is None else whole.unionByName(part)
    return whole


def pruned(index: Index, rules: dict[str, Rule], lower_bound: int = LOWER_BOUND, groupwidth: int | None = None, tau: int | None = None, compat: bool = False) -> tuple[DataFrame | None, list[str]]:
    """(rule, fid) of the rules that the index can prune, and the names of those that it can't."""
    spark = index.postings.sparkSession
    rows, trees, whole, found = [], {}, [], plans(rules, lower_bound)
    for name, node in found.items():
        mine, tree = terms(node, lower_bound, compat)
        if tree is True:
            whole.append(name)
        elif tree is not False:
            trees[name] = tree
            rows += [(name, r["expr_id"], r["string_id"], r["variant_id"], r["slot"], r["ngram"], r["slots"], r["n"]) for r in mine]
    if not rows:
        return None, whole
    if groupwidth is None or lower_bound == 3:  # 3-gram lists are never folded
        hits = _hits(spark, index, rows, lower_bound)
    else:
        hits = _grouped_hits(spark, index, {name: found[name] for name in trees}, groupwidth, tau)
    # one shuffle: every group below holds one sample's rows only
    hits = hits.repartition("fid")
    variants = hits.distinct().groupBy(*_SLOT).agg(F.count("*").alias("_slots")).where("_slots = slots")
    strings = variants.select("rule", "expr_id", "string_id", "n", "fid").distinct()
    leaves = strings.groupBy("rule", "expr_id", "n", "fid").agg(F.count("*").alias("_strings")).where("_strings >= n")
    held = leaves.groupBy("rule", "fid").agg(F.collect_set("expr_id").alias("held"))  # as many entries as a rule has leaves
    matches = F.lit(False)
    for name, tree in trees.items():
        matches = matches | ((F.col("rule") == name) & formula(tree, lambda k: F.array_contains("held", k)))
    return held.where(matches).select("rule", "fid"), whole


def candidates(index: Index, rules: dict[str, Rule] | str, lower_bound: int = LOWER_BOUND, groupwidth: int | None = None, tau: int | None = None, compat: bool = False) -> DataFrame:
    """(rule, fid, prunable): the samples that can match each rule.

    A rule that the index can't prune has all samples, with prunable false; no match is left out. With a `lower_bound`
    of 3, strings of three bytes count too, except that a sample that has one as its last three bytes only isn't found.
    `groupwidth` and `tau` look literals up in folded lists, which finds more samples.
    """
    spark = index.postings.sparkSession
    rules = parse(rules) if isinstance(rules, str) else rules
    out, whole = pruned(index, rules, lower_bound, groupwidth, tau, compat)
    out = None if out is None else out.select("rule", "fid", F.lit(True).alias("prunable"))
    if whole:
        every = index.paths.select(F.explode(F.array(*map(F.lit, whole))).alias("rule"), "fid", F.lit(False).alias("prunable"))
        out = every if out is None else out.unionByName(every)
    return spark.createDataFrame([], "rule string, fid long, prunable boolean") if out is None else out


def evaluate_rule(rule: Rule, index: Index, lowerbound: int = LOWER_BOUND, groupwidth: int | None = None, tau: int | None = None, compat: bool = False) -> DataFrame:
    """(fid) of the samples that can match one rule."""
    return candidates(index, {rule.name: rule}, lowerbound, groupwidth, tau, compat).select("fid")
