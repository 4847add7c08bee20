"""Groups of linked rows: connected components, and links found through shared keys.

Nothing here emits all pairs of a bucket. Every member is compared with one leader first; what that
links becomes one component, and only members of different components are compared after that, in blocks of a
bucket so that no task has all of a large one. Pairs and buckets of a hub are salted; the trees of components are
joined by their ids alone, 16 bytes a row, which a hub isn't split for. Each round is written to the
shared folder, so a lost executor costs no more than a round; tables of earlier rounds are deleted.

Nulls: ids and keys must not be null. Empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread, stored

#: Members of a block: buckets with more are compared block by block.
BLOCK = 1000
#: Buckets with more members are crowded: `refine` deals them anew. To count and deal a member's runs takes as long as to
#: compare its sketch with some thousands of others.
CROWD = 4096


def roots(forest: DataFrame) -> DataFrame:
    """(a, to) with `to` the root of a's tree, from parents (a, to) that are unique in a: paths double in each round."""
    before = None
    while True:
        up = forest.select(F.col("a").alias("to"), F.col("to").alias("up"))
        jumped = stored(forest.join(up, "to", "left").select("a", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved")), "forest")
        if before is not None:
            discard(before)
        forest, before = jumped.drop("moved"), jumped
        if jumped.where("moved").isEmpty():
            return forest


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every row of `edges` (a, b): component is the smallest id that links reach.

    In each round every node hooks to its smallest smaller neighbour, and the edges are rewritten to the roots
    of the trees that this makes. A node that has hooked is on no later edge, so it hooks once. Ids without
    an edge are not returned.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    left = stored(pairs.distinct(), "edges")
    hooks: DataFrame | None = None
    while not left.isEmpty():
        found = roots(left.groupBy("a").agg(F.min("b").alias("to")))
        hooks = found if hooks is None else hooks.unionByName(found)
        other = found.select(F.col("a").alias("b"), F.col("to").alias("b_to"))
        moved = left.join(found, "a").join(other, "b", "left").select(F.col("to").alias("x"), F.coalesce("b_to", "b").alias("y"))
        rest = stored(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a > b").distinct(), "edges")
        discard(left)
        left = rest
    if hooks is None:
        kind = edges.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"id {kind}, component {kind}")
    forest = roots(hooks)
    tops = forest.select(F.col("to").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return forest.select(F.col("a").alias("id"), F.col("to").alias("component")).unionByName(tops)


def link(keys: DataFrame, verifier: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], admit, extra: list[str], apart=None, once=None, refine=None, sketch=None, alike=None) -> DataFrame:
    """(id, component) of the rows that verified links join.

    keys: (key, id, *extra), unique; two ids with a common key are compared unless a component already holds both.
    The leader of a key is its first member by the extra columns, in their order, and then by id.
    verifier(ids): gets every id that can be compared (a superset) and gives a function that takes candidate
    pairs (a, b) and returns them with `linked` and facts of the comparison.
    admit(x, y): a condition on the extra columns of both sides that every link fulfils.
    apart(x, y): a condition on the extra columns and on the facts of both sides' comparison with their
    leader, that only members of one leader that are not linked fulfil.
    once(x, y): a condition that holds for at most one common key of two members, and for one if they are linked; each side
    has in `prefix` those of its keys that members of several components have, among which all common keys are.
    refine(ids): (key, id), other keys for the members of crowded buckets; linked ids of which both are among `ids` have one in
    common. Two ids that meet in no smaller bucket are both members of crowded ones, so no link is lost.
    sketch(): (id, ...) further columns of all ids that the verifier got; alike(x, y): a condition on them that every link
    fulfils. It holds back pairs that `admit` lets pass, of which a bucket has as many as the square of its members.
    """
    own = keys.select("key", F.struct(*extra, "id").alias("own"), F.col("id").alias("_by"))
    buckets = stored(own.groupBy("key").agg(F.min("own").alias("lead"), F.count("*").alias("_members")).where("_members > 1"), "buckets")
    fits = (F.col("lead.id") != F.col("own.id")) & admit("lead", "own")
    met = stored(spread(own, buckets, "key", "_by", counts=buckets.select("key", F.col("_members").alias("_n"))).drop("_by").withColumn("_fits", fits), "keys")
    discard(buckets)
    keys = met.select("*", "own.*")
    # round 1: one leader for each member
    first = stored(keys.where("_fits").groupBy("id").agg(F.min("lead").alias("lead")).select(F.col("lead.id").alias("a"), F.col("id").alias("b")), "leaders")
    # whoever may be compared: members with a leader that fits, the leaders, and members of larger buckets
    pair = keys.where("_fits").select(F.explode(F.array("id", "lead.id")).alias("id"))
    verify = verifier(pair.unionByName(keys.where("_members > 2").select("id")).distinct())
    judged = stored(verify(first), "leader-pairs")
    found = stored(components(judged.where("linked").select("a", "b")), "components")
    # round 2: members of different components that share a key
    near = judged.select(F.col("b").alias("id"), F.col("a").alias("near"), *(c for c in judged.columns if c not in ("a", "b", "linked")))
    sides = keys.select("key", "id", *extra).join(found, "id", "left").join(near, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sides = every = stored(sides, "sides")
    discard(met)

    def several(sides: DataFrame) -> DataFrame:
        """(key, _members) of the buckets with members of several components."""
        by = sides.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count("*").alias("_members"))
        return stored(by.where("_lo < _hi").select("key", "_members"), "mixed")

    mixed = first_mixed = several(sides)
    old = [every, first_mixed]
    if refine is not None and not mixed.where(F.col("_members") > CROWD).isEmpty():
        members = sides.join(mixed.where(F.col("_members") > CROWD).select("key"), "key", "left_semi").drop("key").dropDuplicates(["id"])
        # a key of the new order is no key of the old one
        fresh = stored(refine(members.select("id")).select(F.xxhash64("key", F.lit(CROWD)).alias("key"), "id").join(members, "id"), "fresh-sides")
        fresh_mixed = several(fresh)
        sides = sides.join(mixed.where(F.col("_members") <= CROWD).select("key"), "key", "left_semi").unionByName(fresh)
        mixed = mixed.where(F.col("_members") <= CROWD).unionByName(fresh_mixed)
        old += [fresh, fresh_mixed]
    # of b blocks, each cell (i, j) has the members of i and j, and compares those of i with those of j
    blocks = mixed.select("key", F.ceil(F.col("_members") / BLOCK).alias("_blocks"))
    cells = spread(sides, blocks, "key", "id", counts=mixed.select("key", F.col("_members").alias("_n")))
    if sketch is not None:
        cells = cells.join(sketch(), "id")
    cells = stored(cells, "cells")
    discard(*old)
    pieces = cells if once is None else cells.join(cells.groupBy("id").agg(F.collect_set("key").alias("prefix")), "id")
    pieces = pieces.withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    pieces = pieces.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    pieces = pieces.withColumn("_cell", F.xxhash64("key", F.least("_block", "_other"), F.greatest("_block", "_other")))
    # the cell is the only equality of the join, so that both sides are one exchange
    pieces = pieces.repartition("_cell")
    x, y = pieces.alias("x"), pieces.alias("y")
    same = lambda a, b: F.col(a).bitwiseXOR(F.col(b)) == 0
    on = (F.col("x._cell") == F.col("y._cell")) & same("x.key", "y.key") & same("x._other", "y._block") & same("x._block", "y._other")
    on = on & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & admit("x", "y")
    if alike is not None:
        on = on & alike("x", "y")
    if apart is not None:
        on = on & ~F.coalesce((F.col("x.near") == F.col("y.near")) & apart("x", "y"), F.lit(False))
    if once is not None:
        on = on & once("x", "y")
    pairs = x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    pairs = pairs if once is not None else pairs.distinct()
    done = judged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(pairs.join(done, ["a", "b"], "left_anti"), "rest")
    star = found.where("id != component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    out = found
    if not pairs.isEmpty():
        rest = stored(verify(pairs), "rest-pairs")
        out = stored(components(star.unionByName(rest.where("linked").select("a", "b"))), "components")
        discard(rest, found)
    discard(first, judged, cells, pairs)
    return out
