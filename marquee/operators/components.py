"""Connected components of a (member, key) relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import materialize


def _contract(edges: DataFrame, turn: int) -> DataFrame:
    """Every node moves to the neighbour that comes first in this turn's hash order: (node, parent).

    A fresh order per turn halves long chains whatever their ids look like.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    place = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("id"))
    best = both.groupBy("node").agg(F.min(place("other")).alias("_o"))
    return best.select("node", F.least(place("node"), F.col("_o")).getField("id").alias("parent"))


def _relabel(edges: DataFrame, parents: DataFrame) -> DataFrame:
    left = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
    right = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
    moved = edges.join(left, "a").join(right, "b")
    return (moved.where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())


def components(memberships: DataFrame, member: str, key: str, name: str = "component") -> DataFrame:
    """Smallest member of the connected component of every member: (member, name).

    Members that share a key belong together. A key never yields pairs: its members point at its
    smallest member, found by a map-side combined minimum, so a key holding a third of all rows
    costs one row per member. What is left is a small graph between those smallest members,
    contracted turn by turn; each turn's mapping is kept and the mappings are applied from the
    last, smallest one back to the first.
    """
    # both uses below read the written pairs, so keys are computed from their texts once
    pairs = materialize(memberships.select(F.col(member).alias("m"), F.col(key).alias("k")))
    heads = pairs.groupBy("k").agg(F.min("m").alias("head"))
    linked = materialize(pairs.join(heads, "k").select("m", "head").distinct())
    first = linked.groupBy("m").agg(F.min("head").alias("root"))
    edges = materialize(linked.join(first, "m").where("head <> root")
                        .select(F.least("head", "root").alias("a"), F.greatest("head", "root").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        parents = materialize(_contract(edges, len(maps)))
        maps.append(parents)
        edges = materialize(_relabel(edges, parents))
    if not maps:
        return first.select(F.col("m").alias(member), F.col("root").alias(name))
    final = maps.pop()
    while maps:
        step = maps.pop()
        up = final.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        final = step.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"))
    # the smallest member of a component is the head of its own keys, hence a node of this graph
    labels = final.groupBy("parent").agg(F.min("node").alias("top"))
    top = final.join(labels, "parent").select(F.col("node").alias("root"), "top")
    return first.join(top, "root", "left").select(F.col("m").alias(member), F.coalesce("top", "root").alias(name))


class RedirectCycle(ValueError):
    """A chain of redirects never reaches a stored row."""


def resolve_chain(pointers: DataFrame, node: str, target: str, name: str = "resolved") -> DataFrame:
    """Follow ``target`` pointers to the end: (node, resolved); null when the end is not stored.

    Each round doubles the distance covered, so a chain of length n takes log2(n) rounds. Rows
    still moving once the distance exceeds the number of rows are on a cycle.
    """
    base = pointers.select(F.col(node).alias("n"), F.col(target).alias("t"))
    chain = materialize(base.where("t is not null"))
    limit, reach = chain.count(), 1
    hops = chain
    while True:
        ahead = hops.select(F.col("n").alias("t"), F.col("t").alias("next"))
        hops = materialize(hops.join(ahead, "t", "left").select("n", F.coalesce("next", "t").alias("t")))
        if hops.join(chain.select(F.col("n").alias("t")), "t", "left_semi").isEmpty():
            break
        reach *= 2
        if reach > limit:
            raise RedirectCycle("cyclic redirect")
    stored = base.select(F.col("n").alias("end"))
    ends = hops.join(stored, F.col("t") == F.col("end"), "left").select("n", F.col("end").alias("r"))
    whole = base.where("t is null").select("n", F.col("n").alias("r")).unionByName(ends)
    return whole.select(F.col("n").alias(node), F.col("r").alias(name))
