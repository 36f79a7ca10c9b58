"""Closures of deep graphs by contracting their chains: rounds grow with the logarithm of a chain's length, rows with the input.

An edge is a *link* if it is the only one that leaves its start and the only one that enters its end. Links
make chains (or rings) without branches. Each round takes about a quarter of a chain's nodes out, no two of which
are neighbours: those whose coin is up where that of the node before them is down; what followed such a node then points
past it. So the rounds together move some four times the links. What is left when ``HELD`` pointers are, the driver walks
along, and the nodes that were taken out get their places back, the last first. Every other edge leads from the end of a chain to the head of
another, so the chains themselves are a graph, whose depth is that of the branching; it is searched level by level.

Only pointers to a node whose coin is up are looked up in a round, and no two of them have one target, so
no round has a hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixpoint import HELD, closure, union_all
from .shared import materialize


@dataclass
class Chains:
    """``chains``: node, head, place of each node at a link; any other is its own head. ``joints``: pairs (from_id, to_id) of heads; ``rings``: heads of rings; ``rounds`` of contraction."""

    chains: DataFrame
    joints: DataFrame
    rings: DataFrame
    rounds: int


def _up(node: str, round_: int) -> Column:
    """A node's coin in a round."""
    return F.xxhash64(node, F.lit(round_)).bitwiseAND(1) == 1


def _walk(pointers: DataFrame) -> DataFrame:
    """``node, head, place, ring`` along at most ``HELD`` pointers; ``ring`` is a ring's length, and its head any node of it."""
    rows = pointers.collect()
    before = {r.node: (r.to, r.jump) for r in rows}
    after = {r.to: r.node for r in rows}
    out = []
    for head in [x for x in after if x not in before]:
        node, place = after.get(head), 0
        while node is not None:
            place += before[node][1]
            out.append((node, head, place, None))
            node = after.get(node)
    left = set(before) - {x[0] for x in out}
    while left:
        head = node = next(iter(left))
        places, place = [(head, 0)], 0
        while (node := after[node]) != head:
            place += before[node][1]
            places.append((node, place))
        out += [(x, head, at, place + before[head][1]) for x, at in places]
        left -= {x for x, _ in places}
    kind = dict(pointers.dtypes)["node"]
    return pointers.sparkSession.createDataFrame(out, f"node {kind}, head {kind}, place long, ring long")


def contract(pairs: DataFrame) -> Chains:
    """The chains of ``pairs`` (from_id, to_id). A ring's head is its smallest node, and places count from there."""
    pairs = materialize(pairs.select("from_id", "to_id").where("from_id is not null and to_id is not null").distinct(), "pairs")
    out = materialize(pairs.groupBy("from_id").agg(F.count("*").alias("leaving"), F.min("to_id").alias("to_id")), "leaving")
    into = pairs.groupBy("to_id").agg(F.count("*").alias("entering")).where("entering = 1").select("to_id", F.lit(True).alias("link"))
    single = materialize(out.where("leaving = 1").select("from_id", "to_id").join(into, "to_id", "left"), "links")
    branches = pairs.join(out.where("leaving > 1").select("from_id"), "from_id", "left_semi")
    branches = branches.select("from_id", "to_id").union(single.where("link is null").select("from_id", "to_id"))
    # ``to``: the node before, or one further back; ``jump``: how many links lie between.
    active = single.where("link").select(F.col("to_id").alias("node"), F.col("from_id").alias("to"), F.lit(1).cast("long").alias("jump"))
    levels: list[DataFrame] = []
    while active.count() > HELD:
        up, ahead = _up("node", len(levels)), _up("to", len(levels))
        taken = active.where(up & ~ahead).select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("jump").alias("_jump"))
        past = active.where(ahead).join(taken, "to", "left").select("node", F.coalesce("_to", "to").alias("to"), (F.col("jump") + F.coalesce("_jump", F.lit(0))).alias("jump"))
        levels.append(active)
        active = materialize(past.union(active.where(~up & ~ahead)), "pointers")
    known = [materialize(_walk(active), "chained")]
    for round_ in reversed(range(len(levels))):
        taken = levels[round_].where(_up("node", round_) & ~_up("to", round_))
        # The node before one that was taken out was not, or is a head.
        found = union_all(known).where(~_up("node", round_)).select(F.col("node").alias("to"), "head", "place", "ring")
        place = F.coalesce("place", F.lit(0)) + F.col("jump")
        placed = taken.join(found, "to", "left").select("node", F.coalesce("head", "to").alias("head"), F.when(F.col("ring").isNull(), place).otherwise(F.pmod(place, F.col("ring"))).alias("place"), "ring")
        known.append(materialize(placed, "chained"))
    placed = union_all(known)
    chained = placed.where("ring is null").select("node", "head", "place")
    heads = chained.where("place = 1").select(F.col("head").alias("node"), "head", F.lit(0).cast("long").alias("place"))
    rings = placed.where("ring is not null")
    least = rings.groupBy("head").agg(F.min(F.struct("node", "place")).alias("least"))
    rings = rings.join(least, "head").select("node", F.col("least.node").alias("head"), F.pmod(F.col("place") - F.col("least.place"), F.col("ring")).alias("place"))
    rings = materialize(rings, "rings")
    chains = chained.union(heads).union(rings)
    joined = branches.join(chains.select(F.col("node").alias("from_id"), "head"), "from_id", "left")
    joints = joined.select(F.coalesce("head", "from_id").alias("from_id"), "to_id").distinct()
    return Chains(chains, joints, rings.where("place = 0").select("head"), len(levels))


def deep_closure(pairs: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes reachable along ``pairs`` from ``start`` (node), themselves included, however deep the graph is."""
    found = contract(pairs)
    chains, joints = found.chains, materialize(found.joints, "joints")
    begins = start.select("node").distinct().join(chains, "node", "left")
    begins = materialize(begins.select("node", F.coalesce("head", "node").alias("head"), F.coalesce("place", F.lit(0)).alias("place")), "begins")
    # Of a chain that is begun inside, what follows; of those behind it, and of rings, all.
    beyond = joints.join(begins.select(F.col("head").alias("from_id")).distinct(), "from_id", "left_semi").select(F.col("to_id").alias("node")).distinct()
    whole = materialize(closure(joints, beyond).select(F.col("node").alias("head")).distinct(), "whole")
    first = begins.groupBy("head").agg(F.min("place").alias("from"))
    first = first.join(found.rings.withColumn("ring", F.lit(True)), "head", "left")
    inside = chains.join(first, "head").where("ring or place >= from").select("node")
    out = chains.join(whole, "head", "left_semi").select("node").union(whole.select("head")).union(inside).union(begins.select("node"))
    return out.distinct()
