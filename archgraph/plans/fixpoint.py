"""Recursion over DataFrames: semi-naive closures, breadth-first levels and least paths.

Each round is one join of the frontier with the edges and one anti-join with what is
already known. A search of few nodes holds them on the driver, by a fixed bound; else the
frontier and the known rows are tables in the shared folder, so plans stay short and the
planner sees their sizes: a small frontier is broadcast, a large one is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adjacency import INLINE, Direction
from .shared import materialize

MAX_ROUNDS = 10_000


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def seeds(spark: SparkSession, *nodes) -> DataFrame:
    return spark.createDataFrame([(x,) for x in nodes], "node " + ("string" if isinstance(nodes[0], str) else "long"))


def fixpoint(seed: DataFrame, step, keys: list[str], label: str = "fixpoint", max_rounds: int = MAX_ROUNDS, hint: str | None = None) -> DataFrame:
    """All rows that ``step(new rows)`` derives from ``seed``, each key once (the first round that finds it wins).

    ``hint`` says how to join with what is known, where its size in files doesn't tell its size in memory.
    """
    frontier = materialize(seed.dropDuplicates(keys), label)
    known = [frontier]
    for _ in range(max_rounds):
        found = step(frontier).dropDuplicates(keys)
        before = union_all([x.select(*keys) for x in known])
        new = found.join(before.hint(hint) if hint else before, keys, "left_anti")
        frontier = materialize(new, label)
        if frontier.isEmpty():
            return union_all(known)
        known.append(frontier)
        if len(known) >= 16:  # keep the union short
            known = [materialize(union_all(known), label)]
    raise RuntimeError(f"{label} did not settle in {max_rounds} rounds")


#: So many nodes a search holds on the driver at most; beyond, its levels are tables in the shared folder.
HELD = 10_000


@dataclass
class Levels:
    """``reached``: node, hops. ``truncated``: a node at the last level has a neighbour beyond it."""

    reached: DataFrame
    truncated: bool


def small(spark: SparkSession, type_: str, **columns: list) -> DataFrame:
    """A frame of at most some thousand rows, whose size the planner knows; a column ``node`` has the type ``type_``."""
    kinds = {"node": pa.int64() if type_ == "bigint" else pa.string(), "nodes": pa.list_(pa.string())}
    return spark.createDataFrame(pa.table({k: pa.array(v, kinds.get(k, pa.int32())) for k, v in columns.items()}))


class Search:
    """Breadth-first levels along ``pairs`` (from_id, to_id) from ``start`` (node).

    Of pairs that are clustered, a level reads the buckets of its nodes, or joins without moving the edges. Up to ``HELD`` nodes, a level is one job that returns its new nodes, and nothing is
    written. A larger search goes on over tables in the shared folder.
    """

    def __init__(self, pairs: DataFrame | Direction, start: DataFrame) -> None:
        self.clustered = pairs if isinstance(pairs, Direction) else None
        self.pairs = pairs.pairs() if isinstance(pairs, Direction) else pairs.select("from_id", "to_id")
        self.spark, self.type = pairs.sparkSession, dict(start.dtypes)["node"]
        self.hop = 0
        first = start.select("node").distinct().limit(HELD + 1).collect()
        self.held: dict | None = {r.node: 0 for r in first}
        self.last: list = list(self.held)
        self.known: list[DataFrame] = []
        self.frontier: DataFrame | None = None
        if len(first) > HELD:
            self._spill(start.select("node").distinct())

    def _spill(self, frontier: DataFrame, *known: DataFrame) -> None:
        self.frontier = materialize(frontier, "level")
        self.known = [*known, self.frontier.withColumn("hops", F.lit(self.hop))]
        self.held = None

    def _frame(self, nodes: list) -> DataFrame:
        return F.broadcast(small(self.spark, self.type, node=nodes))  # of at most HELD rows

    def _beyond(self) -> DataFrame:
        """What the last level leads to; in a large search without what is known."""
        if self.clustered is not None and self.held is not None and len(self.last) <= INLINE:
            return self.clustered.pairs_of(self.last).select(F.col("to_id").alias("node")).distinct()
        last = self._frame(self.last) if self.held is not None else self.frontier
        found = self.pairs.join(last, self.pairs.from_id == last.node, "left_semi").select(F.col("to_id").alias("node")).distinct()
        return found if self.held is not None else found.join(union_all([x.select("node") for x in self.known]), "node", "left_anti")

    def step(self) -> bool:
        """Go one level on; whether there was any new node."""
        found = self._beyond()
        self.hop += 1
        if self.held is not None:
            rows = found.limit(HELD + 1).collect()
            new = [r.node for r in rows if r.node not in self.held]
            if len(rows) <= HELD and len(self.held) + len(new) <= HELD:
                self.held |= dict.fromkeys(new, self.hop)
                self.last = new
                return bool(new)
            before = materialize(self.reached(), "levels")
            self._spill(found.join(before.select("node"), "node", "left_anti"), before)
        else:
            self.frontier = materialize(found, "level")
            self.known.append(self.frontier.withColumn("hops", F.lit(self.hop)))
            if len(self.known) >= 16:  # keep the union short
                self.known = [materialize(union_all(self.known), "levels")]
        return not self.frontier.isEmpty()

    def more(self) -> bool:
        """Whether a node of the last level has a neighbour that isn't reached."""
        if self.held is None:
            return not self._beyond().isEmpty()
        rows = self._beyond().limit(len(self.held) + 1).collect()
        return any(r.node not in self.held for r in rows)

    def reached(self) -> DataFrame:
        """``node, hops``."""
        if self.held is None:
            return union_all(self.known)
        return small(self.spark, self.type, node=list(self.held), hops=list(self.held.values()))


def levels(pairs: DataFrame | Direction, start: DataFrame, max_hops: int) -> Levels:
    """Breadth-first distances along ``pairs`` (from_id, to_id) from ``start`` (node), up to ``max_hops``."""
    if max_hops <= 0:
        raise ValueError("max_hops must be positive")
    search = Search(pairs, start)
    for _ in range(max_hops):
        if not search.step():
            return Levels(search.reached(), False)
    return Levels(search.reached(), search.more())


def closure(pairs: DataFrame | Direction, start: DataFrame) -> DataFrame:
    """Nodes reachable along ``pairs`` from ``start``, itself included."""
    return levels(pairs, start, MAX_ROUNDS).reached.select("node")


def all_pairs_closure(pairs: DataFrame, reflexive: bool = False) -> DataFrame:
    """The transitive closure of ``pairs``: each (from_id, to_id) with a path; for small relations such as project references."""
    pairs = pairs.select("from_id", "to_id").distinct()
    seed = pairs
    if reflexive:
        nodes = pairs.select("from_id").union(pairs.select("to_id")).distinct()
        seed = pairs.union(nodes.selectExpr("from_id", "from_id as to_id"))
    onward = pairs.selectExpr("from_id as mid", "to_id as next")
    return fixpoint(seed, lambda new: new.join(onward, new.to_id == onward.mid).selectExpr("from_id", "next as to_id"), ["from_id", "to_id"], "pairs")


@dataclass
class Path:
    """``path``: one row with an array ``nodes``, or none. ``truncated`` as in Levels, where no path is found."""

    path: DataFrame
    truncated: bool


def least_path(pairs: DataFrame | Direction, source: str, target: str, max_hops: int) -> Path:
    """Of the shortest paths of at most ``max_hops``, the one with the smallest node sequence.

    Each level keeps one path a node, the smallest; a longer path's smallest prefix is its
    parent's smallest path, so no other is ever needed.
    """
    spark = pairs.sparkSession
    clustered = pairs if isinstance(pairs, Direction) else None
    pairs = pairs.pairs() if isinstance(pairs, Direction) else pairs.select("from_id", "to_id")
    none = small(spark, "string", nodes=[])
    last, known_names, hop = {source: [source]}, {source}, 0
    while hop < max_hops:
        if clustered is not None and len(last) <= INLINE:
            leaving = clustered.pairs_of(list(last))
        else:
            at = F.broadcast(small(spark, "string", node=list(last)))  # of at most HELD rows
            leaving = pairs.join(at, pairs.from_id == at.node).select("from_id", "to_id")
        steps = leaving.distinct().limit(HELD + 1).collect()
        if len(steps) > HELD or len(known_names) + len(steps) > HELD:
            break
        found: dict[str, list[str]] = {}
        for r in steps:
            if r.to_id not in known_names:
                path = [*last[r.from_id], r.to_id]
                if r.to_id not in found or path < found[r.to_id]:
                    found[r.to_id] = path
        hop += 1
        if target in found:
            return Path(small(spark, "string", nodes=[found[target]]), False)
        if not found:
            return Path(none, False)
        last = found
        known_names |= set(found)
    frontier = small(spark, "string", node=list(last), nodes=list(last.values()))
    known = [small(spark, "string", node=list(known_names))]

    def beyond() -> DataFrame:
        found = frontier.join(pairs, frontier.node == pairs.from_id).select(F.col("to_id").alias("node"), F.concat("nodes", F.array("to_id")).alias("nodes"))
        return found.groupBy("node").agg(F.min("nodes").alias("nodes")).join(union_all(known), "node", "left_anti")

    for _ in range(hop, max_hops):
        frontier = materialize(beyond(), "paths")
        found = frontier.where(F.col("node") == target).select("nodes")
        if not found.isEmpty():
            return Path(found, False)
        if frontier.isEmpty():
            return Path(found, False)
        known.append(frontier.select("node"))
        if len(known) >= 16:
            known = [materialize(union_all(known), "known")]
    return Path(frontier.where("false").select("nodes"), not beyond().isEmpty())
