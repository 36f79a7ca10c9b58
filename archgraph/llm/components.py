"""Connected components of a link table, as DataFrame joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_few_files, materialize

MAX_ROUNDS = 60


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("coalesce(sum(cast(xxhash64(a, b) as decimal(38, 0))), 0)")).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links`` (columns a, b); ``root`` is the smallest node reachable.

    Alternates large-star and small-star rounds (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014): each round is two aggregates to the smallest neighbour
    and joins back, so no task holds a component, and a hub's rows are an ordinary skewed
    join. The edges of each round are a table in the shared folder. Ends when a round
    changes nothing; edges then are stars to the smallest node. Self links and repeated
    links are harmless; null ends are ignored.
    """
    edges = materialize(links.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "links")
    before = _sum(edges)
    if before[0] == 0:
        return edges.selectExpr("a as node", "b as root")
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as u", "least(a, m) as m")
        large = both.join(least, both.a == least.u).where("b > a").selectExpr("b as a", "m as b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as u", "m")
        joined = large.join(least, large.a == least.u)
        stars = joined.where("b <> m").selectExpr("b as a", "m as b").union(least.select("u", "m")).distinct()
        # At most two rows for each link of the round before.
        edges = materialize(in_few_files(stars, 2 * before[0]), "edges")
        after = _sum(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.selectExpr("a as node", "b as root")
    return nodes.union(edges.selectExpr("b as node", "b as root").distinct())
