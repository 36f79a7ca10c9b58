"""Synthetic topologies on whole numbers, and bounded reachability over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import levels, seeds
from ..plans.shared import materialize


def linear(spark: SparkSession, n: int) -> DataFrame:
    """i -> i + 1."""
    return spark.range(n - 1).select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"))


def tree(spark: SparkSession, n: int, fanout: int) -> DataFrame:
    """i -> i * fanout + 1 .. i * fanout + fanout: made from the children, which have one parent each."""
    return spark.range(1, n).select(F.expr(f"(id - 1) div {fanout}").alias("from_id"), F.col("id").alias("to_id"))


def dag(spark: SparkSession, n: int, fanout: int) -> DataFrame:
    """i -> i + 1 .. i + fanout."""
    return spark.range(n).select(F.col("id").alias("from_id"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + fanout)).alias("to_id")).where(F.col("to_id") < n)


def corpus(spark: SparkSession, n: int) -> DataFrame:
    """Chains with shortcuts: each to the next; even ones to the next but one; every tenth to 3..7 on; every thousandth to 8..157 on."""
    i = spark.range(n)
    offsets = F.expr(
        f"concat(array(1L), if(id % 2 = 0 and id < {n - 2}, array(2L), cast(array() as array<bigint>)), "
        f"if(id % 10 = 0 and id < {n - 7}, sequence(3L, 7L), cast(array() as array<bigint>)), "
        f"if(id % 1000 = 0 and id < {n - 158}, sequence(8L, 157L), cast(array() as array<bigint>)))"
    )
    return i.select("id", F.explode(offsets).alias("k")).select(F.col("id").alias("from_id"), (F.col("id") + F.col("k")).alias("to_id")).where(F.col("to_id") < n)


def reach_counts(edges: DataFrame, root: int, depth: int) -> DataFrame:
    """``hops, n``: nodes at each distance from ``root``, up to ``depth``."""
    found = levels(edges, seeds(edges.sparkSession, root), depth)
    return found.reached.groupBy("hops").agg(F.count("*").alias("n"))


def shortest_by_predecessor(edges: DataFrame, root: int, target: int, depth: int) -> DataFrame:
    """``position, node`` of a shortest path that goes back from ``target`` to the smallest predecessor each time."""
    found = materialize(levels(edges, seeds(edges.sparkSession, root), depth).reached, "reached")
    step = edges.join(found.selectExpr("node as from_id", "hops as h"), "from_id").join(found.selectExpr("node as to_id", "hops as k"), "to_id").where("k = h + 1")
    back = step.groupBy("to_id").agg(F.min("from_id").alias("from_id"))
    from ..plans.fixpoint import fixpoint

    chain = fixpoint(
        seeds(edges.sparkSession, target).join(found, "node").selectExpr("node", "hops as position"),
        lambda new: new.join(back, new.node == back.to_id).selectExpr("from_id as node", "position - 1 as position"), ["node"], "back",
    )
    return chain.select(F.col("position").cast("long").alias("position"), "node")
