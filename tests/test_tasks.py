"""Shuffles of edges have as many tasks as their tables are worth, so that no task's rows grow with the input."""

import pytest

from archgraph import queries
from archgraph.operators import resolve
from archgraph.plans import rules, shared
from archgraph.queries_resolve import receiver_chains


@pytest.fixture
def tiny_tasks(monkeypatch):
    monkeypatch.setattr(shared, "TASK_BYTES", 5_000)


def tables(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("concat('a', id % 5000) as from_id", "'uses' as relation", "concat('b', id % 5000) as to_id", "concat('e', id % 10000) as evidence", "1.0D as confidence", "'ast' as provenance")
    rows.write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    overrides = edges.where("evidence like '%7'").selectExpr("from_id", "relation", "to_id as unresolved_to", "'c' as resolved_to", "evidence", "confidence", "provenance")
    return edges, overrides


def test_views_are_dealt_by_the_size_of_their_tables(spark, tmp_path, tiny_tasks):
    edges, overrides = tables(spark, tmp_path)
    tasks = shared.tasks_for(edges)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    masked = rules.masked(edges, overrides)
    assert masked.count() == 18_000
    view = rules.direct_edges(edges, overrides)
    assert view.rdd.getNumPartitions() >= tasks
    assert view.count() == 10_000
    assert {r.to_id for r in view.where("evidence like '%7'").collect()} == {"c"}


def test_evidence_is_dealt_by_the_size_of_its_tables(spark, tmp_path, tiny_tasks):
    edges, _ = tables(spark, tmp_path)
    owners = edges.selectExpr("from_id as id", "'r' as repository").union(edges.selectExpr("to_id", "'s'")).distinct()
    found = resolve.repository_evidence(edges, owners)
    assert found.rdd.getNumPartitions() >= shared.tasks_for(edges)
    assert found.count() == 10_000 and found.first().from_repository == "r"


def test_small_tables_keep_the_partitions_of_a_shuffle(spark, sf_dir):
    assert shared.tasks_for(queries.supply(spark, sf_dir).states) is None


def test_receiver_chains_join_without_the_driver(spark, sf_dir):
    plan = receiver_chains(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
