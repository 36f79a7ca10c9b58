"""Maps over files: many small files in few partitions are read by many tasks, and what they yield goes back many at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archgraph.sources import frameworks, graphql, languages, protobuf
from archgraph.sources.mapping import BATCH_FACTS, batches_of

PARSERS = {"rs": languages.analyze, "ex": frameworks.recognize, "graphql": graphql.analyze, "proto": protobuf.proto_sources}


@pytest.mark.parametrize("ending", sorted(PARSERS))
def test_files_of_one_partition_are_read_by_many_tasks(spark, ending):
    noise = F.concat(F.lit("#"), *(F.sha2(F.concat("id", F.lit(str(k))), 256) for k in range(20)))
    files = spark.range(5000).coalesce(1).select(F.lit("r").alias("repository"), F.concat("id", F.lit(f".{ending}")).alias("path"), F.encode(noise, "utf-8").alias("content"))
    assert files.rdd.getNumPartitions() == 1
    assert PARSERS[ending](files).rdd.getNumPartitions() > 1


def test_facts_of_many_files_make_few_batches():
    schema = pa.schema([("path", pa.string()), ("id", pa.string())])
    found = ([{"path": str(n), "id": None if n % 2 else "x"}] * (n % 3) for n in range(20_000))
    batches = list(batches_of(found, schema))
    want = [(str(n), None if n % 2 else "x") for n in range(20_000) for _ in range(n % 3)]
    assert [(r["path"], r["id"]) for b in batches for r in b.to_pylist()] == want
    assert len(batches) == -(-len(want) // BATCH_FACTS)
    assert list(batches_of(iter([[], []]), schema)) == []


@pytest.mark.parametrize("name", ["macro_uses", "imported_parents", "embedded_calls"])
def test_files_are_parsed_once(spark, sf_dir, name):
    """Branches of a plan that read the same facts must not each parse the files."""
    from archgraph import queries_workspace

    plan = getattr(queries_workspace, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Scan parquet" in plan
