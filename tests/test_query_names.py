"""SQL that a query reads when it runs is the SQL that it was registered with."""

import pytest

from archgraph import queries_sources as sources
from archgraph import queries_workspace as workspace


def test_accepted_paths_reads_its_own_rows(spark, sf_dir):
    rows = sources.accepted_paths(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert any(r.taken for r in rows) and any(not r.taken for r in rows)


@pytest.mark.parametrize("module", [sources, workspace])
def test_no_constant_is_assigned_twice(module):
    """Queries look names up when they run, and so would get the last one."""
    import ast
    import inspect

    names = [t.id for x in ast.parse(inspect.getsource(module)).body if isinstance(x, ast.Assign) for t in x.targets if isinstance(t, ast.Name)]
    assert len(names) == len(set(names)), sorted(x for x in names if names.count(x) > 1)
