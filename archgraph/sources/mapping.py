"""One map over files: they are dealt out evenly, and what is found in them is handed back many rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of found facts that go back to Spark at once: a batch costs far more than its rows, if it holds those of one short file.
BATCH_FACTS = 5_000


def dealt(files: DataFrame) -> DataFrame:
    """``files`` dealt out by name, as reading them costs far more than moving them, and many small ones may lie in few partitions."""
    return files.repartition("repository" if "repository" in files.columns else "path", "path")


def batches_of(found: Iterator[list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of each file's facts, in batches of about ``BATCH_FACTS``."""
    rows: list[dict] = []
    for facts in found:
        rows += facts
        if len(rows) >= BATCH_FACTS:
            yield _batch(rows, schema)
            rows = []
    if rows:
        yield _batch(rows, schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)
