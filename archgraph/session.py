"""Sessions, and shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "archgraph", cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


#: Rows of an Arrow batch between Spark and Python: whole texts are long, so fewer than Spark's default.
BATCH_ROWS = "2500"


def ship(spark: SparkSession) -> SparkSession:
    """Add this package to the Python path of the executors, once for each application.

    A session that still has Spark's default of rows for an Arrow batch gets ``BATCH_ROWS``.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="archgraph-"), "archgraph.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, Path(root.name) / file.relative_to(root))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark
