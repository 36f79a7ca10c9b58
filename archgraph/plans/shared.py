"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Bytes of the tables that rows come from for one task of a join or an aggregate: edges take some ten times that in memory.
TASK_BYTES = 16_000_000


def table_bytes(df: DataFrame) -> int:
    """The size of the tables that ``df`` comes from."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(x for x in sizes if x < 1 << 62)  # Spark's default for a size it doesn't know is above that


def tasks_for(df: DataFrame) -> int | None:
    """As many tasks as the tables that ``df`` comes from are worth, if a shuffle has fewer partitions: else a task's rows grow with the input."""
    tasks = -(-table_bytes(df) // TASK_BYTES)
    return tasks if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt_by(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt to ``tasks`` by ``keys``, if any number is given. What joins or groups by these keys then moves no row again."""
    return df if tasks is None else df.repartition(tasks, *keys)


def shared_root(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where a session of one machine names none, as in unit tests, a temporary folder is
    made and set; executors of a cluster would not share it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="archgraph-shared-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one table in the shared folder."""
    return f"{shared_root(spark)}/archgraph/{uuid.uuid4().hex}/{label}"


def _place(spark: SparkSession, path: str):
    """(file system, path) of a path in any store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def delete_path(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def rename_path(spark: SparkSession, path: str, to: str) -> bool:
    """Give a folder its name, unless that is taken."""
    files, place = _place(spark, path)
    target = _place(spark, to)[1]
    if files.exists(target):
        return False
    return files.rename(place, target)


#: Paths of the tables that each open scratch deletes, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are made inside are deleted at its end, but for those that are ``kept``: these belong to the scratch around it, if any.

    Nothing that outlives it may read the others; what is kept is written by then, and needs none of them.
    """
    made: list[str] = []
    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in made:
            delete_path(spark, path.rpartition("/")[0])


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session that hold inside; in names, ``__`` stands for a dot."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def freed_shuffles(spark: SparkSession):
    """Inside, what a query has shuffled goes at its end; else it lies on the executors' disks until the driver happens to collect its garbage."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def materialize(df: DataFrame, label: str, kept: bool = False) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder, and read it back.

    The files survive lost executors, a later step never repeats the work above it, and
    their size is known to the planner, which so picks broadcasts by measured sizes.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    scratches = _OPEN.get()[: -1 if kept else None]
    if scratches:
        scratches[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
