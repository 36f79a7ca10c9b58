"""Capped debouncing of a stream: one row of state a key, runs are cut as its watermark passes them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import MOST, QUIET, _milliseconds

#: Keyed state with timers needs this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Runs(StatefulProcessor):
    """Folds a key's changes in the order of their times into runs.

    Changes come in any order, so those that the watermark hasn't passed wait, counted by
    millisecond: as many entries as the watermark's delay has. Those that it passed are folded into the one open
    run: a gap of more than ``quiet`` ends it, and so does a change ``most`` or more after its start. The
    run goes out when no change can come that would still be in it.
    """

    def __init__(self, keys: tuple[str, ...], quiet: int, most: int) -> None:
        self.keys, self.quiet, self.most = keys, quiet, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "started long, last long, changes long")
        self.waiting = handle.getMapState("waiting", "at long", "changes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for at, n in frame["at"].value_counts().items():
                if at > passed:  # others come too late
                    before = self.waiting.getValue((int(at),)) if self.waiting.containsKey((int(at),)) else (0,)
                    self.waiting.updateValue((int(at),), (int(before[0]) + int(n),))
        return self._advance(key, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, passed: int) -> Iterator[pd.DataFrame]:
        run = self.run.get() if self.run.exists() else None
        out, left = [], None
        for (at,), (n,) in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
            if at > passed:
                left = at
                break
            self.waiting.removeKey((at,))
            if run is not None and at - run[1] <= self.quiet and at - run[0] < self.most:
                run = (run[0], at, run[2] + n)
            else:
                if run is not None:
                    out.append(run)
                run = (at, at, n)
        if run is not None and passed > run[1] + self.quiet:
            out.append(run)
            run = None
        if run is None:
            self.run.clear()
        else:
            self.run.update(tuple(int(x) for x in run))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [t for t in (left, run[1] + self.quiet + 1 if run is not None else None) if t is not None]
        if due:
            self.handle.registerTimer(min(due))
        columns = {c: pd.Series([k] * len(out), dtype=object) for c, k in zip(self.keys, key)}
        yield pd.DataFrame(columns | {"started_ms": pd.Series([r[0] for r in out], dtype="int64"), "changes": pd.Series([r[2] for r in out], dtype="int64")})

    def close(self) -> None:
        pass


def debounce_stream(changes: DataFrame, by: tuple[str, ...], quiet: str = QUIET, most: str = MOST, delay: str = "10 seconds") -> DataFrame:
    """``*by, started, changes`` of each run of a stream of changes (ts, *by), as ``jobs.debounce_capped`` has them over a table.

    Changes may come up to ``delay`` late. The session's state store must be ``PROVIDER``.
    """
    kinds = dict(changes.dtypes)
    at = changes.withWatermark("ts", delay).select(*by, "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("at"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", started_ms long, changes long"
    runs = at.groupBy(*by).transformWithStateInPandas(Runs(tuple(by), _milliseconds(quiet), _milliseconds(most)), schema, "Append", "EventTime")
    return runs.select(*by, F.timestamp_millis("started_ms").alias("started"), "changes")
