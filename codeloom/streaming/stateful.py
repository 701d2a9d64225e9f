"""Streams that remember: series that are recorded when they change, and bursts of events that end in silence.

State lives per key in the RocksDB store beside the query's checkpoint, so a query that starts again goes on where it
stopped. A key's state is its last values, or one entry per path of its open burst; neither is ever gathered in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Processors with timers and several states need this store; a session that has chosen one of its own keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(key):
        spark.conf.set(key, PROVIDER)


class Changes(StatefulProcessor):
    """Of each key the rows that differ from the last one recorded; the first always counts."""

    def __init__(self, at: str, values: tuple[str, ...], tolerance: float):
        self.at, self.values, self.tolerance = at, values, tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", ", ".join(f"v{i} double" for i in range(len(self.values))))

    def _moved(self, old: tuple, new: tuple) -> bool:
        return any((a is None) != (b is None) or (a is not None and abs(a - b) > self.tolerance) for a, b in zip(old, new, strict=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.last.get()) if self.last.exists() else None
        for df in [pd.concat(list(rows)).sort_values(self.at, kind="stable")]:  # one key's rows of one batch
            kept = []
            for place, row in enumerate(df[list(self.values)].itertuples(index=False, name=None)):
                new = tuple(None if pd.isna(x) else float(x) for x in row)
                if old is None or self._moved(old, new):
                    kept.append(place)
                    old = new
            if kept:
                self.last.update(old)
                yield df.iloc[kept]

    def close(self) -> None:
        pass


def record_on_change(series: DataFrame, key: str, at: str, values: tuple[str, ...], tolerance: float = 1e-9) -> DataFrame:
    """The streaming form of ``logs.on_change``: rows of a series (key, at, values ...) that differ from the one before.

    Rows of a batch are taken in order of ``at``; batches in order of arrival: a row that comes late is held against what
    was recorded last, as an append-only log would.
    """
    with_state_store(series.sparkSession)
    slim = series.select(key, at, *(F.col(v).cast("double").alias(v) for v in values))
    return slim.groupBy(key).transformWithStateInPandas(Changes(at, values, tolerance), outputStructType=slim.schema, outputMode="Append", timeMode="None")


class Silence(StatefulProcessor):
    """The paths of a burst once its key has been quiet for a time by the clock."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            for path, n in df.groupby("path").size().items():
                held = self.paths.getValue((path,))[0] if self.paths.containsKey((path,)) else 0
                self.paths.updateValue((path,), (held + int(n),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame({"key": [], "path": [], "n_events": [], "closed_ms": []}).astype({"key": "str", "path": "str", "n_events": "int64", "closed_ms": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, rows = expiredTimerInfo.getExpiryTimeInMs(), []
        for (path,), (n,) in self.paths.iterator():
            rows.append((key[0], path, n, at))
            if len(rows) == 10_000:
                yield pd.DataFrame(rows, columns=["key", "path", "n_events", "closed_ms"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["key", "path", "n_events", "closed_ms"])
        self.paths.clear()

    def close(self) -> None:
        pass


def quiet_bursts(events: DataFrame, quiet_ms: int = 2_000) -> DataFrame:
    """(key, path, n_events, closed_ms): the files of each burst of events (key, path), told once when the key has had no
    event for ``quiet_ms`` of wall-clock time. Events that come before that join the open burst and put its end off. When a
    query starts again from its checkpoint, open bursts wait for the first event of any key: Spark runs no batch before."""
    with_state_store(events.sparkSession)
    slim = events.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "path").where("path is not null")
    return slim.groupBy("key").transformWithStateInPandas(Silence(quiet_ms), outputStructType="key string, path string, n_events long, closed_ms long", outputMode="Append", timeMode="ProcessingTime")
