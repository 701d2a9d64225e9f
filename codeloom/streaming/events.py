"""Change events and the call log as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import language_of
from ..sources.files import IGNORED_DIRS
from ..sources.reports import LOG


def relevant(events: DataFrame) -> DataFrame:
    """Events (path, ts) of files in a known language outside hidden and ignored folders."""
    parts = F.split("path", "/")
    inside = ~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.startswith(".") | p.isin(*IGNORED_DIRS))
    return events.where(language_of(F.col("path")).isNotNull() & inside)


def bursts(events: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """One row per burst of events: its files. A burst ends after ``quiet`` without an event, once the watermark passes."""
    timed = relevant(events).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", quiet).alias("w")).agg(F.collect_set("path").alias("paths"), F.count("*").alias("n_events")).select("w.start", "w.end", "paths", "n_events")


def reindex(bursts_: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each batch of burst files (path) to ``index``."""

    def each(batch: DataFrame, number: int) -> None:
        index(batch.select(F.explode("paths").alias("path")).distinct(), number)

    return bursts_.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").start()


def call_log(spark: SparkSession, folder: str) -> DataFrame:
    """The growing JSON-lines call log; broken lines left out."""
    raw = spark.readStream.schema(LOG).json(folder)
    return raw.where("tool_name is not null").drop("_corrupt_record")


def running_tool_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("tool_name").agg(F.count("*").alias("calls"), F.sum(F.col("error").isNotNull().cast("long")).alias("errors"))
