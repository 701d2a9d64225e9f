"""Usage log analytics and record-on-change series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tool_stats(log: DataFrame) -> DataFrame:
    """Per tool: calls, errors, percentiles of latency and result size.

    Percentiles come from counted values: rank of each distinct value by running counts, so no group is collected.
    """
    per = log.groupBy("tool_name").agg(F.count("*").alias("calls"), F.sum(F.col("error").cast("long")).alias("errors"), F.max("result_chars").alias("result_chars_max"))
    for value, p, name in (("latency_ms", 0.5, "latency_ms_p50"), ("latency_ms", 0.95, "latency_ms_p95"), ("result_chars", 0.5, "result_chars_p50")):
        counted = log.groupBy("tool_name", value).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("tool_name").orderBy(value))
        total = F.sum("n").over(Window.partitionBy("tool_name"))
        place = F.least(F.floor(total * F.lit(p)), total - 1)
        at = counted.withColumn("upto", upto).withColumn("place", place).where("upto > place").groupBy("tool_name").agg(F.min(value).alias(name))
        per = per.join(at, "tool_name")
    return per


def followups(log: DataFrame, most: int = 20) -> DataFrame:
    """Commonest pairs of consecutive calls in a session."""
    nxt = F.lead("tool_name").over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
    pairs = log.where("session_id is not null").select(F.col("tool_name").alias("a"), nxt.alias("b")).where("b is not null")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(most)


def silent_tools(log: DataFrame, known: DataFrame) -> DataFrame:
    return known.select("tool_name").distinct().join(log.select("tool_name"), "tool_name", "left_anti")


def on_change(series: DataFrame, key: str, at: str, values: tuple[str, ...], tolerance: float = 1e-9) -> DataFrame:
    """Rows that differ from the one before them of their key (null-safe); the first always counts."""
    w = Window.partitionBy(key).orderBy(at)
    moved = F.lag(F.lit(1)).over(w).isNull()
    for v in values:
        old = F.lag(v).over(w)
        moved = moved | ~F.coalesce(F.abs(F.col(v) - old) <= tolerance, F.col(v).isNull() & old.isNull())
    return series.withColumn("moved", moved).where("moved").drop("moved")
