"""Coverage reports, usage logs and external graphs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PLACE = "struct<start:struct<line:int>>"
ISTANBUL = f"map<string,struct<statementMap:map<string,{_PLACE}>,s:map<string,string>,fnMap:map<string,{_PLACE}>,f:map<string,string>>>"
LOG = "timestamp string, ts string, tool_name string, args_redacted string, latency_ms long, result_chars long, error string, session_id string, workspace string, _corrupt_record string"


def read_istanbul(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of every statement or function that ran; a list of counts ran if one of them is above 0."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", ISTANBUL).alias("m")).where("m is not null")
    files = raw.select(F.explode("m").alias("path", "c"))
    found = None
    for places, counts in (("statementMap", "s"), ("fnMap", "f")):
        hit = files.select("path", F.col(f"c.{places}").alias("p"), F.explode(f"c.{counts}").alias("k", "n"))
        ran = F.exists(F.split(F.regexp_replace("n", r"[\[\]\s\"]", ""), ","), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)) > 0)
        hit = hit.where(ran).select("path", F.col("p")[F.col("k")]["start"]["line"].alias("line"))
        found = hit if found is None else found.union(hit)
    return found.where("line is not null").distinct()


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) with hits: the last ``SF:`` line above a ``DA:`` line names its file. One report is read in order."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report"), F.posexplode(F.split("value", "\n")).alias("at", "text"))
    own = F.when(F.col("text").startswith("SF:"), F.trim(F.substring("text", 4, 10_000)))
    named = raw.withColumn("path", F.last(own, ignorenulls=True).over(Window.partitionBy("report").orderBy("at")))
    da = named.where(F.col("text").startswith("DA:") & F.col("path").isNotNull())
    parts = F.split(F.substring("text", 4, 10_000), ",")
    got = da.select("path", F.trim(parts[0]).try_cast("int").alias("line"), F.trim(parts[1]).try_cast("double").alias("hits"))
    return got.where("hits > 0 and line is not null").select("path", "line").distinct()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; lines that aren't JSON are left out."""
    raw = spark.read.schema(LOG).option("mode", "PERMISSIVE").json(path)
    return raw.where("_corrupt_record is null and tool_name is not null").drop("_corrupt_record")


_GRAPH = (
    "nodes array<struct<id:string,label:string,source_file:string,source_location:string,file_type:string,community:int,_callable:boolean,_callable_class:boolean,_origin:string>>, "
    + ", ".join(f"{k} array<struct<source:string,target:string,relation:string,type:string,rel:string,confidence_score:double,weight:double,_origin:string>>" for k in ("links", "edges"))
)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a node-link JSON, with their places in it; rows without id, target or relation are left out.

    A line is the number after the L of "L53" or "L53-L60". Links may stand under ``edges``, relations under ``type``.
    """
    raw = spark.read.schema(_GRAPH).option("multiLine", True).json(path)
    nodes = raw.select(F.posexplode("nodes").alias("at", "n")).select("at", "n.*").where("id is not null")
    line = F.regexp_extract("source_location", r"^L([0-9]+)", 1).try_cast("int")
    called = F.coalesce("_callable", F.lit(False)) | F.coalesce("_callable_class", F.lit(False))
    nodes = nodes.select("id", F.coalesce("label", F.lit("")).alias("label"), "source_file", line.alias("line"), called.alias("callable"), "community", F.col("_origin").alias("origin"), "at")
    some = F.when(F.size("links") > 0, F.col("links")).otherwise(F.col("edges"))
    links = raw.select(F.posexplode(some).alias("at", "l")).select("at", "l.*")
    links = links.select("source", "target", F.coalesce("relation", "type", "rel").alias("relation"), "weight", F.col("_origin").alias("origin"), "at")
    return nodes, links.where("target is not null and relation is not null")


#: Reports that a workspace may have, below its folder of coverage. Fixed values.
REPORTS = ("coverage-final.json", "lcov.info")


def read_coverage(spark: SparkSession, root: str) -> DataFrame | None:
    """(path, line) covered by the reports below ``root``/coverage, paths relative to the root; None without a report."""
    found = None
    for name, read in zip(REPORTS, (read_istanbul, read_lcov), strict=True):
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/coverage/{name}")
        if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            lines = read(spark, f"{root}/coverage/{name}")
            found = lines if found is None else found.union(lines)
    if found is None:
        return None
    base = root.rstrip("/") + "/"
    path = F.when(F.col("path").startswith(base), F.substring("path", len(base) + 1, 100_000)).otherwise(F.regexp_replace("path", r"^\./", ""))
    return found.select(path.alias("path"), "line").distinct()
