"""The star-schema test tables seen as the engine's model. These are stand-ins, not a data model of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import normalize_route

KINDS = {"ECONOMY": "function", "MEDIUM": "function", "STANDARD": "function", "SMALL": "method", "PROMO": "method", "LARGE": "class"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as symbols: a brand is a file, every fifth one a test file."""
    p = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    name = F.translate("p_name", " ", "_")
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("p_type")]
    path = F.when(brand % 5 == 0, F.concat(F.lit("tests/test_brand"), brand, F.lit(".py"))).otherwise(F.concat(F.lit("src/brand"), brand, F.lit(".py")))
    return p.select(
        F.col("p_partkey").alias("symbol_id"), name.alias("name"), F.concat(F.lit("brand"), brand, F.lit("."), name, F.lit("_"), "p_partkey").alias("qualified_name"),
        path.alias("file_path"), kind.alias("kind"), ((F.col("p_partkey") % 100) * 10 + 1).cast("long").alias("start_line"), ((F.col("p_partkey") % 100) * 10 + 1 + F.col("p_size")).cast("long").alias("end_line"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order as calls, weighted by discount."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_discount"))
    d = F.col("l_discount")
    weight = F.when(d >= 0.09, 1.0).when(d >= 0.07, 0.9).when(d >= 0.05, 0.7).otherwise(0.5)
    e = line.select(F.col("l_partkey").alias("src"), nxt.alias("dst"), weight.alias("weight")).where("dst is not null and src <> dst")
    return e.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as specs, linked to parts."""
    line = table(spark, sf_dir, "lineitem")
    relation = F.when(F.col("l_returnflag") == "R", "tests").when(F.col("l_returnflag") == "A", "implements").otherwise("references")
    return line.select(F.col("l_suppkey").alias("spec"), F.col("l_partkey").alias("symbol_id"), relation.alias("relation"), (1 - 5 * F.col("l_discount")).alias("confidence"))


def tight_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of large, much reduced lines alone: few enough that some symbols have no caller."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_quantity")
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_discount"))
    e = line.select(F.col("l_partkey").alias("src"), nxt.alias("dst"), "l_discount", "l_quantity").where("dst is not null and src <> dst and l_discount >= 0.09 and l_quantity >= 45")
    return e.select("src", "dst", F.lit(1.0).alias("weight")).distinct()


def tight_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implementing links of large lines at full price."""
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_discount = 0 and l_quantity >= 49")
    return line.select(F.col("l_suppkey").alias("spec"), F.col("l_partkey").alias("symbol_id"), F.lit("implements").alias("relation"), F.lit(1.0).alias("confidence"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls as servers, their hrefs as clients."""
    p = table(spark, sf_dir, "pages")
    server = p.select(F.col("page_id").alias("symbol_id"), F.lit("server").alias("role"), F.when(F.col("page_id") % 3 == 0, "GET").otherwise("ROUTE").alias("method"), normalize_route(F.col("url")).alias("norm_path"))
    href = p.select(F.col("page_id").alias("symbol_id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    client = href.select("symbol_id", F.lit("client").alias("role"), F.lit("GET").alias("method"), normalize_route(F.col("href")).alias("norm_path"))
    # every site also calls its neighbour page, so that some paths meet
    near = p.select((F.col("page_id") + 1).alias("symbol_id"), F.lit("client").alias("role"), F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST").alias("method"), normalize_route(F.regexp_replace("url", "[0-9]+", ":id")).alias("norm_path")).where("symbol_id % 4 = 0")
    return server.union(client).union(near)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a tool call log."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("tool_name"), "ts", F.col("user_id").alias("session_id"), F.floor(F.col("value") * 10).cast("long").alias("latency_ms"), F.get_json_object("props", "$.k").cast("long").alias("result_chars"), (F.col("event_type") == "error").alias("error"))


# ---- the same in DuckDB's SQL
SYM = """sym AS (SELECT p_partkey AS symbol_id, translate(p_name, ' ', '_') AS name,
  concat('brand', b, '.', translate(p_name, ' ', '_'), '_', p_partkey) AS qualified_name,
  CASE WHEN b % 5 = 0 THEN concat('tests/test_brand', b, '.py') ELSE concat('src/brand', b, '.py') END AS file_path,
  CASE p_type WHEN 'SMALL' THEN 'method' WHEN 'PROMO' THEN 'method' WHEN 'LARGE' THEN 'class' ELSE 'function' END AS kind,
  CAST((p_partkey % 100) * 10 + 1 AS BIGINT) AS start_line, CAST((p_partkey % 100) * 10 + 1 + p_size AS BIGINT) AS end_line
  FROM (SELECT *, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS b FROM part))"""
EDGE = """edge AS (SELECT src, dst, max(weight) AS weight FROM (SELECT l_partkey AS src,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount) AS dst,
  CAST(CASE WHEN l_discount >= CAST(0.09 AS DOUBLE) THEN 1.0 WHEN l_discount >= CAST(0.07 AS DOUBLE) THEN 0.9 WHEN l_discount >= CAST(0.05 AS DOUBLE) THEN 0.7 ELSE 0.5 END AS DOUBLE) AS weight
  FROM lineitem) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""
TIGHT = """tight AS (SELECT DISTINCT src, dst, CAST(1.0 AS DOUBLE) AS weight FROM (SELECT l_partkey AS src, l_discount, l_quantity,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst AND l_discount >= CAST(0.09 AS DOUBLE) AND l_quantity >= 45)"""
FEW = "few AS (SELECT l_suppkey AS spec, l_partkey AS symbol_id, 'implements' AS relation FROM lineitem WHERE l_returnflag = 'A' AND l_discount = 0 AND l_quantity >= 49)"
LINK = """link AS (SELECT l_suppkey AS spec, l_partkey AS symbol_id,
  CASE l_returnflag WHEN 'R' THEN 'tests' WHEN 'A' THEN 'implements' ELSE 'references' END AS relation, 1 - 5 * l_discount AS confidence FROM lineitem)"""


def _norm(x: str) -> str:
    s = f"regexp_replace(CASE WHEN regexp_matches(trim({x}), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+$') THEN '/' ELSE regexp_replace(trim({x}), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+/', '/') END, '[?#].*$', '')"
    for p in ("<[^>]+>", r"\{[^}]+\}", ":[A-Za-z_][A-Za-z0-9_]*", r"\*+"):
        s = f"regexp_replace({s}, '{p}', '{{}}', 'g')"
    s = f"array_to_string(list_transform(string_split({s}, '/'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN '{{}}' ELSE p END), '/')"
    s = f"regexp_replace(concat('/', {s}), '/+', '/', 'g')"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' WHEN length({s}) > 1 THEN regexp_replace({s}, '/$', '') ELSE {s} END"


ROUTE = f"""raw_route AS (SELECT page_id AS symbol_id, 'server' AS role, CASE WHEN page_id % 3 = 0 THEN 'GET' ELSE 'ROUTE' END AS method, url AS u FROM pages
  UNION ALL SELECT page_id, 'client', 'GET', unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages
  UNION ALL SELECT page_id + 1, 'client', CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END, regexp_replace(url, '[0-9]+', ':id', 'g') FROM pages WHERE (page_id + 1) % 4 = 0),
route AS (SELECT symbol_id, role, method, {_norm('u')} AS norm_path FROM raw_route)"""
LOG = """log AS (SELECT event_id, event_type AS tool_name, ts, user_id AS session_id, CAST(floor(value * 10) AS BIGINT) AS latency_ms,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS result_chars, event_type = 'error' AS error FROM events)"""
