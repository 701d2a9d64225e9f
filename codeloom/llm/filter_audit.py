"""What each filter takes away in every order of the filters: a direct relational replay.

Each document gets one bit per failed filter. Every document is crossed with the 120 orders of five filters (a broadcast
table of fixed size), its first failure in that order is computed, the five steps are exploded, and the counts are
conditional sums by (part, order, step), combined in the map task before the shuffle: a task sends at most 600 rows a
part, whatever its documents. The fifth filter asks for equal texts in the whole table. Texts go by their SHA-256; the
least id of each text that comes more than once is joined back, so a text without a copy is not shuffled for it twice,
and a hot text is a hot key of an outer join alone, which adaptive execution splits. Word and character flags are made
in one Arrow pass over whole texts, which leaves nothing but the flags.

Cases: a null text is empty, and equal to other empty ones; a null id is not greater or less than any, so such a row
fails no E and makes none fail; rows of one id and text don't make each other fail E, and count each. A null source and
an empty one are one part. Several labels of one id: any 1 counts. A text without words fails A, not B; without
characters not C. Other columns are never read. Empty table: no part, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, read_table, stage, strings

FILTERS = "ABCDE"
BITS = {f: 1 << i for i, f in enumerate(FILTERS)}
#: Characters that filter D asks for, and the capitals of filter C. Fixed values.
MARKS = "#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEPS = len(FILTERS)


def flags_of(text: str) -> tuple[int, bytes]:
    """Bits of filters A to D, and the text's SHA-256."""
    raw = text.encode()
    words = raw.split()
    few = BITS["A"] * (len(words) < 50) + BITS["B"] * (100 * len(set(words)) < 65 * len(words))
    loud = BITS["C"] * (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 5 * len(text))
    return few + loud + BITS["D"] * any(m in text for m in MARKS), hashlib.sha256(raw).digest()


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [flags_of(t) for t in strings(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], names=["doc_id", "part", "flags", "name"]
        )


def flagged(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(part, flags, good, toxic) of every document: which of the five filters it fails, and what its labels say."""
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), "text")
    rows = stage(map_arrow(slim, _flagged, "doc_id long, part string, flags int, name binary"), "flags")
    least = rows.groupBy("name").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("name", "least")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    rows = rows.join(least, "name", "left").select("doc_id", "part", (F.col("flags") + F.when(copy, BITS["E"]).otherwise(0)).alias("flags"))
    if labels is None:
        return rows.select("part", "flags", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    says = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    says = says.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    no = F.lit(False)
    return rows.join(says, "doc_id", "left").select("part", "flags", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def orders(spark: SparkSession) -> DataFrame:
    """The 120 orders: (o, filter_order, b1 .. b5), the bits in order."""
    rows = [(o, "".join(p), *(BITS[f] for f in p)) for o, p in enumerate(permutations(FILTERS))]
    return spark.createDataFrame(rows, "o int, filter_order string, " + ", ".join(f"b{i} int" for i in range(1, STEPS + 1)))


def replay(flags: DataFrame) -> DataFrame:
    """Counts by (part, filter_order, step) from the rows of ``flagged``."""
    spark = flags.sparkSession
    names = orders(spark)
    each = flags.crossJoin(F.broadcast(names.drop("filter_order")))
    first = F.lit(STEPS + 1)
    for i in range(STEPS, 0, -1):
        first = F.when(F.col("flags").bitwiseAND(F.col(f"b{i}")) != 0, i).otherwise(first)
    each = each.select("part", "o", "flags", "good", "toxic", first.alias("first"), F.posexplode(F.array(*(f"b{i}" for i in range(1, STEPS + 1)))).alias("at", "bit"))
    step, fails = F.col("at") + 1, F.col("flags").bitwiseAND(F.col("bit")) != 0
    here = F.col("first") == step
    n = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("long")
    out = each.groupBy("part", "o", step.alias("step"), "bit").agg(
        n(F.col("first") > step).alias("kept"), n(here).alias("removed"), n(fails & (F.col("first") < step)).alias("redundant"),
        n(F.col("flags") == F.col("bit")).alias("unique_fails"), n(here & F.col("good")).alias("good_lost"), n(here & F.col("toxic")).alias("toxic_lost"),
    )
    # 120 rows for each part and filter.
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")))
    return out.join(F.broadcast(names.select("o", "filter_order")), "o").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(flagged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH T AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
F AS (SELECT part, len(w) < 50 AS A, 100 * len(list_distinct(w)) < 65 * len(w) AS B,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS E,
  EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = T.doc_id AND l.quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = T.doc_id AND l.toxic = 1) AS toxic FROM T),
M AS (SELECT part, concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END, CASE WHEN D THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS fails, good, toxic FROM F),
L AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
O AS (SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order FROM L a, L b, L c, L d, L e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
X AS (SELECT M.*, O.filter_order, coalesce(list_min(list_filter([instr(O.filter_order, 'A'), instr(O.filter_order, 'B'), instr(O.filter_order, 'C'), instr(O.filter_order, 'D'), instr(O.filter_order, 'E')], lambda i: instr(M.fails, substr(O.filter_order, CAST(i AS INTEGER), 1)) > 0)), 6) AS first FROM M, O),
C AS (SELECT part, filter_order, s.step, substr(filter_order, s.step, 1) AS f,
  CAST(sum(CASE WHEN first > s.step THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN first = s.step THEN 1 ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN first < s.step AND instr(fails, substr(filter_order, s.step, 1)) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = substr(filter_order, s.step, 1) THEN 1 ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN first = s.step AND good THEN 1 ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN first = s.step AND toxic THEN 1 ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM X, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step) s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM C
"""
