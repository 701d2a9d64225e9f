"""Mixing sources to target weights by Pareto order sampling, DataFrame functions only.

A source with target t and size S gives every document floor(t / S) certain whole copies. The rest of the target is a
fixed-size sample of the source's documents with unequal inclusion probabilities: with f = frac(t / S), a document's
inclusion odds are ``f / (1 - f) * sqrt(size / mean size of its source)``, its rank is its random odds ``u / (1 - u)``
divided by its inclusion odds, and documents are taken in rank order while they fit in the words still wanted;
one more, the one whose size comes nearest to what is left, closes the gap. u comes from a hash of the id, so reruns agree.

The point where a source's sample ends is found without sorting the source: ranks are summed in ``BUCKETS`` equal
steps per source, and only the rows of the step in which the target is reached are ordered. The hot source's rows are
never brought together.

Defined results: null text has size 0 and is never taken; a null source is one source, last in order; rows with the
same id and size rank alike and share their verdict; sources without words get target 0; an empty table gives an empty
result; extra columns are kept by ``mix`` (its own start with ``__`` until the end).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read_table, stage

BUCKETS = 4096
MOST_COPIES = 3
SEED = "mix-1"


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _keys(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("__null", F.col(source).isNull()).withColumn("__key", F.coalesce(F.col(source), F.lit("")))


def source_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1 .. cycle, repeating, by the order of the sources. Rows: __null, __key, __S, __n, __w.

    The order comes from a range partitioning and each partition's count, not from one sorted task.
    """
    dealt = sizes.repartitionByRange("__null", "__key").sortWithinPartitions("__null", "__key")
    dealt = stage(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "sources")
    per = dealt.groupBy("__part").agg(F.count("*").alias("__c"), F.min("__at").alias("__first"))
    before = per.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("__before") + F.col("__at") - F.col("__first")
    return dealt.join(F.broadcast(before.drop("__c")), "__part").withColumn("__w", place % cycle + 1).select("__null", "__key", "__S", "__n", "__w")


def targets(weighted: DataFrame) -> DataFrame:
    """Add __target: the total shared by weight, at most ``MOST_COPIES`` times a source's size, the excess reshared."""
    cap = MOST_COPIES * F.col("__S")
    total = weighted.agg(F.coalesce(F.sum("__S"), F.lit(0)).alias("t"), F.coalesce(F.sum("__w"), F.lit(0)).alias("w")).first()
    num, den, full = total["t"], total["w"], -1
    while True:
        above = cap * F.lit(den).cast("long") < F.col("__w") * F.lit(num).cast("long")
        r = weighted.where(above).agg(F.count("*").alias("n"), F.coalesce(F.sum(cap), F.lit(0)).alias("c"), F.coalesce(F.sum("__w"), F.lit(0)).alias("w")).first()
        if r["n"] == full or r["w"] == total["w"]:
            break
        num, den, full = total["t"] - r["c"], total["w"] - r["w"], r["n"]
    share = (F.col("__w") * F.lit(num).cast("long")).cast("double") / F.lit(max(den, 1)).cast("double")
    return weighted.withColumn("__target", F.when(above, cap.cast("double")).otherwise(share))


def ranked(df: DataFrame, plan: DataFrame, doc_id: str) -> DataFrame:
    """Add the plan of each row's source, and its rank __z in (0, 1) where it may be sampled."""
    df = df.join(plan, ["__null", "__key"])
    code = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":" + SEED)).cast("binary")), 1, 13), 16, 10)
    df = df.withColumn("__u", (code.cast("long").cast("double") + 0.5) / F.lit(2.0**52)).withColumn("__id", F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)))
    may = (F.col("__size") > 0) & (F.col("__rest") > 0.5)
    odds = F.col("__f") / (1 - F.col("__f")) * F.sqrt(F.col("__size").cast("double") * F.col("__n").cast("double") / F.col("__S").cast("double"))
    q = F.when(may, F.col("__u") / (1 - F.col("__u")) / odds)
    return df.withColumn("__z", q / (1 + q)).withColumn("__b", F.floor(F.col("__z") * BUCKETS))


def _drawn() -> F.Column:
    """Before the cut of its source. A source whose sample takes all its documents has no edge."""
    at_edge = F.coalesce(F.struct("__z", "__id") <= F.col("__cut"), F.lit(False))
    return F.when(F.col("__z").isNull(), False).when(F.col("__edge").isNull(), True).when(F.col("__b") != F.col("__edge"), F.col("__b") < F.col("__edge")).otherwise(at_edge)


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", slim: DataFrame | None = None) -> DataFrame:
    """``df`` with size, source_size, target and taken (words, repeats counted) of each row.

    slim: the id, source and word count of the same rows if they are already at hand (then ``df`` is not read).
    """
    kept = df.columns if slim is None else [doc_id, source]
    if slim is None:
        slim = stage(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("__size")), "mix")
        rows = _keys(df.withColumn("__size", word_count(text)), source)
    else:
        rows = _keys(slim.withColumnRenamed("doc_id", doc_id).withColumnRenamed("source", source), source)
    small = _keys(slim, "source")
    sizes = small.groupBy("__null", "__key").agg(F.sum("__size").alias("__S"), F.count("*").alias("__n"))
    plan = targets(source_weights(sizes))
    whole = F.when(F.col("__S") > 0, F.floor(F.col("__target") / F.when(F.col("__S") > 0, F.col("__S")))).otherwise(0)
    plan = plan.withColumn("__whole", whole.cast("long")).withColumn("__rest", F.col("__target") - F.col("__whole") * F.col("__S"))
    plan = stage(plan.withColumn("__f", F.when(F.col("__S") > 0, F.col("__rest") / F.when(F.col("__S") > 0, F.col("__S").cast("double"))).otherwise(0.0)), "plan")

    at = ["__null", "__key"]
    drawn = ranked(small, plan, "doc_id").where("__z is not null")
    steps = drawn.groupBy(*at, "__b").agg(F.sum("__size").alias("__s"), F.first("__rest").alias("__rest"))
    run = Window.partitionBy(*at).orderBy("__b")
    steps = steps.withColumn("__upto", F.sum("__s").over(run)).withColumn("__before", F.col("__upto") - F.col("__s"))
    edge = steps.where("__before < __rest and __upto >= __rest").select(*at, F.col("__b").alias("__edge"), "__before")
    edge = stage(edge, "edge")
    # Rows of the step in which a source's target is reached; equal ranks are one.
    last = drawn.join(edge, at).where("__b = __edge").groupBy(*at, "__z", "__id").agg(F.sum("__size").alias("__s"), F.first("__rest").alias("__rest"), F.first("__before").alias("__before"))
    order = Window.partitionBy(*at).orderBy("__z", "__id")
    last = last.withColumn("__upto", F.col("__before") + F.sum("__s").over(order))
    inside = F.col("__upto") <= F.col("__rest")
    cut = last.groupBy(*at).agg(
        F.max(F.when(inside, F.struct("__z", "__id"))).alias("__cut"),
        (F.first("__rest") - F.coalesce(F.max(F.when(inside, F.col("__upto"))), F.first("__before"))).alias("__gap"),
    )
    plan = stage(plan.join(edge.drop("__before"), at, "left").join(cut, at, "left"), "cuts")
    # Of what lies beyond the cut, the document that closes the gap best.
    beyond = ranked(small, plan, "doc_id").where("__edge is not null").where(~_drawn())
    miss = F.abs(F.col("__gap") - F.col("__size"))
    close = beyond.where(miss < F.col("__gap")).groupBy(*at).agg(F.min(F.struct(miss.alias("__miss"), "__z", "__id")).alias("__close"))
    plan = stage(plan.join(close, at, "left"), "closed")

    out = ranked(rows, plan, doc_id)
    drawn_in = _drawn() | F.coalesce((F.col("__z") == F.col("__close.__z")) & (F.col("__id") == F.col("__close.__id")), F.lit(False))
    taken = F.col("__size") * (F.col("__whole") + F.when(drawn_in, 1).otherwise(0))
    own = {"size": F.col("__size"), "source_size": F.col("__S"), "target": F.col("__target"), "taken": taken.cast("long")}
    return out.select(*(F.col(f"`{c}`") for c in rows.columns if c in kept and c not in own), *(v.alias(k) for k, v in own.items()))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    slim = stage(docs.select("doc_id", "source", word_count().alias("__size")), "mix")
    return mix(docs, slim=slim).select("doc_id", "size", "source_size", "target", "taken")


#: The same rule over a table ``{docs}`` of doc_id, text and source.
MIX_SQL = r"""
SIZED AS (SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS sz FROM {docs}),
SRC AS (SELECT source, CAST(sum(sz) AS BIGINT) AS S, count(*) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM SIZED GROUP BY source),
FILL AS (SELECT *, CAST((SELECT sum(S) FROM SRC) - coalesce(sum(3 * S) OVER before, 0) AS BIGINT) AS num,
  CAST((SELECT sum(w) FROM SRC) - coalesce(sum(w) OVER before, 0) AS BIGINT) AS den
  FROM SRC WINDOW before AS (ORDER BY 3.0 * S / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
LEVEL AS (SELECT num, den FROM FILL WHERE 3 * S * den >= w * num ORDER BY 3.0 * S / w, source NULLS LAST LIMIT 1),
PLAN AS (SELECT SRC.*, CASE WHEN 3 * S * den < w * num THEN CAST(3 * S AS DOUBLE) ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target FROM SRC, LEVEL),
PLAN2 AS (SELECT *, CASE WHEN S > 0 THEN CAST(floor(target / S) AS BIGINT) ELSE 0 END AS whole FROM PLAN),
PLAN3 AS (SELECT *, target - whole * S AS rest, CASE WHEN S > 0 THEN (target - whole * S) / CAST(S AS DOUBLE) ELSE 0.0 END AS f FROM PLAN2),
DRAW AS (SELECT SIZED.*, p.S, p.target, p.whole, p.rest, p.f, p.n,
  (CAST(CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':mix-1')), 1, 13)) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM SIZED JOIN PLAN3 p ON SIZED.source IS NOT DISTINCT FROM p.source),
RANKED AS (SELECT *, CASE WHEN sz > 0 AND rest > 0.5 THEN u / (1 - u) / (f / (1 - f) * sqrt(CAST(sz AS DOUBLE) * CAST(n AS DOUBLE) / CAST(S AS DOUBLE))) END AS q FROM DRAW),
ORDERED AS (SELECT *, q / (1 + q) AS z, CASE WHEN q IS NOT NULL THEN sum(CASE WHEN q IS NULL THEN 0 ELSE sz END) OVER (PARTITION BY source ORDER BY q / (1 + q) NULLS LAST, doc_id) END AS upto FROM RANKED),
GAPS AS (SELECT *, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM ORDERED),
CLOSED AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN upto > rest AND abs(gap - sz) < gap THEN abs(gap - sz) END NULLS LAST, z, doc_id) AS place FROM GAPS),
MIXED AS (SELECT *, CAST(sz * (whole + CASE WHEN upto <= rest OR (place = 1 AND upto > rest AND abs(gap - sz) < gap) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM CLOSED)
"""

OP2_SQL = f"WITH {MIX_SQL.replace('{docs}', 'documents')} SELECT doc_id, sz AS size, S AS source_size, target, taken FROM MIXED"
