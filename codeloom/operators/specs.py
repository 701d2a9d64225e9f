"""Specs: listing, dependencies, findings, proposals, drift, duplicate bodies and frozen debt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import generic_tokens, gram_hashes, id_prefix, structural_hash, winnow
from ..sources.syntax import code_tokens
from ..staging import stage


def page(df: DataFrame, order: list, cursor: int = 0, limit: int = 200) -> DataFrame:
    """One page under a total order."""
    return df.orderBy(*order).offset(cursor).limit(limit)


def list_specs(specs: DataFrame, links: DataFrame, has_implementation: bool | None = None) -> DataFrame:
    """Specs with their number of links."""
    n = links.groupBy("spec").agg(F.count("*").alias("n_links"))
    out = specs.join(n, "spec", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    if has_implementation is None:
        return out
    done = links.where("relation = 'implements'").select("spec")
    return out.join(done, "spec", "left_semi" if has_implementation else "left_anti")


def prefix_histogram(specs: DataFrame) -> DataFrame:
    return specs.select(id_prefix(F.col("spec_id")).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


def findings(rows: DataFrame, sample: int = 5) -> DataFrame:
    """(issue, severity, n, examples): the first ``sample`` ids of each. rows: issue, severity, spec_id."""
    order = Window.partitionBy("issue", "severity").orderBy("spec_id")
    some = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample)
    examples = some.groupBy("issue", "severity").agg(F.array_join(F.array_sort(F.collect_list("spec_id")), ",").alias("examples"))
    return rows.groupBy("issue", "severity").agg(F.count("*").alias("n")).join(examples, ["issue", "severity"])


def fingerprints(bodies: DataFrame) -> DataFrame:
    """(id, structural_hash, n_tokens, marks) of bodies (id, body), by their syntax if they have a language, else by words."""
    t = code_tokens(bodies).withColumnRenamed("tokens", "t") if "language" in bodies.columns else bodies.select("id", generic_tokens(F.col("body")).alias("t"))
    return t.select("id", structural_hash(F.col("t")).alias("structural_hash"), F.size("t").alias("n_tokens"), winnow(gram_hashes(F.col("t"))).alias("marks"))


def same_structure(prints: DataFrame) -> DataFrame:
    """Members of groups with one structural hash and more than one member. The prints are made once, then counted and joined."""
    prints = stage(prints, "prints")
    n = prints.groupBy("structural_hash").agg(F.count("*").alias("n")).where("n > 1")
    return prints.join(n, "structural_hash").select(*prints.columns, "n")


def near_structure(candidates: DataFrame, corpus: DataFrame, threshold: float = 0.8, least_tokens: int = 40) -> DataFrame:
    """(candidate, id, similarity) of fingerprints that share marks; a pair needs a common mark.

    Equal sets of marks are one class, named by their hash; only classes meet, and members are joined to their class at
    the end. Two sets of sizes m <= n alike to ``threshold`` share ``threshold`` x n marks, so of each set's marks, rarest
    first in one order, some 1 - ``threshold`` hold a common one: these alone are listed, and pairs that meet there and
    are of like size are compared whole.
    """
    able = (F.col("n_tokens") >= least_tokens) & (F.size("marks") > 0)
    name = F.xxhash64(F.array_sort("marks")).alias("s")
    a = stage(candidates.where(able).select(F.col("id").alias("candidate"), name, "marks"), "candidates")
    b = stage(corpus.where(able).select("id", name, "marks"), "corpus")
    sets = lambda df: df.groupBy("s").agg(F.first("marks").alias("marks"))
    asked, known = sets(a), sets(b)
    n = known.select(F.explode("marks").alias("m")).groupBy("m").agg(F.count("*").alias("n"))

    def listed(df: DataFrame, as_: str) -> DataFrame:
        posted = df.select("s", F.size("marks").alias("k"), F.explode("marks").alias("m")).join(n, "m", "left")
        posted = posted.withColumn("nth", F.row_number().over(Window.partitionBy("s").orderBy(F.coalesce("n", F.lit(0)), "m")))
        return posted.where(F.col("nth") <= F.col("k") - F.ceil(F.col("k") * threshold - 1e-9) + 1).select(F.col("s").alias(as_), "m", F.col("k").alias("k_" + as_))

    met = listed(asked, "x").join(listed(known, "y").hint("merge"), "m").where(F.least("k_x", "k_y") >= F.greatest("k_x", "k_y") * threshold - 1e-9).select("x", "y").distinct()
    met = met.join(asked.select(F.col("s").alias("x"), F.col("marks").alias("mx")).hint("merge"), "x").join(known.select(F.col("s").alias("y"), F.col("marks").alias("my")).hint("merge"), "y")
    both = F.size(F.array_intersect("mx", "my"))
    alike = met.select("x", "y", (both / (F.size("mx") + F.size("my") - both)).alias("similarity")).where(F.col("similarity") >= threshold)
    alike = a.select("candidate", F.col("s").alias("x")).join(alike.hint("merge"), "x").select("candidate", "y", "similarity")
    return alike.join(b.select("id", F.col("s").alias("y")).hint("merge"), "y").select("candidate", "id", "similarity")


def freeze_debt(prints: DataFrame, baseline: DataFrame) -> DataFrame:
    """Members of duplicated structures that the baseline doesn't hold yet."""
    return same_structure(prints).join(baseline, ["structural_hash", "id"], "left_anti")


def changed(before: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or modified by content hash."""
    a, b = before.select(key, F.col(digest).alias("old")), now.select(key, F.col(digest).alias("new"))
    change: Column = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, key, "full_outer").withColumn("change", change).where("change is not null").select(key, "change")
