"""How much of each spec tests reach: by calls, by explicit links, by the lines that coverage reports name.

Covered lines meet symbols over (path, block of lines), so a long file with many of both is no group of its own; the
three kinds of evidence are joined per (spec, symbol) and summed up once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_test_file
from .graph import reach

#: Lines of a block, and uncovered symbols that a spec names.
BLOCK, NAMED = 64, 50


def covered_symbols(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(symbol_id): symbols with a covered line (path, line) inside. A symbol without lines has none."""
    block = lambda c: F.floor(F.col(c) / BLOCK)
    spans = symbols.where("start_line <= end_line").select("symbol_id", F.col("file_path").alias("path"), "start_line", "end_line", F.explode(F.sequence(block("start_line"), block("end_line"))).alias("block"))
    met = spans.join(lines.select("path", "line", block("line").alias("block")).distinct(), ["path", "block"])
    return met.where(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("symbol_id").distinct()


def spec_test_coverage(links: DataFrame, symbols: DataFrame, edges: DataFrame, lines: DataFrame | None = None, max_depth: int = 3) -> DataFrame:
    """(spec_id, n_implementing, n_verified, ratio, source, n_uncovered, uncovered) of every spec with a link.

    An implementing symbol counts if a test reaches it within ``max_depth`` calls (derived), if a tests-link names it or
    any tests-link of the spec goes to a symbol in a test file, which may drive the product without a call that can be
    seen (explicit), or if a report covers one of its lines (report). source: which kinds did, ``both`` for the first
    two; uncovered: the first ``NAMED`` names of the rest. A spec that nothing implements has ratio 0.
    """
    in_tests = symbols.where(is_test_file(F.col("file_path"))).select("symbol_id")
    derived = reach(edges, in_tests.withColumnRenamed("symbol_id", "node"), max_depth, keep_seeds=True).select(F.col("node").alias("symbol_id")).distinct().withColumn("derived", F.lit(True))
    says = links.where("relation = 'tests'").select("spec_id", "symbol_id").distinct()
    harness = says.join(in_tests, "symbol_id", "left_semi").select("spec_id").distinct().withColumn("harness", F.lit(True))
    own = links.where("relation = 'implements'").select("spec_id", "symbol_id").distinct().join(symbols.select("symbol_id", "qualified_name"), "symbol_id", "left")
    own = own.join(derived, "symbol_id", "left").join(says.withColumn("named", F.lit(True)), ["spec_id", "symbol_id"], "left").join(harness, "spec_id", "left")
    own = own.join(covered_symbols(symbols, lines).withColumn("report", F.lit(True)), "symbol_id", "left") if lines is not None else own.withColumn("report", F.lit(None).cast("boolean"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    own = own.select("spec_id", "qualified_name", yes("derived").alias("d"), (yes("named") | yes("harness")).alias("e"), yes("report").alias("r"))
    own = own.withColumn("done", F.col("d") | F.col("e") | F.col("r"))
    per = own.groupBy("spec_id").agg(F.count("*").alias("n_implementing"), F.sum(F.col("done").cast("long")).alias("n_verified"), *(F.max(c).alias(c) for c in "der"))
    nth = F.row_number().over(Window.partitionBy("spec_id").orderBy("qualified_name"))
    left = own.where(~F.col("done") & F.col("qualified_name").isNotNull()).withColumn("nth", nth).where(F.col("nth") <= NAMED).groupBy("spec_id").agg(F.array_sort(F.collect_list("qualified_name")).alias("uncovered"))
    kinds = F.when(F.col("r"), F.concat_ws("+", F.when(F.col("d"), "derived"), F.when(F.col("e"), "explicit"), F.lit("report")))
    source = F.coalesce(kinds, F.when(F.col("d") & F.col("e"), "both").when(F.col("d"), "derived").when(F.col("e"), "explicit").otherwise("none"))
    every = links.select("spec_id").distinct().join(per, "spec_id", "left").join(left, "spec_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    ratio = F.when(n("n_implementing") > 0, F.round(F.col("n_verified") / F.col("n_implementing"), 4)).otherwise(0.0)
    return every.select("spec_id", n("n_implementing").alias("n_implementing"), n("n_verified").alias("n_verified"), ratio.alias("ratio"), source.alias("source"), (n("n_implementing") - n("n_verified")).alias("n_uncovered"), F.coalesce("uncovered", F.array().cast("array<string>")).alias("uncovered"))
