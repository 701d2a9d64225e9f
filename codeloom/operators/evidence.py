"""What a second graph of the same tree says about candidates: dead code that it sees used, tests that it sees reach product code.

nodes: id, label, source_file, line, callable, at (place in its file). links: source, target, relation, origin, at.
A graph that shares less than a tenth of its files with the index is refused: matching nothing would read as "nothing to
drop". Every step is an equi-join; the driver sees the overlap and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_file
from ..staging import stage

#: Relations by which one symbol depends on another. Fixed values.
EVIDENCE = ("calls", "indirect_call", "inherits", "mixes_in", "uses", "references", "imports", "imports_from", "re_exports")
LEAST_OVERLAP = 0.1


@dataclass
class Corroboration:
    """kept: candidates that stand. dropped: symbol_id with what speaks against them. by_relation: (relation, n) of dropped
    candidates. overlap: share of the graph's files that are indexed. not_ast: links of another origin than a parser."""

    kept: DataFrame
    dropped: DataFrame
    matched: DataFrame
    by_relation: DataFrame
    overlap: float
    not_ast: bool


def bare(name: Column) -> Column:
    """The last segment of a name, without call brackets, in lower case."""
    return F.lower(F.trim(F.element_at(F.split(F.regexp_replace(name, r"[()]+$", ""), r"\."), -1)))


def overlap(nodes: DataFrame, files: DataFrame) -> float:
    """Share of the graph's files, those with a node that has a line, that ``files`` (path) holds."""
    theirs = nodes.where("source_file <> '' and line is not null").select(F.col("source_file").alias("path")).distinct()
    ours = files.select("path").distinct().withColumn("ours", F.lit(1))
    n = theirs.join(ours, "path", "left").agg(F.count("*").alias("n"), F.count("ours").alias("both")).first()
    return n["both"] / n["n"] if n["n"] else 0.0


def matched(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol_id, id): the first node at the candidate's file and line, if it isn't the file itself and is callable or of
    that name; else the file's only node of that name."""
    n = nodes.where("source_file <> ''").withColumn("bare", bare(F.col("label")))
    file_node = F.trim("label").isin("") | (F.trim("label") == F.col("source_file")) | (F.trim("label") == F.element_at(F.split("source_file", "/"), -1))
    first = n.where("line is not null").groupBy("source_file", "line").agg(F.min(F.struct("at", "id", "bare", F.coalesce("callable", F.lit(False)).alias("callable"), file_node.alias("is_file"))).alias("p"))
    alone = n.where("label <> ''").groupBy("source_file", "bare").agg(F.min("id").alias("by_name"), F.count("*").alias("n")).where("n = 1").drop("n")
    c = candidates.select("symbol_id", F.col("file_path").alias("source_file"), F.col("start_line").cast("long").alias("line"), bare(F.col("name")).alias("bare"))
    c = c.join(first, ["source_file", "line"], "left").join(alone, ["source_file", "bare"], "left")
    here = ~F.col("p.is_file") & (F.col("p.callable") | (F.col("p.bare") == F.col("bare")))
    return c.select("symbol_id", F.coalesce(F.when(here, F.col("p.id")), "by_name").alias("id")).where("id is not null")


def inbound(found: DataFrame, links: DataFrame) -> DataFrame:
    """(symbol_id, relation, n): links of evidence that end at matched nodes."""
    return links.where(F.col("relation").isin(*EVIDENCE)).join(found, links.target == found.id).groupBy("symbol_id", "relation").agg(F.count("*").alias("n"))


def outbound(found: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol_id, relation, n): links of evidence from matched nodes, one hop, that end in a file that is no test."""
    product = nodes.where((F.coalesce("source_file", F.lit("")) != "") & ~is_test_file(F.col("source_file"))).select(F.col("id").alias("target")).distinct()
    real = links.where(F.col("relation").isin(*EVIDENCE)).join(product, "target", "left_semi")
    return real.join(found, real.source == found.id).groupBy("symbol_id", "relation").agg(F.count("*").alias("n"))


def corroborate(candidates: DataFrame, nodes: DataFrame, links: DataFrame, files: DataFrame, outward: bool = False) -> Corroboration:
    """Candidates without what the graph knows better. outward: drop those that reach product code instead of those that
    something refers to."""
    share = overlap(nodes, files)
    if share < LEAST_OVERLAP:
        raise ValueError(f"the external graph shares {share:.0%} of its files with this index: another tree, or other roots")
    found = stage(matched(candidates, nodes), "matched")
    against = stage(outbound(found, links, nodes) if outward else inbound(found, links), "evidence")
    dropped = against.groupBy("symbol_id").agg(F.array_sort(F.collect_set("relation")).alias("relations"))  # at most nine
    return Corroboration(
        candidates.join(against.select("symbol_id"), "symbol_id", "left_anti"), dropped, found, against.groupBy("relation").agg(F.count("*").alias("n")), share,
        not links.where("origin is not null and origin <> 'ast'").isEmpty(),
    )


def relation_counts(links: DataFrame) -> DataFrame:
    """(relation, n) over all links."""
    return links.groupBy("relation").agg(F.count("*").alias("n"))
