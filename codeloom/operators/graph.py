"""Graph operators over (vertices, edges) DataFrames: bounded cones, closures, PageRank, cycles.

Edges have ``src``, ``dst`` and ``weight``. Every step is an equi-join on the frontier; frontiers and visited sets stay
DataFrames and are staged each level, so lineage doesn't grow and a lost executor costs one level.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def simple(edges: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """One edge per pair, the heaviest; edges below ``min_weight`` dropped."""
    e = edges.where(F.col("weight") >= min_weight) if min_weight > 0 else edges
    return e.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def cones(edges: DataFrame, seeds: DataFrame, max_depth: int | None, min_weight: float = 0.0, backward: bool = False, keep_seeds: bool = False) -> DataFrame:
    """(origin, node, depth): nodes within ``max_depth`` (None: any number) of each origin at their least depth.

    seeds: (origin, node). An origin's own seeds are left out unless ``keep_seeds``. Many origins share one frontier.
    """
    e = simple(edges, min_weight).select(*((F.col("dst"), F.col("src")) if backward else (F.col("src"), F.col("dst"))))
    e = e.toDF("at", "next")
    if max_depth is None or max_depth > 1:
        e = stage(e, "edges")  # every level reads it
    seen = seeds.select("origin", "node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(e, frontier.node == e.at).select("origin", F.col("next").alias("node")).distinct()
        frontier = step.join(seen, ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth))
        if max_depth is None or depth < max_depth:
            frontier = stage(frontier, "frontier")
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
            if depth % 16 == 0:
                seen = stage(seen, "seen")  # one table again, so that the plan stays small
        else:
            seen = seen.unionByName(frontier)
    return seen if keep_seeds else seen.where("depth > 0")


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None, min_weight: float = 0.0, backward: bool = False, keep_seeds: bool = False) -> DataFrame:
    """(node, depth) from all ``seeds`` (node) at once."""
    one = cones(edges, seeds.select(F.lit(0).alias("origin"), "node"), max_depth, min_weight, backward, keep_seeds)
    return one.select("node", "depth")


def closure(edges: DataFrame, seeds: DataFrame, backward: bool = False) -> DataFrame:
    """(node, depth): everything reachable, to a fixpoint."""
    return reach(edges, seeds, None, backward=backward)


def walk(edges: DataFrame, root: int, max_depth: int, direction: str = "forward") -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges traversed) from ``root``: forward, backward or both over one visited set.

    edges: src, dst, kind. An edge is traversed from a node nearer than ``max_depth``; each is given once, with the
    kind that sorts first.
    """
    ways = {"forward": (("src", "dst"),), "backward": (("dst", "src"),), "both": (("src", "dst"), ("dst", "src"))}[direction]
    parts = [edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(1.0).alias("weight")) for a, b in ways]
    seed = edges.sparkSession.createDataFrame([(root,)], "node long")
    nodes = reach(parts[0].union(parts[1]) if len(parts) > 1 else parts[0], seed, max_depth, keep_seeds=True)
    nodes = stage(nodes, "walk")
    near = nodes.where(F.col("depth") < max_depth)
    met = [edges.join(near.select(F.col("node").alias(a)), a, "left_semi").select("src", "dst", "kind") for a, _ in ways]
    every = met[0].union(met[1]) if len(met) > 1 else met[0]
    return nodes, every.groupBy("src", "dst").agg(F.min("kind").alias("kind"))


def creates_cycle(edges: DataFrame, src: int, dst: int) -> bool:
    """Would the edge src -> dst close a cycle?"""
    if src == dst:
        return True
    start = edges.sparkSession.createDataFrame([(dst,)], "node long")
    return not closure(edges, start).where(F.col("node") == src).isEmpty()


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int = 50, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank), unweighted, the mass of nodes without out-edges shared by all.

    Each round is one job over staged tables: a join of the edges with the ranks' shares and a sum per node. Only the
    loose mass and, where a tolerance is asked for, the movement come to the driver.
    """
    nodes = vertices.select("node").distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    e = edges.select("src", "dst").distinct().join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    e = stage(e, "edges")
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    ranks = stage(nodes.join(out, "node", "left").withColumn("rank", F.lit(1.0 / n)), "ranks")
    for _ in range(rounds):
        loose = ranks.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        share = ranks.where("out is not null").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("share"))
        sent = e.join(share, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("sent"))
        rank = (1 - damping) / n + damping * (F.coalesce("sent", F.lit(0.0)) + F.lit(loose) / n)
        new = stage(ranks.withColumnRenamed("rank", "old").join(sent, "node", "left").select("node", "out", "old", rank.alias("rank")), "ranks")
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] if tolerance > 0 else None
        ranks = new.drop("old")
        if moved is not None and moved < tolerance:
            break
    return ranks.select("node", "rank")
