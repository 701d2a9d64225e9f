"""Hard negatives per anchor and positive, by a full sort of each anchor's scores.

The anchors, a stated query set, go against all rows in blocks. A task holds the vectors of one round of anchors (at most
``ROUND_BYTES``, broadcast) and takes its rows batch by batch: integer scores of all anchors with the batch by a matrix
product, each anchor's scores sorted by score and id, and of the sorted batch what may be among the first of all rows.
Two passes: the first finds each anchor's positives; the second looks up each positive's upper limit in the sorted
scores by binary search and reads on among the different-label entries while they stay above the lower limit. What
leaves a task is a few rows per anchor; they are merged by anchor with ranks. More anchors mean more rounds over the
rows, not larger tasks, and nothing is dealt by label or by vector, so common labels and equal vectors have no group.

Cases: rows with a null id, label or vector, or a null or non-finite component, take no part. Repeated rows take part
each for itself, but rows of one id are no positives or negatives of each other; two anchor rows of one id give their
rows each. Vectors of unequal length meet as if the shorter one went on with zeros; an empty vector scores 0. A scaled
component beyond a long stands at a long's end; an inner product beyond +-(2**62 - 1) counts as that. Other columns of
the input are never read. No anchors or an empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, read_table, stage

#: Vectors of the anchors of one round, as float64: bounds the broadcast and what a task holds.
ROUND_BYTES = 16 << 20
ROUND_ROWS = 32_768
#: Anchors scored at once, so that a batch's scores stay in a core's cache.
AT_ONCE = 256
#: Rows a task takes at least, if there are that many; fewer where pairs are few enough for it to be quick.
TASK_ROWS, TASK_PAIRS = 131_072, 1 << 21
MOST = 2**62 - 1
NONE, NOBODY = -(2**62), 2**63 - 1


def scaled(df: DataFrame, id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v: long components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(F.col(id).isNotNull() & F.col(label).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of long components, shorter ones filled up with zeros."""
    at = lists.offsets.to_numpy()
    wide, values = np.diff(at), lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    most = int(wide.max(initial=0))
    if (wide == most).all():
        return values.reshape(len(wide), most)
    out = np.zeros((len(wide), most), np.int64)
    out[np.arange(most) < wide[:, None]] = values
    return out


def widened(m: np.ndarray, n: int) -> np.ndarray:
    return m if m.shape[1] == n else np.pad(m, ((0, 0), (0, n - m.shape[1])))


def sorted_scores(a: np.ndarray, b: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a: the rows of b by falling score, then by place, and those scores. b stands in order of its ids."""
    if exact:  # score and place in one number: sorting it sorts by score, then by place
        bits = max(1, int(len(b) - 1).bit_length())
        key = -(a @ b.T).astype(np.int64) << bits | np.arange(len(b))
        key.sort(axis=1)
        return key & ((1 << bits) - 1), -(key >> bits)
    s = np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST).astype(np.int64) if a.shape[1] else np.zeros((len(a), len(b)), np.int64)
    order = np.lexsort((np.broadcast_to(np.arange(len(b)), s.shape), -s), axis=-1)
    return order, np.take_along_axis(s, order, 1)


def blocks(batches: Iterator[pa.RecordBatch], anchors: dict):
    """(anchor slice, ids, labels, order, scores) of each block of anchors with each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, labels, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
        by_id = np.argsort(ids, kind="stable")
        ids, labels, v = ids[by_id], labels[by_id], v[by_id]
        wide = max(v.shape[1], anchors["v"].shape[1])
        v, peak = widened(v, wide), int(max(v.max(initial=0), -int(v.min(initial=0))))
        exact = peak * anchors["peak"] * wide < 1 << 50
        w = v.astype(np.float64) if exact else v
        for lo in range(0, len(anchors["id"]), AT_ONCE):
            part = slice(lo, lo + AT_ONCE)
            a = widened(anchors["v"][part], wide)
            yield part, ids, labels, *sorted_scores(a.astype(np.float64) if exact else a, w, exact)


def keep_best(held: tuple[np.ndarray, np.ndarray], part: slice, scores: np.ndarray, ids: np.ndarray) -> None:
    """Merge new candidates into what is held of these anchors: the first by score, then by id."""
    n = held[0].shape[-1]
    s, i = np.concatenate([held[0][part], scores], -1), np.concatenate([held[1][part], ids], -1)
    order = np.lexsort((i, -s), axis=-1)[..., :n]
    held[0][part], held[1][part] = np.take_along_axis(s, order, -1), np.take_along_axis(i, order, -1)


def positives_of(batches: Iterator[pa.RecordBatch], anchors: dict, k: int) -> Iterator[pa.RecordBatch]:
    """The task's first k same-label rows of each anchor: a, score, vec_id."""
    n = len(anchors["id"])
    held = np.full((n, k), NONE), np.full((n, k), NOBODY)
    for part, ids, labels, order, scores in blocks(batches, anchors):
        mine = (labels[order] == anchors["label"][part, None]) & (ids[order] != anchors["id"][part, None])
        place = mine.cumsum(1)
        r, c = np.nonzero(mine & (place <= k))
        new = np.full((len(scores), k), NONE), np.full((len(scores), k), NOBODY)
        new[0][r, place[r, c] - 1], new[1][r, place[r, c] - 1] = scores[r, c], ids[order[r, c]]
        keep_best(held, part, *new)
    r, c = np.nonzero(held[0] > NONE)
    yield pa.RecordBatch.from_pydict({"a": anchors["a"][r], "score": held[0][r, c], "vec_id": held[1][r, c]})


def negatives_of(batches: Iterator[pa.RecordBatch], anchors: dict, k: int) -> Iterator[pa.RecordBatch]:
    """The task's first k rows of another label within each positive's limits: a, j, score, vec_id."""
    upper, lower, n = anchors["upper"], anchors["lower"], len(anchors["id"])
    held = np.full((*upper.shape, k), NONE), np.full((*upper.shape, k), NOBODY)
    for part, ids, labels, order, scores in blocks(batches, anchors):
        other = (labels[order] != anchors["label"][part, None]) & (ids[order] != anchors["id"][part, None])
        new = np.full((len(scores), upper.shape[1], k), NONE), np.full((len(scores), upper.shape[1], k), NOBODY)
        for i, at in enumerate(range(*part.indices(n))):
            there = np.flatnonzero(other[i])
            if len(there):
                s = scores[i, there]
                read = np.searchsorted(-s, -upper[at])[:, None] + np.arange(k)
                inside = np.minimum(read, len(s) - 1)
                good = (read < len(s)) & (s[inside] >= lower[at][:, None])
                new[0][i][good], new[1][i][good] = s[inside][good], ids[order[i, there[inside]]][good]
        keep_best(held, part, *new)
    r, j, c = np.nonzero(held[0] > NONE)
    yield pa.RecordBatch.from_pydict({"a": anchors["a"][r], "j": pa.array(j, pa.int32()), "score": held[0][r, j, c], "vec_id": held[1][r, j, c]})


def first_of(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def limits(p: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest n with low * p <= 100 * n <= high * p, without leaving a long."""
    q, r = p // 100, p % 100
    return low * q - (-low * r) // 100, high * q + high * r // 100


def one_round(rows: DataFrame, some: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    got = some.toArrow().combine_chunks()
    lists = got.column("v").combine_chunks()
    v = matrix(lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists)
    anchors = {"a": got.column("a").to_numpy(), "id": got.column("vec_id").to_numpy(), "label": got.column("label").to_numpy(), "v": v, "peak": int(max(v.max(initial=0), -int(v.min(initial=0))))}
    sent = spark.sparkContext.broadcast(anchors)
    found = first_of(map_arrow(rows, lambda it: positives_of(it, sent.value, positives), "a long, score long, vec_id long"), ["a"], positives)
    found = stage(found, "positives")
    sent.unpersist()
    # At most ``positives`` rows for each anchor of the round.
    best = found.select("a", "rank", "score").toArrow()
    index = {a: i for i, a in enumerate(anchors["a"].tolist())}
    upper, lower = np.full((len(index), positives), NONE), np.full((len(index), positives), MOST)
    at, j, p = np.array([index[a] for a in best.column("a").to_pylist()], np.int64), best.column("rank").to_numpy() - 1, best.column("score").to_numpy()
    lower[at, j], upper[at, j] = limits(p, low, high)
    full = spark.sparkContext.broadcast(anchors | {"upper": upper, "lower": lower})
    near = first_of(map_arrow(rows, lambda it: negatives_of(it, full.value, negatives), "a long, j int, score long, vec_id long"), ["a", "j"], negatives)
    of = found.select("a", (F.col("rank") - 1).alias("j"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
    out = near.join(of, ["a", "j"]).join(some.select("a", F.col("vec_id").alias("anchor_id")), "a")
    out = stage(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    full.unpersist()
    return out


def mine(
    df: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    round_rows: int = ROUND_ROWS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: which rows of (vec_id, label) ask. Each takes its first ``positives`` other rows of its label; each of those
    gets the first ``negatives`` rows of another label with ``low * positive <= 100 * negative <= high * positive``.
    """
    slim = df.select(F.col(id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"))
    all_rows, asking = slim.count(), slim.where(anchors).count()
    pairs = max(1, all_rows * min(asking, round_rows))
    tasks = max(1, min(-(-pairs // TASK_PAIRS), max(-(-all_rows // TASK_ROWS), 4 * df.sparkSession.sparkContext.defaultParallelism)))
    rows = stage(scaled(df, id, vector, label, scale).repartition(tasks), "vectors")
    some = stage(rows.where(anchors).withColumn("a", F.monotonically_increasing_id()), "anchors")
    size = some.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("wide")).first()
    if not size["n"]:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    most = max(1, min(round_rows, ROUND_BYTES // (8 * max(1, size["wide"]))))
    rounds = -(-size["n"] // most)
    turn = F.pmod(F.xxhash64("a"), F.lit(rounds))
    return reduce(DataFrame.union, [one_round(rows, some.where(turn == r) if rounds > 1 else some, positives, negatives, low, high) for r in range(rounds)])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", shifted.alias("label")), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH R AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
S AS (SELECT a.rid, a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM R a JOIN R r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
P AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS j FROM S WHERE same),
N AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.rid, p.j ORDER BY n.score DESC, n.vec_id) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM P p JOIN S n ON n.rid = p.rid AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score WHERE p.j <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM N WHERE rank <= 5
"""
