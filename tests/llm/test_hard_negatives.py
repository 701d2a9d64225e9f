import math

import numpy as np
from helpers import SF
from pyspark.sql import functions as F

from codeloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, anchor, k=5):
    """One anchor and one pair at a time, in Python's integers."""
    use = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, c in use:
        if anchor(i):
            s = sorted((-max(-hn.MOST, min(hn.MOST, sum(a * b for a, b in zip(v, w, strict=False)))), j, d) for j, w, d in use if j != i)
            for p, j, _ in [x for x in s if x[2] == c][:k]:
                near = [x for x in s if x[2] != c and 80 * -p <= 100 * -x[0] <= 100 * -p][:k]
                out += [(i, j, r, n, -p, -q) for r, (q, n, _) in enumerate(near, 1)]
    return sorted(out)


def got_of(df):
    return sorted(map(tuple, df.collect()))


def test_matches_sql_and_a_plain_loop(spark, duck):
    got = got_of(hn.op13_hard_negatives(spark, SF))
    assert got == sorted(duck.sql(hn.OP13_SQL).fetchall()) and got
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got == plain(rows, lambda i: i % 100 == 0)


def made(n, labels, seed, spread=0.3):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in r.normal(0.4, spread, 6).round(1)], int(r.integers(labels))) for i in range(n)]


def test_ties_rounds_and_batches(spark, monkeypatch):
    """Many equal scores, several rounds of anchors, batches of a few rows, blocks of two anchors."""
    monkeypatch.setattr(hn, "AT_ONCE", 2)
    rows = made(120, 3, 1, 0.15) + [(i, [0.5] * 6, i % 2) for i in range(120, 200)]  # equal vectors
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows, lambda i: i % 10 == 0)
    for most in (3, 1000):
        assert got_of(hn.mine(df, F.col("vec_id") % 10 == 0, round_rows=most)) == want
    assert len(want) > 300


def test_negative_and_zero_scores(spark):
    rows = [(0, [1.0, -1.0], 1), (1, [-1.0, 1.0], 1), (2, [0.0, 0.0], 1), (3, [0.0, 0.0], 2), (4, [-0.9, 0.9], 2), (5, [1.0, -0.9], 2), (6, [1.0, -1.0], 2), (7, [1.0, -1.0], 1)]
    got = got_of(hn.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0))
    assert got == plain(rows, lambda i: i == 0) and (0, 2, 1, 3, 0, 0) in got and not [g for g in got if g[1] == 1]


def test_awkward(spark):
    rows = made(60, 2, 3) + [(60, None, 1), (61, [1.0, None], 1), (62, [float("nan")] * 6, 1), (63, [float("inf")] * 6, 0), (64, [1.0] * 6, None), (None, [1.0] * 6, 1), (65, [], 1), (66, [0.5, 0.7], 0)]
    rows += [(67, [1e9, -1e9, 1e9, 3e8], 1), (68, [1e9, 2e9, 1e9], 0), (70, [9e8, -1e9, 1e9, 1e8], 1)]  # products beyond 2 ** 53
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("a", F.lit(1)).withColumn("v", F.lit(2))
    got = got_of(hn.mine(df, F.col("vec_id") % 10 == 0))
    assert got == plain(rows, lambda i: i % 10 == 0) and {g[0] for g in got} >= {0, 10}
    assert hn.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0 and hn.mine(df, F.lit(False)).count() == 0
    twice = spark.createDataFrame(rows[:60] + rows[:60], SCHEMA)
    got = hn.mine(twice, F.col("vec_id") == 10).collect()
    assert all(r.positive_id != 10 and r.negative_id != 10 for r in got) and len(got) % 2 == 0
    same = spark.createDataFrame([(i, [1.0], 1) for i in range(20)], SCHEMA)  # no other label
    assert hn.mine(same, F.col("vec_id") == 0).count() == 0


def test_limits():
    for p in (-7, 0, 1, 99, 100, 101, 12345, hn.MOST):
        lower, upper = (int(x) for x in hn.limits(np.int64(p), 80, 100))
        assert upper == p and 80 * p <= 100 * lower and 80 * p > 100 * (lower - 1)
