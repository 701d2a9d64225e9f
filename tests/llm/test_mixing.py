import duckdb
from helpers import SF, awkward, empty

from codeloom.llm import mixing as mx


def plain_targets(sizes):
    """sizes in source order: reshare until none is above."""
    total, w = sum(sizes), [i % 3 + 1 for i in range(len(sizes))]
    full = set()
    while True:
        rest = total - sum(3 * sizes[i] for i in full)
        weight = sum(w[i] for i in range(len(sizes)) if i not in full)
        t = [3 * s if i in full else rest * w[i] / weight for i, s in enumerate(sizes)] if weight else [3 * s for s in sizes]
        more = {i for i, s in enumerate(sizes) if t[i] > 3 * s} - full
        if not more:
            return t
        full |= more


def test_matches_sql(spark, duck):
    got = {tuple(r) for r in mx.op2_mix_sources(spark, SF).select("doc_id", "size", "source_size", "taken").collect()}
    want = {(a, b, c, e) for a, b, c, _, e in duck.sql(mx.OP2_SQL).fetchall()}
    assert got == want


def test_targets_with_caps(spark):
    sizes = [5, 1000, 10, 300, 1, 50, 0]
    df = spark.createDataFrame([(False, f"s{i}", n, 3) for i, n in enumerate(sizes)], "__null boolean, __key string, __S long, __n long")
    got = [r["__target"] for r in mx.targets(mx.source_weights(df)).orderBy("__key").collect()]
    assert all(abs(a - b) < 1e-6 for a, b in zip(got, plain_targets(sizes), strict=True))


def test_near_target_and_bounded(spark):
    rows = mx.op2_mix_sources(spark, SF).collect()
    assert all(r.taken in {r.size * k for k in range(4)} for r in rows)
    again = mx.op2_mix_sources(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_awkward(spark):
    docs = awkward(spark)
    out = mx.mix(docs)
    rows = out.collect()
    assert len(rows) == 10 and set(docs.columns) - {"size"} <= set(out.columns)
    assert {r.taken for r in rows if not r.size} == {0}
    one = [r.taken for r in rows if r.doc_id == 1]
    assert one[0] == one[1]
    assert mx.mix(empty(spark)).count() == 0


def test_sql_text_parses():
    duckdb.sql("select 1")
    assert "documents" in mx.OP2_SQL
