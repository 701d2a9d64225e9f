from collections import defaultdict
from itertools import permutations

from helpers import SF, awkward, documents, empty

from codeloom.llm import filter_audit as fa


def plain(docs, labels):
    good = {x.doc_id for x in labels if x.quality == 1 and x.doc_id is not None}
    toxic = {x.doc_id for x in labels if x.toxic == 1 and x.doc_id is not None}
    least = {}
    for d in docs:
        if d.doc_id is not None:
            least[d.text or ""] = min(d.doc_id, least.get(d.text or "", d.doc_id))
    out, shapley, parts = defaultdict(lambda: [0] * 6), defaultdict(int), {d.source or "" for d in docs}
    for p in parts:
        for o in permutations("ABCDE"):
            for k in range(1, 6):
                out[p, "".join(o), k] = [0] * 6
    for d in docs:
        t, p = d.text or "", d.source or ""
        w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in t for c in "#$%&*|"), "E": d.doc_id is not None and d.doc_id > least[t]}
        for o in permutations("ABCDE"):
            gone = False
            for k, f in enumerate(o, 1):
                row = out[p, "".join(o), k]
                here = fails[f] and not gone
                row[2] += fails[f] and gone
                row[3] += fails[f] and sum(fails.values()) == 1
                row[1] += here
                row[4] += here and d.doc_id in good
                row[5] += here and d.doc_id in toxic
                shapley[p, f] += here
                gone |= here
                row[0] += not gone
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got_of(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_equals_a_plain_loop(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert got_of(fa.op12_filter_audit(spark, SF)) == plain(documents(spark).collect(), labels.collect())


def test_matches_sql(spark, duck):
    df = fa.op12_filter_audit(spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(duck.sql(f"select {', '.join(df.columns)} from ({fa.OP12_SQL})").fetchall())


def test_awkward(spark):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    docs = awkward(spark).withColumnRenamed("b", "part").withColumnRenamed("s", "flags")
    got = got_of(fa.replay(fa.flagged(docs, labels)))
    assert got == plain(docs.collect(), labels.collect()) and len(got) == 3 * 600
    assert got_of(fa.replay(fa.flagged(docs))) == plain(docs.collect(), [])
    assert fa.replay(fa.flagged(empty(spark), labels)).count() == 0
    assert got_of(fa.replay(fa.flagged(docs, labels.limit(0)))) == plain(docs.collect(), [])


def test_orders(spark):
    rows = fa.orders(spark).collect()
    assert len({r.filter_order for r in rows}) == 120 and all([fa.BITS[f] for f in r.filter_order] == [r.b1, r.b2, r.b3, r.b4, r.b5] for r in rows)
