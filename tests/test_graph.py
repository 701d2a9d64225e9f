import random

import pytest

from codeloom.operators import graph, logs, resolve, search


@pytest.fixture(scope="module")
def tangle():
    r = random.Random(4)
    return sorted({(a, b) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(70)) if a != b})


def plain_cone(edges, start, depth, backward=False):
    best, front = {start: 0}, [start]
    for d in range(1, depth + 1):
        front = sorted({(a if backward else b) for a, b in edges for f in front if (b if backward else a) == f} - set(best))
        best.update(dict.fromkeys(front, d))
    return {k: v for k, v in best.items() if v}


@pytest.mark.parametrize("backward", [False, True])
def test_cones(spark, tangle, backward):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in tangle], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(1, 1), (2, 2)], "origin long, node long")
    got = {(r.origin, r.node): r.depth for r in graph.cones(e, seeds, 3, backward=backward).collect()}
    assert got == {(s, k): v for s in (1, 2) for k, v in plain_cone(tangle, s, 3, backward).items()}


def test_min_weight_keeps_equal(spark):
    e = spark.createDataFrame([(1, 2, 0.6), (1, 3, 0.5), (1, 3, 0.4)], "src long, dst long, weight double")
    seed = spark.createDataFrame([(1,)], "node long")
    assert [r.node for r in graph.reach(e, seed, 1, 0.6).collect()] == [2]


def test_cycle_and_closure(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, weight double")
    assert graph.creates_cycle(e, 3, 1) and not graph.creates_cycle(e, 1, 4)
    assert {r.node: r.depth for r in graph.closure(e, spark.createDataFrame([(1,)], "node long")).collect()} == {2: 1, 3: 2}


def test_pagerank_sums_to_one(spark, tangle):
    v = spark.createDataFrame([(i,) for i in range(30)], "node long")
    e = spark.createDataFrame([(a, b, 1.0) for a, b in tangle], "src long, dst long, weight double")
    got = graph.pagerank(v, e, 12).collect()
    assert len(got) == 30 and abs(sum(r["rank"] for r in got) - 1) < 1e-9


def test_resolution_rules(spark):
    s = spark.createDataFrame(
        [(1, "f", "a.f", "a.py", []), (2, "f", "b.f", "b.py", []), (3, "g", "a.g", "a.py", ["h"]), (4, "h", "b.h", "b.py", []), (5, "only", "c.only", "c.py", []), (6, "g2", "d.g2", "d.py", [])],
        "symbol_id long, name string, qualified_name string, file_path string, kind string, param_names array<string>".replace("kind string, ", ""),
    )
    refs = [(1, 3, "f", None), (2, 3, "f", "b"), (3, 3, "only", None), (4, 3, "h", None), (5, 6, "f", None), (6, 6, "only", "requests"), (7, 6, "nothing", None)]
    r = spark.createDataFrame(refs, "ref_id long, src long, target_name string, scope_module string")
    got = {(x.src, x.dst): x.weight for x in resolve.resolve_refs(r, s).collect()}
    # one lexical candidate left (a.f), one scoped candidate left for b.f, a single candidate, a parameter, an open fan-out, an outside module
    assert got == {(3, 1): 1.0, (3, 2): 1.0, (3, 5): 1.0, (6, 1): 0.5, (6, 2): 0.5}


def test_pack_chunks(spark):
    text = "\n\n".join(["x" * 40, "y" * 40, "z" * 400, "w" * 8])
    got = search.pack_chunks(spark.createDataFrame([(1, text)], "id long, text string"), 30).orderBy("chunk").collect()
    assert [(r.n_pieces, r.tokens) for r in got] == [(2, 20), (1, 100), (1, 2)]


def test_on_change(spark):
    rows = [(1, 1, 0.5), (1, 2, 0.5), (1, 3, None), (1, 4, None), (1, 5, 0.7), (2, 1, None)]
    got = logs.on_change(spark.createDataFrame(rows, "k long, t long, v double"), "k", "t", ("v",)).collect()
    assert sorted((r.k, r.t) for r in got) == [(1, 1), (1, 3), (1, 5), (2, 1)]


def test_heaviest_pairs_without_broadcast_or_shuffle_of_all(spark):
    from codeloom.operators import resolve

    s = spark.createDataFrame([(i, n, f"m{m}.{n}", f"m{m}.py") for i, n, m in [(1, "f", 1), (2, "f", 2), (3, "f", 2), (4, "g", 1), (5, "g", 1), (5, "f", 3), (6, "h", 3), (7, "h", 3)]], "symbol_id long, name string, qualified_name string, file_path string")
    refs = spark.createDataFrame([(k, a, t, m) for k, (a, t, m) in enumerate([(4, "f", "m2"), (4, "f", None), (4, "f", "m1"), (1, "g", None), (6, "f", None), (6, "g", "nowhere"), (1, "h", "m3"), (7, "f", "m2"), (7, "f", "m2"), (2, "g", "m1")])], "ref_id long, src long, target_name string, scope_module string")
    want = sorted(map(tuple, resolve.heaviest(resolve.resolve_each(refs, s)).collect()))
    got = resolve.resolve_refs(refs, s)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 8
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_routes_of_common_paths_are_dealt(spark, monkeypatch):
    from pyspark.sql import functions as F

    from codeloom.functions.paths import route_weight
    from codeloom.operators import resolve

    monkeypatch.setattr(resolve, "SHARE", 5, raising=False)
    verbs = ["GET", "post", "", None, "ALL", "PUT"]
    rows = [(i % 40, "client" if i % 3 else "server", verbs[i * i % 6], ["/a", "/b", "/c", ""][i % 7 % 4]) for i in range(300)]
    r = spark.createDataFrame(rows, "symbol_id long, role string, method string, norm_path string")
    c, s = (r.where(f"role = '{x}' and norm_path <> ''") for x in ("client", "server"))
    pairs = c.selectExpr("symbol_id src", "method cm", "norm_path").join(s.selectExpr("symbol_id dst", "method sm", "norm_path"), "norm_path").where("src <> dst")
    want = pairs.withColumn("w", route_weight(F.col("cm"), F.col("sm"))).where("w is not null").groupBy("src", "dst").agg(F.max("w"))
    got = resolve.resolve_routes(r)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    assert "share" in got._jdf.queryExecution().optimizedPlan().toString()  # no path is one task's


def test_sites_of_a_common_path_have_few_copies(spark, monkeypatch):
    from codeloom.operators import resolve

    monkeypatch.setattr(resolve, "SHARE", 10)
    client, server = spark.range(1_000).selectExpr("id src", "'/a' norm_path"), spark.range(4_000).selectExpr("id dst", "'/a' norm_path")
    c, s = resolve.dealt(client, server)
    assert c.count() + s.count() < 100_000  # 400,000 copies of servers when each share of clients met them all
    assert c.join(s, ["norm_path", "share", "part"]).select("src", "dst").distinct().count() == c.join(s, ["norm_path", "share", "part"]).count() == 4_000_000
