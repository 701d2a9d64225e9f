import difflib
import math
import random
import re

from pyspark.sql import functions as F

from codeloom.operators import search, specs, views
from codeloom.sources import spec_text, syntax


def plain(texts, query):
    """BM25 with phrases as units, one chunk at a time."""
    cut = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in texts}
    n, mean = len(cut), sum(map(len, cut.values())) / len(cut)
    units = [*query.phrases, *((w,) for w in query.words)]
    tf = {u: {i: sum(tuple(ts[k : k + len(u)]) == u for k in range(len(ts))) for i, ts in cut.items()} for u in units}
    out = {}
    for i, ts in cut.items():
        if all(tf[p][i] for p in query.phrases) and (not query.words or any(tf[(w,)][i] for w in query.words)):
            score = 0.0
            for u in units:
                df = sum(v > 0 for v in tf[u].values())
                score += max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf[u][i] * 2.2 / (tf[u][i] + 1.2 * (0.25 + 0.75 * len(ts) / mean)) if tf[u][i] else 0.0
            out[i] = round(score, 9)
    return out


def test_phrases_equal_a_plain_loop(spark):
    r = random.Random(5)
    texts = [(i, " ".join(r.choice(["a", "b", "a_b", "c", "user", "login", "d"]) for _ in range(r.randint(0, 30)))) for i in range(150)] + [(150, None), (151, ""), (152, "-- !!"), (153, "a a a a")]
    df = spark.createDataFrame(texts, "chunk_id long, text string")
    index, stats = search.postings(df), search.lengths(df).first()
    assert stats.n == len(texts)
    for text in ('"user login"', '"a a" d', "user.login c", '"a b" "user login" d', '"a a a"', "zzz", '"a zzz"', '""', "x*y!", '"c" "c"'):
        q = search.parse_query(text)
        got = {x.chunk_id: round(x.score, 9) for x in search.search_index(index, stats.n, stats.total, q).collect()}
        assert got == (plain(texts, q) if q.terms else {}), text
    one = {x.chunk_id: round(x.score, 9) for x in search.bm25(df, ["user", "c"]).collect()}
    assert one == {x.chunk_id: round(x.score, 9) for x in search.bm25_indexed(index, stats.n, stats.total / stats.n, ["user", "c"]).collect()} == plain(texts, search.Query((), ("user", "c")))


def test_query_parsing():
    q = search.parse_query('"user login" get_by-id x*y a.b Über "x"')
    assert q.phrases == (("user", "login"), ("x",)) and q.words == ("get", "by", "id", "xy", "a", "b", "uber") and q.mode == "mixed"
    assert search.parse_query("").mode == "tokens" and search.parse_query('"a"').mode == "phrase"


def test_syntax_tokens_equal_under_renaming():
    a = syntax.syntax_tokens("def add(a, b):\n    c = a + b\n    return c.go(1)\n")
    assert a == syntax.syntax_tokens("    def total(x, y):\n        z = x + y\n        return z.go(2)\n") == syntax.syntax_tokens("@deco\ndef f(q, r):\n    s = q + r\n    return s.go(9)\n")
    assert a != syntax.syntax_tokens("def add(a, b):\n    c = a + b\n    return c.run(1)\n") and a != syntax.syntax_tokens("def add(a, b):\n    c = a + a\n    return c.go(1)\n") and a != syntax.syntax_tokens("def add(a, b):\n    c = a + b\n    return c.go('1')\n")
    assert syntax.syntax_tokens("x = ") is None and syntax.syntax_tokens("") == ["Module"]
    assert a[:4] == ["Module", "function", "argument 0", "argument 1"]


def test_code_fingerprints(spark):
    body = "def f(a):\n" + "".join(f"    b{i} = a.m{i}(a, {i})\n" for i in range(12))
    rows = [("1", body, "python"), ("2", body.replace("a", "zz").replace("pzzss", "pass").replace("def", "def"), "python"), ("3", body.replace(".m3(", ".other("), "python"), ("4", "fn f() {", "rust"), ("5", "fn g() {", "rust"), ("6", "def (", "python"), ("7", None, "python"), ("8", None, None)]
    prints = {r.id: r for r in specs.fingerprints(spark.createDataFrame(rows, "id string, body string, language string")).collect()}
    assert prints["1"].structural_hash == prints["2"].structural_hash != prints["3"].structural_hash and prints["1"].n_tokens > 40
    assert prints["4"].structural_hash == prints["5"].structural_hash and prints["6"].n_tokens == 2 + 0 and prints["8"].n_tokens == 0
    df = specs.fingerprints(spark.createDataFrame(rows, "id string, body string, language string"))
    assert {r.id for r in specs.near_structure(df.where("id = '3'"), df).collect()} >= {"1", "2"} - ({"1", "2"} if len(prints["3"].marks) < 3 else set())


def test_did_you_mean_equals_a_plain_loop(spark):
    r = random.Random(3)
    names = ["".join(r.choice("abcdlogin_") for _ in range(r.randint(1, 12))) for _ in range(400)] + ["login", "logn", "Login", "logout"]
    rows = [(i, n, f"m{i % 7}.{n}", "function", f"m{i % 7}.py", i) for i, n in enumerate(names)]
    s = spark.createDataFrame(rows, "symbol_id long, name string, qualified_name string, kind string, file_path string, start_line int")
    for wanted in ("lgoin", "abcd", "x.y.logni", "zzzzzz", "a"):
        short = wanted.rsplit(".", 1)[-1]
        near = difflib.get_close_matches(short, sorted(set(names)), 6, 0.55)
        got = views.alike_names(s, short).orderBy(F.desc("ratio"), F.desc("name")).limit(6).collect()
        assert [x.name for x in got] == near
        q = sorted({x[2] for x in rows if short.lower() in x[2].lower()}, key=lambda x: (len(x), x))[:3]
        more = [y for n in near for y in sorted({x[2] for x in rows if x[1] == n and short.lower() not in x[2].lower()}, key=lambda y: (len(y), y))]
        assert [x.qualified_name for x in views.did_you_mean(s, wanted).orderBy("nth").collect()] == (q + more)[:3], wanted


def test_denials_reach_twelve_characters():
    known = {"foo-1": "foo-1"}
    say = lambda t: len(spec_text.annotations(t, known))
    assert say("It tests foo-1") == 1 and say("skip a b tests foo-1") == 0 and say("this does not really quite test it, tests foo-1") == 1 and say("never tests foo-1") == 0 and say("not so much as it tests foo-1") == 1


def test_grep_finds_matches_late_in_long_lines(spark, tmp_path):
    import duckdb

    from codeloom.plans.registry import ORACLES, QUERIES

    late = "x" * 4_100
    rows = [(1, late + "123"), (2, f"a\n{late} rights 7\n{late}4567\n12"), (3, "y" * 3_998 + "123"), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name, n in (("grep_regex_capped", 3), ("grep_literal", 1)):
        got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(c.sql(ORACLES[name]).fetchall()) and len(got) == n
    files = spark.createDataFrame(rows, "path long, content string")
    assert search.grep(files, "[0-9]{3}", literal=False, line_most=search.LINE_MOST).count() == 0


def test_near_structures_equal_a_plain_loop(spark):
    r = random.Random(7)
    base = [sorted(r.sample(range(60), r.randint(1, 30))) for _ in range(25)]
    sets = [sorted(set(s) ^ set(r.sample(range(60), r.randint(0, 3)))) for s in base for _ in range(5)] + [[], [1], [1]]
    df = spark.createDataFrame([(i, 50 if i % 9 else 30, s) for i, s in enumerate(sets)], "id long, n_tokens int, marks array<long>")
    got = specs.near_structure(df.where("id % 4 = 0"), df)
    able = [(i, set(s)) for i, s in enumerate(sets) if i % 9 and s]
    want = {(i, j): len(a & b) / len(a | b) for i, a in able if i % 4 == 0 for j, b in able if len(a & b) >= 0.8 * len(a | b)}
    rows = got.collect()
    assert {(x.candidate, x.id): x.similarity for x in rows} == want and len(rows) == len(want) > 60
    assert "array_intersect" in got._jdf.queryExecution().optimizedPlan().toString()  # sets are compared whole, not counted pair by pair


def test_every_document_is_asked_for_near_copies(spark, tmp_path):
    """Ids of any remainder and texts of any length, down to those of one mark and of none."""
    import duckdb

    from codeloom.plans.registry import ORACLES, QUERIES

    long = " ".join(f"a{i}, 5." if i % 3 else f"if b{i};" for i in range(60))
    rows = [(1, long), (2, long + " end"), (7, "a, 1. b"), (8, "z, 2. y"), (9, "a, 1. b. c."), (10, "z, 2. y. x."), (11, "a b"), (12, "a b"), (13, None), (14, None), (15, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["dup_near"](spark, str(tmp_path)).collect()))
    assert got == sorted(c.sql(ORACLES["dup_near"]).fetchall()) and {x[:2] for x in got} >= {(1, 2), (2, 1), (7, 8), (8, 7), (9, 10), (10, 9)}
