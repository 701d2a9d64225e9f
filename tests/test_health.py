"""Liveness, handlers, second opinions and incremental edges on extracted trees, against plain loops."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.functions.frameworks import ENTRY_DECORATORS
from codeloom.operators import evidence, handlers, indexing, liveness, resolve
from codeloom.sources import code, protection
from codeloom.workspace import Workspace

TREE = {
    "pkg/used.py": 'class Made:\n    def one(self):\n        return 1\n\n    def two(self):\n        return 2\n\n\nclass Idle:\n    def three(self):\n        return 3\n\n\ndef small():\n    return 1\n\n\ndef my_state():\n    return 2\n\n\ndef make():\n    return Made()\n\n\ndef outer():\n    def inner():\n        pass\n\n    return run(cb=inner)\n\n\nif True:\n    outer()\n',
    "pkg/deco.py": 'import mcp\n\ntool_alias = mcp.tool if mcp else noop_deco\n\n\ndef noop_deco(f):\n    return f\n\n\n@tool_alias\ndef served():\n    return 1\n\n\n@app.get("/x")\ndef routed():\n    return 2\n\n\ndef plain():\n    return make_not()\n',
    "web/panel.component.ts": "@Component\nexport class Panel {\n  save() {\n    return 1;\n  }\n}\n@NgModule\nexport class Mod {\n  ngOnInit() {\n    return 1;\n  }\n  other() {\n    return 2;\n  }\n}\nclass Bare {\n  lonely() {\n    return 1;\n  }\n}\n",
    "web/routes.ts": "import express from 'express';\nimport details from './controllers/details';\nimport * as health from './controllers/health';\nimport { list as listAll } from './controllers/list';\nconst app = express();\napp.get('/details', wrap(details));\napp.get('/health', health.check);\napp.post('/list', auth, listAll);\napp.get('/inline', async (c) => c.text('x'));\napp.route('/api', subApp);\napp.get('/far', farAway);\n",
    "web/controllers/details.ts": "function helper() {\n  return 1;\n}\nfunction details(req) {\n  return 2;\n}\nfunction lost() {\n  return 3;\n}\n",
    "web/controllers/health.ts": "function check() {\n  return 1;\n}\n",
    "web/controllers/list.ts": "function first() {\n  return 1;\n}\nfunction second() {\n  return 1;\n}\n",
    "web/other/details.ts": "function details() {\n  return 9;\n}\nfunction farAway() {\n  return 9;\n}\n",
    "srv/Service.java": "@Service\npublic class Orders {\n    void handle() {\n        go();\n    }\n}\nclass Loose {\n    private void drop() {\n        go();\n    }\n}\n",
    "lib/a.rs": "pub fn open() {\n}\npub(crate) fn inner() {\n}\n",
    "tests/test_used.py": "from pkg.used import make\n\n\ndef test_make():\n    assert make()\n\n\ndef helper():\n    return other()\n\n\ndef other():\n    return 1\n\n\ndef test_loop():\n    helper()\n",
    "tests/test_client.py": "from fastapi.testclient import TestClient\n\n\ndef test_api():\n    c = TestClient(app)\n",
    "tests/conftest.py": "def pytest_setup():\n    return 1\n",
}


def write(root, tree):
    for p, t in tree.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write(root, TREE)
    w = Workspace(spark)
    w.index_project(str(root))
    w.root = root
    return w


def plain_dead(symbols, edges, protected, served):
    """The rules, one symbol at a time."""
    called = {e.dst for e in edges}
    names = {p.name for p in protected if p.category not in ("nested", "alias")}
    nested = {(p.path, p.name) for p in protected if p.category == "nested"}
    alias = {p.name.lower() for p in protected if p.category == "alias"}
    marks = {s.qualified_name: {d.split(".")[-1].lower() for d in s.decorators or []} for s in symbols if s.kind == "class"}
    live = {s.qualified_name for s in symbols if s.kind == "class" and s.symbol_id in called}
    out = {}
    for s in symbols:
        if s.symbol_id in called:
            continue
        deco = {d.split(".")[-1].lower() for d in s.decorators or []}
        owner, short = s.qualified_name.rsplit(".", 1)[0], s.qualified_name.split(".")[-2]
        m = marks.get(owner, set())
        if s.file_path.startswith("tests/"):
            why = "tests"
        elif any(x.startswith("__") and x.endswith("__") for x in s.qualified_name.split(".")) or (s.kind in ("function", "method") and s.name.endswith(("_state", "_settings", "_config", "_session"))):
            why = "infrastructure"
        elif deco & (set(ENTRY_DECORATORS) | alias) or s.name.lower() in alias:
            why = "infrastructure"
        elif s.visibility in ("pub", "public", "exported"):
            why = "public"
        elif s.symbol_id in served:
            why = "handler"
        elif s.name in names or (s.file_path, s.name) in nested:
            why = "infrastructure"
        elif s.kind == "method" and (short in names or owner in live or m & {"component", "directive", "pipe", "injectable", "service", "controller", "repository", "restcontroller"} or (s.name == "ngOnInit" and "ngmodule" in m)):
            why = "infrastructure"
        else:
            why = None
        out[s.qualified_name] = why
    return out


def test_dead_code_equals_plain_rules(ws):
    served = {r.symbol_id for r in handlers.handler_symbols(ws.routes, ws.symbols).collect()}
    want = plain_dead(ws.symbols.collect(), ws.edges().collect(), ws.protected.collect(), served)
    got = {r.qualified_name: r.reason for r in ws.find_dead_code(include_non_python=True).collect()}
    assert got == want
    dead = {q for q, why in got.items() if why is None}
    assert {"pkg.used.small", "pkg.used.Idle.three", "web.panel.component.Bare.lonely", "web.controllers.details.lost", "srv.Service.Loose.drop", "lib.a.inner", "web.panel.component.Mod.other"} <= dead
    assert not dead & {"pkg.used.Made.one", "pkg.used.Made.two", "web.panel.component.Panel.save", "web.panel.component.Mod.ngOnInit", "srv.Service.Orders.handle", "pkg.deco.noop_deco", "pkg.deco.served", "web.controllers.details.details", "lib.a.open", "pkg.used.outer.inner"}
    rules = {r.qualified_name: r.class_rule for r in ws.find_dead_code(include_non_python=True).collect() if r.class_rule}
    assert rules["pkg.used.Made.two"] == "called" and rules["web.panel.component.Panel.save"] == "template" and rules["srv.Service.Orders.handle"] == "stereotype" and rules["web.panel.component.Mod.ngOnInit"] == "hook"
    every = {r.qualified_name for r in ws.find_dead_code(include_non_python=True, include_infrastructure=True, include_public=True, include_tests=True).where("reason is null").collect()}
    assert {"pkg.used.Made.one", "lib.a.open", "pkg.used.my_state", "pkg.deco.routed"} <= every and "web.controllers.details.details" not in every


def test_class_rules_are_one_row_each(spark):
    rows = [(1, "C", "m.C", "class", ["Component", "x.Injectable"]), (2, "C", "m.C", "class", None), (3, "f", "m.C.f", "method", None), (4, "f", "f", "method", None), (5, "D", "m.D", "class", [])]
    s = spark.createDataFrame(rows, "symbol_id long, name string, qualified_name string, kind string, decorators array<string>")
    e = spark.createDataFrame([(9, 2, 1.0), (9, 3, 1.0)], "src long, dst long, weight double")
    assert [(r.owner, r.rule) for r in liveness.class_rules(s, e).collect()] == [("m.C", "called")]
    got = {r.symbol_id: r.class_rule for r in liveness.with_class_rule(s, s, e).collect()}
    assert got == {1: None, 2: None, 3: "called", 4: None, 5: None}
    assert liveness.with_class_rule(s.limit(0), s, e.limit(0)).count() == 0


def test_handlers(ws):
    got = {r.http: (r.qualified_name, r.resolution) for r in ws.find_endpoints("express").collect()}
    assert got == {
        "GET /details": ("web.controllers.details.details", "import"), "GET /health": ("web.controllers.health.check", "import"),
        "POST /list": ("web.controllers.list.first", "first_function"), "GET /inline": ("web.routes.__module__", "enclosing_scope"),
        "ROUTE /api": ("web.routes.__module__", "enclosing_scope"), "GET /far": ("web.other.details.farAway", "by_name"),
    }
    assert ws.find_endpoints("hono").count() == 0 and {r.qualified_name for r in ws.find_endpoints("fastmcp").collect()} == {"pkg.deco.served"}
    every = {(r.qualified_name, r.source) for r in ws.find_endpoints().collect()}
    assert ("pkg.deco.routed", "decorator") in every and ("web.controllers.health.check", "route") in every and ("pkg.deco.served", "decorator") not in every
    assert {r.http for r in ws.find_endpoints().where("qualified_name = 'pkg.deco.routed'").collect()} == {"GET /x"}


def test_handler_arguments():
    say = lambda a: code.handler_of(a)
    assert say("show") == ("show", "show") and say("ctrl.show") == ("show", "ctrl") and say("wrap(ctrl.show)") == ("show", "ctrl") and say("wrap( )") == ("wrap", "wrap") and say("a(b(c))") == ("c", "c")
    assert say("async (c) => c.text()") == say("function (a) { b() }") == say("{ a: b }") == say("") == say("null") == (None, None)
    assert protection._decorator_names(__import__("ast").parse("a = x.task").body[0]) == {"a"} and protection._decorator_names(__import__("ast").parse("a = x.other").body[0]) == set()


def test_orphan_tests(ws):
    got = {r.qualified_name: (r.reason, r.reasons, r.confidence) for r in ws.find_orphan_tests().collect()}
    assert got == {"tests.test_used.helper": ("cone_stays_in_tests", ["cone_stays_in_tests"], 0.55), "tests.test_used.other": ("no_outgoing_calls", ["no_outgoing_calls"], 0.85), "tests.test_used.test_loop": ("cone_stays_in_tests", ["cone_stays_in_tests"], 0.55)}
    more = {r.qualified_name: r.confidence for r in ws.find_orphan_tests(include_harness=True, include_fixtures=True).collect()}
    assert more["tests.test_client.test_api"] == 0.3 and more["tests.conftest.pytest_setup"] == 0.85
    assert {r.what: r.n for r in ws.orphan_report().collect()} == {"fixture_skipped": 1, "harness_skipped": 1, "test_files": 3, "test_symbols": 6, "test_files_without_symbols": 0}


def test_corroboration(ws, tmp_path):
    node = lambda i, label, path, line, **k: {"id": i, "label": label, "source_file": path, "source_location": f"L{line}", **k}
    graph = {
        "nodes": [node("a", "small()", "pkg/used.py", 14, _callable=True), node("b", "used.py", "pkg/used.py", 1), node("c", "Idle.three", "pkg/used.py", 99), node("t", "helper()", "tests/test_used.py", 7), node("p", "make()", "pkg/used.py", 22)],
        "links": [{"source": "x", "target": "a", "relation": "references"}, {"source": "b", "target": "c", "relation": "method"}, {"source": "x", "target": "b", "relation": "imports"}, {"source": "t", "target": "p", "relation": "calls", "_origin": "llm"}],
    }
    (tmp_path / "g.json").write_text(json.dumps(graph))
    why = {r.qualified_name: r.reason for r in ws.find_dead_code(corroborate_with=str(tmp_path / "g.json")).collect()}
    assert why["pkg.used.small"] == "corroborated" and why["pkg.used.Idle.three"] is None
    got = ws.corroborated(ws.find_dead_code().where("reason is null"), str(tmp_path / "g.json"))
    assert got.overlap == 1.0 and got.not_ast and {r.relation: r.n for r in got.by_relation.collect()} == {"references": 1} and got.matched.count() == 2
    assert {r.qualified_name for r in ws.find_orphan_tests(corroborate_with=str(tmp_path / "g.json")).collect()} == {"tests.test_used.other", "tests.test_used.test_loop"}
    assert ws.dead_code_page(corroborate_with=str(tmp_path / "g.json")).count == sum(v is None for v in why.values())
    (tmp_path / "far.json").write_text(json.dumps({"nodes": [node(str(i), "f", f"elsewhere/{i}.py", 3) for i in range(20)], "edges": []}))
    with pytest.raises(ValueError, match="shares"):
        ws.find_dead_code(corroborate_with=str(tmp_path / "far.json"))


def test_matching_prefers_places(spark):
    nodes = spark.createDataFrame([("n2", "g", "a.py", 3, True, 1), ("n1", "f", "a.py", 3, False, 0), ("n3", "g", "b.py", None, False, 2), ("n4", "h", "a.py", 9, False, 3), ("n5", "h", "a.py", 12, False, 4)], "id string, label string, source_file string, line int, callable boolean, at int")
    c = spark.createDataFrame([(1, "F", "a.py", 3), (2, "g", "a.py", 3), (3, "m.g", "b.py", 1), (4, "h", "a.py", 1)], "symbol_id long, name string, file_path string, start_line int")
    assert {r.symbol_id: r.id for r in evidence.matched(c, nodes).collect()} == {1: "n1", 2: "n2", 3: "n3"}  # h has two nodes


def edges_of(w):
    return {(r.ref_id, r.src, r.dst, r.weight) for r in w.ref_edges.collect()}


def test_edges_after_each_of_a_series_of_edits(spark, tmp_path):
    """Kept-up edges equal a full run; links follow a symbol that moves; only what is asked for is derived again."""
    tree = {"a/m.py": "from b.n import g\n\n\ndef f():\n    g()\n    h()\n", "b/n.py": "def g():\n    return 1\n", "c/k.py": "def h():\n    return 1\n\n\ndef u():\n    return h()\n", "d/z.py": "import ext.lib\n\n\ndef z():\n    ext.run()\n    u()\n"}
    write(tmp_path, tree)
    w = Workspace(spark)
    w.index_project(str(tmp_path))
    w.create_spec("s-1", "S")
    w.link_spec_symbol("s-1", "b.n.g")
    edits = [
        {"b/n.py": "X = 1\n\n\ndef g():\n    return 2\n", "c/k.py": "def u():\n    return 1\n"},  # moved down: another id; a name goes
        {"c/k2.py": "def h():\n    return f()\n", "b/n.py": "def g(:\n"},  # it comes back elsewhere; a file doesn't parse and keeps what it had
        {"b/n.py": "def g2():\n    return 1\n", "ext/lib.py": "def run():\n    return 1\n", "e/h.py": "def h():\n    return 1\n"},  # a scope comes; ambiguous now
        {"ext/lib.py": None, "e/h.py": None},
    ]
    for n, edit in enumerate(edits):
        for p, t in edit.items():
            if t is None:
                (tmp_path / p).unlink()
            else:
                write(tmp_path, {p: t})
        done = w.index_project(str(tmp_path))
        assert done["changed"] == (1 if n == 1 else len(edit))
        full = {tuple(r) for r in resolve.resolve_each(w.refs, w.symbols).select("ref_id", "src", "dst", "weight").collect()}
        assert edges_of(w) == full, n
        names = {r.symbol_id: r.qualified_name for r in w.symbols.collect()}
        assert [names.get(r.symbol_id) for r in w.links.collect()] == (["b.n.g"] if n < 2 else []), n
    assert w.index_project(str(tmp_path))["changed"] == 0
    w.index_project(str(tmp_path), force=True)
    assert edges_of(w) == full


def test_affected_refs_are_few(spark, tmp_path):
    files = [(f"p/m{i}.py", "python", f"def f{i}():\n    return f{(i + 1) % 30}()\n") for i in range(30)]
    df = spark.createDataFrame(files, "path string, language string, content string")
    s, r, _ = code.index(df)
    now = s.withColumn("name", F.when(F.col("file_path") == "p/m7.py", "other").otherwise(F.col("name")))
    moved = spark.createDataFrame([("p/m7.py",)], "path string")
    again = indexing.affected_refs(r, s, now, moved)
    assert {x.file_path for x in again.collect()} == {"p/m7.py", "p/m6.py"}


def test_links_meet(spark):
    before = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "symbol_id long, qualified_name string")
    now = spark.createDataFrame([(9, "a"), (8, "a"), (3, "b")], "symbol_id long, qualified_name string")
    links = spark.createDataFrame([("s", 1, "implements", 0.5, "x"), ("s", 2, "implements", 0.9, "y"), ("s", 3, "tests", 1.0, "x"), ("s", 4, "tests", 1.0, "x")], "spec_id string, symbol_id long, relation string, confidence double, source string")
    assert sorted(map(tuple, indexing.carry_links(links, before, now).collect())) == [("s", 3, "tests", 1.0, "x"), ("s", 8, "implements", 0.9, "y")]


def test_edges_after_change_broadcasts_no_symbols(spark):
    from codeloom.plans.registry import QUERIES

    df = QUERIES["edges_after_change"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_innermost_symbols_equal_a_plain_loop(spark):
    import random

    from codeloom.operators import analysis

    r = random.Random(4)
    spans = [(i, f"f{r.randint(0, 2)}.py", a := r.randint(1, 300), a + r.randint(-1, 2 ** r.randint(0, 8))) for i in range(400)]
    at = [(i, f"f{r.randint(0, 3)}.py", r.randint(0, 600)) for i in range(500)] + [(600, None, 5), (601, "f1.py", None)]
    s = spark.createDataFrame(spans, "symbol_id long, file_path string, start_line long, end_line long")
    got = analysis.enclosing(s, spark.createDataFrame(at, "place_id long, path string, line long"))
    assert got.columns == ["place_id", "path", "line", "symbol_id", "file_path", "start_line", "end_line"]
    want = {}
    for i, path, line in at:
        around = [(b - a, -a, k) for k, f, a, b in spans if f == path and line is not None and a <= line <= b]
        if around:
            want[i] = min(around)[2]
    assert {x.place_id: x.symbol_id for x in got.collect()} == want and len(want) > 100
    ops = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(sign in line for line in ops.splitlines() if "Join" in line for sign in ("<=", ">="))  # no range join
