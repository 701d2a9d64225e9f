from codeloom.operators import annotations
from codeloom.sources import code, protection
from codeloom.workspace import Workspace

TSX = """import { load } from './lib'
export function Panel(props) {
  function onClose() { props.close() }
  function onOpen() { return 1 }
  function lost() { return 2 }
  const kept = () => onOpen()
  bus.addListener('x', onClose)
  return <Card title="a" on={kept} />
}
app.get('/users', auth, listUsers)
app.use(wrap(inner), plain, { a: notThis })
// app.post('/no', commented)
"""
GO = """package main
func Setup(r *gin.Engine) {
  r.GET("/users/:id", getUser)
  http.HandleFunc("/plain", plain)
  mux.HandleFunc("POST /items", addItem)
  apiRouter.Method("PUT", `/raw`, raw)
  s.router.Any("/any", any)
  cache.Get("/no", x)
  // r.POST("/commented", x)
  r.Handle("/h", h)
}
"""
RUST = """fn outer() {
    fn used(x: i32) -> i32 { x }
    fn lost() { lost2() }
    let cb = used;
}
"""


def test_tsx():
    got = code.extract_lexical(TSX, "web.panel", "tsx")
    assert {s["qualified_name"] for s in got["symbols"]} >= {"web.panel.Panel", "web.panel.Panel.onClose", "web.panel.__module__"}
    assert ("jsx", "Card") in {(r["ref_type"], r["target_name"]) for r in got["refs"]}
    assert [(r["method"], r["path"]) for r in got["routes"]] == [("GET", "/users")]


def test_go_routes():
    got = [(r["method"], r["path"], r["line"], r["scope"]) for r in code.extract_lexical(GO, "main", "go")["routes"]]
    s = "main.Setup"
    assert got == [("GET", "/users/:id", 3, s), ("ALL", "/plain", 4, s), ("POST", "/items", 5, s), ("PUT", "/raw", 6, s), ("ALL", "/h", 10, s)]


def test_lexical_protection(spark):
    got = protection.lexical_names(TSX, "tsx")
    assert {n for c, n in got if c == "registered"} == {"onClose", "auth", "listUsers", "plain"}
    assert {n for c, n in got if c == "nested"} == {"onClose", "onOpen"}
    assert protection.lexical_names(RUST, "rust") == {("nested", "used")} and protection.lexical_names(GO, "go") == set() and protection.lexical_names("f(", "javascript") == set()
    files = spark.createDataFrame([("a.tsx", "tsx", TSX), ("b.go", "go", GO), ("c.py", "python", "x = [first]"), ("d.rs", "rust", None)], "path string, language string, content string")
    assert {(r.path, r.category) for r in protection.scan(files).collect()} == {("a.tsx", "registered"), ("a.tsx", "nested"), ("c.py", "module")}


def test_annotation_verbs(spark):
    text = "# @rf:BE-RF-080\n# @spec:BE-RF-080\ndef f():\n    # @sepc: auth  @rf=x\n    pass\n# @spec:SPEC-001\n# @tests: nothing\n# @spec:spec-7 @Rf: y"
    files = spark.createDataFrame([("a.py", text), ("b.py", "no mark"), ("c.py", None)], "path string, content string")
    specs = spark.createDataFrame([("SPEC-001",), ("slug",)], "spec_id string")
    dead = annotations.dead_annotations(files, specs)
    groups = {r.verb: (r.n, r.reason, r.did_you_mean) for r in annotations.verb_groups(dead).collect()}
    assert groups == {"@rf": (2, "unrecognized_verb", "@spec"), "@spec": (1, "token_shape", None), "@sepc": (1, "unrecognized_verb", "@see"), "@tests": (1, "token_shape", None), "@Rf": (1, "unrecognized_verb", "@see")}
    symbols = spark.createDataFrame([(1, "a.f", "a.py", 3, 5, "function")], "symbol_id long, qualified_name string, file_path string, start_line int, end_line int, kind string")
    rows = {(r.verb, r.line, r.qualified_name) for r in annotations.verb_samples(dead, symbols, 1).collect()}
    assert {("@rf", 1, None), ("@sepc", 4, "a.f")} <= rows and len(rows) == 5
    assert annotations.verb_groups(annotations.dead_annotations(files.where("false"), specs)).count() == 0


def test_workspace(spark, tmp_path):
    for path, text in {"a.py": "@mcp.tool()\ndef f():\n    return 1\n\n\n# @rf: x\n", "s/specs/auth/spec.md": "### Requirement: Log in\nIt SHALL.\n", "s/changes/c/specs/auth/spec.md": "## REMOVED Requirements\n### Requirement: Log in\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    w = Workspace(spark)
    w.index_project(str(tmp_path))
    w.import_spec_tree(str(tmp_path / "s"))
    assert [(r.spec_id, r.status) for r in w.specs.collect()] == [("auth-log-in", "active")]
    w.link_spec_symbol("auth-log-in", "f", confidence=0.9)
    shown = w.explorer()
    board = shown["dashboard"].first()
    assert (board.specs, board.implemented, board.with_endpoints, board.with_dependencies, board.implemented_pct) == (1, 1, 1, 0, 100.0)
    assert [(r.framework, r.kind) for r in shown["endpoints"].collect()] == [(None, "tool")]
    assert [r.verb for r in w.scan_annotation_verbs()[0].collect()] == ["@rf"]
    assert [(r.change, r.status) for r in w.import_changes(str(tmp_path / "s")).collect()] == [("c", "proposed")]
    assert [(r.operation, r.spec_id) for r in w.deltas.collect()] == [("removed", "auth-log-in")]


def test_body_hashes(spark):
    """Layout and comments don't count; texts, names and signs do."""
    js = ("function f(a) {\n  // why\n  return g(a, 'x y')\n}", "function f( a ){ return g(a,\n 'x y') /* so */ }", "function f(a) {\n  return g(a, 'x  y')\n}", "function f(a) {\n  return g(b, 'x y')\n}")
    py = ("def f(a):\n    return g(a, 'x')  # why", "def f(a):\n\n    return g(\n        a, 'x')", "def f(a):\n    return g(a, 'y')", "def f(b):\n    return g(b, 'x')")
    rows = [(f"{i}.{e}", language, t) for e, language, texts in (("js", "javascript", js), ("py", "python", py)) for i, t in enumerate(texts)]
    s = code.index(spark.createDataFrame(rows, "path string, language string, content string"))[0]
    got = {r.file_path: r.body_hash for r in s.where("name = 'f'").collect()}
    assert "seed" not in s.columns and len(got) == 8
    for e in ("js", "py"):
        assert got[f"0.{e}"] == got[f"1.{e}"] and len({got[f"{i}.{e}"] for i in range(4)}) == 3
