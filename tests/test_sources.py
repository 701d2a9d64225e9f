import json

from pyspark.sql import functions as F

from codeloom.operators import evidence
from codeloom.operators.resolve import resolve_refs
from codeloom.sources import code, files, reports, spec_text

AUTH = '''"""Auth."""
import os
from .store import save as keep

Alias = dict[str, int]


def verify(token: str, *, strict=False) -> bool:
    """Checks."""
    return bool(token)


def login(user, key=None):
    """@spec:auth-user-login"""
    keep(user)
    return verify(user)


class Session(Base):
    @property
    def live(self):
        return self.ping()

    def ping(self): return os.getpid()


@app.route("/users/<int:id>", methods=["GET", "POST"])
def users(id):
    requests.get("https://h.example/users/7")
    register(login)
'''


def test_python_extraction():
    got = code.extract_python(AUTH, "pkg.auth")
    by = {s["qualified_name"]: s for s in got["symbols"]}
    assert set(by) == {"pkg.auth.Alias", "pkg.auth.verify", "pkg.auth.login", "pkg.auth.Session", "pkg.auth.Session.live", "pkg.auth.Session.ping", "pkg.auth.users"}
    assert by["pkg.auth.verify"]["signature"] == "verify(token: str, *, strict=...) -> bool" and by["pkg.auth.Session"]["signature"] == "class Session(Base)"
    assert by["pkg.auth.Session.live"]["kind"] == "method" and by["pkg.auth.Session.live"]["decorators"] == ["property"]
    refs = {(r["scope"], r["target_name"], r["ref_type"], r["scope_module"]) for r in got["refs"]}
    assert ("pkg.auth.login", "keep", "call", "pkg.store") in refs and ("pkg.auth.users", "login", "callback_arg", None) in refs
    assert [(r["role"], r["method"]) for r in got["routes"]] == [("server", "GET"), ("server", "POST"), ("client", "GET")]
    assert code.extract_python("def (", "m")["parse_error"]


def test_tree_to_edges(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg/auth.py").write_text(AUTH)
    (tmp_path / "pkg/api.js").write_text("import { go } from './lib'\nclass A {\n  run(x) {\n    helper(x)\n  }\n}\nfunction helper(y) { return go(y) }\n")
    (tmp_path / "node_modules/x.py").write_text("a = 1")
    (tmp_path / "notes.txt").write_text("no")
    (tmp_path / "skip.py").write_text("b = 1")
    tree = files.read_tree(spark, str(tmp_path), ["/skip.py"])
    assert sorted(r.path for r in tree.collect()) == ["pkg/api.js", "pkg/auth.py"]
    symbols, refs, routes = code.index(tree)
    edges = {(r.a, r.b) for r in resolve_refs(refs, symbols).join(symbols.select(F.col("symbol_id").alias("src"), F.col("name").alias("a")), "src").join(symbols.select(F.col("symbol_id").alias("dst"), F.col("name").alias("b")), "dst").select("a", "b").collect()}
    assert {("login", "verify"), ("users", "login"), ("run", "helper"), ("live", "ping")} <= edges
    assert routes.count() == 3


def test_lexical_languages():
    for language, text, names in (
        ("go", "package m\ntype S struct {}\nfunc (s S) Run() {\n  help()\n}\nfunc help() {}\n", {"S", "Run", "help"}),
        ("rust", "struct A {}\nimpl A {\n  fn run(&self) { help(); }\n}\nfn help() {}\n", {"A", "run", "help"}),
        ("java", "class A {\n  public void run(int x) {\n    help();\n  }\n  void help() {\n  }\n}\n", {"A", "run", "help"}),
        ("ruby", "class A\n  def run\n    help()\n  end\nend\n", {"A", "run"}),
        ("php", "<?php\nclass A {\n  function run() { help(); }\n}\nfunction help() {}\n", {"A", "run", "help"}),
    ):
        got = code.extract_lexical(text, "m", language)
        assert {s["name"] for s in got["symbols"]} >= names, language
        assert any(r["target_name"] == "help" and r["scope"].endswith("un") for r in got["refs"]), language


def test_coverage_reports(spark, tmp_path):
    place = lambda n: {"start": {"line": n}}
    (tmp_path / "c.json").write_text(json.dumps({"a.js": {"statementMap": {"0": place(1), "1": place(2)}, "s": {"0": 3, "1": 0}, "fnMap": {"0": place(7)}, "f": {"0": [0, 2]}}}))
    assert sorted(map(tuple, reports.read_istanbul(spark, str(tmp_path / "c.json")).collect())) == [("a.js", 1), ("a.js", 7)]
    (tmp_path / "lcov.info").write_text("TN:\nSF:a.py\nDA:1,1\nDA:2,0\nSF:b.py\nDA:5,2\nDA:x,1\nend_of_record\n")
    assert sorted(map(tuple, reports.read_lcov(spark, str(tmp_path / "lcov.info")).collect())) == [("a.py", 1), ("b.py", 5)]


def test_log_and_graph(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"tool_name":"a","latency_ms":3}\nbroken\n{"tool_name":"b"}\n')
    assert sorted(r.tool_name for r in reports.read_log(spark, str(tmp_path / "log.jsonl")).collect()) == ["a", "b"]
    graph = {"nodes": [{"id": "n1", "label": "m.f()", "source_file": "m.py", "source_location": "L26"}, {"id": "n2", "label": "m.py", "source_file": "m.py", "source_location": "L1"}, {"label": "lost"}], "links": [{"source": "n2", "target": "n1", "relation": "contains"}, {"source": "n9", "target": "n1", "relation": "calls"}, {"source": "n9"}]}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    nodes, links = reports.read_graph(spark, str(tmp_path / "g.json"))
    s = spark.createDataFrame([(1, "f", "m.py", 30), (2, "top", "m.py", 1)], "symbol_id long, name string, file_path string, start_line int")
    found = evidence.matched(s.selectExpr("*", "name as label"), nodes)
    assert [tuple(r) for r in found.collect()] == [(1, "n1")]
    assert [tuple(r) for r in evidence.inbound(found, links).collect()] == [(1, "calls", 1)]
    assert {r.relation: r.n for r in evidence.relation_counts(links).collect()} == {"contains": 1, "calls": 1}


SPEC = """## Purpose
Things.
## ADDED Requirements
### Requirement: User Login
The system SHALL log in.
#### Scenario: good
- WHEN x
```
#### Scenario: not one
```
#### Scenario: bad
- WHEN y
## REMOVED Requirements
### Requirement: Old Way
## RENAMED Requirements
- FROM: `Before`
- TO: `After`
"""


def test_spec_markdown(spark):
    got = spec_text.parse_specs(SPEC, "auth")
    assert [(s["spec_id"], s["status"], s["operation"]) for s in got] == [("auth-user-login", "active", "added"), ("auth-old-way", "deprecated", "removed"), ("auth-after", "active", "renamed")]
    assert [x["name"] for x in got[0]["scenarios"]] == ["good", "bad"] and got[2]["rename_from"] == "Before"
    df = spark.createDataFrame([("b.md", SPEC, "auth"), ("a.md", "### Requirement: User Login\nOther.", "auth")], "path string, content string, capability string")
    assert {r.spec_id: r.path for r in spec_text.read_specs(df).collect()}["auth-user-login"] == "b.md"


def test_annotations(spark):
    known = {"auth-login": "auth-login", "be-rf-7": "BE-RF-7", "x": "x"}
    pick = lambda t: {(h["spec_id"], h["relation"], h["confidence"]) for h in spec_text.annotations(t, known)}
    assert pick("# @spec:auth-login, be-rf-7:0.85") == {("auth-login", "implements", 0.85), ("BE-RF-7", "implements", 0.85)}
    assert pick("@tests: auth-login\n@not_spec: auth-login") == set()
    assert pick("Implements auth-login. It does not implements x") == {("auth-login", "implements", 0.7)}
    assert pick("@specifically auth-login") == set() and pick(None) == set()
    t = spark.createDataFrame([(1, "@see x"), (2, None)], "id long, text string")
    assert [tuple(r) for r in spec_text.linked(t, spark.createDataFrame([("x",)], "spec_id string")).collect()] == [(1, "x", "references", 1.0)]


def test_script_routes_and_annotations():
    ts = """import { Row } from './row'
// app.get('/commented', x)
app.get('/users/:id', authorise, handler)
function handler(req) {
  fetch(`${base}/items/${req.id}`)
  return axios.post("/orders", req)
}
@Component({})
class Page {
  render() {
    items.map(draw)
    return <Row.Cell a={1}/>
  }
}
"""
    got = code.extract_lexical(ts, "web.app", "typescript")
    assert {(r["role"], r["method"], r["path"]) for r in got["routes"]} == {("server", "GET", "/users/:id"), ("client", "", "/items/{}"), ("client", "POST", "/orders")}
    refs = {(r["target_name"], r["ref_type"], r["scope_module"]) for r in got["refs"]}
    assert {("handler", "callback_arg", None), ("draw", "callback_arg", None), ("Row", "jsx", "web.row")} <= refs
    assert next(s for s in got["symbols"] if s["name"] == "Page")["decorators"] == ["Component"]
    java = """@RestController
@RequestMapping("/api")
class Users {
  @GetMapping("/{id}")
  public User one(int id) {
    return find(id);
  }
}
"""
    got = code.extract_lexical(java, "Users", "java")
    assert [(r["method"], r["path"], r["scope"]) for r in got["routes"]] == [("GET", "/api/{id}", "Users.Users.one")]
    assert next(s for s in got["symbols"] if s["name"] == "Users")["decorators"] == ["RestController", "RequestMapping"]
