import pytest
from pyspark.sql import functions as F

from codeloom.functions import frameworks, paths
from codeloom.operators import graph, search, spec_store, views
from codeloom.sources import changes, code
from codeloom.workspace import Workspace

FILES = {
    "pkg/auth.py": 'def verify(t):\n    """Checks."""\n    return bool(t)\n\n\ndef login(u):\n    """@spec:auth-user-login"""\n    return verify(u)\n',
    "pkg/api.py": 'from pkg.auth import login\n\n\nclass Api(View):\n    def handle(self, u):\n        return login(u)\n\n\n@app.get("/users/{id}")\ndef users(id):\n    return 1\n\n\ndef unused():\n    a = 1\n    b = 2\n    c = 3\n    d = 4\n    return a + b + c + d\n',
    "tests/test_auth.py": "from pkg.auth import login\n\n\ndef test_login():\n    assert login(1)\n\n\ndef test_nothing():\n    assert True\n",
    "web/client.py": 'import requests\n\n\ndef fetch():\n    return requests.get("https://h.example/users/7")\n',
}


@pytest.fixture
def ws(spark, tmp_path):
    for p, t in FILES.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    w = Workspace(spark)
    w.index_project(str(tmp_path))
    w.create_spec("auth-user-login", "User login", "The system SHALL log in.")
    w.scan_spec_annotations()
    return w


def names(df):
    return {r.qualified_name for r in df.collect()}


def test_read_tools(ws):
    assert names(ws.who_calls("verify")) == {"pkg.auth.login"}
    assert names(ws.who_calls("pkg.auth.verify", max_depth=3)) == {"pkg.auth.login", "pkg.api.Api.handle", "tests.test_auth.test_login"}
    assert names(ws.who_does_this_call("handle", 2)) == {"pkg.auth.login", "pkg.auth.verify"}
    assert names(ws.find_symbol("LOGIN")) == {"pkg.auth.login", "tests.test_auth.test_login"}
    assert ws.resolve_location("pkg/api.py", 6).first().qualified_name == "pkg.api.Api.handle"
    assert ws.resolve_location("./api.py", 6).first().qualified_name == "pkg.api.Api.handle" and ws.resolve_location("none.py", 6).first() is None
    assert {r.qualified_name for r in ws.symbol_page("verfy").summary.collect()} == {"pkg.auth.verify"} and ws.symbol_page("verify").count == 1
    assert ws.search('"def verify"').count() == 1 and ws.search('"verify def"').count() == 0
    assert {r.qualified_name for r in ws.find_dead_code().where("reason is null").collect()} >= {"pkg.api.unused"}
    assert names(ws.find_orphan_tests()) == {"tests.test_auth.test_nothing"}
    assert {(r.qualified_name, r.source) for r in ws.find_endpoints().collect()} == {("pkg.api.users", "decorator"), ("pkg.api.Api", "view")}
    assert names(ws.who_calls("pkg.api.users")) == {"web.client.fetch"}
    got = {r.spec: r.n_verified for r in ws.audit_coverage()["coverage"].collect()}
    assert got == {"auth-user-login": 1}
    assert names(ws.analyze_impact("spec", "auth-user-login", 1)) == {"pkg.api.Api.handle", "tests.test_auth.test_login"}
    assert ws.search_similar(FILES["pkg/api.py"].split("\n\n\n")[3].rstrip("\n")).first().id == "pkg.api.unused"
    assert ws.get_project_overview().count() > 0 and ws.quick_orient("login").first().n_callers == 2
    assert ws.search(["checks"]).count() == 1


def test_incremental(ws, spark, tmp_path):
    (tmp_path / "pkg/auth.py").write_text("def broken(\n")
    (tmp_path / "web/client.py").unlink()
    (tmp_path / "pkg/more.py").write_text("from pkg.auth import login\n\n\ndef extra():\n    login(2)\n")
    old = {r.path: r.content_hash for r in ws.files.collect()}
    ws.index_project(str(tmp_path))
    new = {r.path: r.content_hash for r in ws.files.collect()}
    assert new["pkg/auth.py"] == old["pkg/auth.py"] and "web/client.py" not in new
    assert "pkg.more.extra" in names(ws.who_calls("login")) and "web.client.fetch" not in names(ws.symbols)


def test_spec_store(spark, ws):
    ws.create_spec("b", "B", "", module="m")
    ws.update_spec("b", title="Better", priority="high")
    assert ws.list_specs(priority="high").first().title == "Better"
    deltas = spark.createDataFrame([(1, "modified", "b", "Old text", "x", "m", None), (2, "modified", "b", "New", "The thing SHALL work.", "m", None), (3, "renamed", "auth-login", "Login", "It MUST.", "auth", "auth-user-login"), (4, "removed", "ghost", None, None, None, None)], spec_store.DELTAS)
    assert {(r.spec_id, r.issue) for r in ws.apply_spec_change(deltas, dry_run=True).collect()} == {("ghost", "doesn't exist")}
    ws.apply_spec_change(deltas)
    assert {r.spec_id: r.title for r in ws.specs.collect()} == {"b": "New", "auth-login": "Login"}
    assert {r.spec_id for r in ws.links.collect()} == {"auth-login"}
    found = {r.issue: r.n for r in ws.validate_specs().collect()}
    assert found == {"no scenario": 2}
    assert "### Requirement: New" in {r.module: r.text for r in ws.export_specs().collect()}["m"]
    m = spark.createDataFrame([("b", "pkg.auth.verify", "tests"), ("zz", "x", "tests"), ("b", "nope", "tests"), ("auth-login", "pkg.auth.login", "implements")], "spec_id string, qname string, relation string")
    assert sorted(r.outcome for r in ws.bulk_link_spec_symbols(m).collect()) == ["no spec", "no symbol", "ok", "skipped"]
    ws.link_spec_dependency(1, 2)
    ws.link_spec_dependency(2, 3)
    with pytest.raises(ValueError, match="cycle"):
        ws.link_spec_dependency(3, 1)
    assert {r.node: r.depth for r in ws.get_spec_dependency_graph(1).collect()} == {2: 1, 3: 2}
    ws.delete_spec("b")
    assert ws.list_specs().count() == 1


def test_debt(ws):
    ws.debt_baseline_capture()
    assert ws.baseline.count() >= 0
    rows = ws.spark.createDataFrame([("a.f", "a.py"), ("b.f", "b.py")], "qualified_name string, file_path string")
    base = ws.spark.createDataFrame([("h", "a.f", "a.py")], "structural_hash string, qualified_name string, file_path string")
    assert spec_store.duplicate_verdict(rows, base, "h").count() == 0
    assert spec_store.duplicate_verdict(rows, base, "new").count() == 2
    assert [r.qualified_name for r in spec_store.duplicate_verdict(rows, base, "h", ("b.py",), True).collect()] == ["b.f"]


@pytest.mark.parametrize(("path", "want"), [("src/pages/index.tsx", "nextjs_pages"), ("app/page.tsx", "nextjs_app"), ("app/page.test.tsx", None), ("src/routes/+page.svelte", "sveltekit"), ("app/routes/x.tsx", "remix"), ("islands/A.tsx", "fresh"), ("pages/a.py", None)])
def test_routed_files(spark, path, want):
    assert spark.range(1).select(frameworks.routed_file(F.lit(path))).first()[0] == want


def test_predicates(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(frameworks.view_base(F.lit("class A(x.Mixin, views.ListView[T], metaclass=M)"))) == "ListView" and one(frameworks.view_base(F.lit("class A"))) is None
    assert one(frameworks.is_build_output(F.lit("web/dist/a.js"))) and one(frameworks.is_build_output(F.lit("a.min.js"))) and not one(frameworks.is_build_output(F.lit("distant/a.js")))
    assert one(frameworks.has_decorator(F.array(F.lit("app.Route")), ["route"])) and not one(frameworks.has_decorator(F.lit(None).cast("array<string>"), ["route"]))


def test_small_parsers():
    assert changes.parse_name_status("M\ta.py\nR090\told.py\tnew.py\n") == [("M", "a.py"), ("R", "old.py"), ("R", "new.py")]
    assert changes.redact({"api_key": "x", "p": ["/root/w/a", {"Token": 1}]}, "/root/w") == {"api_key": "***", "p": ["./a", {"Token": "***"}]}
    assert changes.template_path("${base}/flights/v2") == "/flights/v2" and changes.template_path("${url}/list/${a}/${b}") == "/list/{}/{}"
    assert changes.template_path('${url}/list/${p.a ? `${p.a}/` : ""}${p.b ? `${p.b}` : ""}') == "/list/{}/{}" and changes.template_path("not-a-url") is None


def test_pages_and_orientation(ws):
    got = ws.callers_page("verify", max_depth=3, limit=2)
    assert got.count == 3 and got.next_cursor == 2 and got.rows.count() == 2 and {r.file_path: r.n for r in got.summary.collect()} == {"pkg/auth.py": 1, "pkg/api.py": 1, "tests/test_auth.py": 1}
    last = ws.callers_page("verify", max_depth=3, limit=2, cursor=2)
    assert last.next_cursor is None and last.rows.count() == 1 and ws.callers_page("verify", summary_only=True).rows is None
    assert {(r.side, r.qualified_name) for r in ws.top_neighbours("login").collect()} == {("caller", "pkg.api.Api.handle"), ("caller", "tests.test_auth.test_login"), ("callee", "pkg.auth.verify")}
    assert ws.quick_orient("users").first().is_entry_point and not ws.quick_orient("login").first().is_entry_point
    assert names(ws.route_peers("pkg.api.users")) == {"web.client.fetch"} and names(ws.route_peers("web.client.fetch", incoming=False)) == {"pkg.api.users"}
    unit = {(r.part, r.name) for r in ws.read_unit("login").collect()}
    assert {("body", "pkg.auth.login"), ("callee", "pkg.auth.verify"), ("test", "tests.test_auth.test_login")} <= unit
    assert {r.what: r.n for r in ws.index_status().collect()}["files"] == 4
    assert ws.grep_page("def ", limit=3).next_cursor == 3 and ws.grep_in_indexed_files("def ", path_glob="web/*").count() == 1


def test_dead_code_report(ws):
    got = ws.dead_code_page()
    why = {r.reason: r.n for r in got.summary.collect()}
    assert "pkg.api.unused" in names(got.rows) and why["tests"] == 2 and got.count == why["dead"]
    assert "tests" not in {r.reason for r in ws.dead_code_page(include_tests=True).summary.collect()} and ws.dead_code_page(summary_only=True).rows is None


def test_changes_reach_tests_and_specs(ws, spark):
    change = spark.createDataFrame([("M", "pkg/auth.py"), ("A", "pkg/new.py")], "status string, path string")
    assert {r.file_path for r in ws.suggested_tests(change).collect()} == {"tests/test_auth.py"} and [r.path for r in ws.unindexed(change).collect()] == ["pkg/new.py"]
    assert [tuple(r) for r in ws.diff_spec_impact(change).collect()] == [("auth-user-login", "implements", 1)]
    lists = ws.audit_coverage()
    assert names(lists["implicit"]) == {"pkg.auth.verify"} and {r.spec_id: r.n_tests for r in lists["tests_per_spec"].collect()} == {"auth-user-login": 0}


def test_writing_tools(ws, spark):
    m = spark.createDataFrame([("auth-user-login", "pkg.auth.verify", "implements"), ("none", "pkg.auth.verify", "implements")], "spec_id string, qname string, relation string")
    before = ws.links.count()
    assert sorted(r.outcome for r in ws.bulk_link_spec_symbols(m).collect()) == ["no spec", "ok"] and ws.links.count() == before + 1
    ws._put("scenarios", spark.createDataFrame([("auth-user-login", "Login", "x")], "spec_id string, name string, body string"))
    assert ws.link_scenario_tests("auth-user-login").count() == 1 and {r.n_tests for r in ws.audit_coverage()["tests_per_spec"].collect()} == {1}
    ws.link_spec_dependency(1, 2)
    ws.link_spec_dependency(2, 3)
    assert ws.walk_spec_dependencies(2, "both", 1)[1].count() == 2
    ws.unlink_spec_dependency(2, 3)
    assert ws.walk_spec_dependencies(2, "forward", 1)[1].count() == 0
    ws.debt_baseline_capture()
    assert ws.debt_baseline_status().first().captured is False or ws.baseline.count() > 0
    ws.debt_baseline_reset()
    assert ws.baseline.count() == 0
    ws.write_docs(spark.createDataFrame([("symbol", "pkg.auth.login", "How to log in."), ("symbol", "gone.one", "Old.")], "target_type string, target_key string, content string"))
    assert {(r.target_key, r.drift) for r in ws.list_docs(only_stale=True).collect()} == {("gone.one", "gone")} and ws.export_docs().count() == 2
    assert ws.search(["log"], scope="specs").first().snippet and ws.search(["checks"], scope="all").count() == 1


def test_text_predicates(spark):
    rows = [("index.ts", "// x\nexport { a } from './a';\nexport * from \"./b\";\n", True), ("w/index.ts", "export const a = 1", False), ("w/index.jsx", "export {\n  a,\n  b\n} from './c'\nexport * as d from './d'", True), ("v/index.js", None, True), ("u/index.js", "export * from './a'\nrun()", False), ("a.ts", "", False)]
    df = spark.createDataFrame(rows, "path string, content string, only boolean")
    assert {r.path for r in code.marker_files(df).collect()} == {r[0] for r in rows if r[2]}
    assert df.select(paths.has_harness(F.lit("c = TestClient(app)"))).first()[0] and not df.select(paths.has_harness(F.lit(None).cast("string"))).first()[0]
    assert [search.grep_mode(p) for p in ("a+", "(a+)+", "x" * 201, "(", "(ab)+")] == ["regex", "literal", "literal", "literal", "regex"]
    files = spark.createDataFrame([("a.py", "from x import Alpha, beta\nimport os\nuse y::Gamma;\nGhost()")], "path string, content string")
    assert {r.name for r in views.imported_names(files).collect()} == {"Alpha", "Gamma"}
    long = spark.createDataFrame([("s", "T", "\n\n".join(["w" * 400] * 20))], "spec_id string, title string, description string")
    assert search.chunk_specs(long).count() == 3


def test_unbounded_closure(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "src long, dst long, weight double")
    assert graph.closure(chain, spark.createDataFrame([(0,)], "node long")).agg(F.max("depth")).first()[0] == 40
    assert graph.creates_cycle(chain, 40, 0)
