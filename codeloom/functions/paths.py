"""Path and route predicates as Column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path segments of test trees, and endings of test files. Fixed values.
TEST_SEGMENTS = ("tests", "test", "__tests__", "spec")
SCRIPT_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
TEST_ENDINGS = tuple(f"{mark}.{e}" for mark in (".test", ".spec", "_spec") for e in SCRIPT_EXTENSIONS) + ("_spec.rb",)
NON_PRODUCT_DIRS = ("scripts", "bench", "fixtures")
FIXTURE_DIRS = ("fixtures", "__fixtures__", "test_utils", "test_helpers")
#: File extension to language. Fixed values.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "c_sharp", "kt": "kotlin", "swift": "swift", "scala": "scala",
}


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(_clean(path), "/"), -1)


def folders(path: Column) -> Column:
    parts = F.split(_clean(path), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def language_of(path: Column) -> Column:
    """Language by extension; null for others."""
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return names[F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))]


def is_test_file(path: Column) -> Column:
    base = base_name(path)
    ends = [base.endswith(e) for e in TEST_ENDINGS]
    found = F.arrays_overlap(folders(path), F.array(*map(F.lit, TEST_SEGMENTS))) | base.startswith("test_") | base.contains("_test.")
    for e in ends:
        found = found | e
    return found


def is_test_scaffold(path: Column) -> Column:
    base = base_name(path)
    return is_test_file(path) | (base == "conftest.py") | base.startswith("conftest_") | F.arrays_overlap(folders(path), F.array(*map(F.lit, FIXTURE_DIRS)))


def is_non_product(path: Column) -> Column:
    return is_test_file(path) | F.element_at(F.split(_clean(path), "/"), 1).isin(*NON_PRODUCT_DIRS)


def is_entry_point_file(path: Column) -> Column:
    p = F.concat(F.lit("/"), path)
    return path.startswith("bin/") | path.startswith("scripts/") | p.contains("/bin/") | p.contains("/scripts/") | p.endswith("/__main__.py") | p.endswith("/manage.py")


def path_distance(a: Column, b: Column) -> Column:
    """0 same file, 1 same folder, 2 else."""
    return F.when(a == b, 0).when(F.array_join(folders(a), "/") == F.array_join(folders(b), "/"), 1).otherwise(2)


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def is_infrastructure(qname: Column, name: Column, start: Column, end: Column) -> Column:
    """Dunder segments, register hooks, state and settings holders, and tiny wrappers (two to five lines)."""
    dunder = F.exists(F.split(qname, r"\."), lambda s: s.startswith("__") & s.endswith("__"))
    holder = name.rlike("_(state|settings|config|session)$")
    return dunder | (name == "register") | holder | ((end - start > 0) & (end - start < 5))


def normalize_route(raw: Column) -> Column:
    """One form for a route however its framework writes parameters; empty for null or empty input."""
    s = F.trim(raw)
    s = F.when(s.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+$"), "/").otherwise(F.regexp_replace(s, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+/", "/"))
    s = F.regexp_replace(s, "[?#].*$", "")
    for parameter in ("<[^>]+>", r"\{[^}]+\}", ":[A-Za-z_][A-Za-z0-9_]*", r"\*+"):
        s = F.regexp_replace(s, parameter, "{}")
    s = F.array_join(F.transform(F.split(s, "/"), lambda p: F.when(p.rlike("^[0-9]+$"), "{}").otherwise(p)), "/")
    s = F.regexp_replace(F.concat(F.lit("/"), s), "/+", "/")
    s = F.when(F.length(s) > 1, F.regexp_replace(s, "/$", "")).otherwise(s)
    return F.when(raw.isNull() | (raw == ""), "").otherwise(s)


#: Server verbs that say nothing about the method. Fixed values.
OPEN_VERBS = ("ROUTE", "WEBSOCKET", "ON", "ALL")
#: Paths that infrastructure serves, and beginnings of such paths. Fixed values.
INFRA_PATHS = (
    "/health", "/liveness", "/readiness", "/ready", "/ping", "/metrics", "/actuator/health", "/actuator/info", "/api-docs", "/v3/api-docs",
    "/openapi.yaml", "/openapi.json", "/swagger", "/swagger-ui", "/ui", "/playground", "/info",
)
INFRA_PREFIXES = ("/metrics/", "/actuator/", "/api-docs/", "/v3/api-docs/", "/swagger-ui/", "/swagger/")
#: What a test file holds that drives the product through a client. Fixed values.
HARNESS_MARKS = ("from fastmcp", "import fastmcp", "Client(mcp)", "Client(mcp,", "supertest", "request(app)", "TestClient(", "AsyncClient(")


def is_infra_route(path: Column) -> Column:
    """Health, metrics and docs routes: the path without query and closing slash, in lower case."""
    bare = F.regexp_replace(F.element_at(F.split(F.coalesce(path, F.lit("/")), r"\?", 2), 1), "/+$", "")
    p = F.lower(F.when(bare == "", "/").otherwise(bare))
    found = p.isin(*INFRA_PATHS)
    for x in INFRA_PREFIXES:
        found = found | p.startswith(x)
    return found


def is_fixture_only(path: Column) -> Column:
    """conftest files and fixture or helper folders: nothing that runs by itself."""
    base = base_name(path)
    return (base == "conftest.py") | base.startswith("conftest_") | F.arrays_overlap(folders(path), F.array(*map(F.lit, FIXTURE_DIRS)))


def is_runnable_test(path: Column) -> Column:
    """A test file by its name, outside fixture and data folders. The name parts and folders are fixed values."""
    base, p = F.element_at(F.split(path, "/"), -1), F.concat(F.lit("/"), path)
    data = p.contains("/fixtures/") | path.contains("/__fixtures__/") | path.contains("/data/")
    named = (base.startswith("test_") & base.contains(".")) | base.contains("_test.") | base.startswith("test.") | base.contains(".test.")
    return ~data & named


def names_a_test(path: Column, name: Column) -> Column:
    """The unit reader's idea of a test: its folder, its file's name or its own."""
    folder = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ("test", "tests", "spec", "__tests__"))))
    base = F.element_at(F.split(path, "/"), -1)
    return folder | base.startswith("test_") | path.rlike(r"_test\.[a-z]+$") | name.rlike("^(test_|Test|it_|should_)")


def has_harness(text: Column, most: int = 50_000) -> Column:
    """The head of a test file holds a mark of a client that drives the product."""
    head, found = F.substring(text, 1, most), F.lit(False)
    for mark in HARNESS_MARKS:
        found = found | head.contains(mark)
    return F.coalesce(found, F.lit(False))


def route_weight(client: Column, server: Column) -> Column:
    """0.9 equal methods, 0.8 if one isn't known, null if they differ."""
    c = F.when(F.upper(client) != "", F.upper(client))
    s = F.when(~F.upper(server).isin(*OPEN_VERBS, ""), F.upper(server))
    return F.when(c.isNull() | s.isNull(), 0.8).when(c == s, 0.9)
