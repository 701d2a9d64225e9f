import json

from codeloom.operators import coverage
from codeloom.sources import reports


def tables(spark):
    s = spark.createDataFrame([(1, "m.a", "src/m.py", 1, 5), (2, "m.b", "src/m.py", 7, 200), (3, "m.c", "src/m.py", 201, 201), (4, "t.x", "tests/test_m.py", 1, 3), (5, "m.d", "src/n.py", 9, 8)], "symbol_id long, qualified_name string, file_path string, start_line int, end_line int")
    e = spark.createDataFrame([(4, 1, 1.0)], "src long, dst long, weight double")
    return s, e


def test_lines_meet_symbols(spark):
    s, _ = tables(spark)
    lines = lambda *rows: spark.createDataFrame([*rows], "path string, line int")
    got = lambda df: {r.symbol_id for r in coverage.covered_symbols(s, df).collect()}
    assert got(lines(("src/m.py", 128), ("src/m.py", 6), ("src/n.py", 9), (None, 1), ("src/m.py", None))) == {2}
    assert got(lines(("src/m.py", 200), ("src/m.py", 201), ("src/m.py", 1))) == {1, 2, 3} and got(lines()) == set()


def test_sources_of_coverage(spark):
    s, e = tables(spark)
    rows = [("p", 1, "implements"), ("p", 2, "implements"), ("p", 2, "implements"), ("q", 2, "implements"), ("q", 4, "tests"), ("r", 3, "implements"), ("r", 3, "tests"), ("r", 1, "implements"), ("s", 2, "references"), ("t", 99, "implements")]
    links = spark.createDataFrame(rows, "spec_id string, symbol_id long, relation string")
    got = {r.spec_id: (r.n_implementing, r.n_verified, r.ratio, r.source, r.uncovered) for r in coverage.spec_test_coverage(links, s, e).collect()}
    assert got == {"p": (2, 1, 0.5, "derived", ["m.b"]), "q": (1, 1, 1.0, "explicit", []), "r": (2, 2, 1.0, "both", []), "s": (0, 0, 0.0, "none", []), "t": (1, 0, 0.0, "none", [])}
    lines = spark.createDataFrame([("src/m.py", 100)], "path string, line int")
    more = {r.spec_id: (r.n_verified, r.source) for r in coverage.spec_test_coverage(links, s, e, lines).collect()}
    assert more["p"] == (2, "derived+report") and more["q"] == (1, "explicit+report") and more["r"] == (2, "both") and more["t"] == (0, "none")
    assert coverage.spec_test_coverage(links.limit(0), s, e, lines.limit(0)).count() == 0


def test_reports_of_a_tree(spark, tmp_path):
    assert reports.read_coverage(spark, str(tmp_path)) is None
    (tmp_path / "coverage").mkdir()
    place = {"start": {"line": 3}}
    (tmp_path / "coverage/coverage-final.json").write_text(json.dumps({f"{tmp_path}/src/a.js": {"statementMap": {"0": place}, "s": {"0": 2}, "fnMap": {}, "f": {}}}))
    (tmp_path / "coverage/lcov.info").write_text("SF:./src/b.js\nDA:7,1\nDA:8,0\nend_of_record\n")
    assert sorted(map(tuple, reports.read_coverage(spark, str(tmp_path)).collect())) == [("src/a.js", 3), ("src/b.js", 7)]
