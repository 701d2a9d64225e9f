import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths, text


def value(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], list(given)).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("shop/<uuid:cart>/items/", "/shop/{}/items"), ("/f/*", "/f/{}"), ("/2024/report", "/{}/report"), ("ws://h.example:81/live/:room?x", "/live/{}"), ("///", "/"), ("/o/{a}/{b}#top", "/o/{}/{}"), ("  /pad ", "/pad"), ("", ""), ("ftp://only.host", "/")],
)
def test_normalize_route(spark, raw, want):
    assert value(spark, paths.normalize_route(F.col("p")), p=raw) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [("tests/a.py", True), ("contest/a.py", False), ("src/test/A.java", True), ("a/test_x.py", True), ("a/x_test.go", True), ("latest.ts", False), ("a/x.test.ts", True), ("import_spec.py", False), ("a_spec.rb", True), ("specs/a.py", False), ("test", False), ("\\tests\\a.py", True)],
)
def test_test_paths(spark, path, want):
    assert value(spark, paths.is_test_file(F.col("p")), p=path) is want


def test_route_weight(spark):
    got = [value(spark, paths.route_weight(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("GET", "get"), ("GET", "POST"), ("", "POST"), ("GET", "ROUTE"))]
    assert got == [0.9, None, 0.8, 0.8]


def test_winnow_matches_plain(spark):
    import hashlib

    t = "def f ( ID ) : return ID + NUM while ID : ID = ID - NUM if not ID : break".split()
    g = [int(hashlib.md5(" ".join(t[i : i + 5]).encode()).hexdigest()[:15], 16) for i in range(len(t) - 4)]
    want = sorted({min(g[i : i + 4]) for i in range(len(g) - 3)})
    assert value(spark, text.winnow(text.gram_hashes(F.split("t", " "))), t=" ".join(t)) == want
    assert value(spark, text.winnow(text.gram_hashes(F.split("t", " "))), t="a b") == []


def test_generic_tokens(spark):
    assert value(spark, text.generic_tokens(F.col("s")), s="if x1 == 20: return _y") == ["if", "ID", "=", "=", "NUM", ":", "return", "ID"]


def test_small_ones(spark):
    assert value(spark, text.slug(F.col("s")), s="Ünïcode & Things!") == "unicode-things"
    assert value(spark, text.id_prefix(F.col("s")), s="BE-RF-102") == "BE-RF"
    assert value(spark, paths.path_distance(F.col("a"), F.col("b")), a="x/a.py", b="x/b.py") == 1
    assert value(spark, text.first_sentence(F.col("s")), s="Do it. Then rest.") == "Do it."
