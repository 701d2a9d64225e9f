from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import analysis
from codeloom.sources import changes, protection

CODE = """from a import helper
__all__ = ["public"]
TABLE = [first, "pkg.mod.second"]
my_tool = app.tool


def outer():
    def cb():
        pass

    def lost():
        pass

    bus.register(handler)
    return cb
"""


def test_protection(spark):
    got = protection.protected_names(CODE)
    assert {("export", "helper"), ("export", "public"), ("module", "first"), ("module", "second"), ("alias", "my_tool"), ("nested", "cb"), ("registered", "handler")} <= got
    assert ("nested", "lost") not in got and protection.protected_names("def (") == set()
    files = spark.createDataFrame([("m.py", "python", CODE), ("x.js", "javascript", "a")], "path string, language string, content string")
    cand = spark.createDataFrame([(1, "cb", "m.py"), (2, "cb", "other.py"), (3, "first", "z.py"), (4, "free", "m.py")], "symbol_id long, name string, file_path string")
    assert {r.symbol_id: r.protected for r in protection.spare(cand, protection.scan(files)).collect()} == {1: "nested", 2: None, 3: "module", 4: None}


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_text(spark):
    assert one(spark, text.humanise(F.lit("user_login-flow"))) == "User Login Flow"
    assert one(spark, text.nearest(F.lit("Implments"), ["tests", "implements"])) == "implements" and one(spark, text.nearest(F.lit("zzz"), ["tests"])) is None
    assert one(spark, text.java_mapping(F.lit('@GetMapping(value = "/a/{id}")'))) == "GET /a/{id}"
    assert one(spark, text.java_mapping(F.lit('@RequestMapping(path="/b", method = RequestMethod.PUT)'))) == "PUT /b" and one(spark, text.java_mapping(F.lit("@Bean"))) is None
    assert one(spark, text.raised_names(F.lit("raise KeyError(x)\nthrow new Oops()"))) == ["KeyError", "Oops"]


def test_types_and_freshness(spark):
    s = spark.createDataFrame([(1, "Order", "m.Order", "class", "class Order: Item"), (2, "Item", "m.Item", "class", "class Item: Price"), (3, "Price", "m.Price", "type_alias", ""), (4, "Order", "long.m.Order", "class", "")], "symbol_id long, name string, qualified_name string, kind string, body string")
    roots = spark.createDataFrame([(9, "def f(o: Order): pass")], "root long, body string")
    assert {(r.symbol_id, r.level) for r in analysis.expand_types(s, roots, 2).collect()} == {(1, 1), (2, 2)}
    files = spark.createDataFrame([("a", "h1"), ("b", "h2")], "path string, content_hash string")
    chunks = spark.createDataFrame([(1, "a", "h1"), (2, "b", "old"), (3, "c", "h")], "chunk_id long, path string, content_hash string")
    assert {r.chunk_id for r in analysis.stale_chunks(chunks, files).collect()} == {2, 3}
    t = spark.createDataFrame([(1, "@spec:known, ghost:0.8")], "id long, text string")
    assert [tuple(r) for r in analysis.unknown_annotations(t, spark.createDataFrame([("Known",)], "spec_id string")).collect()] == [(1, "ghost")]


def test_small():
    assert changes.payload_warning(10, 200) is None and "KiB" in changes.payload_warning(5000, 200) and "holds" in changes.payload_warning(300, 200)
