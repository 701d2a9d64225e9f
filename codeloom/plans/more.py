"""Further named queries: pages, orientation, flags, peers, chunks and upkeep. ``registry`` loads them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import analysis, graph, search, specs, views
from . import proxy
from .proxy import EDGE, FEW, LINK, ROUTE, SYM, TIGHT
from .registry import _IS_TEST, _PATH_SQL, _PR, _REASON, _ROUNDS, ROOT, _paths, query

_DEAD = f"{SYM}, {TIGHT}, {FEW}, dead AS (SELECT * FROM sym WHERE symbol_id NOT IN (SELECT dst FROM tight) AND symbol_id NOT IN (SELECT symbol_id FROM few))"
_FLAGS = ("include_tests", "include_infrastructure", "include_public", "include_non_python", "include_framework_routes")
_SEEN = "CASE WHEN symbol_id % 2 = 0 THEN 'public' END"
_INFRA_NAME = "(kind IN ('function', 'method') AND regexp_matches(name, '_(state|settings|config|session)$')) OR (name = 'register' AND kind = 'function')"
_WHY = f"""CASE WHEN {{tests}} AND file_path LIKE 'tests/%' THEN 'tests' WHEN {{routes}} AND regexp_matches(file_path, '/pages/.*\\.tsx$') THEN 'fs_routing' WHEN {{other}} AND NOT ends_with(file_path, '.py') THEN 'non_python'
  WHEN {{infra}} AND ({_INFRA_NAME}) THEN 'infrastructure' WHEN {{public}} AND visibility = 'public' THEN 'public' ELSE 'dead' END"""
_VARIED = f"varied AS (SELECT * REPLACE (CASE WHEN kind = 'class' THEN concat('web/pages/p', symbol_id, '.tsx') WHEN start_line > 900 THEN concat('lib/m', symbol_id, '.go') ELSE file_path END AS file_path), {_SEEN} AS visibility FROM dead)"


def _flag_sql(flag: str) -> str:
    on = {k: "false" if f == flag else "true" for k, f in zip(("tests", "infra", "public", "other", "routes"), _FLAGS, strict=True)}
    return f"SELECT '{flag}' AS flag, {_WHY.format(**on)} AS reason, count(*) AS n FROM varied GROUP BY ALL"


@query(f"WITH {_DEAD}, {_VARIED} " + " UNION ALL ".join(_flag_sql(f) for f in ("none", *_FLAGS)))
def dead_code_flags(spark, d):
    """What each filter leaves out, without flags and under each of them."""
    s = proxy.symbols(spark, d)
    path = F.when(F.col("kind") == "class", F.concat(F.lit("web/pages/p"), "symbol_id", F.lit(".tsx"))).when(F.col("start_line") > 900, F.concat(F.lit("lib/m"), "symbol_id", F.lit(".go"))).otherwise(F.col("file_path"))
    s = s.withColumn("file_path", path).withColumn("visibility", F.when(F.col("symbol_id") % 2 == 0, "public"))
    out = None
    for flag in ("none", *_FLAGS):
        found = analysis.dead_code(s, proxy.tight_edges(spark, d), proxy.tight_links(spark, d), **({flag: True} if flag != "none" else {}))
        one = analysis.filtered_out(found).select(F.lit(flag).alias("flag"), "reason", "n")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {_DEAD}, kept AS (SELECT 'nested' AS category, file_path AS path, name FROM sym WHERE kind = 'method' AND end_line - start_line > 40 UNION ALL SELECT 'export', file_path, name FROM sym WHERE kind = 'class' AND end_line - start_line > 45),
live AS (SELECT symbol_id FROM dead JOIN (SELECT DISTINCT name FROM kept WHERE category = 'export') USING (name) UNION SELECT symbol_id FROM dead JOIN kept ON kept.category = 'nested' AND kept.path = dead.file_path AND kept.name = dead.name
  UNION SELECT symbol_id FROM dead JOIN (SELECT DISTINCT name AS owner FROM kept WHERE category = 'export') ON kind = 'method' AND string_split(qualified_name, '.')[-2] = owner)
SELECT symbol_id, {_REASON.replace(" END", "")} WHEN symbol_id IN (SELECT symbol_id FROM live) THEN 'infrastructure' ELSE 'dead' END AS reason FROM dead""")
def dead_code_protected(spark, d):
    """Names that code keeps alive without calling them take their symbols out."""
    s = proxy.symbols(spark, d)
    size = F.col("end_line") - F.col("start_line")
    kept = s.where((F.col("kind") == "method") & (size > 40)).select(F.lit("nested").alias("category"), F.col("file_path").alias("path"), "name")
    kept = kept.union(s.where((F.col("kind") == "class") & (size > 45)).select(F.lit("export"), "file_path", "name"))
    found = analysis.dead_code(s, proxy.tight_edges(spark, d), proxy.tight_links(spark, d), protected=kept)
    return found.select("symbol_id", F.coalesce("reason", F.lit("dead")).alias("reason"))


@query(f"""WITH {SYM}, {EDGE}, c AS (SELECT sym.* FROM sym JOIN edge ON src = symbol_id WHERE dst = {ROOT} AND weight >= 0.6), n AS (SELECT *, row_number() OVER (ORDER BY file_path, start_line, symbol_id) AS nth FROM c)
SELECT symbol_id, file_path, (SELECT count(*) FROM c) AS total, CASE WHEN (SELECT count(*) FROM c) > 7 THEN CAST(7 AS BIGINT) END AS next_cursor FROM n WHERE nth > 2 AND nth <= 7""")
def who_calls_page(spark, d):
    """The second page of a symbol's callers, with the exact count and the next cursor."""
    s = proxy.symbols(spark, d)
    cone = graph.reach(proxy.edges(spark, d), spark.createDataFrame([(ROOT,)], "node long"), 1, 0.6, backward=True).withColumnRenamed("node", "symbol_id")
    got = views.paged(cone.join(s, "symbol_id"), ["file_path", "start_line", "symbol_id"], 2, 5, "file_path")
    return got.rows.select("symbol_id", "file_path", F.lit(got.count).cast("long").alias("total"), F.lit(got.next_cursor).cast("long").alias("next_cursor"))


@query(f"WITH {SYM}, {EDGE}, c AS (SELECT sym.* FROM sym JOIN edge ON src = symbol_id WHERE dst = {ROOT} AND weight >= 0.6) SELECT file_path, count(*) AS n FROM c GROUP BY file_path")
def who_calls_summary(spark, d):
    s = proxy.symbols(spark, d)
    cone = graph.reach(proxy.edges(spark, d), spark.createDataFrame([(ROOT,)], "node long"), 1, 0.6, backward=True).withColumnRenamed("node", "symbol_id")
    return views.paged(cone.join(s, "symbol_id"), ["symbol_id"], summary_by="file_path", summary_only=True).summary


_RANKED = f"{_PR}, ranked AS (SELECT sym.*, rank FROM r{_ROUNDS} JOIN sym ON symbol_id = node)"


def _ranks(spark, d):
    return graph.pagerank(proxy.symbols(spark, d).select(F.col("symbol_id").alias("node")), proxy.edges(spark, d), _ROUNDS, tolerance=0)


@query(f"""{_RANKED}, n AS (SELECT 'caller' AS side, src AS symbol_id FROM edge WHERE dst = {ROOT} AND weight >= 0.6 UNION ALL SELECT 'callee', dst FROM edge WHERE src = {ROOT} AND weight >= 0.6),
o AS (SELECT side, row_number() OVER (PARTITION BY side ORDER BY rank DESC, symbol_id) AS nth, symbol_id, qualified_name FROM n JOIN ranked USING (symbol_id)) SELECT side, CAST(nth AS INTEGER) AS nth, symbol_id, qualified_name FROM o WHERE nth <= 5""")
def orient_top5(spark, d):
    return views.top_neighbours(proxy.edges(spark, d), _ranks(spark, d), proxy.symbols(spark, d), ROOT).drop("rank")


_SHOWN = "shown AS (SELECT * FROM ranked WHERE NOT (end_line - start_line > 0 AND end_line - start_line < 5)), top AS (SELECT * FROM shown WHERE file_path NOT LIKE 'tests/%' ORDER BY rank DESC, symbol_id LIMIT 20)"


@query(f"{_RANKED}, {_SHOWN} SELECT 'top' AS list, symbol_id FROM top UNION ALL SELECT 'outranking test', symbol_id FROM (SELECT * FROM shown WHERE file_path LIKE 'tests/%' AND rank >= (SELECT min(rank) FROM top) ORDER BY rank DESC, symbol_id LIMIT 20)")
def overview_top(spark, d):
    top, above = views.overview(_ranks(spark, d), proxy.symbols(spark, d), include_structural=True)
    return top.select(F.lit("top").alias("list"), "symbol_id").union(above.select(F.lit("outranking test"), "symbol_id"))


@query(f"""WITH RECURSIVE {SYM}, {TIGHT}, {FEW}, r(node, depth) AS (SELECT symbol_id, 0 FROM few UNION SELECT tight.dst, r.depth + 1 FROM r JOIN tight ON tight.src = r.node WHERE r.depth < 10),
loose AS (SELECT * FROM sym WHERE file_path NOT LIKE 'tests/%' AND symbol_id NOT IN (SELECT symbol_id FROM few)), product AS (SELECT * FROM sym WHERE file_path NOT LIKE 'tests/%')
SELECT 'implicit' AS list, count(*) AS n FROM loose WHERE symbol_id IN (SELECT node FROM r WHERE depth > 0) UNION ALL SELECT 'uncovered', count(*) FROM loose WHERE symbol_id NOT IN (SELECT node FROM r WHERE depth > 0)
UNION ALL SELECT 'files_without_link', count(DISTINCT file_path) FROM product WHERE file_path NOT IN (SELECT file_path FROM product WHERE symbol_id IN (SELECT symbol_id FROM few))
UNION ALL SELECT 'specs_without_implementation', count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT spec FROM few) UNION ALL SELECT 'specs_without_test', count(*) FROM supplier UNION ALL SELECT 'tests_per_spec', count(*) FROM supplier""")
def audit_lists(spark, d):
    """How long each of the audit's lists is."""
    named = proxy.table(spark, d, "supplier").select(F.col("s_suppkey").alias("spec_id"))
    links = proxy.tight_links(spark, d).withColumnRenamed("spec", "spec_id")
    lists = views.coverage_lists(proxy.symbols(spark, d), proxy.tight_edges(spark, d), named, links)
    return views.index_status(**lists).withColumnRenamed("what", "list")


@query(f"WITH {_PATH_SQL} SELECT id, path, b = 'conftest.py' OR starts_with(b, 'conftest_') OR list_has_any(dirs, ['fixtures', '__fixtures__', 'test_utils', 'test_helpers']) AS fixture_only, NOT regexp_matches('/' || path, '/fixtures/|/__fixtures__/|/data/') AND ((starts_with(b, 'test_') AND contains(b, '.')) OR contains(b, '_test.') OR starts_with(b, 'test.') OR contains(b, '.test.')) AS runnable, list_has_any(string_split(path, '/'), ['test', 'tests', 'spec', '__tests__']) OR starts_with(b, 'test_') OR regexp_matches(path, '_test\\.[a-z]+$') AS unit_test, {_IS_TEST} AS is_test FROM f")
def test_predicates(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("id", "path", paths.is_fixture_only(p).alias("fixture_only"), paths.is_runnable_test(p).alias("runnable"), paths.names_a_test(p, F.lit("x")).alias("unit_test"), paths.is_test_file(p).alias("is_test"))


@query(f"""WITH {ROUTE}, c AS (SELECT DISTINCT symbol_id AS src, method AS cm, norm_path FROM route WHERE role = 'client' AND norm_path <> ''),
s AS (SELECT DISTINCT symbol_id AS dst, CASE WHEN method IN ('ROUTE', 'WEBSOCKET', 'ON', 'ALL') THEN NULL ELSE method END AS sm, norm_path FROM route WHERE role = 'server' AND norm_path <> ''),
e AS (SELECT src, dst, max(CASE WHEN sm IS NULL THEN 0.8 ELSE 0.9 END) AS weight FROM c JOIN s USING (norm_path) WHERE src <> dst AND (sm IS NULL OR sm = cm) GROUP BY src, dst),
few AS (SELECT min(dst) AS node FROM e) SELECT url AS qualified_name, 'in' AS side, CAST(weight AS DOUBLE) AS confidence FROM e JOIN pages ON page_id = src WHERE dst = (SELECT node FROM few)
UNION ALL SELECT url, 'out', CAST(weight AS DOUBLE) FROM e JOIN pages ON page_id = dst WHERE src = (SELECT node FROM few)""")
def route_peers(spark, d):
    """Who reaches the first server over a route, and whom it reaches."""
    from ..operators.resolve import resolve_routes

    e = resolve_routes(proxy.routes(spark, d))
    node = e.agg(F.min("dst")).first()[0]
    s = proxy.table(spark, d, "pages").select(F.col("page_id").alias("symbol_id"), F.col("url").alias("qualified_name"), F.lit("").alias("file_path"))
    part = lambda side: views.peers(e, s, node, side == "in").select("qualified_name", F.lit(side).alias("side"), "confidence")
    return part("in").union(part("out"))


@query("""WITH e AS (SELECT c_custkey % 50 AS src, c_nationkey AS dst, CASE WHEN c_custkey % 2 = 0 THEN 'requires' ELSE 'extends' END AS kind, c_custkey AS pos, c_name AS label FROM customer)
SELECT src, dst, kind, first(label ORDER BY pos) AS label FROM e GROUP BY src, dst, kind""")
def edge_first_labels(spark, d):
    c = proxy.table(spark, d, "customer")
    e = c.select((F.col("c_custkey") % 50).alias("src"), F.col("c_nationkey").alias("dst"), F.when(F.col("c_custkey") % 2 == 0, "requires").otherwise("extends").alias("kind"), F.col("c_custkey").alias("at"), F.col("c_name").alias("label"))
    return views.first_labels(e)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS src, c_custkey * 3 % 40 AS dst, 'requires' AS kind FROM customer WHERE c_nationkey < 12), both_ways AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r(node, depth) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT b, depth + 1 FROM r JOIN both_ways ON a = node WHERE depth < 2), n AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
SELECT DISTINCT src, dst, kind FROM e WHERE src IN (SELECT node FROM n WHERE depth < 2) OR dst IN (SELECT node FROM n WHERE depth < 2)""")
def dependency_walk(spark, d):
    """Dependencies traversed from one spec in both directions."""
    c = proxy.table(spark, d, "customer").where("c_nationkey < 12")
    e = c.select(F.col("c_custkey").cast("long").alias("src"), (F.col("c_custkey") * 3 % 40).cast("long").alias("dst"), F.lit("requires").alias("kind")).distinct()
    return graph.walk(e, 3, 2, "both")[1]


@query(f"WITH {SYM}, {EDGE} SELECT 'edges' AS what, count(*) AS n FROM edge UNION ALL SELECT 'files', count(DISTINCT file_path) FROM sym UNION ALL SELECT 'specs', count(*) FROM supplier UNION ALL SELECT 'symbols', count(*) FROM sym")
def index_status(spark, d):
    s = proxy.symbols(spark, d)
    return views.index_status(files=s.select("file_path").distinct(), symbols=s, edges=proxy.edges(spark, d), specs=proxy.table(spark, d, "supplier"))


@query("SELECT count(*) > 0 AS captured, count(*) AS frozen, min(ts) AS first_captured_at, max(ts) AS last_captured_at FROM events WHERE event_type = 'error'")
def debt_status(spark, d):
    return views.baseline_status(proxy.table(spark, d, "events").where("event_type = 'error'").withColumnRenamed("ts", "captured_at"))


@query("""WITH p AS (SELECT regexp_extract(concat(upper(substr(n_name, 1, 2)), '-RF-', n_nationkey), '^(.+)-[0-9]+$', 1) AS prefix FROM nation UNION ALL SELECT 'XX-RF' FROM region), h AS (SELECT prefix, count(*) AS n FROM p GROUP BY prefix)
SELECT prefix, n, round(n / (SELECT sum(n) FROM h), 6) AS share FROM h ORDER BY n DESC, prefix LIMIT 1""")
def dominant_prefix(spark, d):
    ids = proxy.table(spark, d, "nation").select(F.concat(F.upper(F.substring("n_name", 1, 2)), F.lit("-RF-"), "n_nationkey").alias("spec_id"))
    ids = ids.union(proxy.table(spark, d, "region").select(F.concat(F.lit("XX-RF-"), "r_regionkey")))
    return views.dominant_prefix(specs.prefix_histogram(ids))


@query("""WITH s AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY id) AS nth FROM s)
SELECT id, CASE WHEN nth > 1 THEN concat(slug, '-', nth) ELSE slug END AS slug FROM n""")
def unique_slugs(spark, d):
    return views.unique_slugs(proxy.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")))


_DOCS = "doc AS (SELECT CAST(o_orderkey AS VARCHAR) AS target_key, md5(o_orderstatus) AS body_hash, md5(o_orderpriority) AS signature_hash FROM orders), now AS (SELECT CAST(o_orderkey AS VARCHAR) AS target_key, md5(CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END) AS b, md5(CASE WHEN o_totalprice < 20000 THEN 'Y' ELSE o_orderpriority END) AS s FROM orders WHERE o_orderstatus <> 'P')"


@query(f"WITH {_DOCS} SELECT doc.target_key, CASE WHEN now.target_key IS NULL THEN 'gone' WHEN s <> signature_hash THEN 'signature' ELSE 'body' END AS drift FROM doc LEFT JOIN now USING (target_key) WHERE now.target_key IS NULL OR s <> signature_hash OR b <> body_hash")
def doc_drift(spark, d):
    o = proxy.table(spark, d, "orders")
    md5 = lambda c: F.md5(c.cast("binary"))
    key = F.col("o_orderkey").cast("string").alias("target_key")
    docs = o.select(key, md5(F.col("o_orderstatus")).alias("body_hash"), md5(F.col("o_orderpriority")).alias("signature_hash"))
    now = o.where("o_orderstatus <> 'P'").select(key, md5(F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus"))).alias("body_hash"), md5(F.when(F.col("o_totalprice") < 20000, "Y").otherwise(F.col("o_orderpriority"))).alias("signature_hash"))
    return views.doc_drift(docs, now)


_CHUNKS = "SELECT l_orderkey AS symbol_id, CAST(l_linenumber AS INTEGER) AS chunk, {0} AS content_hash FROM lineitem"
_NEW = "md5(CASE WHEN l_quantity = 50 THEN 'changed' ELSE CAST(l_partkey AS VARCHAR) END)"


@query(f"""WITH old AS ({_CHUNKS.format("md5(CAST(l_partkey AS VARCHAR))")}), new AS ({_CHUNKS.format(_NEW)} WHERE l_orderkey > 100), moved AS (SELECT DISTINCT l_orderkey AS symbol_id FROM lineitem WHERE l_quantity = 50 AND l_orderkey > 100)
SELECT symbol_id, chunk, content_hash, 'old' AS origin FROM old WHERE symbol_id NOT IN (SELECT symbol_id FROM moved) UNION ALL SELECT symbol_id, chunk, content_hash, 'new' FROM new WHERE symbol_id IN (SELECT symbol_id FROM moved)""")
def chunk_upsert(spark, d):
    """Chunks after an update, by each source's sequence of hashes."""
    line = proxy.table(spark, d, "lineitem")
    part = F.col("l_partkey").cast("string")
    row = lambda df, h, origin: df.select(F.col("l_orderkey").alias("symbol_id"), F.col("l_linenumber").cast("int").alias("chunk"), F.md5(h.cast("binary")).alias("content_hash"), F.lit(origin).alias("origin"))
    return search.upsert_chunks(row(line, part, "old"), row(line.where("l_orderkey > 100"), F.when(F.col("l_quantity") == 50, "changed").otherwise(part), "new"))


_HEAD = "concat('# doc.', doc_id, chr(10), '# Kind: ', lang, chr(10), '# File: ', source, chr(10), chr(10))"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, {_HEAD} AS head, text FROM documents), b AS (SELECT doc_id, head, text, greatest(1, length(head || text) // 4) <= 1500 AS fits FROM d),
p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS piece, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k FROM b WHERE NOT fits), q AS (SELECT doc_id, k, piece, greatest(1, length(piece) // 4) AS t FROM p),
r AS (SELECT doc_id, k, 0 AS chunk, t AS size, piece AS buf FROM q WHERE k = 1 UNION ALL SELECT q.doc_id, q.k, CASE WHEN size + t > 1500 THEN chunk + 1 ELSE chunk END, CASE WHEN size + t > 1500 THEN t ELSE size + t END, CASE WHEN size + t > 1500 THEN piece ELSE concat(buf, chr(10), chr(10), piece) END FROM r JOIN q ON q.doc_id = r.doc_id AND q.k = r.k + 1),
l AS (SELECT doc_id, chunk, last(buf ORDER BY k) AS body FROM r GROUP BY doc_id, chunk)
SELECT doc_id, CAST(0 AS INTEGER) AS chunk, md5(head || text) AS content_hash FROM b WHERE fits UNION ALL SELECT doc_id, CAST(chunk AS INTEGER), md5(head || body) FROM l JOIN d USING (doc_id)""")
def chunk_texts(spark, d):
    """Texts as code chunks under their headers, split on blank lines beyond the budget."""
    t = proxy.table(spark, d, "documents")
    s = t.select(F.col("doc_id").alias("symbol_id"), F.concat(F.lit("doc."), "doc_id").alias("qualified_name"), F.col("lang").alias("kind"), F.col("source").alias("file_path"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.col("text").alias("body"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    return search.chunk_symbols(s).select(F.col("symbol_id").alias("doc_id"), "chunk", "content_hash")


@query("""WITH l AS (SELECT concat(source, '/d', doc_id, '.txt') AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE contains(source, 'e')),
h AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS nth FROM l WHERE contains(substr(text, 1, 4000), '(a+)+')) SELECT path, CAST(line AS INTEGER) AS line, substr(text, 1, 240) AS text FROM h WHERE nth <= 20""")
def grep_guarded(spark, d):
    """A pattern that repeats a repeated group is searched as it stands; a glob picks the files."""
    t = proxy.table(spark, d, "documents").select(F.concat("source", F.lit("/d"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return search.grep(t, "(a+)+", literal=False, glob="*e*/d*.txt", line_most=search.LINE_MOST)


@query(f"""WITH {SYM}, {LINK}, hit AS (SELECT DISTINCT symbol_id FROM sym WHERE file_path IN ('src/brand1.py', 'src/brand2.py')) SELECT spec, relation, count(DISTINCT symbol_id) AS n_symbols FROM link WHERE symbol_id IN (SELECT symbol_id FROM hit) GROUP BY spec, relation""")
def diff_spec_impact(spark, d):
    hit = proxy.symbols(spark, d).where(F.col("file_path").isin("src/brand1.py", "src/brand2.py")).select("symbol_id")
    return proxy.links(spark, d).join(hit, "symbol_id", "left_semi").groupBy("spec", "relation").agg(F.countDistinct("symbol_id").alias("n_symbols"))


@query("""WITH i AS (SELECT concat(CASE WHEN s_suppkey % 2 = 0 THEN 'Spec-' ELSE 'spec_' END, s_suppkey // 2) AS spec_id FROM supplier), k AS (SELECT regexp_replace(lower(spec_id), '[^a-z0-9]+', '', 'g') AS key, spec_id FROM i)
SELECT key, count(*) AS n, string_agg(spec_id, ',' ORDER BY spec_id) AS spec_ids FROM k GROUP BY key HAVING count(*) > 1""")
def duplicate_spec_ids(spark, d):
    s = proxy.table(spark, d, "supplier")
    return views.duplicate_ids(s.select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Spec-").otherwise("spec_"), F.floor(F.col("s_suppkey") / 2)).alias("spec_id")))


@query("""WITH p AS (SELECT ['/health', '/v1/HEALTH?x', '/metrics/cache', '/swagger-ui/', '/users', '/actuator', '/info/', ''] AS s) SELECT n_nationkey AS id, s[n_nationkey % 8 + 1] AS path,
regexp_matches(s[n_nationkey % 8 + 1], '^/(health|info/|swagger-ui/|metrics/cache)$') AS infra FROM nation, p""")
def infra_routes(spark, d):
    some = F.array(*map(F.lit, ("/health", "/v1/HEALTH?x", "/metrics/cache", "/swagger-ui/", "/users", "/actuator", "/info/", "")))
    n = proxy.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.element_at(some, (F.col("n_nationkey") % 8 + 1).cast("int")).alias("path"))
    return n.withColumn("infra", paths.is_infra_route(F.col("path")))


@query("""WITH e AS (SELECT o_custkey AS source, o_orderkey % 100 AS target, lower(o_orderstatus) AS relation FROM orders) SELECT DISTINCT source AS node, relation, target FROM e WHERE relation IN ('f', 'o') AND source < 50 AND target IN (SELECT n_nationkey FROM nation)""")
def external_reach(spark, d):
    o = proxy.table(spark, d, "orders")
    e = o.select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 100).alias("target"), F.lower("o_orderstatus").alias("relation"))
    return views.external_reach(e.where("source < 50").select(F.col("source").alias("node")), e, proxy.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node")), ["f", "o"])
