"""Every named query of the engine with its DuckDB counterpart, over the stand-in model of ``proxy``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import approx_tokens
from ..functions.text import KEYWORDS, MARKED, PLAIN, first_sentence
from ..operators import analysis, graph, logs, resolve, search, specs, views
from . import proxy
from .proxy import EDGE, FEW, LINK, LOG, ROUTE, SYM, TIGHT

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ROOT, DEEP = 17, 2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _seed(spark: SparkSession, *nodes: int) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node long")


def _named(cone: DataFrame, symbols: DataFrame) -> DataFrame:
    return cone.join(symbols.withColumnRenamed("symbol_id", "node"), "node").select("node", "qualified_name", "file_path", "start_line", "depth")


def _cone_sql(start: str, depth: int, least: float, backward: bool) -> str:
    a, b = ("dst", "src") if backward else ("src", "dst")
    w = f"weight >= {least}" if least else "true"
    return f"""WITH RECURSIVE {SYM}, {EDGE}, seed AS ({start}), r(node, depth) AS (SELECT node, 0 FROM seed UNION
  SELECT edge.{b}, r.depth + 1 FROM r JOIN edge ON edge.{a} = r.node WHERE {w} AND r.depth < {depth}),
best AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node)"""


_PICK = " SELECT node, qualified_name, file_path, start_line, depth FROM best JOIN sym ON symbol_id = node WHERE depth > 0"


@query(_cone_sql(f"SELECT {ROOT} AS node", 1, 0.6, True) + _PICK)
def who_calls_d1(spark, d):
    return _named(graph.reach(proxy.edges(spark, d), _seed(spark, ROOT), 1, 0.6, backward=True), proxy.symbols(spark, d))


@query(_cone_sql(f"SELECT {ROOT} AS node", 2, 0.6, True) + _PICK)
def who_calls_d2(spark, d):
    return _named(graph.reach(proxy.edges(spark, d), _seed(spark, ROOT), DEEP, 0.6, backward=True), proxy.symbols(spark, d))


@query(_cone_sql(f"SELECT {ROOT} AS node", 2, 0.6, False) + _PICK)
def who_does_this_call(spark, d):
    return _named(graph.reach(proxy.edges(spark, d), _seed(spark, ROOT), DEEP, 0.6), proxy.symbols(spark, d))


@query(_cone_sql(f"SELECT {ROOT} AS node", 3, 1.0, True) + _PICK)
def impact_symbol(spark, d):
    return _named(graph.reach(proxy.edges(spark, d), _seed(spark, ROOT), 3, 1.0, backward=True), proxy.symbols(spark, d))


@query(_cone_sql("SELECT symbol_id AS node FROM sym WHERE file_path = 'src/brand7.py'", 2, 1.0, True) + _PICK)
def impact_file(spark, d):
    s = proxy.symbols(spark, d)
    return _named(graph.reach(proxy.edges(spark, d), s.where("file_path = 'src/brand7.py'").select(F.col("symbol_id").alias("node")), 2, 1.0, backward=True), s)


@query(_cone_sql("SELECT symbol_id AS node FROM sym WHERE file_path LIKE 'tests/%'", 3, 1.0, False) + " SELECT node, depth FROM best")
def reach_multi_seed(spark, d):
    tests = proxy.symbols(spark, d).where("file_path like 'tests/%'").select(F.col("symbol_id").alias("node"))
    return graph.reach(proxy.edges(spark, d), tests, 3, 1.0, keep_seeds=True)


@query(_cone_sql("SELECT 0 AS node WHERE false", 0, 0, False).split(", seed AS")[0] + """, seed AS (SELECT DISTINCT file_path AS origin, symbol_id AS node FROM sym WHERE file_path IN ('src/brand1.py', 'src/brand2.py', 'src/brand3.py')),
r(origin, node, depth) AS (SELECT origin, node, 0 FROM seed UNION SELECT r.origin, edge.src, r.depth + 1 FROM r JOIN edge ON edge.dst = r.node WHERE weight >= 1.0 AND r.depth < 2),
best AS (SELECT origin, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL) SELECT origin, count(*) AS n_affected, max(depth) AS deepest FROM best WHERE depth > 0 GROUP BY origin""")
def diff_impact_by_file(spark, d):
    s = proxy.symbols(spark, d).where(F.col("file_path").isin("src/brand1.py", "src/brand2.py", "src/brand3.py"))
    cone = graph.cones(proxy.edges(spark, d), s.select(F.col("file_path").alias("origin"), F.col("symbol_id").alias("node")), 2, 1.0, backward=True)
    return cone.groupBy("origin").agg(F.count("*").alias("n_affected"), F.max("depth").alias("deepest"))


_ROUNDS = 10
_PR = f"WITH {SYM}, {EDGE}, nodes AS (SELECT symbol_id AS node FROM sym), outs AS (SELECT src, count(*) AS k FROM edge GROUP BY src), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"
for _i in range(_ROUNDS):
    _PR += f""", l{_i} AS (SELECT coalesce(sum(rank), 0) AS loose FROM r{_i} LEFT JOIN outs ON src = node WHERE k IS NULL),
s{_i} AS (SELECT dst, sum(rank / k) AS sent FROM edge JOIN r{_i} ON r{_i}.node = edge.src JOIN outs ON outs.src = edge.src GROUP BY dst),
r{_i + 1} AS (SELECT node, (1 - 0.85::DOUBLE) / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * (coalesce(sent, 0) + (SELECT loose FROM l{_i}) / (SELECT count(*) FROM nodes)) AS rank FROM nodes LEFT JOIN s{_i} ON dst = node)"""


@query(_PR + f" SELECT node, round(rank * 1000000, 4) AS rank_ppm FROM r{_ROUNDS} ORDER BY rank_ppm DESC, node LIMIT 20")
def pagerank_top(spark, d):
    r = graph.pagerank(proxy.symbols(spark, d).select(F.col("symbol_id").alias("node")), proxy.edges(spark, d), _ROUNDS, tolerance=0)
    return r.select("node", F.round(F.col("rank") * 1000000, 4).alias("rank_ppm")).orderBy(F.desc("rank_ppm"), "node").limit(20)


@query(f"WITH {ROUTE} SELECT symbol_id, role, method, norm_path FROM route")
def route_normalize(spark, d):
    return proxy.routes(spark, d).select("symbol_id", "role", "method", "norm_path")


@query(f"""WITH {ROUTE}, c AS (SELECT DISTINCT symbol_id AS src, method AS cm, norm_path FROM route WHERE role = 'client' AND norm_path <> ''),
s AS (SELECT DISTINCT symbol_id AS dst, CASE WHEN method IN ('ROUTE', 'WEBSOCKET', 'ON', 'ALL') THEN NULL ELSE method END AS sm, norm_path FROM route WHERE role = 'server' AND norm_path <> '')
SELECT src, dst, CAST(max(CASE WHEN sm IS NULL THEN 0.8 ELSE 0.9 END) AS DOUBLE) AS weight FROM c JOIN s USING (norm_path) WHERE src <> dst AND (sm IS NULL OR sm = cm) GROUP BY src, dst""")
def route_edges(spark, d):
    return resolve.resolve_routes(proxy.routes(spark, d))


_INFRA = r"regexp_matches(lower(norm_path), '^/(health|liveness|readiness|ready|ping|metrics|actuator/health|actuator/info|api-docs|v3/api-docs|openapi\.yaml|openapi\.json|swagger|swagger-ui|ui|playground|info)$|^/(metrics|actuator|api-docs|v3/api-docs|swagger-ui|swagger)/')"


@query(f"WITH {ROUTE} SELECT DISTINCT symbol_id, method, norm_path FROM route WHERE role = 'server' AND norm_path <> '' AND NOT {_INFRA} AND norm_path NOT IN (SELECT norm_path FROM route WHERE role = 'client')")
def legacy_servers(spark, d):
    return resolve.unmatched(proxy.routes(spark, d), "server")


@query(f"WITH {ROUTE} SELECT DISTINCT symbol_id, method, norm_path FROM route WHERE role = 'client' AND norm_path <> '' AND norm_path NOT IN (SELECT norm_path FROM route WHERE role = 'server')")
def orphan_clients(spark, d):
    return resolve.unmatched(proxy.routes(spark, d), "client")


_THIN = f"{SYM}, {TIGHT}, {FEW}, {LINK}, dead AS (SELECT * FROM sym WHERE symbol_id NOT IN (SELECT dst FROM tight) AND symbol_id NOT IN (SELECT symbol_id FROM few))"
_REASON = "CASE WHEN file_path LIKE 'tests/%' THEN 'tests' WHEN (kind IN ('function', 'method') AND regexp_matches(name, '_(state|settings|config|session)$')) OR (name = 'register' AND kind = 'function') THEN 'infrastructure' END"


@query(f"WITH {_THIN} SELECT symbol_id, qualified_name, file_path FROM dead")
def dead_candidates(spark, d):
    return analysis.unreached(proxy.symbols(spark, d), proxy.tight_edges(spark, d), proxy.tight_links(spark, d)).select("symbol_id", "qualified_name", "file_path")


@query(f"WITH {_THIN} SELECT coalesce({_REASON}, 'dead') AS reason, kind, count(*) AS n FROM dead GROUP BY ALL")
def dead_by_reason(spark, d):
    found = analysis.dead_code(proxy.symbols(spark, d), proxy.tight_edges(spark, d), proxy.tight_links(spark, d))
    return found.groupBy(F.coalesce("reason", F.lit("dead")).alias("reason"), "kind").agg(F.count("*").alias("n"))


@query(f"WITH {SYM} SELECT name, count(DISTINCT file_path) AS n_files FROM sym GROUP BY name HAVING count(DISTINCT file_path) >= 3")
def structural_names(spark, d):
    return analysis.structural_names(proxy.symbols(spark, d))


@query(f"WITH {SYM}, {EDGE}, deg AS (SELECT dst AS symbol_id, count(*) AS n_callers, sum(weight) AS mass FROM edge GROUP BY dst) SELECT symbol_id, qualified_name, n_callers, round(mass, 6) AS mass FROM deg JOIN sym USING (symbol_id) WHERE file_path NOT LIKE 'tests/%' ORDER BY mass DESC, symbol_id LIMIT 25")
def top_symbols(spark, d):
    e = graph.simple(proxy.edges(spark, d)).groupBy(F.col("dst").alias("symbol_id")).agg(F.count("*").alias("n_callers"), F.round(F.sum("weight"), 6).alias("mass"))
    s = proxy.symbols(spark, d).where("file_path not like 'tests/%'")
    return e.join(s, "symbol_id").select("symbol_id", "qualified_name", "n_callers", "mass").orderBy(F.desc("mass"), "symbol_id").limit(25)


@query(f"""WITH RECURSIVE {_THIN}, t AS (SELECT symbol_id FROM sym WHERE file_path LIKE 'tests/%' AND kind <> 'class'),
r(origin, node, depth) AS (SELECT symbol_id, symbol_id, 0 FROM t UNION SELECT r.origin, tight.dst, r.depth + 1 FROM r JOIN tight ON tight.src = r.node WHERE r.depth < 10)
SELECT symbol_id, qualified_name FROM t JOIN sym USING (symbol_id) WHERE symbol_id NOT IN (SELECT r.origin FROM r JOIN sym p ON p.symbol_id = r.node WHERE p.file_path NOT LIKE 'tests/%')""")
def orphan_tests(spark, d):
    return analysis.orphan_tests(proxy.symbols(spark, d), proxy.tight_edges(spark, d)).select("symbol_id", "qualified_name")


@query(f"WITH {LINK} SELECT spec, count(*) AS n_links, round(avg(confidence), 6) AS mean_confidence FROM link GROUP BY spec HAVING round(avg(confidence), 6) < 0.75")
def spec_low_confidence(spark, d):
    return analysis.low_confidence(proxy.links(spark, d), 0.75)


@query(f"WITH {FEW} SELECT s_suppkey AS spec, s_name AS title FROM supplier WHERE s_suppkey NOT IN (SELECT spec FROM few)")
def spec_without_impl(spark, d):
    s = proxy.table(spark, d, "supplier").select(F.col("s_suppkey").alias("spec"), F.col("s_name").alias("title"))
    return specs.list_specs(s, proxy.tight_links(spark, d), has_implementation=False).select("spec", "title")


@query(f"""WITH RECURSIVE {_THIN}, r(node, depth) AS (SELECT symbol_id, 0 FROM sym WHERE file_path LIKE 'tests/%' UNION SELECT tight.dst, r.depth + 1 FROM r JOIN tight ON tight.src = r.node WHERE r.depth < 3),
own AS (SELECT DISTINCT spec, symbol_id FROM link WHERE relation = 'implements'), named AS (SELECT DISTINCT spec, symbol_id FROM link WHERE relation = 'tests')
SELECT own.spec, count(*) AS n_implementing, sum(CASE WHEN own.symbol_id IN (SELECT node FROM r) OR named.spec IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_verified,
round(sum(CASE WHEN own.symbol_id IN (SELECT node FROM r) OR named.spec IS NOT NULL THEN 1 ELSE 0 END) / count(*), 6) AS ratio
FROM own LEFT JOIN named ON own.spec = named.spec AND own.symbol_id = named.symbol_id GROUP BY own.spec""")
def spec_coverage(spark, d):
    return analysis.spec_coverage(proxy.links(spark, d), proxy.symbols(spark, d), proxy.tight_edges(spark, d))


@query("SELECT CAST(ts AS DATE) AS day, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END), 6) AS ratio, count(*) AS n FROM events GROUP BY 1")
def coverage_trend(spark, d):
    e = proxy.table(spark, d, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)), 6).alias("ratio"), F.count("*").alias("n"))


@query(f"""WITH {SYM}, place AS (SELECT event_id AS place_id, concat('src/brand', event_id % 25 + 1, '.py') AS path, user_id * 7 + 1 AS line FROM events),
met AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY end_line - start_line, start_line DESC, symbol_id) AS nth FROM place JOIN sym ON path = file_path AND line BETWEEN start_line AND end_line)
SELECT place_id, line, symbol_id, start_line, end_line FROM met WHERE nth = 1""")
def enclosing_symbol(spark, d):
    e = proxy.table(spark, d, "events")
    places = e.select(F.col("event_id").alias("place_id"), F.concat(F.lit("src/brand"), F.col("event_id") % 25 + 1, F.lit(".py")).alias("path"), (F.col("user_id") * 7 + 1).alias("line"))
    return analysis.enclosing(proxy.symbols(spark, d), places).select("place_id", "line", "symbol_id", "start_line", "end_line")


def _refs(spark, d):
    s = proxy.symbols(spark, d)
    scope = F.when(F.col("symbol_id") % 2 == 0, F.concat(F.lit("brand"), (F.col("symbol_id") % 30 + 1).cast("string")))
    return s.select(F.col("symbol_id").alias("ref_id"), F.col("symbol_id").alias("src"), F.element_at(F.array(*map(F.lit, ("small_ring", "red_widget", "blue_bolt", "nowhere"))), (F.col("symbol_id") % 4 + 1).cast("int")).alias("target_name"), scope.alias("scope_module"))


@query(f"""WITH {SYM}, ref AS (SELECT symbol_id AS ref_id, symbol_id AS src, ['small_ring', 'red_widget', 'blue_bolt', 'nowhere'][symbol_id % 4 + 1] AS target_name,
  CASE WHEN symbol_id % 2 = 0 THEN concat('brand', symbol_id % 30 + 1) END AS scope, qualified_name AS sq, file_path AS sf FROM sym),
scopes AS (SELECT DISTINCT string_split(qualified_name, '.')[1] AS scope FROM sym UNION SELECT qualified_name FROM sym UNION SELECT string_split(qualified_name, '.')[2] FROM sym),
m AS (SELECT ref.*, c.symbol_id AS dst, c.qualified_name AS dq, c.file_path AS df, coalesce(contains(concat('.', c.qualified_name, '.'), concat('.', scope, '.')), false) AS ins FROM ref JOIN sym c ON c.name = ref.target_name),
m1 AS (SELECT *, sum(ins::INT) OVER (PARTITION BY ref_id) AS ns FROM m), m2 AS (SELECT * FROM m1 WHERE (scope IS NULL OR ns > 0 OR scope IN (SELECT scope FROM scopes)) AND (ns = 0 OR ins)),
m3 AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n, max(CASE WHEN scope IS NULL AND (sq = string_split(dq, '.')[1] OR starts_with(sq, concat(string_split(dq, '.')[1], '.'))) THEN length(string_split(dq, '.')[1]) END) OVER (PARTITION BY ref_id) AS deep FROM m2),
m4 AS (SELECT *, ns = 0 AND n > 1 AND deep IS NOT NULL AS lex FROM m3), m5 AS (SELECT * FROM m4 WHERE NOT lex OR starts_with(sq, concat(string_split(dq, '.')[1], '.'))),
m6 AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n2, sum((df = sf)::INT) OVER (PARTITION BY ref_id) AS same FROM m5),
m7 AS (SELECT *, n2 > 1 AND ns = 0 AND NOT lex AND same > 0 AS byf FROM m6), m8 AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n3 FROM m7 WHERE NOT byf OR df = sf)
SELECT src, dst, CAST(max(CASE WHEN n3 = 1 THEN 1.0 WHEN ns > 0 THEN 0.9 WHEN lex THEN 0.8 WHEN byf THEN 0.7 ELSE 0.5 END) AS DOUBLE) AS weight FROM m8 WHERE src <> dst GROUP BY src, dst""")
def resolve_refs_weights(spark, d):
    return resolve.resolve_refs(_refs(spark, d), proxy.symbols(spark, d))


def _files(spark, d):
    return proxy.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))


_LINES = "lines AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


@query(f"WITH {_LINES}, hit AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS nth FROM lines WHERE contains(text, 'rights')) SELECT path, CAST(line AS INTEGER) AS line, substr(text, 1, 240) AS text FROM hit WHERE nth <= 20")
def grep_literal(spark, d):
    return search.grep(_files(spark, d), "rights")


@query(f"WITH {_LINES}, hit AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS nth FROM lines WHERE regexp_matches(text, '[0-9]{{3}}')) SELECT path, CAST(line AS INTEGER) AS line, substr(text, 1, 240) AS text FROM hit WHERE nth <= 2")
def grep_regex_capped(spark, d):
    return search.grep(_files(spark, d), "[0-9]{3}", literal=False, per_file=2)


_WORDS = ["with", "rights", "und", "password"]
_TERMS = f"list_filter(string_split(regexp_replace(translate(lower(text), '{MARKED}', '{PLAIN}'), '[^a-z0-9ß]+', ' ', 'g'), ' '), lambda t: t <> '')"


@query(f"""WITH sized AS (SELECT doc_id AS chunk_id, {_TERMS} AS t FROM documents), stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM sized),
hits AS (SELECT chunk_id, term, count(*) AS tf, any_value(len) AS length FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS term FROM sized) WHERE term IN ({", ".join(repr(w) for w in _WORDS)}) GROUP BY chunk_id, term),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term)
SELECT chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM hits JOIN df USING (term), stats GROUP BY chunk_id""")
def bm25_search(spark, d):
    found = search.bm25(proxy.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), _WORDS)
    return found.select("chunk_id", F.round("score", 6).alias("score"))


@query("""WITH RECURSIVE p AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), q AS (SELECT id, k, greatest(1, length(piece) // 4) AS t FROM p),
r AS (SELECT id, k, 0 AS chunk, t AS size, 1 AS n FROM q WHERE k = 1 UNION ALL SELECT q.id, q.k, CASE WHEN size + t > 200 THEN chunk + 1 ELSE chunk END, CASE WHEN size + t > 200 THEN t ELSE size + t END, CASE WHEN size + t > 200 THEN 1 ELSE n + 1 END FROM r JOIN q ON q.id = r.id AND q.k = r.k + 1)
SELECT id, CAST(chunk AS INTEGER) AS chunk, CAST(max(n) AS BIGINT) AS n_pieces, CAST(max(size) AS BIGINT) AS tokens FROM r GROUP BY id, chunk""")
def chunk_pack(spark, d):
    t = proxy.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return search.pack_chunks(t, 200)


@query("""WITH f AS (SELECT conv_id, turn, lower(regexp_extract(text, '^\\s*([^\\s]+)', 1)) AS verb FROM conversations) SELECT verb, count(*) AS n FROM f GROUP BY verb ORDER BY n DESC, verb LIMIT 25""")
def hints_verbs(spark, d):
    c = proxy.table(spark, d, "conversations")
    verb = F.lower(F.regexp_extract(first_sentence(F.col("text"), 100000), r"^\s*([^\s]+)", 1))
    return c.groupBy(verb.alias("verb")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "verb").limit(25)


def _prints(spark, d):
    return specs.fingerprints(proxy.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")))


@query("""WITH t AS (SELECT doc_id AS id, list_transform(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\\sA-Za-z0-9_])', 1), lambda x: CASE WHEN x IN (%s) THEN x WHEN regexp_matches(x, '^[A-Za-z_]') THEN 'ID' WHEN regexp_matches(x, '^[0-9]+$') THEN 'NUM' ELSE x END) AS t FROM documents),
h AS (SELECT id, substr(sha256(array_to_string(t, ' ')), 1, 32) AS structural_hash, CAST(len(t) AS INTEGER) AS n_tokens FROM t), g AS (SELECT *, count(*) OVER (PARTITION BY structural_hash) AS n FROM h)
SELECT id, structural_hash, n_tokens, n FROM g WHERE n > 1""" % ", ".join(repr(w) for w in __import__("codeloom.functions.text", fromlist=["KEYWORDS"]).KEYWORDS))
def dup_structural(spark, d):
    return specs.same_structure(_prints(spark, d).drop("marks")).select("id", "structural_hash", "n_tokens", "n")


_MARKS = """t AS (SELECT doc_id AS id, list_transform(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\\sA-Za-z0-9_])', 1), lambda x: CASE WHEN x IN (%s) THEN x WHEN regexp_matches(x, '^[A-Za-z_]') THEN 'ID' WHEN regexp_matches(x, '^[0-9]+$') THEN 'NUM' ELSE x END) AS t FROM documents),
h AS (SELECT id, len(t) AS n, list_transform(range(1, len(t) - 3), lambda i: substr(md5(array_to_string(t[i:i + 4], ' ')), 1, 15)) AS h FROM t),
marks AS (SELECT id, list_distinct(list_transform(range(1, greatest(len(h) - 2, 2)), lambda i: list_min(h[i:i + 3]))) AS m FROM h)""" % ", ".join(repr(w) for w in KEYWORDS)


@query(f"""WITH {_MARKS}, one AS (SELECT id, len(m) AS k, unnest(m) AS x FROM marks), met AS (SELECT a.id AS candidate, b.id AS id, count(*) AS c, a.k + b.k - count(*) AS u FROM one a JOIN one b USING (x) WHERE a.id <> b.id GROUP BY a.id, b.id, a.k, b.k)
SELECT candidate, id, c / u AS similarity FROM met WHERE c / u >= 0.8""")
def dup_near(spark, d):
    p = specs.stage(_prints(spark, d), "prints")
    return specs.near_structure(p, p, least_tokens=0).where("candidate <> id")


@query("""WITH t AS (SELECT doc_id AS id, list_transform(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\\sA-Za-z0-9_])', 1), lambda x: CASE WHEN x IN (%s) THEN x WHEN regexp_matches(x, '^[A-Za-z_]') THEN 'ID' WHEN regexp_matches(x, '^[0-9]+$') THEN 'NUM' ELSE x END) AS t FROM documents),
h AS (SELECT id, substr(sha256(array_to_string(t, ' ')), 1, 32) AS structural_hash FROM t), g AS (SELECT *, count(*) OVER (PARTITION BY structural_hash) AS n FROM h) SELECT id, structural_hash FROM g WHERE n > 1 AND id %% 2 <> 0""" % ", ".join(repr(w) for w in KEYWORDS))
def debt_frozen(spark, d):
    p = _prints(spark, d)
    return specs.freeze_debt(p, p.where("id % 2 = 0").select("structural_hash", "id")).select("id", "structural_hash")


@query(f"""WITH {SYM}, {EDGE}, c AS (SELECT sym.*, CASE WHEN file_path = (SELECT file_path FROM sym WHERE symbol_id = {ROOT}) THEN 0 WHEN split_part(file_path, '/', 1) = split_part((SELECT file_path FROM sym WHERE symbol_id = {ROOT}), '/', 1) THEN 1 ELSE 2 END AS distance, (end_line - start_line + 1) * 10 AS tokens
FROM sym JOIN edge ON edge.dst = symbol_id WHERE edge.src = {ROOT}), r AS (SELECT *, sum(tokens) OVER (ORDER BY distance, qualified_name ROWS UNBOUNDED PRECEDING) AS running FROM c)
SELECT symbol_id, qualified_name, CAST(distance AS INTEGER) AS distance, tokens, CAST(running AS BIGINT) AS running FROM r WHERE running <= 2000""")
def closure_callees(spark, d):
    return analysis.closure_callees(proxy.symbols(spark, d), proxy.edges(spark, d), ROOT, 2000).select("symbol_id", "qualified_name", "distance", "tokens", "running")


@query(f"""WITH {LOG}, s AS (SELECT tool_name, list_sort(list(latency_ms)) AS l, list_sort(list(result_chars)) AS c, count(*) AS n, sum(error::INT)::BIGINT AS errors FROM log GROUP BY tool_name)
SELECT tool_name, n AS calls, errors, l[least(floor(n * 0.5), n - 1)::INT + 1] AS latency_ms_p50, l[least(floor(n * 0.95), n - 1)::INT + 1] AS latency_ms_p95, c[least(floor(n * 0.5), n - 1)::INT + 1] AS result_chars_p50, c[-1] AS result_chars_max FROM s""")
def tool_stats(spark, d):
    return logs.tool_stats(proxy.log(spark, d))


@query(f"WITH {LOG}, p AS (SELECT tool_name AS a, lead(tool_name) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS b FROM log) SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b ORDER BY n DESC, a, b LIMIT 20")
def followup_pairs(spark, d):
    return logs.followups(proxy.log(spark, d))


_KNOWN = ("click", "view", "signup", "refund", "export", "audit")


@query("SELECT t AS tool_name FROM (VALUES " + ", ".join(f"('{t}')" for t in _KNOWN) + ") v(t) WHERE t NOT IN (SELECT event_type FROM events)")
def silent_tools(spark, d):
    return logs.silent_tools(proxy.log(spark, d), spark.createDataFrame([(t,) for t in _KNOWN], "tool_name string"))


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS pos, CAST(length(o_orderpriority) AS DOUBLE) AS v FROM orders), w AS (SELECT *, lag(1) OVER (PARTITION BY k ORDER BY pos) AS seen, lag(v) OVER (PARTITION BY k ORDER BY pos) AS old FROM s)
SELECT k, pos, v FROM w WHERE seen IS NULL OR abs(v - old) > 1e-9""")
def record_on_change(spark, d):
    o = proxy.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"), F.length("o_orderpriority").cast("double").alias("v"))
    return logs.on_change(o, "k", "pos", ("v",))


def _dependencies(spark, d):
    n = proxy.table(spark, d, "nation").select((F.col("n_regionkey") + 1000000).cast("long").alias("src"), (F.col("n_nationkey") + 2000000).cast("long").alias("dst"))
    s = proxy.table(spark, d, "supplier").select((F.col("s_nationkey") + 2000000).cast("long").alias("src"), F.col("s_suppkey").alias("dst"))
    return n.union(s).withColumn("weight", F.lit(1.0))


@query("""WITH RECURSIVE dep AS (SELECT n_regionkey + 1000000 AS src, n_nationkey + 2000000 AS dst FROM nation UNION ALL SELECT s_nationkey + 2000000, s_suppkey FROM supplier),
r(node, depth) AS (SELECT 1000001, 0 UNION SELECT dst, depth + 1 FROM r JOIN dep ON src = node) SELECT CAST(node AS BIGINT) AS node, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE depth > 0 GROUP BY node""")
def spec_dependency_closure(spark, d):
    return graph.closure(_dependencies(spark, d), _seed(spark, 1000001))


@query("""WITH i AS (SELECT 'negative_balance' AS issue, 'error' AS severity, c_name AS spec_id FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'no_orders', 'warning', c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)),
s AS (SELECT *, row_number() OVER (PARTITION BY issue, severity ORDER BY spec_id) AS nth FROM i) SELECT issue, severity, count(*) AS n, string_agg(CASE WHEN nth <= 5 THEN spec_id END, ',' ORDER BY spec_id) AS examples FROM s GROUP BY issue, severity""")
def validate_findings(spark, d):
    c = proxy.table(spark, d, "customer")
    bad = c.where("c_acctbal < 0").select(F.lit("negative_balance").alias("issue"), F.lit("error").alias("severity"), F.col("c_name").alias("spec_id"))
    idle = c.join(proxy.table(spark, d, "orders"), c.c_custkey == F.col("o_custkey"), "left_anti").select(F.lit("no_orders").alias("issue"), F.lit("warning").alias("severity"), F.col("c_name").alias("spec_id"))
    return specs.findings(bad.union(idle))


@query("SELECT regexp_extract(id, '^(.+)-[0-9]+$', 1) AS prefix, count(*) AS n FROM (SELECT concat(upper(replace(p_name, ' ', '-')), '-', p_size) AS id FROM part) GROUP BY 1")
def prefix_histogram(spark, d):
    ids = proxy.table(spark, d, "part").select(F.concat(F.upper(F.translate("p_name", " ", "-")), F.lit("-"), "p_size").alias("spec_id"))
    return specs.prefix_histogram(ids)


@query(f"WITH {LINK}, n AS (SELECT spec, count(*) AS n_links FROM link GROUP BY spec) SELECT s_suppkey AS spec, s_name AS title, coalesce(n_links, 0) AS n_links FROM supplier LEFT JOIN n ON spec = s_suppkey ORDER BY title, spec LIMIT 25 OFFSET 10")
def list_specs_page(spark, d):
    s = proxy.table(spark, d, "supplier").select(F.col("s_suppkey").alias("spec"), F.col("s_name").alias("title"))
    return specs.page(specs.list_specs(s, proxy.links(spark, d)), ["title", "spec"], 10, 25)


@query("""WITH a AS (SELECT o_orderkey AS k, md5(concat(o_orderstatus, o_orderpriority)) AS h FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, md5(concat(CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END, o_orderpriority)) AS h FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.h IS DISTINCT FROM b.h""")
def changed_files(spark, d):
    o = proxy.table(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    before = o.where("k % 5 <> 0").select("k", F.md5(F.concat("o_orderstatus", "o_orderpriority")).alias("h"))
    now = o.where("k % 7 <> 0").select("k", F.md5(F.concat(F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority")).alias("h"))
    return specs.changed(before, now, "k", "h")


@query("SELECT source, lang, count(*) AS n_docs, sum(CAST(greatest(1, floor(length(text) / 4)) AS BIGINT))::BIGINT AS tokens FROM documents GROUP BY ALL")
def language_counts(spark, d):
    docs = proxy.table(spark, d, "documents")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum(approx_tokens(F.col("text"))).alias("tokens"))


@query(f"WITH {SYM} SELECT symbol_id, qualified_name FROM sym WHERE contains(lower(qualified_name), 'red_w') ORDER BY length(qualified_name), symbol_id LIMIT 50")
def find_symbol(spark, d):
    s = proxy.symbols(spark, d).where(F.lower("qualified_name").contains("red_w"))
    return s.select("symbol_id", "qualified_name").orderBy(F.length("qualified_name"), "symbol_id").limit(50)


@query(f"WITH {SYM} SELECT file_path, kind, count(*) AS n, max(end_line) AS last_line FROM sym GROUP BY ALL")
def project_overview(spark, d):
    return proxy.symbols(spark, d).groupBy("file_path", "kind").agg(F.count("*").alias("n"), F.max("end_line").alias("last_line"))


@query(f"WITH {SYM}, {LINK} SELECT spec, relation, count(*) AS n, count(DISTINCT symbol_id) AS n_symbols, count(DISTINCT file_path) AS n_files FROM link JOIN sym USING (symbol_id) GROUP BY ALL")
def spec_implementation(spark, d):
    j = proxy.links(spark, d).join(proxy.symbols(spark, d), "symbol_id")
    return j.groupBy("spec", "relation").agg(F.count("*").alias("n"), F.countDistinct("symbol_id").alias("n_symbols"), F.countDistinct("file_path").alias("n_files"))


@query(f"WITH {SYM}, {LINK} SELECT file_path, count(*) AS n_symbols FROM sym WHERE file_path NOT LIKE 'tests/%' AND file_path NOT IN (SELECT file_path FROM sym WHERE symbol_id IN (SELECT symbol_id FROM link WHERE spec = 0 AND relation = 'tests')) GROUP BY file_path")
def orphan_files(spark, d):
    return analysis.orphan_files(proxy.symbols(spark, d), proxy.links(spark, d).where("spec = 0 and relation = 'tests'"))


@query(f"WITH {SYM}, {EDGE} SELECT a.file_path AS from_file, b.file_path AS to_file, count(*) AS n_calls, round(sum(weight), 6) AS mass FROM edge JOIN sym a ON a.symbol_id = src JOIN sym b ON b.symbol_id = dst WHERE a.file_path <> b.file_path GROUP BY ALL")
def flow_topology(spark, d):
    return views.topology(proxy.edges(spark, d), proxy.symbols(spark, d))


@query("""WITH d AS (SELECT o_custkey AS k, max(o_orderdate) AS written FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), s AS (SELECT o_custkey AS k, max(o_orderdate) AS touched FROM orders GROUP BY 1) SELECT k, written, touched FROM d JOIN s USING (k) WHERE touched > written""")
def stale_docs(spark, d):
    o = proxy.table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    docs = o.where("o_orderstatus = 'F'").groupBy("k").agg(F.max("o_orderdate").alias("written"))
    return docs.join(o.groupBy("k").agg(F.max("o_orderdate").alias("touched")), "k").where("touched > written")


# ---- predicates, spec store and incremental maintenance over the stand-ins
_PATHS = ("tests/a_{}.py", "src/test_{}.py", "contest/{}.ts", "web/{}.test.tsx", "scripts/{}.py", "dist/{}.js", "pages/{}.tsx", "app/{}/page.tsx", "lib/{}_spec.rb", "bin/{}", "src/{}.min.js", "spec/{}.rb", "src/{}/manage.py", "fixtures/{}.json")


def _paths(spark, d):
    p = proxy.table(spark, d, "part")
    shape = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("p_partkey") % len(_PATHS) + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), F.replace(shape, F.lit("{}"), F.translate("p_name", " ", "_")).alias("path"))


_PATH_SQL = "p AS (SELECT p_partkey AS id, replace([" + ", ".join(f"'{x}'" for x in _PATHS) + f"][p_partkey % {len(_PATHS)} + 1], '{{}}', replace(p_name, ' ', '_')) AS path FROM part), q AS (SELECT *, string_split(path, '/') AS s, string_split(path, '/')[-1] AS b FROM p), f AS (SELECT *, s[1:len(s) - 1] AS dirs FROM q)"
_IS_TEST = "(list_has_any(dirs, ['tests', 'test', '__tests__', 'spec']) OR starts_with(b, 'test_') OR contains(b, '_test.') OR regexp_matches(b, '(\\.test|\\.spec|_spec)\\.(ts|tsx|js|jsx|mjs|cjs)$') OR ends_with(b, '_spec.rb'))"


@query(f"""WITH {_PATH_SQL} SELECT id, path, {_IS_TEST} AS is_test, {_IS_TEST} OR dirs[1] IN ('scripts', 'bench', 'fixtures') AS non_product,
list_has_any(dirs, ['_fresh', 'dist', 'build', '.next', 'out', 'node_modules', '.svelte-kit', 'target', '__pycache__', '.turbo', '.vite', '.cache', '.parcel-cache']) OR regexp_matches(b, '\\.min\\.(js|mjs|css)$|\\.bundle\\.js$') AS build_output,
CASE WHEN NOT regexp_matches(lower(b), '\\.(ts|tsx|js|jsx|svelte)$') THEN NULL WHEN contains('/' || path, '/pages/') THEN 'nextjs_pages' WHEN contains('/' || path, '/app/') AND b = 'page.tsx' THEN 'nextjs_app' END AS routed FROM f""")
def path_rules(spark, d):
    from ..functions.frameworks import is_build_output, routed_file
    from ..functions.paths import is_non_product, is_test_file

    p = F.col("path")
    return _paths(spark, d).select("id", "path", is_test_file(p).alias("is_test"), is_non_product(p).alias("non_product"), is_build_output(p).alias("build_output"), routed_file(p).alias("routed"))


@query(f"""WITH {_PATH_SQL}, e AS (SELECT id, lower(regexp_extract(b, '\\.([^.]+)$', 1)) AS x FROM f)
SELECT CASE x WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'rb' THEN 'ruby' END AS language, count(*) AS n FROM e GROUP BY 1""")
def files_by_language(spark, d):
    from ..functions.paths import language_of

    return _paths(spark, d).groupBy(language_of(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


def _specs(spark, d):
    s = proxy.table(spark, d, "supplier")
    return s.select(F.concat(F.lit("spec-"), "s_suppkey").alias("spec_id"), F.col("s_name").alias("title"), F.when(F.col("s_acctbal") > 5000, "It SHALL pay.").when(F.col("s_acctbal") > 2000, "It pays.").otherwise("").alias("description"), F.lit("functional_requirement").alias("kind"), F.concat(F.lit("n"), "s_nationkey").alias("module"), F.when(F.col("s_suppkey") % 9 == 0, "deprecated").otherwise("active").alias("status"), F.lit("medium").alias("priority"), F.lit("markdown").alias("source"))


_SPECS = "spec AS (SELECT concat('spec-', s_suppkey) AS spec_id, s_name AS title, CASE WHEN s_acctbal > 5000 THEN 'It SHALL pay.' WHEN s_acctbal > 2000 THEN 'It pays.' ELSE '' END AS description, concat('n', s_nationkey) AS module, CASE WHEN s_suppkey % 9 = 0 THEN 'deprecated' ELSE 'active' END AS status FROM supplier)"


@query(f"""WITH {_SPECS}, live AS (SELECT * FROM spec WHERE status <> 'deprecated'), i AS (SELECT 'no scenario' AS issue, spec_id FROM live WHERE spec_id NOT IN (SELECT concat('spec-', c_custkey) FROM customer WHERE c_custkey % 2 = 0)
UNION ALL SELECT 'empty body', spec_id FROM live WHERE description = '' UNION ALL SELECT 'no normative word', spec_id FROM live WHERE description = 'It pays.'),
n AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY spec_id) AS nth FROM i)
SELECT issue, 'warning' AS severity, count(*) AS n, string_agg(CASE WHEN nth <= 10 THEN spec_id END, ',' ORDER BY spec_id) AS examples, (SELECT count(*) FROM live) >= 20 AND count(*) >= 0.95 * (SELECT count(*) FROM live) AS project_level FROM n GROUP BY issue""")
def validate_specs(spark, d):
    from ..operators.spec_store import validate

    scenarios = proxy.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("spec-"), "c_custkey").alias("spec_id"), F.lit("s").alias("name"), F.lit("").alias("body"))
    return validate(_specs(spark, d), scenarios)


@query(f"""WITH {_SPECS} SELECT module, concat('## Requirements', chr(10), chr(10), string_agg(concat('### Requirement: ', title, chr(10), description), concat(chr(10), chr(10)) ORDER BY spec_id), chr(10)) AS text FROM spec WHERE status <> 'deprecated' GROUP BY module""")
def export_specs(spark, d):
    from ..operators.spec_store import to_markdown

    return to_markdown(_specs(spark, d))


def _deltas(spark, d):
    s = proxy.table(spark, d, "supplier").where("s_suppkey % 4 = 0")
    op = F.element_at(F.array(*map(F.lit, ("modified", "removed", "renamed", "added"))), ((F.col("s_suppkey") / 4) % 4 + 1).cast("int"))
    sid = F.when(op.isin("renamed", "added"), F.concat(F.lit("new-"), "s_suppkey")).otherwise(F.concat(F.lit("spec-"), "s_suppkey"))
    return s.select(F.col("s_suppkey").cast("int").alias("ordinal"), op.alias("operation"), sid.alias("spec_id"), F.concat(F.lit("T"), "s_suppkey").alias("title"), F.lit("It MUST.").alias("description"), F.lit("cap").alias("capability"), F.when(op == "renamed", F.concat(F.lit("spec-"), "s_suppkey")).alias("rename_from"))


@query(f"""WITH {_SPECS}, delta AS (SELECT s_suppkey AS k, ['modified', 'removed', 'renamed', 'added'][(s_suppkey // 4) % 4 + 1] AS op FROM supplier WHERE s_suppkey % 4 = 0)
SELECT spec_id, CASE WHEN op = 'modified' THEN concat('T', k) ELSE title END AS title, CASE op WHEN 'modified' THEN 'active' WHEN 'removed' THEN 'deprecated' ELSE status END AS status FROM spec LEFT JOIN delta ON spec_id = concat('spec-', k) WHERE coalesce(op, '') <> 'renamed'
UNION ALL SELECT concat('new-', k), concat('T', k), 'active' FROM delta WHERE op IN ('renamed', 'added')""")
def apply_change_specs(spark, d):
    from ..operators.spec_store import LINKS, apply_change

    return apply_change(_specs(spark, d), spark.createDataFrame([], LINKS), _deltas(spark, d))[0].select("spec_id", "title", "status")


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS symbol_id FROM lineitem), delta AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 4 = 0 AND (s_suppkey // 4) % 4 = 2)
SELECT CASE WHEN delta.k IS NULL THEN concat('spec-', l.k) ELSE concat('new-', l.k) END AS spec_id, symbol_id FROM l LEFT JOIN delta ON l.k = delta.k""")
def apply_change_links(spark, d):
    from ..operators.spec_store import apply_change

    links = proxy.table(spark, d, "lineitem").select(F.concat(F.lit("spec-"), "l_suppkey").alias("spec_id"), F.col("l_partkey").alias("symbol_id"), F.lit("implements").alias("relation"), F.lit(1.0).alias("confidence"), F.lit("manual").alias("source")).distinct()
    return apply_change(_specs(spark, d), links, _deltas(spark, d))[1].select("spec_id", "symbol_id")


@query(f"""WITH {SYM}, moved AS (SELECT DISTINCT file_path FROM sym WHERE symbol_id % 400 = 1), names AS (SELECT DISTINCT name FROM sym WHERE file_path IN (SELECT file_path FROM moved)),
ref AS (SELECT symbol_id AS ref_id, file_path, ['small_ring', 'red_widget', 'blue_bolt', 'nowhere'][symbol_id % 4 + 1] AS target_name FROM sym)
SELECT ref_id, target_name FROM ref WHERE file_path IN (SELECT file_path FROM moved) OR target_name IN (SELECT name FROM names)""")
def affected_refs(spark, d):
    from ..operators.indexing import affected_refs as affected

    s = proxy.symbols(spark, d)
    refs = _refs(spark, d).join(s.select(F.col("symbol_id").alias("src"), "file_path"), "src").select("ref_id", "file_path", "target_name")
    return affected(refs, s, s, s.where("symbol_id % 400 = 1").select(F.col("file_path").alias("path")).distinct()).select("ref_id", "target_name")


@query("""WITH d AS (SELECT doc_id, count(*) OVER (PARTITION BY l_hash) AS n FROM (SELECT doc_id, md5(text) AS l_hash FROM documents)) SELECT doc_id, n FROM d WHERE n > 1""")
def duplicate_bodies(spark, d):
    docs = proxy.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("structural_hash"))
    return specs.same_structure(docs).select(F.col("id").alias("doc_id"), "n")


@query(f"""WITH {LINK}, n AS (SELECT spec, count(DISTINCT symbol_id) AS n, round(avg(confidence), 4) AS c FROM link GROUP BY spec), t AS (SELECT DISTINCT spec FROM link WHERE relation = 'tests' AND confidence >= 1.0),
s AS (SELECT coalesce(n, 0) AS n, c, CASE WHEN t.spec IS NULL THEN 0.0 ELSE 1.0 END AS tested, CASE WHEN coalesce(n, 0) = 0 THEN 'not_started' WHEN t.spec IS NOT NULL THEN 'verified' WHEN c IS NULL OR c < 0.7 THEN 'in_progress' ELSE 'implemented' END AS state, s_nationkey FROM supplier LEFT JOIN n ON n.spec = s_suppkey LEFT JOIN t ON t.spec = s_suppkey)
SELECT count(*) AS specs, count(*) FILTER (state = 'not_started') AS not_started, count(*) FILTER (state = 'in_progress') AS in_progress, count(*) FILTER (state = 'implemented') AS implemented, count(*) FILTER (state = 'verified') AS verified,
count(*) FILTER (s_nationkey < 5) AS with_endpoints, count(*) FILTER (s_nationkey >= 20) AS with_dependencies, CAST(round(100.0 * count(*) FILTER (n > 0) / count(*), 1) AS DOUBLE) AS implemented_pct, round(avg(c), 4) AS avg_coverage, CAST(round(avg(tested), 4) AS DOUBLE) AS avg_test_coverage FROM s""")
def explorer_dashboard(spark, d):
    from ..operators import spec_store

    s = proxy.table(spark, d, "supplier").select(F.col("s_suppkey").alias("spec_id"), "s_nationkey")
    links = proxy.links(spark, d).withColumnRenamed("spec", "spec_id")
    tested = links.where("relation = 'tests' and confidence >= 1.0").select("spec_id", F.lit(1.0).alias("ratio")).distinct()
    return spec_store.dashboard(spec_store.spec_states(s, links, tested), s.where("s_nationkey < 5"), s.where("s_nationkey >= 20"))


from . import health, more  # noqa: E402, F401  their queries join these
