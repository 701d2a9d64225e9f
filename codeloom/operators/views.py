"""Answers in the shape a caller asks for: pages, summaries, orientation, peers, status, upkeep of docs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frameworks import is_build_output
from ..functions.paths import is_infrastructure, is_test_file, names_a_test, path_distance
from ..functions.text import raised_names, slug, type_names
from .analysis import expand_types, structural_names
from .graph import simple
from .specs import page


@dataclass
class Page:
    """A page's rows (none if only the summary was asked for), the exact count, and where the next page begins."""

    rows: DataFrame | None
    count: int
    next_cursor: int | None
    summary: DataFrame | None = None


def paged(df: DataFrame, order: list, cursor: int = 0, limit: int = 200, summary_by: str | None = None, summary_only: bool = False) -> Page:
    n = df.count()
    following = cursor + limit if cursor + limit < n else None
    summary = df.groupBy(summary_by).agg(F.count("*").alias("n")) if summary_by else None
    return Page(None if summary_only else page(df, order, cursor, limit), n, None if summary_only else following, summary)


def top_neighbours(edges: DataFrame, ranks: DataFrame, symbols: DataFrame, root: int, n: int = 5, min_weight: float = 0.6) -> DataFrame:
    """(side, nth, symbol_id, qualified_name, rank): the n callers and the n callees of highest rank."""
    e = simple(edges, min_weight)
    sides = e.where(F.col("dst") == root).select(F.lit("caller").alias("side"), F.col("src").alias("symbol_id"))
    sides = sides.union(e.where(F.col("src") == root).select(F.lit("callee"), F.col("dst")))
    met = sides.join(ranks.withColumnRenamed("node", "symbol_id"), "symbol_id").join(symbols.select("symbol_id", "qualified_name"), "symbol_id")
    nth = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("rank"), "symbol_id"))
    return met.withColumn("nth", nth).where(F.col("nth") <= n).select("side", "nth", "symbol_id", "qualified_name", "rank")


def peers(route_edges: DataFrame, symbols: DataFrame, node: int, incoming: bool) -> DataFrame:
    """(qualified_name, file_path, confidence): who reaches ``node`` over a route, or what it reaches."""
    mine, other = ("dst", "src") if incoming else ("src", "dst")
    met = route_edges.where(F.col(mine) == node).select(F.col(other).alias("symbol_id"), F.round("weight", 3).alias("confidence"))
    return met.join(symbols.select("symbol_id", "qualified_name", "file_path"), "symbol_id").select("qualified_name", "file_path", "confidence")


def ranked_symbols(ranks: DataFrame, symbols: DataFrame, include_infrastructure: bool = False, include_structural: bool = False) -> DataFrame:
    """Ranks of the symbols an overview may show, with is_test: product symbols are its top, tests may outrank them."""
    s = ranks.withColumnRenamed("node", "symbol_id").join(symbols, "symbol_id").where(~is_build_output(F.col("file_path")))
    if not include_infrastructure:
        s = s.where(~is_infrastructure(F.col("qualified_name"), F.col("name"), F.col("start_line"), F.col("end_line")))
    if not include_structural:
        s = s.join(structural_names(symbols).select("name"), "name", "left_anti")
    return s.withColumn("is_test", is_test_file(F.col("file_path")))


def overview(ranks: DataFrame, symbols: DataFrame, n: int = 20, **include: bool) -> tuple[DataFrame, DataFrame]:
    """(the n product symbols of highest rank, the tests that outrank the last of them, at most n)."""
    s = ranked_symbols(ranks, symbols, **include)
    top = s.where(~F.col("is_test")).orderBy(F.desc("rank"), "symbol_id").limit(n)
    cut = top.agg(F.min("rank"), F.count("*")).first()
    least = cut[0] if cut[1] == n else 0.0
    above = s.where(F.col("is_test") & (F.col("rank") >= F.lit(least))).orderBy(F.desc("rank"), "symbol_id").limit(n)
    return top.drop("is_test"), above.drop("is_test")


def first_labels(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, kind) with the label that comes first. edges: src, dst, kind, at, label."""
    return edges.groupBy("src", "dst", "kind").agg(F.min(F.struct("at", "label")).alias("f")).select("src", "dst", "kind", F.col("f.label").alias("label"))


def route_hops(route_edges: DataFrame, symbols: DataFrame, routes: DataFrame) -> DataFrame:
    """(from_file, to_file, src, dst, label, weight): route edges with both symbols and the path and method they meet at."""
    a, b = (symbols.select(F.col("symbol_id").alias(k), F.col("file_path").alias(p)) for k, p in (("src", "from_file"), ("dst", "to_file")))
    side = lambda role, k, m: routes.where(F.col("role") == role).select(F.col("symbol_id").alias(k), "norm_path", F.col("method").alias(m)).distinct()
    met = route_edges.join(a, "src").join(b, "dst").join(side("client", "src", "cm"), "src").join(side("server", "dst", "sm"), ["dst", "norm_path"])
    label = F.concat_ws(" ", F.coalesce("cm", "sm"), "norm_path")
    return met.groupBy("from_file", "to_file", "src", "dst").agg(F.min(label).alias("label"), F.max("weight").alias("weight"))


def topology(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_file, to_file, n_calls, mass): calls between files."""
    a, b = (symbols.select(F.col("symbol_id").alias(k), F.col("file_path").alias(p)) for k, p in (("src", "from_file"), ("dst", "to_file")))
    e = simple(edges).join(a, "src").join(b, "dst").where("from_file <> to_file")
    return e.groupBy("from_file", "to_file").agg(F.count("*").alias("n_calls"), F.round(F.sum("weight"), 6).alias("mass"))


def index_status(**tables: DataFrame) -> DataFrame:
    """(what, n): rows of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def baseline_status(baseline: DataFrame) -> DataFrame:
    """(captured, frozen, first_captured_at, last_captured_at) of a debt baseline with captured_at."""
    return baseline.agg((F.count("*") > 0).alias("captured"), F.count("*").alias("frozen"), F.min("captured_at").alias("first_captured_at"), F.max("captured_at").alias("last_captured_at"))


def dominant_prefix(histogram: DataFrame) -> DataFrame:
    """(prefix, n, share): the commonest prefix, alphabetical among equals."""
    h = histogram.where("prefix <> ''")
    return h.agg(F.min(F.struct((-F.col("n")).alias("m"), "prefix")).alias("b"), F.sum("n").alias("all")).where("b is not null").select("b.prefix", (-F.col("b.m")).alias("n"), F.round(-F.col("b.m") / F.col("all"), 6).alias("share"))


def unique_slugs(titles: DataFrame, default: str = "spec") -> DataFrame:
    """(id, slug): slugs of titles; from the second of equals on with -2, -3 ... in order of id."""
    s = titles.select("id", F.when(slug(F.col("title")) == "", default).otherwise(slug(F.col("title"))).alias("slug"))
    nth = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
    return s.withColumn("nth", nth).select("id", F.when(F.col("nth") > 1, F.concat_ws("-", "slug", F.col("nth").cast("string"))).otherwise(F.col("slug")).alias("slug"))


def upsert_docs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Docs after an update: of one (target_type, target_key) the new row counts."""
    keys = ["target_type", "target_key"]
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def doc_drift(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_key, drift): docs whose target is gone, or has another body or signature now. targets: target_key,
    body_hash, signature_hash."""
    now = targets.select("target_key", F.col("body_hash").alias("b"), F.col("signature_hash").alias("s"), F.lit(True).alias("there"))
    drift = F.when(F.col("there").isNull(), "gone").when(~F.col("signature_hash").eqNullSafe(F.col("s")), "signature").when(~F.col("body_hash").eqNullSafe(F.col("b")), "body")
    return docs.join(now, "target_key", "left").withColumn("drift", drift).where("drift is not null").select("target_key", "drift")


def export_docs(docs: DataFrame) -> DataFrame:
    """(path, text): one markdown file a doc, by type and key."""
    name = F.concat(F.lit("docs/"), "target_type", F.lit("/"), F.regexp_replace("target_key", "[^A-Za-z0-9._-]+", "_"), F.lit(".md"))
    return docs.select(name.alias("path"), F.concat(F.lit("# "), "target_key", F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("text"))


def external_reach(nodes: DataFrame, edges: DataFrame, targets: DataFrame, relations: list[str]) -> DataFrame:
    """(node, relation, target): one hop of an external graph that lands on a target. edges: source, target, relation."""
    e = edges.where(F.col("relation").isin(*relations)).select(F.col("source").alias("node"), "relation", "target")
    return e.join(nodes.select("node").distinct(), "node", "left_semi").join(targets.select(F.col("node").alias("target")).distinct(), "target", "left_semi").select("node", "relation", "target").distinct()


def imported_names(files: DataFrame, most: int = 8_000) -> DataFrame:
    """(path, name): capitalised names on import lines at the head of a file. files: path, content."""
    lines = F.filter(F.split(F.substring("content", 1, most), "\n"), lambda x: x.rlike(r"^\s*(from\s+\S+\s+import\s|import\s|use\s)"))
    clause = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*from\s+\S+\s+import\s", ""), r"['\"].*$", ""))
    return files.select("path", F.explode(F.flatten(F.transform(clause, lambda x: F.regexp_extract_all(x, F.lit(r"\b([A-Z][A-Za-z0-9_]*)\b"), F.lit(1))))).alias("name")).distinct()


def coverage_lists(symbols: DataFrame, edges: DataFrame, specs: DataFrame, links: DataFrame, max_depth: int = 10) -> dict[str, DataFrame]:
    """The audit's lists. implicit: unlinked product symbols that an implementing symbol calls, at whatever remove up to
    ``max_depth``; uncovered: those that none does. specs and links share spec_id."""
    product = symbols.where(~is_test_file(F.col("file_path")))
    own = links.where("relation = 'implements'").select("symbol_id").distinct()
    linked = links.select("symbol_id").distinct()
    reached = reach_ids(edges, own, max_depth)
    loose = product.join(linked, "symbol_id", "left_anti")
    tests = links.where("relation = 'tests'").groupBy("spec_id").agg(F.count("*").alias("n_tests"))
    return {
        "implicit": loose.join(reached, "symbol_id", "left_semi"),
        "uncovered": loose.join(reached, "symbol_id", "left_anti"),
        "files_without_link": product.select("file_path").distinct().join(product.join(linked, "symbol_id", "left_semi").select("file_path").distinct(), "file_path", "left_anti"),
        "specs_without_implementation": specs.join(links.where("relation = 'implements'").select("spec_id"), "spec_id", "left_anti"),
        "specs_without_test": specs.join(tests, "spec_id", "left_anti"),
        "tests_per_spec": specs.select("spec_id").join(tests, "spec_id", "left").select("spec_id", F.coalesce("n_tests", F.lit(0)).alias("n_tests")),
    }


def reach_ids(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    from .graph import reach

    return reach(edges, seeds.select(F.col("symbol_id").alias("node")), max_depth).select(F.col("node").alias("symbol_id"))


def read_unit(symbols: DataFrame, edges: DataFrame, files: DataFrame, root: int, depth: int = 1, budget: int = 2_000) -> DataFrame:
    """(part, nth, name, file_path, text, tokens, running): a symbol with what one needs to read it.

    In order: its body, its callees' signatures by path distance, the types they name (to ``depth``), what it raises,
    the tests that call it, and names it imports. The body always stays; the rest while the running sum of tokens fits.
    """
    own = symbols.where(F.col("symbol_id") == root)
    home = own.select("file_path").first()
    home = home[0] if home else ""
    e = simple(edges)
    called = symbols.join(e.where(F.col("src") == root).select(F.col("dst").alias("symbol_id")), "symbol_id")
    by = symbols.join(e.where(F.col("dst") == root).select(F.col("src").alias("symbol_id")), "symbol_id").where(names_a_test(F.col("file_path"), F.col("name")))
    sign = F.coalesce("signature", "qualified_name")
    none = F.lit(None).cast("string")
    part = lambda n, key, df, name, path, text: df.select(F.lit(n).alias("part"), key.alias("key"), name.alias("name"), path.alias("file_path"), text.alias("text"))
    parts = [
        part("1 body", F.lit(""), own, F.col("qualified_name"), F.col("file_path"), F.col("body")),
        part("2 callee", F.concat(path_distance(F.col("file_path"), F.lit(home)).cast("string"), "qualified_name"), called, F.col("qualified_name"), F.col("file_path"), sign),
    ]
    if depth > 0:
        surface = own.select(F.lit(root).alias("root"), sign.alias("body")).union(called.select(F.lit(root), sign))
        types = expand_types(symbols, surface, depth).select("symbol_id").distinct()
        parts.append(part("3 type", F.col("qualified_name"), symbols.join(types, "symbol_id"), F.col("qualified_name"), F.col("file_path"), F.col("body")))
        named = surface.select(F.explode(type_names(F.col("body"))).alias("name")).distinct().join(symbols.select("name").distinct(), "name", "left_anti")
        known = imported_names(files.where(F.col("path") == home)).select("name")
        parts.append(part("6 external", F.col("name"), named.join(known, "name", "left_semi"), F.col("name"), none, none))
        parts.append(part("7 unresolved", F.col("name"), named.join(known, "name", "left_anti"), F.col("name"), none, none))
    parts.append(part("4 raises", F.col("name"), own.select(F.explode(raised_names(F.col("body"))).alias("name")), F.col("name"), none, none))
    parts.append(part("5 test", F.col("qualified_name"), by, F.col("qualified_name"), F.col("file_path"), none))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    order = Window.orderBy("part", "key", "name")  # one symbol's surroundings: few rows
    out = out.withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", "name")) / 4)).cast("long"))
    out = out.withColumn("running", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(order))
    return out.where((F.col("part") == "1 body") | (F.col("running") <= budget)).select(F.substring("part", 3, 20).alias("part"), "nth", "name", "file_path", "text", "tokens", "running")


def duplicate_ids(specs: DataFrame) -> DataFrame:
    """(key, n, spec_ids): spec ids that differ only in case and separators."""
    key = F.regexp_replace(F.lower("spec_id"), "[^a-z0-9]+", "")
    return specs.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("spec_id")), ",").alias("spec_ids")).where("n > 1")


def alike_names(names: DataFrame, wanted: str, least: float = 0.55) -> DataFrame:
    """(name, ratio) of distinct names (name) alike ``wanted``: twice the matching blocks by both lengths, ``least`` or more.

    A ratio of r needs lengths and common letters that allow it, so few names are compared in full: lengths are held
    against r in the scan, letters before blocks in one Arrow pass. No name is left out by a guess.
    """
    n = len(wanted)
    able = names.select("name").where(2.0 * F.least(F.length("name"), F.lit(n)) >= least * (F.length("name") + n)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        match = SequenceMatcher()
        match.set_seq2(wanted)
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                match.set_seq1(name)
                if match.quick_ratio() >= least and (r := match.ratio()) >= least:
                    rows.append((name, r))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["name", "ratio"])

    return able.mapInArrow(run, "name string, ratio double")


def did_you_mean(symbols: DataFrame, wanted: str, limit: int = 3) -> DataFrame:
    """(qualified_name, kind, file_path, nth): symbols that hold the last part of ``wanted`` in a name, shortest first; then
    those whose name is alike, the 2 * ``limit`` nearest names by ratio."""
    short = wanted.rsplit(".", 1)[-1]
    low = short.lower()
    s = symbols.groupBy("qualified_name").agg(F.min(F.struct("file_path", "start_line", "kind", "name")).alias("f")).select("qualified_name", "f.kind", "f.file_path", "f.name")
    holds = F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower("qualified_name"), F.lit(low))
    first = s.where(holds).select("qualified_name", "kind", "file_path", F.lit(0).alias("pass"), F.lit(0.0).alias("miss"), F.lit("").alias("name")).orderBy(F.length("qualified_name"), "qualified_name").limit(limit)
    near = alike_names(symbols, short).orderBy(F.desc("ratio"), F.desc("name")).limit(2 * limit)
    # a name that very many symbols share: the first few of them are all that can be shown
    nth = F.row_number().over(Window.partitionBy("name").orderBy("qualified_name"))
    alike = s.join(F.broadcast(near), "name").where(~holds).withColumn("n", nth).where(F.col("n") <= limit)
    every = first.union(alike.select("qualified_name", "kind", "file_path", F.lit(1), -F.col("ratio"), "name"))
    order = Window.orderBy("pass", "miss", F.desc("name"), F.length("qualified_name"), "qualified_name")  # at most limit + 2 * limit * limit rows
    return every.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).select("qualified_name", "kind", "file_path", "nth")
