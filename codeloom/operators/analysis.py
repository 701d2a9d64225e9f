"""Questions about symbols: dead code, orphan tests, coverage, names, locations, overview."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frameworks import ENTRY_DECORATORS, has_decorator, implicit_entry_point, is_build_output, last_segments, routed_file
from ..functions.paths import base_name, is_entry_point_file, is_fixture_only, is_non_product, is_test_file
from ..sources.protection import spare
from .graph import reach, simple
from .liveness import with_class_rule

#: Visibilities that callers beyond the index may use. Fixed values.
PUBLIC = ("pub", "public", "exported")


def unreached(symbols: DataFrame, edges: DataFrame, links: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """Symbols without inbound edge (of at least ``min_weight``) and without spec link."""
    called = edges.where(F.col("weight") >= min_weight) if min_weight > 0 else edges
    return symbols.join(called.select(F.col("dst").alias("symbol_id")), "symbol_id", "left_anti").join(links.select("symbol_id"), "symbol_id", "left_anti")


def dead_code(symbols: DataFrame, edges: DataFrame, links: DataFrame, min_weight: float = 0.0, *, include_tests: bool = False, include_framework_routes: bool = False, include_non_python: bool = False, include_infrastructure: bool = False, include_public: bool = False, protected: DataFrame | None = None, handlers: DataFrame | None = None) -> DataFrame:
    """Unreached symbols with the first filter that spares them; null reason: dead. Each flag takes one filter away.

    In order: tests, entry points, build output, files a framework routes, other languages than Python, infrastructure
    (called from outside by name or by a decorator, or part of such a decorator), public symbols, handlers (symbol_id)
    that a router is handed, then infrastructure by what the code's text keeps alive and by a method's class
    (``liveness``). A wrapper of a few lines is as dead as anything else. protected: of ``protection.scan``. symbols may
    have decorators and visibility. ``class_rule`` tells the class's rule where one holds.
    """
    p, q, name, kind = (F.col(c) for c in ("file_path", "qualified_name", "name", "kind"))
    found = unreached(symbols, edges, links, min_weight)
    never, none = F.lit(False), F.lit(None).cast("string")
    infra = implicit_entry_point(name, q, kind)
    if include_infrastructure:
        found = found.withColumn("protected", none).withColumn("class_rule", none)
    else:
        found = with_class_rule(found, symbols, edges)
        if protected is None:
            found = found.withColumn("protected", none)
        else:
            found = spare(found, protected)
            # a method lives as long as its class is named
            short = F.when((kind == "method") & (F.size(F.split(q, r"\.")) >= 2), F.element_at(F.split(q, r"\."), -2))
            named = protected.where("category not in ('nested', 'alias')").select(F.col("name").alias("short")).distinct().withColumn("owned", F.lit("class"))
            found = found.withColumn("short", short).join(named, "short", "left").withColumn("protected", F.coalesce("protected", "owned")).drop("short", "owned")
        if "decorators" in symbols.columns:
            infra = infra | has_decorator(F.col("decorators"), ENTRY_DECORATORS)
        if protected is not None:
            aliases = protected.where("category = 'alias'").select(F.lower("name").alias("alias")).distinct()
            found = found.join(aliases.withColumnRenamed("alias", "machine"), F.lower("name") == F.col("machine"), "left")
            infra = infra | F.col("machine").isNotNull()
            if "decorators" in symbols.columns:
                deco = found.select("symbol_id", F.explode(last_segments(F.col("decorators"))).alias("alias")).join(aliases, "alias").select("symbol_id", F.lit(True).alias("aliased")).distinct()
                found = found.join(deco, "symbol_id", "left")
                infra = infra | F.coalesce("aliased", never)
    if handlers is not None:
        found = found.join(handlers.select("symbol_id", F.lit(True).alias("handler")).distinct(), "symbol_id", "left")
    public = F.col("visibility").isin(*PUBLIC) if "visibility" in symbols.columns else never
    reason = F.when(never if include_tests else is_test_file(p), "tests").when(is_entry_point_file(p), "entry_point").when(is_build_output(p), "build_output")
    reason = reason.when(never if include_framework_routes else routed_file(p).isNotNull(), "fs_routing").when(never if include_non_python else ~p.endswith(".py"), "non_python")
    reason = reason.when(never if include_infrastructure else infra, "infrastructure").when(never if include_public else F.coalesce(public, never), "public")
    reason = reason.when(F.coalesce("handler", never) if handlers is not None else never, "handler").when(F.col("protected").isNotNull() | F.col("class_rule").isNotNull(), "infrastructure")
    return found.withColumn("reason", reason).select(*symbols.columns, "reason", "class_rule")


def filtered_out(found: DataFrame) -> DataFrame:
    """(reason, n) of ``dead_code``'s rows; ``dead`` are those that no filter spares."""
    return found.groupBy(F.coalesce("reason", F.lit("dead")).alias("reason")).agg(F.count("*").alias("n"))


def dead_summary(found: DataFrame) -> DataFrame:
    """(by, value, n) of the dead among ``dead_code``'s rows: by kind and by the first folder of the path."""
    dead = found.where("reason is null")
    parts = [dead.groupBy(v.alias("value")).agg(F.count("*").alias("n")).select(F.lit(by).alias("by"), "value", "n") for by, v in (("kind", F.col("kind")), ("dir", F.element_at(F.split("file_path", "/", 2), 1)))]
    return parts[0].union(parts[1])


def orphan_tests(symbols: DataFrame, edges: DataFrame, max_depth: int = 10, min_weight: float = 0.0, harness: DataFrame | None = None, include_harness: bool = False, include_fixtures: bool = False) -> DataFrame:
    """Test functions from which no product symbol can be reached, with reason, reasons and confidence.

    One walk backward from all product symbols. reasons: no_outgoing_calls, or cone_stays_in_tests if it calls anything;
    harness_indirection besides for files (``harness``: path) that drive the product through a client, which are left out
    unless asked for, as fixture files are. Confidence .85, .55, and .3 at most under a harness.
    """
    p = F.col("file_path")
    tests = symbols.where(is_test_file(p) & F.col("kind").isin("function", "method"))
    tests = tests if include_fixtures else tests.where(~is_fixture_only(p))
    if harness is None:
        tests = tests.withColumn("harness", F.lit(False))
    else:
        tests = tests.join(harness.select(F.col("path").alias("file_path"), F.lit(True).alias("harness")).distinct(), "file_path", "left").withColumn("harness", F.coalesce("harness", F.lit(False)))
        tests = tests if include_harness else tests.where(~F.col("harness"))
    product = symbols.where(~is_test_file(p)).select(F.col("symbol_id").alias("node"))
    live = reach(edges, product, max_depth, min_weight, backward=True).select(F.col("node").alias("symbol_id"))
    calls = edges.where((F.col("weight") >= min_weight) & (F.col("src") != F.col("dst"))).select(F.col("src").alias("symbol_id"), F.lit(True).alias("calls")).distinct()
    out = tests.join(live, "symbol_id", "left_anti").join(calls, "symbol_id", "left")
    reason = F.when(F.col("calls"), "cone_stays_in_tests").otherwise("no_outgoing_calls")
    reasons = F.when(F.col("harness"), F.array(reason, F.lit("harness_indirection"))).otherwise(F.array(reason))
    sure = F.when(F.col("harness"), 0.3).when(F.col("calls"), 0.55).otherwise(0.85)
    return out.select(*symbols.columns, reason.alias("reason"), reasons.alias("reasons"), sure.alias("confidence"))


def orphan_report(symbols: DataFrame, files: DataFrame, harness: DataFrame) -> DataFrame:
    """(what, n): how much of the tests ``orphan_tests`` looks at. files: path. harness: path.

    test_files_without_symbols: test files in which no function was seen, but for fixtures and package marks.
    """
    p, path = F.col("file_path"), F.col("path")
    tests = symbols.where(is_test_file(p) & F.col("kind").isin("function", "method"))
    test_files = files.where(is_test_file(path)).select("path").distinct()
    loud = tests.where(~is_fixture_only(p)).join(harness.select(path.alias("file_path")).distinct(), "file_path", "left_semi")
    blind = test_files.join(tests.select(p.alias("path")), "path", "left_anti").where(~is_fixture_only(path) & (base_name(path) != "__init__.py"))
    counts = {"fixture_skipped": tests.where(is_fixture_only(p)), "harness_skipped": loud, "test_files": test_files, "test_symbols": tests, "test_files_without_symbols": blind}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, df in counts.items()]
    return reduce(DataFrame.union, parts)


def structural_names(symbols: DataFrame, least: int = 3) -> DataFrame:
    """Names that at least ``least`` files define."""
    return symbols.groupBy("name").agg(F.countDistinct("file_path").alias("n_files")).where(F.col("n_files") >= least)


#: Levels of blocks: lines up to 2 ** 31.
LEVELS = 32


def _blocks(first, last):
    """(level, block): the fewest aligned blocks of 2 ** level lines that make up first to last."""
    parts = []
    for k in range(LEVELS):
        lo, hi = F.shiftright(first + (2**k - 1), k), F.shiftright(last + 1, k)
        odd = lo.bitwiseAND(F.lit(1).cast("long"))
        parts.append(F.when((lo < hi) & (odd == 1), F.struct(F.lit(k).alias("level"), lo.alias("block"))))
        parts.append(F.when((lo + odd < hi) & (hi.bitwiseAND(F.lit(1).cast("long")) == 1), F.struct(F.lit(k).alias("level"), (hi - 1).alias("block"))))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def enclosing(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """The innermost symbol around each place (place_id, path, line): least span, then latest start.

    A symbol's lines are cut into aligned blocks, of which it has some 2 log(lines). Everything in a block is inside the
    same symbols, so a block keeps its innermost one, and a line looks at the one block of each level that holds it:
    the work grows with the places and the symbols, not with how many symbols surround a place.
    """
    rank = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), (-F.col("start_line")).alias("late"), F.col("symbol_id").alias("id"))
    own = symbols.where("file_path is not null").select("*", rank.alias("__rank"))
    cut = own.select("file_path", "__rank", F.explode(_blocks(F.col("start_line").cast("long"), F.col("end_line").cast("long"))).alias("b"))
    best = cut.groupBy("file_path", "b.level", "b.block").agg(F.min("__rank").alias("__rank"))
    levels = best.groupBy("file_path").agg(F.collect_set("level").alias("levels"))  # at most LEVELS
    lines = places.where("line is not null").select(F.col("path").alias("file_path"), F.col("line").cast("long").alias("line")).distinct()
    asked = lines.join(levels, "file_path").select("file_path", "line", F.explode("levels").alias("level"))
    asked = asked.withColumn("block", F.expr("shiftright(line, level)"))
    inner = asked.join(best.hint("merge"), ["file_path", "level", "block"]).groupBy("file_path", "line").agg(F.min("__rank").alias("__rank"))
    inner = inner.withColumnRenamed("file_path", "__path").withColumnRenamed("line", "__line")
    # each line's symbol; of rows that share file, lines and id, one
    whole = own.withColumnRenamed("__rank", "__own").dropDuplicates(["file_path", "__own"])
    found = inner.join(whole.hint("merge"), (F.col("__path") == F.col("file_path")) & (F.col("__rank") == F.col("__own")))
    met = places.join(found, (places.path == F.col("__path")) & (places.line == F.col("__line"))).drop("__path", "__line", "__own")
    nth = F.row_number().over(Window.partitionBy("place_id").orderBy("__rank"))
    return met.withColumn("nth", nth).where("nth = 1").drop("nth", "__rank")


def spec_coverage(links: DataFrame, symbols: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """(spec, n_implementing, n_verified, ratio): implementing symbols that a test reaches or a tests-link names."""
    tests = symbols.where(is_test_file(F.col("file_path"))).select(F.col("symbol_id").alias("node"))
    reached = reach(edges, tests, max_depth, keep_seeds=True).select(F.col("node").alias("symbol_id"))
    named = links.where("relation = 'tests'").select("spec", "symbol_id").distinct().withColumn("named", F.lit(1))
    done = reached.distinct().withColumn("met", F.lit(1))
    own = links.where("relation = 'implements'").select("spec", "symbol_id").distinct().join(done, "symbol_id", "left").join(named, ["spec", "symbol_id"], "left")
    verified = F.sum(F.when(F.col("met").isNotNull() | F.col("named").isNotNull(), 1).otherwise(0))
    return own.groupBy("spec").agg(F.count("*").alias("n_implementing"), verified.alias("n_verified")).withColumn("ratio", F.round(F.col("n_verified") / F.col("n_implementing"), 6))


def low_confidence(links: DataFrame, below: float = 0.7, least: int = 1) -> DataFrame:
    per = links.groupBy("spec").agg(F.count("*").alias("n_links"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return per.where((F.col("mean_confidence") < below) & (F.col("n_links") >= least))


def orphan_files(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """Product files none of whose symbols is linked."""
    linked = symbols.join(links.select("symbol_id"), "symbol_id", "left_semi").select("file_path").distinct()
    return symbols.where(~is_non_product(F.col("file_path"))).groupBy("file_path").agg(F.count("*").alias("n_symbols")).join(linked, "file_path", "left_anti")


def closure_callees(symbols: DataFrame, edges: DataFrame, root: int, budget: int) -> DataFrame:
    """Callees of ``root``, nearest file first, while their bodies fit in ``budget`` tokens (running sum)."""
    from ..functions.paths import path_distance

    own = symbols.where(F.col("symbol_id") == root).select("file_path").first()
    called = simple(edges).where(F.col("src") == root).select(F.col("dst").alias("symbol_id"))
    c = symbols.join(called, "symbol_id")
    c = c.withColumn("distance", path_distance(F.col("file_path"), F.lit(own[0] if own else ""))).withColumn("tokens", (F.col("end_line") - F.col("start_line") + 1) * 10)
    running = F.sum("tokens").over(Window.orderBy("distance", "qualified_name").rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("running", running).where(F.col("running") <= budget)


def expand_types(symbols: DataFrame, roots: DataFrame, depth: int = 1) -> DataFrame:
    """(root, name, symbol_id, level): definitions of the types that the roots' bodies name, level by level.

    roots: root, body. Of several definitions the one of shortest qualified name counts.
    """
    from ..functions.text import type_names

    order = Window.partitionBy("name").orderBy(F.length("qualified_name"), "qualified_name", "symbol_id")
    types = symbols.where(F.col("kind").isin("class", "type_alias", "interface")).withColumn("nth", F.row_number().over(order)).where("nth = 1").select("name", "symbol_id", F.col("body").alias("next"))
    front, found = roots.select("root", "body"), None
    for level in range(1, depth + 1):
        step = front.select("root", F.explode(type_names(F.col("body"))).alias("name")).distinct().join(types, "name").withColumn("level", F.lit(level))
        step = step if found is None else step.join(found.select("root", "symbol_id"), ["root", "symbol_id"], "left_anti").select(step.columns)
        found = step.drop("next") if found is None else found.unionByName(step.drop("next"))
        front = step.select("root", F.col("next").alias("body"))
    return found


def stale_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks whose file is gone or has another hash now. chunks: chunk_id, path, content_hash."""
    now = files.select("path", F.col("content_hash").alias("now"))
    return chunks.join(now, "path", "left").where("now is null or now <> content_hash").select("chunk_id", "path")


def unknown_annotations(texts: DataFrame, specs: DataFrame) -> DataFrame:
    """(id, spec_id): annotated ids that no spec has. texts: id, text."""
    line = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?m)@(?:spec|implements?|tests?|see|references?)\s*[:=]\s*([^\n]+)"), F.lit(1)))
    ids = texts.select("id", line.alias("rest")).select("id", F.explode(F.split(F.regexp_replace("rest", r"\s*:\s*[0-9.]+\s*$", ""), r"[,\s]+")).alias("spec_id")).where("spec_id <> ''")
    return ids.join(specs.select(F.lower("spec_id").alias("spec_id")), "spec_id", "left_anti").distinct().select("id", "spec_id")
