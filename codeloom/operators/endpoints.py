"""Endpoints: decorated functions, files a framework routes, class-based views, and call-style registrations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frameworks import HOOK_DECORATORS, HTTP_DECORATORS, PRESETS, RUNNER_DECORATORS, SPRING_WEB, has_decorator, last_segments, routed_file, view_base
from ..functions.paths import is_test_scaffold
from .handlers import resolve_handlers

SURFACE = HTTP_DECORATORS + HOOK_DECORATORS + [d for d in RUNNER_DECORATORS if d != "fixture"] + SPRING_WEB


#: Frameworks whose routes are registered by calls. Fixed values.
CALL_STYLE = ("hono", "express", "gin", "echo", "chi", "nethttp")
#: What else a framework of served files is called.
SERVED = {"nextjs": ("nextjs_pages", "nextjs_app")} | {f: (f,) for f in ("fresh", "nextjs_pages", "nextjs_app", "sveltekit", "remix")}


def endpoints(symbols: DataFrame, routes: DataFrame, framework: str | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(qualified_name, file_path, start_line, source, detail, http, framework, resolution).

    Decorated functions, class-based views and files that a framework routes give one row per qualified name, in this
    order of preference. http: the first route of the symbol. Routes registered by a call give one row per (route,
    symbol that serves it), however else that symbol is known; resolution tells how it was found (``handlers``).
    symbols also need decorators and signature. routes: symbol_id, role, method, route, and for the last kind route_id,
    file_path, framework, handler_name, handler_module. aliases: name of bound decorators (for fastmcp).
    """
    names = PRESETS.get(framework, []) if framework else SURFACE
    base = symbols.select("symbol_id", "qualified_name", "file_path", "start_line", "kind", "decorators", "signature")
    out = ["symbol_id", "qualified_name", "file_path", "start_line"]
    row = lambda df, source, detail, frame, rank: df.select(*out, F.lit(source).alias("source"), detail.alias("detail"), frame.alias("framework"), F.lit(rank).alias("rank"))
    none = F.lit(None).cast("string")
    parts = []
    if names:
        known = F.filter(last_segments(F.col("decorators")), lambda d: d.isin(*[n.lower() for n in names]))
        own = base.withColumn("known", known)
        if framework == "fastmcp" and aliases is not None:
            bound = base.select("symbol_id", F.explode(last_segments(F.col("decorators"))).alias("name")).join(aliases.select(F.lower("name").alias("name")).distinct(), "name").groupBy("symbol_id").agg(F.array_sort(F.collect_set("name")).alias("bound"))
            own = own.join(bound, "symbol_id", "left").withColumn("known", F.array_union(F.coalesce("known", F.array().cast("array<string>")), F.coalesce("bound", F.array().cast("array<string>"))))
        parts.append(row(own.where(F.size("known") > 0), "decorator", F.array_join("known", ","), none if framework is None else F.lit(framework), 1))
    if framework is None or framework in SERVED:
        f = base.where(F.col("kind").isin("function", "class")).withColumn("f", routed_file(F.col("file_path"))).where("f is not null")
        parts.append(row(f if framework is None else f.where(F.col("f").isin(*SERVED[framework])), "file", F.col("f"), F.col("f"), 2))
    if framework in (None, "django"):
        views = base.where("kind = 'class'").withColumn("v", view_base(F.col("signature"))).where("v is not null")
        parts.append(row(views, "view", F.col("v"), F.lit("django"), 3))
    shape = "qualified_name string, file_path string, start_line int, source string, detail string, http string, framework string, resolution string"
    found = symbols.sparkSession.createDataFrame([], shape)
    if parts:
        first = Window.partitionBy("qualified_name").orderBy("rank", "file_path", "start_line", "symbol_id")
        every = reduce(DataFrame.union, parts).withColumn("nth", F.row_number().over(first)).where("nth = 1")
        spot = F.struct("line", "method", "route") if "line" in routes.columns else F.struct("method", "route")
        served = routes.where("role = 'server'").groupBy("symbol_id").agg(F.min(spot).alias("r")).select("symbol_id", F.concat_ws(" ", "r.method", "r.route").alias("http"))
        found = found.union(every.join(served, "symbol_id", "left").select("qualified_name", "file_path", "start_line", "source", "detail", "http", "framework", none.alias("resolution")))
    if framework is None or framework in CALL_STYLE:
        calls = routes.where(F.col("role").isin("server", "mount") & F.col("framework").isin(*((framework,) if framework else CALL_STYLE)))
        met = calls.select("route_id", "method", "route", "file_path", "line", "framework").join(resolve_handlers(calls, symbols), "route_id").join(symbols.select("symbol_id", "qualified_name", "start_line"), "symbol_id")
        one = Window.partitionBy("method", "route", "qualified_name").orderBy("file_path", "line", "route_id")
        met = met.withColumn("nth", F.row_number().over(one)).where("nth = 1")
        said = F.concat_ws(" ", "method", "route")
        line = F.when(F.col("resolution") == "enclosing_scope", F.col("line")).otherwise(F.col("start_line"))
        found = found.union(met.select("qualified_name", "file_path", line, F.lit("route"), said, said, "framework", "resolution"))
    return found if framework == "pytest" else found.where(~is_test_scaffold(F.col("file_path")))


#: What a decorator without a route announces. Fixed values.
KINDS = {"tool": "tool", "mutation_tool": "tool", "agentic_tool": "tool", "resource": "resource", "prompt": "prompt", "fixture": "fixture"}


def kind_of(framework, detail):
    """tool (whatever a framework routes, too), resource, prompt, fixture or other, by the first decorator that says."""
    names = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    said = F.filter(F.transform(F.split(detail, ","), lambda d: F.try_element_at(names, d)), lambda k: k.isNotNull())
    return F.when(framework.isNotNull(), "tool").otherwise(F.coalesce(F.try_element_at(said, F.lit(1)), F.lit("other")))
