"""Which symbol serves a route that is registered by a call: ``app.get('/x', wrap(ctrl.show))``.

Every route has at most one candidate of each rank, so the union of candidates is no larger than a few times the routes,
however common a handler's name is: the symbols are reduced to the first one per (file, name), per file and kind, and per
name before they meet the routes. All meetings are equi-joins.

    0  the name in the module that the file imports it from     2  that module's first function
    1  the module's own name there (a default export)           3  that module itself
    4  the name in the route's own file                         5  the name anywhere (first by path and line)
    6  none of these: the symbol around the registration

Null names, names nobody defines and modules that are packages fall through; a route without any symbol around it has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings that an imported module's file may have. Fixed values.
MODULE_FILES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
HOW = ("import", "default_export", "first_function", "module", "same_file", "by_name", "enclosing_scope")


def module_files(module: Column) -> Column:
    """Paths that a dotted module of the project may be; empty for null and for package names."""
    own = module.contains(".") | module.contains("/") | module.startswith("src")
    base = F.replace(module, F.lit("."), F.lit("/"))
    return F.when(own, F.array(*(F.concat(base, F.lit(e)) for e in MODULE_FILES))).otherwise(F.array().cast("array<string>"))


def first_by(symbols: DataFrame, *keys: str) -> DataFrame:
    """(keys, at): the first symbol of each key, by file and line."""
    return symbols.groupBy(*keys).agg(F.min(F.struct("file_path", "start_line", "symbol_id")).alias("at"))


def resolve_handlers(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(route_id, symbol_id, resolution) of routes (route_id, file_path, handler_name, handler_module, symbol_id: the scope
    around it). resolution: of ``HOW``. Routes that nothing resolves are left out."""
    r = routes.select("route_id", "file_path", "handler_name", "handler_module")
    s = symbols.select("symbol_id", "file_path", "name", "kind", "start_line")
    by_file_name = first_by(s, "file_path", "name")
    there = r.where("handler_name is not null").select("route_id", "handler_name", F.element_at(F.split("handler_module", r"\."), -1).alias("own_name"), F.explode(module_files(F.col("handler_module"))).alias("file_path"))
    pick = lambda df, rank: df.select("route_id", F.lit(rank).alias("rank"), "at")
    imported = lambda name, rank: pick(there.join(by_file_name.withColumnRenamed("name", name), ["file_path", name]), rank)
    functions, modules = (first_by(s.where(c), "file_path") for c in ("kind = 'function' and name <> '__module__'", "name = '__module__'"))
    named = r.where("handler_name is not null").withColumnRenamed("handler_name", "name")
    around = routes.where("symbol_id is not null").select("route_id", F.lit(6).alias("rank"), F.struct(F.lit("").alias("file_path"), F.lit(0).cast(s.schema["start_line"].dataType).alias("start_line"), F.col("symbol_id").cast(s.schema["symbol_id"].dataType).alias("symbol_id")).alias("at"))
    parts = [
        imported("handler_name", 0), imported("own_name", 1), pick(there.join(functions, "file_path"), 2), pick(there.join(modules, "file_path"), 3),
        pick(named.join(by_file_name, ["file_path", "name"]), 4), pick(named.join(first_by(s, "name"), "name"), 5), around,
    ]
    best = reduce(DataFrame.union, parts).groupBy("route_id").agg(F.min(F.struct("rank", F.col("at.start_line").alias("line"), F.col("at.file_path").alias("file"), F.col("at.symbol_id").alias("symbol_id"))).alias("best"))
    return best.select("route_id", "best.symbol_id", F.element_at(F.array(*map(F.lit, HOW)), F.col("best.rank") + 1).alias("resolution"))


def handler_symbols(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id) of the symbols that routes name as their handlers, each once; scopes around inline handlers are none."""
    return resolve_handlers(routes.where("role = 'server'"), symbols).where("resolution <> 'enclosing_scope'").select("symbol_id").distinct()

