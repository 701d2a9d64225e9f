"""Methods that live although nothing calls them, because of their class.

Liveness spreads from a class to its methods over the method's owner: its qualified name without the last segment. A
class spreads it if an edge reaches it (it is constructed or subclassed somewhere), if its decorators bind it to a
template, to injection or to a container, and, for a fixed set of hook names, if any framework decorator stands on it.
All rules become one table with a row per class, so one equi-join settles them and adds no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frameworks import last_segments

#: Class decorators in lower case, by what they mean for the methods. Fixed values.
TEMPLATE = ("component", "directive", "pipe")
INJECTED = ("injectable",)
STEREOTYPE = ("restcontroller", "controller", "service", "repository", "component", "configuration", "controlleradvice", "restcontrolleradvice")
HOOKED = (*TEMPLATE, *INJECTED, "ngmodule")
#: Methods that the framework calls on any class with one of its decorators. Fixed values.
HOOKS = ("ngOnInit", "ngOnDestroy", "ngOnChanges", "ngDoCheck", "ngAfterViewInit", "ngAfterViewChecked", "ngAfterContentInit", "ngAfterContentChecked")
#: Rules in the order in which a class's first one is told.
RULES = ("called", "template", "injected", "stereotype", "hook")


def owner(qualified_name: Column) -> Column:
    """What holds a symbol: its name without the last segment; null for a single segment."""
    return F.when(qualified_name.contains("."), F.regexp_replace(qualified_name, r"\.[^.]*$", ""))


def class_rules(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, rule, hooks): one row for each class name that spreads liveness. rule: the first that holds, to all methods;
    null if only hook methods live (hooks). symbols may have decorators."""
    classes = symbols.where("kind = 'class'")
    called = classes.join(edges.select(F.col("dst").alias("symbol_id")), "symbol_id", "left_semi")
    parts = [called.select(F.col("qualified_name").alias("owner"), F.lit(0).alias("nth"))]
    if "decorators" in symbols.columns:
        marked = classes.where("decorators is not null").select(F.col("qualified_name").alias("owner"), F.explode(last_segments(F.col("decorators"))).alias("mark"))
        for nth, marks in ((1, TEMPLATE), (2, INJECTED), (3, STEREOTYPE), (4, HOOKED)):
            parts.append(marked.where(F.col("mark").isin(*marks)).select("owner", F.lit(nth).alias("nth")))
    every = reduce(DataFrame.union, parts).groupBy("owner").agg(F.min("nth").alias("nth"), F.max(F.col("nth") == 4).alias("hooks"))
    rule = F.when(F.col("nth") < 4, F.element_at(F.array(*map(F.lit, RULES)), F.col("nth") + 1))
    return every.select("owner", rule.alias("rule"), "hooks")


def with_class_rule(found: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Add class_rule: the rule by which the symbol's class keeps it alive; null for what is no method or has no live class."""
    rules = class_rules(symbols, edges).withColumnRenamed("owner", "__owner")
    joined = found.withColumn("__owner", F.when(F.col("kind") == "method", owner(F.col("qualified_name")))).join(rules, "__owner", "left")
    kept = F.coalesce("rule", F.when(F.col("hooks") & F.col("name").isin(*HOOKS), F.lit("hook")))
    return joined.withColumn("class_rule", kept).drop("__owner", "rule", "hooks")
