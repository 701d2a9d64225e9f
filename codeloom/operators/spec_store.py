"""The spec store: keyed merges, change packages, links, validation and export, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import creates_cycle
from .specs import findings

SPECS = "spec_id string, title string, description string, kind string, module string, status string, priority string, source string"
LINKS = "spec_id string, symbol_id long, relation string, confidence double, source string"
DELTAS = "ordinal int, operation string, spec_id string, title string, description string, capability string, rename_from string"
#: Words that make a requirement normative, and marks of entries meant to go. Fixed values.
NORMATIVE = r"\b(SHALL|MUST|SHOULD|MAY|REQUIRED)\b"
OBSOLETE = r"(?i)\b(OBSOLETE|DELETE\s+FROM\s+STORE|REMOVE\s+FROM\s+STORE)\b"


def merge(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``new`` rows replace ``old`` ones of equal keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def patch(specs: DataFrame, spec_id: str, **values) -> DataFrame:
    """One spec with the given fields set."""
    hit = F.col("spec_id") == spec_id
    return specs.select(*(F.when(hit, F.lit(values[c])).otherwise(F.col(c)).alias(c) if values.get(c) is not None else F.col(c) for c in specs.columns))


def retire_absent(specs: DataFrame, present: DataFrame, source: str = "markdown") -> DataFrame:
    """Specs of ``source`` that ``present`` no longer holds become deprecated."""
    seen = present.select("spec_id", F.lit(True).alias("seen")).distinct()
    gone = (F.col("source") == source) & F.col("seen").isNull()
    return specs.join(seen, "spec_id", "left").withColumn("status", F.when(gone, "deprecated").otherwise(F.col("status"))).select(specs.columns)


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    return merge(links, new, "spec_id", "symbol_id", "relation")


def classify_mappings(mappings: DataFrame, specs: DataFrame, symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(spec_id, qname, relation, outcome): ok, skipped (there already) or why it failed. mappings: spec_id, qname, relation."""
    s = specs.select("spec_id", F.lit(1).alias("has_spec"))
    q = symbols.groupBy(F.col("qualified_name").alias("qname")).agg(F.min("symbol_id").alias("symbol_id"))
    there = links.select("spec_id", "symbol_id", "relation", F.lit(1).alias("there")).distinct()
    m = mappings.join(s, "spec_id", "left").join(q, "qname", "left").join(there, ["spec_id", "symbol_id", "relation"], "left")
    outcome = F.when(F.col("has_spec").isNull(), "no spec").when(F.col("symbol_id").isNull(), "no symbol").when(F.col("there") == 1, "skipped").otherwise("ok")
    return m.select("spec_id", "qname", "relation", outcome.alias("outcome"))


def depend(spark: SparkSession, dependencies: DataFrame, parent: int, child: int, kind: str = "requires") -> DataFrame:
    """Add parent -> child unless it closes a cycle. dependencies: src, dst, kind."""
    if kind == "requires" and creates_cycle(dependencies.where("kind = 'requires'").withColumn("weight", F.lit(1.0)), parent, child):
        raise ValueError(f"{parent} -> {child} closes a cycle")
    return merge(dependencies, spark.createDataFrame([(parent, child, kind)], dependencies.schema), "src", "dst", "kind")


def delta_warnings(deltas: DataFrame, specs: DataFrame) -> DataFrame:
    """Deltas whose target (or source) isn't as they expect."""
    there = specs.select("spec_id", F.lit(True).alias("there"))
    old = specs.select(F.col("spec_id").alias("rename_from"), F.lit(True).alias("old"))
    d = deltas.join(there, "spec_id", "left").join(old, "rename_from", "left")
    op, has = F.col("operation"), F.col("there").isNotNull()
    issue = F.when((op == "added") & has, "exists already").when((op == "modified") & ~has, "doesn't exist, will be made").when((op == "removed") & ~has, "doesn't exist")
    issue = issue.when((op == "renamed") & F.col("rename_from").isNull(), "has no source").when((op == "renamed") & F.col("old").isNull(), "source doesn't exist")
    return d.withColumn("issue", issue).where("issue is not null").select("operation", "spec_id", "issue")


def apply_change(specs: DataFrame, links: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(specs, links) after a change's deltas: of one spec the last delta counts; a rename takes its links along."""
    last = Window.partitionBy("spec_id").orderBy(F.desc("ordinal"))
    d = deltas.withColumn("nth", F.row_number().over(last)).where("nth = 1")
    text = d.where("operation <> 'removed'").select("spec_id", F.col("title").alias("t"), F.col("description").alias("x"), "capability")
    moved = deltas.where("operation = 'renamed' and rename_from is not null and rename_from <> spec_id").select(F.col("rename_from").alias("old"), F.col("spec_id").alias("new")).distinct()
    kept = specs.join(moved, specs.spec_id == moved.old, "left_anti").join(text, "spec_id", "full_outer")
    fresh = F.col("title").isNull() & F.col("t").isNotNull()
    out = kept.select(
        "spec_id", F.coalesce("t", "title").alias("title"), F.coalesce("x", "description").alias("description"), F.coalesce("kind", F.lit("functional_requirement")).alias("kind"),
        F.coalesce("module", "capability").alias("module"), F.when(F.col("t").isNotNull(), "active").otherwise(F.col("status")).alias("status"),
        F.coalesce("priority", F.lit("medium")).alias("priority"), F.when(fresh, "change").otherwise(F.col("source")).alias("source"),
    )
    removed = d.where("operation = 'removed'").select("spec_id", F.lit(1).alias("gone"))
    out = out.join(removed, "spec_id", "left").withColumn("status", F.when(F.col("gone") == 1, "deprecated").otherwise(F.col("status"))).drop("gone")
    l2 = links.join(moved, links.spec_id == moved.old, "left")
    l2 = l2.withColumn("was_own", F.col("old").isNull()).withColumn("spec_id", F.coalesce("new", "spec_id")).drop("old", "new")
    one = Window.partitionBy("spec_id", "symbol_id", "relation").orderBy(F.desc("was_own"), F.desc("confidence"), "source")
    return out.select(specs.columns), l2.withColumn("nth", F.row_number().over(one)).where("nth = 1").select(links.columns)


def change_scenarios(scenarios: DataFrame, deltas: DataFrame) -> DataFrame:
    """Scenarios (spec_id, name, body) after a change: a spec that is added or modified gets those of its last delta beside
    those it had under other names; a renamed one takes its scenarios along, where the new one has none of that name."""
    last = Window.partitionBy("spec_id").orderBy(F.desc("ordinal"))
    d = deltas.where("operation <> 'removed'").withColumn("nth", F.row_number().over(last)).where("nth = 1")
    new = d.select("spec_id", F.explode("scenarios").alias("s")).select("spec_id", "s.name", "s.body").dropDuplicates(["spec_id", "name"])
    moved = deltas.where("operation = 'renamed' and rename_from is not null and rename_from <> spec_id").groupBy(F.col("rename_from").alias("old")).agg(F.max_by("spec_id", "ordinal").alias("to"))
    kept = scenarios.join(moved, scenarios.spec_id == moved.old, "left").withColumn("own", F.col("old").isNull()).withColumn("spec_id", F.coalesce("to", "spec_id"))
    one = Window.partitionBy("spec_id", "name").orderBy(F.desc("own"), "old")
    kept = kept.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("spec_id", "name", "body")
    return merge(kept, new, "spec_id", "name")


#: What a package may become. A package that is applied stays so when its folder is read again; an archive is final.
STATES = ("proposed", "applied", "archived")


def merge_packages(known: DataFrame, read: DataFrame) -> DataFrame:
    """Packages (folder, change, status, ...) after reading a tree: texts as they are now, the later of both states, packages
    whose folder is gone left out."""
    order = F.array(*map(F.lit, STATES))
    was = known.select("folder", F.col("status").alias("was"))
    later = F.element_at(order, F.greatest(F.array_position(order, F.col("status")), F.coalesce(F.array_position(order, F.col("was")), F.lit(1))).cast("int"))
    return read.join(was, "folder", "left").withColumn("status", later).select(read.columns)


def package_list(packages: DataFrame, deltas: DataFrame, status: str | None = None) -> DataFrame:
    """(change, folder, status, n_deltas, and how many of each operation), active ones first."""
    per = deltas.groupBy("folder").agg(F.count("*").alias("n_deltas"), *(F.sum((F.col("operation") == o).cast("long")).alias(o) for o in ("added", "modified", "removed", "renamed")))
    p = packages if status is None else packages.where(F.col("status") == status)
    counts = ("n_deltas", "added", "modified", "removed", "renamed")
    return p.join(per, "folder", "left").select("change", "folder", "status", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts)).orderBy(F.array_position(F.array(*map(F.lit, STATES)), F.col("status")), "change", "folder")


def validate(specs: DataFrame, scenarios: DataFrame, strict: bool = False, sample: int = 10) -> DataFrame:
    """(issue, severity, n, examples, project_level) of the specs that aren't deprecated."""
    s = specs.where("status <> 'deprecated'").join(scenarios.groupBy("spec_id").agg(F.count("*").alias("n_scenarios")), "spec_id", "left")
    soft = "error" if strict else "warning"
    body = F.trim(F.coalesce("description", F.lit("")))
    checks = [("no title", "error", F.trim(F.coalesce("title", F.lit(""))) == ""), ("no scenario", soft, F.col("n_scenarios").isNull()), ("empty body", "warning", body == ""), ("no normative word", soft, (body != "") & ~body.rlike(NORMATIVE)), ("obsolete mark", "warning", F.concat_ws(" ", "title", "description").rlike(OBSOLETE)), ("numeric id", "error", (F.col("source") == "tree") & F.col("spec_id").rlike("^[A-Za-z]+-[0-9]+$"))]
    found = F.array(*(F.when(bad, F.struct(F.lit(i).alias("issue"), F.lit(v).alias("severity"))) for i, v, bad in checks))
    rows = s.select("spec_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("f.issue", "f.severity", "spec_id")
    checked = s.count()
    return findings(rows, sample).withColumn("project_level", F.lit(checked >= 20) & (F.col("n") >= 0.95 * checked))


def to_markdown(specs: DataFrame) -> DataFrame:
    """(module, text): one requirements file per module, deprecated specs left out."""
    one = F.concat(F.lit("### Requirement: "), "title", F.lit("\n"), F.coalesce("description", F.lit("")))
    live = specs.where("status <> 'deprecated'").select(F.coalesce("module", F.lit("general")).alias("module"), F.struct("spec_id", one.alias("text")).alias("s"))
    parts = live.groupBy("module").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return parts.select("module", F.concat(F.lit("## Requirements\n\n"), F.array_join(F.transform("s", lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("text"))


#: Mean link confidence from which a spec counts as implemented. Fixed value.
IMPLEMENTED = 0.7


def dev_state(n_symbols, coverage, tested):
    """not_started without symbols, verified with any test coverage, else by the links' mean confidence."""
    return F.when(n_symbols == 0, "not_started").when(tested > 0, "verified").when(coverage.isNull() | (coverage < IMPLEMENTED), "in_progress").otherwise("implemented")


def spec_states(specs: DataFrame, links: DataFrame, tested: DataFrame) -> DataFrame:
    """(spec_id, n_symbols, coverage, tested, state). links: spec_id, symbol_id, confidence. tested: spec_id, ratio.

    coverage: the links' mean confidence, null without links; a spec that ``tested`` doesn't hold has the ratio 0.
    """
    n = links.groupBy("spec_id").agg(F.countDistinct("symbol_id").alias("n_symbols"), F.round(F.avg("confidence"), 4).alias("coverage"))
    out = specs.select("spec_id").join(n, "spec_id", "left").join(tested.select("spec_id", F.col("ratio").alias("tested")), "spec_id", "left")
    out = out.withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0))).withColumn("tested", F.coalesce("tested", F.lit(0.0)))
    return out.select("spec_id", "n_symbols", "coverage", "tested", dev_state(F.col("n_symbols"), F.col("coverage"), F.col("tested")).alias("state"))


def dashboard(states: DataFrame, with_endpoints: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row over ``spec_states``: how many specs, by state, implemented share, verified, mean coverages.

    with_endpoints: spec_id of specs that an endpoint serves. dependencies: spec_id of specs that depend on others.
    Means are null without specs (coverage: without links), the share is 0.
    """
    mark = lambda df, name: df.select("spec_id").distinct().withColumn(name, F.lit(1))
    s = states.join(mark(with_endpoints, "e"), "spec_id", "left").join(mark(dependencies, "d"), "spec_id", "left")
    count = lambda c: F.count(F.when(c, 1))
    by_state = [count(F.col("state") == x).alias(x) for x in ("not_started", "in_progress", "implemented", "verified")]
    share = F.coalesce(F.round(F.try_divide(100.0 * count(F.col("n_symbols") > 0), F.count("*")), 1), F.lit(0.0))
    return s.agg(F.count("*").alias("specs"), *by_state, F.count("e").alias("with_endpoints"), F.count("d").alias("with_dependencies"), share.alias("implemented_pct"), F.round(F.avg("coverage"), 4).alias("avg_coverage"), F.round(F.avg("tested"), 4).alias("avg_test_coverage"))


def duplicate_verdict(matches: DataFrame, baseline: DataFrame, structural_hash: str, touched: tuple[str, ...] = (), boy_scout: bool = False) -> DataFrame:
    """Matches (qualified_name, file_path, ...) that still report: none if the shape was duplicated at capture time,
    but for touched files under the boy-scout rule; all if nothing was captured or the shape is new."""
    if baseline.where(F.col("structural_hash") == structural_hash).isEmpty():
        return matches
    return matches.where(F.lit(boy_scout) & F.col("file_path").isin(*touched))
