"""Incremental indexing: only changed files are read again, a file that doesn't parse keeps what it had."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.code import extract, tables
from ..staging import stage
from .resolve import resolve_each, scopes, ways
from .specs import changed


def plan(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) by content hash. Tables: path, content_hash."""
    return changed(before.select("path", "content_hash"), now.select("path", "content_hash"), "path", "content_hash")


@dataclass
class Refreshed:
    """The tables after a change of files, and the paths (path) whose rows in them are new, changed or gone."""

    symbols: DataFrame
    refs: DataFrame
    routes: DataFrame
    files: DataFrame
    moved: DataFrame


def refresh(symbols: DataFrame, refs: DataFrame, routes: DataFrame, before: DataFrame, now: DataFrame, force: bool = False) -> Refreshed:
    """Changed files (all, if ``force``) are extracted once. Failed files keep their rows and their old hash."""
    moves = plan(before, now)
    if force:
        moves = now.select("path", F.lit("forced").alias("change")).union(moves.where("change = 'removed'"))
    moves = stage(moves, "moves")
    todo = now.join(moves.where("change <> 'removed'"), "path", "left_semi")
    got = stage(extract(todo), "extracted")
    failed = got.where("parse_error").select("path")
    s, r, t = tables(got.where("not parse_error"))
    moved = stage(moves.select("path").join(failed, "path", "left_anti"), "moved")
    stale = moved.withColumnRenamed("path", "file_path")
    keep = lambda df: df.join(stale, "file_path", "left_anti")
    held = before.join(failed, "path", "left_semi").select("path", "content_hash")
    files = now.join(failed, "path", "left_anti").select("path", "content_hash").unionByName(held)
    merged = (keep(old).unionByName(new, allowMissingColumns=True) for old, new in ((symbols, s), (refs, r), (routes, t)))
    return Refreshed(*merged, files, moved)


def affected_refs(refs: DataFrame, symbols_before: DataFrame, symbols_now: DataFrame, moved: DataFrame) -> DataFrame:
    """References to resolve again: made in moved files, to a name that a moved file defines or did define, or under a
    scope that came or went with one."""
    m = moved.select(F.col("path").alias("file_path"))
    names = symbols_before.join(m, "file_path", "left_semi").select("name").union(symbols_now.join(m, "file_path", "left_semi").select("name")).distinct()
    hit = refs.join(m.withColumn("made", F.lit(True)), "file_path", "left").join(names.select(F.col("name").alias("target_name"), F.lit(True).alias("named")), "target_name", "left")
    if "scope_module" not in refs.columns:
        return hit.where("made or named").select(refs.columns)
    old, new = scopes(symbols_before.join(m, "file_path", "left_semi")), scopes(symbols_now.join(m, "file_path", "left_semi"))
    turned = old.join(new.hint("merge"), "scope_module", "left_anti").union(new.join(old.hint("merge"), "scope_module", "left_anti"))
    hit = hit.join(turned.withColumn("scoped", F.lit(True)).hint("merge"), "scope_module", "left")
    return hit.where("made or named or scoped").select(refs.columns)


def maintain_edges(ref_edges: DataFrame, refs: DataFrame, symbols_before: DataFrame, symbols_now: DataFrame, moved: DataFrame) -> DataFrame:
    """(ref_id, src, dst, weight) after a change: the edges of references that are gone or affected are taken back, those
    of affected references are derived again, from symbols of the names they ask for alone. All other edges stay."""
    again = stage(affected_refs(refs, symbols_before, symbols_now, moved), "affected")
    asked = again.select(F.col("target_name").alias("name")).distinct()
    new = resolve_each(again, symbols_now, symbols_now.join(asked, "name", "left_semi"))
    standing = refs.select("ref_id").join(again.select("ref_id"), "ref_id", "left_anti")
    return ref_edges.join(standing, "ref_id", "left_semi").unionByName(new)


def maintain_ways(found: DataFrame, refs: DataFrame, symbols_before: DataFrame, symbols_now: DataFrame, moved: DataFrame) -> DataFrame:
    """``resolve.ways`` after a change, as ``maintain_edges`` does for edges: a row per call site, however many symbols it
    goes to. No moved file defines or did define what the standing ones ask for, so they meet the same symbols now."""
    again = stage(affected_refs(refs, symbols_before, symbols_now, moved), "affected")
    asked = again.select(F.col("target_name").alias("name")).distinct()
    new = ways(again, symbols_now, symbols_now.join(asked, "name", "left_semi"))
    standing = refs.select("ref_id").join(again.select("ref_id").hint("merge"), "ref_id", "left_anti")
    return found.join(standing.hint("merge"), "ref_id", "left_semi").unionByName(new)


def carry_links(links: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Links (symbol_id and others) after a re-index: a link belongs to its symbol's qualified name, and goes to the least
    id that has it now. Of links that meet on one symbol the surest stays; links whose name is gone go."""
    name = before.select("symbol_id", "qualified_name")
    least = now.groupBy("qualified_name").agg(F.min("symbol_id").alias("now_id"))
    stays = now.select(F.col("symbol_id").alias("now_id"), "qualified_name", F.lit(True).alias("stays"))
    kept = links.join(name, "symbol_id").join(stays.withColumnRenamed("now_id", "symbol_id"), ["symbol_id", "qualified_name"], "left").join(least, "qualified_name", "left")
    kept = kept.withColumn("symbol_id", F.when(F.col("stays"), F.col("symbol_id")).otherwise(F.col("now_id"))).where("symbol_id is not null")
    order = Window.partitionBy("spec_id", "symbol_id", "relation").orderBy(F.desc("confidence"), "source")
    return kept.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(links.columns)


def unused_fingerprints(bodies: DataFrame, known: DataFrame) -> DataFrame:
    """Bodies whose hash has no fingerprint yet. bodies: body_hash, body."""
    return bodies.dropDuplicates(["body_hash"]).join(known.select("body_hash"), "body_hash", "left_anti")
