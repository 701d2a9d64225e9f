"""Source trees as DataFrames: walk, language, ignore rules, content hash.

Spark's own file readers leave out names that begin with ``_`` (``__init__.py``, ``__tests__``) without a word, so trees
are walked and read by tasks of our own: folders are dealt over the tasks, then files by their bytes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import LANGUAGES, language_of
from ..staging import stage
from .config import MAX_BYTES, RepoConfig, load_config

#: Folders that are never indexed, beside hidden ones. Fixed values.
IGNORED_DIRS = ("node_modules", "__pycache__", "venv", "dist", "build", "target")
#: Folders to have before the tasks take over the walk; bytes of files read by one task, and given on at once.
SPREAD, TASK_BYTES, BATCH_BYTES = 256, 64 << 20, 16 << 20


def glob_to_regex(pattern: str) -> str:
    """An ignore-file pattern as a regular expression over relative paths; folders' paths end in ``/``."""
    anchored = pattern.startswith("/") or "/" in pattern.rstrip("/")
    folder = pattern.endswith("/")
    body = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?|\[!?[^\]]+\]|\\.)", pattern.strip("/")):
        if re.fullmatch(r"\[!?[^\]]+\]", part):
            body += part.replace("[!", "[^", 1)
        elif re.fullmatch(r"\\.", part):
            body += re.escape(part[1])
        else:
            body += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return ("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")


@functools.lru_cache(maxsize=4096)
def _rules(patterns: tuple[str, ...]) -> tuple[tuple[re.Pattern, bool], ...]:
    lines = (p.strip() for p in patterns)
    return tuple((re.compile(glob_to_regex(p.removeprefix("!"))), not p.startswith("!")) for p in lines if p and not p.startswith("#"))


def opinion(path: str, patterns: tuple[str, ...]) -> bool | None:
    """True: left out, False: taken back in by ``!``, None: no pattern matches. The last that matches decides."""
    return next((out for rule, out in reversed(_rules(patterns)) if rule.search(path)), None)


@dataclass(frozen=True)
class Walk:
    """What a walk takes. ``ignore`` outranks ignore files, of which the deepest with an opinion decides."""

    extensions: tuple[str, ...]
    ignore: tuple[str, ...] = ()
    max_bytes: int | None = None
    pruned: tuple[str, ...] = IGNORED_DIRS
    ignore_files: bool = True

    def leaves_out(self, path: str, inherited: list) -> bool:
        found = opinion(path, self.ignore)
        for base, patterns in reversed(inherited if found is None else []):
            found = opinion(path[len(base) + 1 :] if base else path, tuple(patterns))
            if found is not None:
                break
        return bool(found)

    def level(self, fs: pafs.FileSystem, root: str, folder: str, inherited: list) -> tuple[list, list]:
        """([(path, size)], [(folder, inherited)]) right below a folder. Links to folders aren't followed."""
        there = sorted(fs.get_file_info(pafs.FileSelector(f"{root}/{folder}" if folder else root)), key=lambda i: i.base_name)
        own = next((i for i in there if i.base_name == ".gitignore" and i.type == pafs.FileType.File), None)
        if own is not None and self.ignore_files:
            with fs.open_input_stream(own.path) as f:
                inherited = [*inherited, (folder, f.read().decode("utf-8", "replace").splitlines())]
        files, folders = [], []
        for i in there:
            name, path = i.base_name, f"{folder}/{i.base_name}" if folder else i.base_name
            if name.startswith("."):
                continue
            if i.type == pafs.FileType.Directory:
                link = isinstance(fs, pafs.LocalFileSystem) and os.path.islink(i.path)
                if name not in self.pruned and not link and not self.leaves_out(path + "/", inherited):
                    folders.append((path, inherited))
            elif i.type == pafs.FileType.File and name.rpartition(".")[2].lower() in self.extensions and "." in name:
                if (self.max_bytes is None or i.size <= self.max_bytes) and not self.leaves_out(path, inherited):
                    files.append((path, i.size))
        return files, folders


def _place(root: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:|[^:]+$", root):
        return pafs.LocalFileSystem(), os.path.abspath(re.sub("^file:/*", "/", root))
    return pafs.FileSystem.from_uri(root)


def root_reader(root: str):
    """A function that gives the text of a file right below ``root``, None without one."""
    fs, base = _place(root)

    def read(name: str) -> str | None:
        if fs.get_file_info(f"{base}/{name}").type != pafs.FileType.File:
            return None
        with fs.open_input_stream(f"{base}/{name}") as f:
            return f.read().decode("utf-8", "replace")

    return read


def read_files(spark: SparkSession, root: str, walk: Walk) -> DataFrame:
    """(path, content, content_hash) of what ``walk`` takes below ``root``; bytes that are no UTF-8 are replaced.

    root: a local or shared folder or a URI that pyarrow opens, reachable from every executor. Files that vanish between
    walk and reading are left out.
    """
    fs, base = _place(root)
    files, front = [], [("", [])]
    while front and len(front) < SPREAD:  # the first levels, until there is enough to deal
        levels = [walk.level(fs, base, f, inherited) for f, inherited in front]
        files += [x for fs_, _ in levels for x in fs_]
        front = [x for _, folders in levels for x in folders]

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, top = _place(root)
        for b in batches:
            for folder, above in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                todo = [(folder, json.loads(above))]
                while todo:
                    met, more = walk.level(here, top, *todo.pop())
                    todo += more
                    if met:
                        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in met], pa.string()), pa.array([n for _, n in met], pa.int64())], names=["path", "size"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, top = _place(root)
        names = ["path", "content", "content_hash"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)
        for b in batches:
            rows, held = [], 0
            for path in b.column(0).to_pylist():
                try:
                    with here.open_input_stream(f"{top}/{path}") as f:
                        raw = f.read()
                except FileNotFoundError:
                    continue
                rows.append((path, raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest()))
                held += len(raw)
                if held > BATCH_BYTES:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)

    found = spark.createDataFrame(files, "path string, size long")
    if front:
        dealt = spark.createDataFrame([(f, json.dumps(inherited)) for f, inherited in front], "folder string, above string")
        found = found.union(dealt.repartition(min(len(front), 4 * spark.sparkContext.defaultParallelism), "folder").mapInArrow(descend, "path string, size long"))
    found = stage(found, "listing")
    size = found.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, size // TASK_BYTES + 1)
    return found.select("path").repartition(parts, "path").mapInArrow(load, "path string, content string, content_hash string")


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int | None = None, config: RepoConfig | None = None) -> DataFrame:
    """(path, language, content, content_hash, line_count) of the files under ``root`` in a known language.

    Hidden files, default folders, what nested ignore files leave out and files beyond ``max_bytes`` (the config's, 2 MB
    by default) don't count. The config's patterns, then ``ignore``, outrank ignore files. config: read from ``root`` if
    none is given.
    """
    config = config or load_config(root_reader(root))
    kept = tuple(x for x, language in LANGUAGES.items() if not config.languages or language in config.languages)
    f = read_files(spark, root, Walk(kept, config.ignore + tuple(ignore or ()), max_bytes or config.max_bytes))
    return f.select("path", language_of(F.col("path")).alias("language"), "content", "content_hash", F.size(F.split("content", "\n")).alias("line_count"))


#: Folders of spec trees that name no capability. Fixed values.
SPEC_FOLDERS = ("specs", "openspec")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, capability) of the markdown below a spec tree; capability: the file's folder, null for the tree's own."""
    f = read_files(spark, root, Walk(("md",), pruned=("venv", "node_modules"), ignore_files=False))
    parts = F.split("path", "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    return f.select("path", "content", F.when(~folder.isin(*SPEC_FOLDERS, os.path.basename(root.rstrip("/"))), folder).alias("capability"))


def slice_lines(content: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(F.split(content, "\n"), start, end - start + 1), "\n")


__all__ = ["IGNORED_DIRS", "MAX_BYTES", "RepoConfig", "Walk", "glob_to_regex", "opinion", "read_files", "read_markdown", "read_tree", "root_reader", "slice_lines"]
