"""Names that code keeps alive without calling them: one parse per file, five categories.

module: referenced at module level (also as dotted strings); nested: inner functions used by their encloser; export:
imported by name or listed in ``__all__``; registered: handed to a registration call; alias: names bound to a decorator.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frameworks import ENTRY_DECORATORS
from .code import _NAME, _SCRIPT, REGISTRARS, _blank, arguments, dotted, extract_lexical

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _names(node: ast.AST) -> set[str]:
    """Names read in a node, and the segments of dotted strings that could name something."""
    out = set()
    for x in ast.walk(node):
        if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load):
            out.add(x.id)
        elif isinstance(x, ast.Attribute) and isinstance(x.ctx, ast.Load):
            out.add(x.attr)
        elif isinstance(x, ast.Constant) and isinstance(x.value, str) and re.fullmatch(r"[A-Za-z_]\w*([.:][A-Za-z_]\w*)+", x.value):
            out.add(re.split(r"[.:]", x.value)[-1])
    return out


def _decorator_names(node: ast.Assign) -> set[str]:
    """Names that an assignment binds to a framework's decorator, and, of a choice between two, both sides' own names."""
    sides, leaves = [node.value], []
    while sides:
        x = sides.pop()
        sides += [x.body, x.orelse] if isinstance(x, ast.IfExp) else []
        if isinstance(x, (ast.Name, ast.Attribute)):
            leaves.append((x.id if isinstance(x, ast.Name) else x.attr).lower())
    if not any(x in ENTRY_DECORATORS for x in leaves):
        return set()
    return {t.id.lower() for t in node.targets if isinstance(t, ast.Name)} | (set(leaves) if isinstance(node.value, ast.IfExp) else set())


def protected_names(source: str) -> set[tuple[str, str]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return set()
    out: set[tuple[str, str]] = set()
    outer = [n for n in tree.body if not isinstance(n, (*_DEFS, ast.ClassDef, ast.Import, ast.ImportFrom))]
    for n in outer:
        out |= {("module", x) for x in _names(n)}
        if isinstance(n, (ast.Assign, ast.AugAssign)):
            targets = n.targets if isinstance(n, ast.Assign) else [n.target]
            if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets):
                out |= {("export", c.value) for c in ast.walk(n.value) if isinstance(c, ast.Constant) and isinstance(c.value, str)}
    for n in ast.walk(tree):
        if isinstance(n, ast.Assign):
            out |= {("alias", x) for x in _decorator_names(n)}
        if isinstance(n, ast.ImportFrom):
            out |= {("export", a.name) for a in n.names if a.name != "*"}
        if isinstance(n, ast.Call) and dotted(n.func).split(".")[-1] in REGISTRARS:
            out |= {("registered", dotted(a).split(".")[-1]) for a in [*n.args, *(k.value for k in n.keywords)] if isinstance(a, (ast.Name, ast.Attribute)) and dotted(a)}
        if isinstance(n, _DEFS):
            inner = {d.name for d in ast.walk(n) if isinstance(d, _DEFS) and d is not n}
            used = {x.id for x in ast.walk(n) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)}
            out |= {("nested", x) for x in inner & used}
    return out


#: Methods of scripts that take handlers. Fixed values.
SCRIPT_REGISTRARS = ("get", "post", "put", "delete", "patch", "options", "all", "route", "use", "on", "once", "subscribe", "register", "connect", "addeventlistener", "addlistener")
_REGISTERS = re.compile(rf"\.\s*(?:{'|'.join(SCRIPT_REGISTRARS)})\s*\(", re.I)
#: Inner declarations whose names count, by language.
_INNER = {language: r"\b(?:function\s*\*?|class)\s+" for language in _SCRIPT} | {"rust": r"\bfn\s+"}


def lexical_names(source: str, language: str) -> set[tuple[str, str]]:
    """registered and nested names of scripts, nested ones of Rust; other languages have none."""
    if language not in _INNER:
        return set()
    code, out = _blank(source, language), set()
    if language in _SCRIPT:
        out |= {("registered", a) for m in _REGISTERS.finditer(code) for x, y in arguments(code, m.end()) if re.fullmatch(_NAME, a := code[x:y].strip())}
    lines = code.split("\n")
    found = [s for s in extract_lexical(source, "m", language)["symbols"] if s["kind"] != "module"]
    inner: dict[tuple[int, int], list[dict]] = {}
    for s in found:
        around = [o for o in found if o is not s and o["start_line"] <= s["start_line"] and s["end_line"] <= o["end_line"] and (o["start_line"], o["end_line"]) != (s["start_line"], s["end_line"])]
        owner = min(around, key=lambda o: o["end_line"] - o["start_line"], default=None)
        if owner and owner["kind"] in ("function", "method") and re.search(_INNER[language] + re.escape(s["name"]) + r"\b", s["signature"]):
            inner.setdefault((owner["start_line"], owner["end_line"]), []).append(s)
    for (first, last), below in inner.items():
        own = {n for s in below for n in range(s["start_line"], s["end_line"] + 1)}
        rest = "\n".join(lines[n - 1] for n in range(first, last + 1) if n not in own)
        out |= {("nested", s["name"]) for s in below if re.search(rf"(?<![\w$.]){re.escape(s['name'])}(?![\w$])", rest)}
    return out


def scan(files: DataFrame) -> DataFrame:
    """(path, category, name) of the Python, script and Rust files of a tree (path, language, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, c, n) for p, g, t in zip(*(x.to_pylist() for x in b.columns), strict=True) for c, n in sorted(protected_names(t or "") if g == "python" else lexical_names(t or "", g))]
            cols = [*zip(*rows, strict=True)] if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", "category", "name"])

    return files.where(F.col("language").isin("python", *_INNER)).select("path", "language", "content").mapInArrow(run, "path string, category string, name string")


def spare(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates with ``protected``: the first category that keeps them alive. Nested names count in their own file."""
    wide = names.where("category <> 'nested'").groupBy("name").agg(F.min("category").alias("wide"))
    own = names.where("category = 'nested'").select(F.col("path").alias("file_path"), "name").distinct().withColumn("own", F.lit("nested"))
    return candidates.join(wide, "name", "left").join(own, ["file_path", "name"], "left").withColumn("protected", F.coalesce("wide", "own")).drop("wide", "own")
