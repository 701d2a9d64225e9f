"""Python bodies as streams of syntax: the same for copies whose names were changed."""

from __future__ import annotations

import ast
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import generic_tokens


def _tree(source: str) -> ast.AST | None:
    """The body as it stands, else without its common indent (a method cut out of its class); None if neither parses."""
    for text in (source, textwrap.dedent(source)):
        try:
            return ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    return None


def syntax_tokens(source: str) -> list[str] | None:
    """One token a node, parents first. A name is told by where it was first met, an attribute by itself, a constant by its
    type. A function's own name, its decorators and its defaults say nothing. None for what isn't Python."""
    tree = _tree(source)
    if tree is None:
        return None
    out, slots, waiting = [], {}, [tree]
    while waiting:
        node = waiting.pop()
        kind, below = type(node).__name__, ()
        if isinstance(node, ast.Name):
            kind = f"name {slots.setdefault(node.id, len(slots))}"
        elif isinstance(node, ast.arg):
            kind = f"argument {slots.setdefault(node.arg, len(slots))}"
        elif isinstance(node, ast.Attribute):
            kind, below = f"attribute {node.attr}", (node.value,)
        elif isinstance(node, ast.Constant):
            kind = f"constant {type(node.value).__name__}"
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind, below = "function", (*node.args.args, *node.body)
        else:
            below = ast.iter_child_nodes(node)
        out.append(kind)
        waiting.extend(reversed([*below]))
    return out


def code_tokens(bodies: DataFrame) -> DataFrame:
    """(id, tokens) of bodies (id, body, language): syntax for Python, words and signs for all else and for what doesn't
    parse. One Arrow pass; a null body has no tokens."""
    kind = bodies.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [syntax_tokens(t or "") if g == "python" else None for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))], names=["id", "body", "syntax"])

    read = bodies.select("id", "body", "language").mapInArrow(run, f"id {kind}, body string, syntax array<string>")
    plain = F.coalesce(generic_tokens(F.col("body")), F.array().cast("array<string>"))
    return read.select("id", F.coalesce("syntax", plain).alias("tokens"))
