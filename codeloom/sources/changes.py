"""Git changes, log redaction, URL templates: small driver-side parsers."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

SECRET_KEYS = re.compile(r"(?i)(token|secret|password|passwd|api_?key|authorization)")


def parse_name_status(text: str) -> list[tuple[str, str]]:
    """(status, path) of ``git diff --name-status``; a rename gives its old and its new path."""
    out = []
    for line in text.splitlines():
        status, *paths = line.split("\t")
        out += [(status[:1], p) for p in paths if p]
    return out


def git_changes(spark: SparkSession, root: str, base: str = "HEAD~1", head: str = "HEAD") -> DataFrame:
    done = subprocess.run(["git", "-C", root, "diff", "--name-status", "-M", base, head], capture_output=True, text=True, timeout=60, check=True)
    return spark.createDataFrame(parse_name_status(done.stdout), "status string, path string")


def redact(value, root: str = ""):
    """A call's arguments with secrets masked and the workspace's root cut from paths."""
    if isinstance(value, dict):
        return {k: "***" if SECRET_KEYS.search(str(k)) else redact(v, root) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redact(v, root) for v in value]
    return value.replace(root, ".") if root and isinstance(value, str) else value


def template_path(raw: str, most: int = 2000) -> str | None:
    """The path of a URL template: a leading ``${...}`` is the host, any other becomes ``{}``; braces may nest."""
    out, i, head = [], 0, True
    while i < min(len(raw), most):
        if raw.startswith("${", i):
            depth, j = 1, i + 2
            while j < len(raw) and depth:
                depth += (raw[j] == "{") - (raw[j] == "}")
                j += 1
            if depth:
                return None
            out.append("" if head else "{}")
            i = j
        else:
            out.append(raw[i])
            i += 1
        head = False
    text = re.sub(r"(?:\{\}){2,}", lambda m: "/".join(["{}"] * (len(m[0]) // 2)), "".join(out))
    return text if text.startswith("/") or re.match(r"[a-z]+://", text) else None


def payload_warning(count: int, limit: int, item_bytes: int = 400, most: int = 500 * 1024) -> str | None:
    """A hint if a page would be large or cut."""
    if count * item_bytes > most:
        return f"about {count * item_bytes // 1024} KiB; ask for a summary or a smaller page"
    return f"{count} results, the page holds {limit}" if count > limit else None
