"""Requirement markdown and annotations in doc texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SPEC = "spec_id string, title string, status string, operation string, rename_from string, description string, scenarios array<struct<name:string,body:string>>"
_SECTION = re.compile(r"^##\s+(ADDED|MODIFIED|REMOVED|RENAMED)\s+Requirements\s*$", re.I)
_REQUIREMENT = re.compile(r"^###\s+Requirement:\s*(.+?)\s*$", re.I)
_SCENARIO = re.compile(r"^####\s+Scenario:\s*(.+?)\s*$", re.I)
_RENAME = re.compile(r"^\s*[-*]?\s*(FROM|TO):\s*`?(?:###\s+Requirement:\s*)?(.+?)`?\s*$", re.I)
#: Verbs of annotations and what they say. Fixed values.
RELATIONS = {"spec": "implements", "implement": "implements", "implements": "implements", "test": "tests", "tests": "tests", "covers": "tests", "cover": "tests", "see": "references", "reference": "references", "references": "references"}
#: Verbs that take a spec back, and words that deny a mention. Fixed values.
RETRACTIONS = ("not_spec", "!spec")
DENIALS = ("cannot", "can't", "doesn't", "fixme", "isn't", "never", "no", "not", "shouldn't", "skip", "todo", "without", "won't", "wouldn't")
#: Verbs that prose may use for a mention; annotation lines may use all but these last two.
PROSE_ONLY = ("cover", "covers")


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def _prose(text: str) -> Iterator[tuple[str, bool]]:
    """Lines, and whether they stand outside fenced code."""
    fence = None
    for line in text.splitlines():
        mark = line.lstrip()[:3]
        if fence is None and mark in ("```", "~~~"):
            fence = mark
            yield line, False
        elif fence:
            yield line, False
            fence = None if mark == fence else fence
        else:
            yield line, True


def scenarios(description: str) -> list[dict]:
    """Named blocks under scenario headings, the first of each name."""
    found: dict[str, list[str]] = {}
    now = None
    for line, prose in _prose(description):
        m = _SCENARIO.match(line) if prose else None
        if m:
            now = found.setdefault(m[1], []) if m[1] not in found else []
        elif prose and re.match(r"^#{2,4}\s", line.lstrip()):
            now = None
        elif now is not None:
            now.append(line)
    return [{"name": k, "body": "\n".join(v).strip()} for k, v in found.items()]


def parse_specs(text: str, capability: str | None = None) -> list[dict]:
    """Requirements in page order; delta sections give operation and status."""
    out: list[dict] = []
    operation, now, old = None, None, None
    name_of = lambda title: "-".join(x for x in (slug(capability or ""), slug(title)) if x)
    for line, prose in _prose(text):
        section, heading = (_SECTION.match(line.rstrip()), _REQUIREMENT.match(line)) if prose else (None, None)
        rename = _RENAME.match(line) if prose and operation == "renamed" else None
        if section:
            operation, now, old = section[1].lower(), None, None
        elif rename:
            if rename[1].upper() == "FROM":
                old = rename[2]
            elif old is not None:
                out.append({"spec_id": name_of(rename[2]), "title": rename[2], "status": "active", "operation": "renamed", "rename_from": old, "lines": []})
                old = None
        elif heading:
            now = {"spec_id": name_of(heading[1]), "title": heading[1], "status": "deprecated" if operation == "removed" else "active", "operation": operation, "rename_from": None, "lines": []}
            out.append(now)
        elif prose and re.match(r"^#{2,3}\s", line):
            now = None
        elif now is not None:
            now["lines"].append(line)
    for s in out:
        s["description"] = "\n".join(s.pop("lines")).strip()
        s["scenarios"] = scenarios(s["description"])
    return out


def _claim(line: str) -> tuple[str, list[str], float] | None:
    """(verb, ids, confidence) of an annotation line such as ``# @tests: a, b : 0.8``; None for other lines."""
    head, at, rest = line.strip().lstrip("#*").strip().partition("@")
    if head or not at:
        return None
    size = next((i for i, c in enumerate(rest) if c in ":= \t"), len(rest))
    verb, rest = rest[:size].lower(), rest[size:].strip().lstrip(":=").strip()
    if verb not in RETRACTIONS and (verb not in RELATIONS or verb in PROSE_ONLY) or not rest:
        return None
    front, colon, back = rest.rpartition(":")
    sure = 1.0
    if colon:
        try:
            sure = float(back)
        except ValueError:
            front = rest
        else:
            if not 0 < sure <= 1:
                front, sure = rest, 1.0
    else:
        front = rest
    return verb, front.replace(",", " ").split(), sure


_MARKS = ".,;:!?()[]\"'`"


def _mentions(text: str, window: int = 12) -> Iterator[tuple[str, str]]:
    """(verb, word after it) wherever prose uses a verb of a relation that no word within ``window`` characters before it
    denies."""
    words = list(re.finditer(r"\S+", text))
    for m, following in zip(words, words[1:], strict=False):
        verb = m[0].strip(_MARKS).lower()
        if verb in RELATIONS and verb not in ("spec", "see"):
            before = re.split(r"[^\w']+", text[max(0, m.start() - window) : m.start()].lower())
            if not any(w in DENIALS for w in before):
                yield verb, following[0].strip(_MARKS)


def annotations(text: str | None, known: dict[str, str]) -> list[dict]:
    """(spec_id, relation, confidence) of ids in ``known`` (folded id to id): annotation lines at 1.0 or as given,
    mentions in prose at 0.7. A retracted id has none."""
    hits: dict[tuple[str, str], float] = {}
    denied, prose = set(), []
    for line in (text or "").splitlines():
        claim = _claim(line)
        if claim is None:
            prose.append(line)
            continue
        ids = [known[w.casefold()] for w in claim[1] if w.casefold() in known]
        if claim[0] in RETRACTIONS:
            denied.update(ids)
            continue
        for i in ids:
            hits.setdefault((i, RELATIONS[claim[0]]), claim[2])
    for verb, word in _mentions("\n".join(prose)):
        i = known.get(word.casefold())
        if i:
            hits.setdefault((i, RELATIONS[verb]), 0.7)
    return [{"spec_id": i, "relation": r, "confidence": c} for (i, r), c in hits.items() if i not in denied]


def candidate_ids(text: str | None) -> list[str]:
    """Folded words that ``annotations`` would look up, each once."""
    found, prose = [], []
    for line in (text or "").splitlines():
        claim = _claim(line)
        if claim is None:
            prose.append(line)
        else:
            found += [w.casefold() for w in claim[1]]
    found += [w.casefold() for _, w in _mentions("\n".join(prose))]
    return list(dict.fromkeys(found))


def parsed(files: DataFrame) -> DataFrame:
    """Every requirement of markdown files (path, content, capability), ``at`` its place in its file."""
    scenario = pa.list_(pa.struct([("name", pa.string()), ("body", pa.string())]))
    arrow = pa.schema([("path", pa.string()), ("capability", pa.string()), ("at", pa.int32()), *((k, pa.string()) for k in ("spec_id", "title", "status", "operation", "rename_from", "description")), ("scenarios", scenario)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p, "capability": c, "at": i, **s} for p, t, c in zip(*(x.to_pylist() for x in b.columns), strict=True) for i, s in enumerate(parse_specs(t or "", c))]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content", "capability").mapInArrow(run, f"path string, capability string, at int, {SPEC}")


def read_specs(files: DataFrame) -> DataFrame:
    """Requirements of markdown files (path, content, capability); of equal ids the last path's last wins."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    order = Window.partitionBy("spec_id").orderBy(F.desc("path"), F.desc("at"))
    return parsed(files).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


#: Prose files of a change package. Fixed values.
PROSE = ("proposal", "design", "tasks")


def read_changes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, deltas) of a spec tree's markdown (path, content, capability).

    packages: folder, change, status, proposal, design, tasks (null without that file). deltas: folder, change, ordinal
    and the requirement, rename_from as an id; one outside a delta section counts as added. A package lies in ``changes/<name>`` (proposed), in
    ``changes/archive/<name>`` or in ``archive/<name>`` (archived); a folder without markdown is none.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ..functions.text import slug as as_slug

    folder = F.regexp_extract("path", "^((?:changes/)?archive/[^/]+|changes/(?!archive/)[^/]+)/", 1)
    f = files.withColumn("folder", folder).where("folder <> ''")
    rest = F.expr("substring(path, length(folder) + 2)")
    text = [F.max(F.when(rest == f"{p}.md", F.col("content"))).alias(p) for p in PROSE]
    status = F.when(F.col("folder").rlike("^(changes/)?archive/"), "archived").otherwise("proposed")
    change = F.element_at(F.split("folder", "/"), -1)
    packages = f.groupBy("folder").agg(*text).select("folder", change.alias("change"), status.alias("status"), *PROSE)
    own = F.when(F.col("capability") != "specs", F.col("capability"))
    rows = parsed(f.where(rest.startswith("specs/")).withColumn("capability", own)).withColumn("folder", folder)
    nth = F.row_number().over(Window.partitionBy("folder").orderBy("path", "at"))
    # the source of a rename is told by its title; its id follows as any requirement's does
    part = lambda c: F.nullif(as_slug(F.col(c)), F.lit(""))
    source = F.when(F.col("rename_from").isNotNull(), F.concat_ws("-", part("capability"), part("rename_from")))
    deltas = rows.select("folder", change.alias("change"), nth.alias("ordinal"), "path", "capability", "spec_id", "title", F.coalesce("operation", F.lit("added")).alias("operation"), source.alias("rename_from"), "description", "scenarios")
    return packages, deltas


def linked(texts: DataFrame, specs: DataFrame) -> DataFrame:
    """(id, spec_id, relation, confidence) of annotated texts (id, text). Candidate ids are joined with the specs'."""
    from pyspark.sql import functions as F

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [candidate_ids(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], names=["id", "text", "asked"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("id", pa.int64()), ("spec_id", pa.string()), ("relation", pa.string()), ("confidence", pa.float64())])
        for b in batches:
            rows = [{"id": i, **h} for i, t, k in zip(*(x.to_pylist() for x in b.columns), strict=True) for h in annotations(t, {x["f"]: x["spec_id"] for x in k})]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    rows = texts.select("id", "text").mapInArrow(ask, "id long, text string, asked array<string>").where(F.size("asked") > 0)
    ids = specs.groupBy(F.lower("spec_id").alias("f")).agg(F.min("spec_id").alias("spec_id"))
    known = rows.select("id", F.explode("asked").alias("f")).join(ids, "f").groupBy("id").agg(F.collect_list(F.struct("f", "spec_id")).alias("known"))
    return rows.join(known, "id").select("id", "text", "known").mapInArrow(answer, "id long, spec_id string, relation string, confidence double")
