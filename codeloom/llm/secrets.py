"""Secret scans: patterns, and a randomness test battery with false-discovery control.

Base spans come from three patterns. The method adds spans of kind ``random``: runs of token characters that look
drawn uniformly from their inferred encoding and that natural text would hardly produce.

* Battery. A run's encoding (hex, base32, base36, base62, base64 ...) is the narrowest that holds all its characters.
  Under "uniform over that encoding" three p-values are made: chi-squared of the character counts (Wilson-Hilferty),
  a runs test above / below the middle of the alphabet, and the lag-1 serial correlation of the character indices.
  A run whose Fisher combination is under ``ALPHA`` is not random.
* False discoveries. Under "natural text" a run's p-value is the likelihood ratio P(run | corpus letter pairs) /
  P(run | uniform), at most 1 (Markov's inequality makes it a valid p-value). Evidence therefore grows with length,
  and p-values are weighted by length: a run of n characters is weighted n / mean length. Benjamini-Hochberg at ``Q``
  over all runs of the corpus gives the threshold, from a histogram of -log10 p on a fixed grid (p rounded up, so the
  level holds).

Letter pairs, run counts and thresholds come from every row. Defined results: null text is empty; empty texts have no
span; repeated rows have the same spans; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, stage, strings

#: Base patterns. Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHA, Q, STEP, BINS = 0.005, 0.001, 0.05, 1200
CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from narrow to wide.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
_PLACE = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three patterns, in order."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def encoding(run: str) -> str | None:
    """The narrowest encoding; None without both a digit and a letter or mixed case (numbers and plain words)."""
    own = frozenset(run)
    digit, upper, lower = bool(own & _SETS["hex"] & frozenset(_DIGITS)), bool(own & frozenset(_UPPER)), bool(own & frozenset(_LOWER))
    if digit + upper + lower < 2:
        return None
    return next((k for k, s in _SETS.items() if own <= s), None)


def chi_squared_p(x: np.ndarray, k: int) -> float:
    d = k - 1
    s = float(((np.bincount(x, minlength=k) - len(x) / k) ** 2).sum() * k / len(x))
    z = ((s / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs_p(x: np.ndarray, k: int) -> float:
    high = x >= k / 2
    a, n = int(high.sum()), len(x)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 2 * a * b / n + 1
    var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    return math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0


def serial_p(x: np.ndarray, k: int) -> float:
    y = x - (k - 1) / 2
    n = len(y) - 1
    r = float((y[1:] * y[:-1]).sum()) / ((k * k - 1) / 12 * math.sqrt(n))
    return math.erfc(abs(r) / math.sqrt(2))


def battery(run: str, code: str) -> float:
    """Fisher's combination of the three tests, as a p-value under uniformity."""
    x, k = np.array([_PLACE[code][c] for c in run]), len(ENCODINGS[code])
    s = -sum(math.log(max(p, 1e-300)) for p in (chi_squared_p(x, k), runs_p(x, k), serial_p(x, k)))
    return math.exp(-s) * (1 + s + s * s / 2)


def random_runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Runs clear of the base spans that the battery doesn't reject: (start, end, characters)."""
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        run = m[0].rstrip("=")
        if len(run) < 16 or any(s < b and a < e for s, _, e in base):
            continue
        code = encoding(run)
        if code and battery(run, code) >= ALPHA:
            out.append((a, b, run))
    return out


_CLASS = np.full(256, len(CLASSES), np.int64)
_CLASS[np.frombuffer(CLASSES.encode(), np.uint8)] = np.arange(len(CLASSES))
N_CLASSES = len(CLASSES) + 1


def pairs(text: str) -> np.ndarray:
    """Counts of neighbouring character classes."""
    x = _CLASS[np.frombuffer(text.encode(), np.uint8)]
    return np.bincount(x[:-1] * N_CLASSES + x[1:], minlength=N_CLASSES**2) if len(x) > 1 else np.zeros(N_CLASSES**2, np.int64)


@dataclass
class Model:
    """What the whole corpus decides: log10 letter-pair probabilities, mean run length, and the cut on the grid."""

    pair: np.ndarray
    mean_length: float
    cut: int

    def level(self, run: str) -> int:
        """-log10 of the weighted natural-text p-value, on the grid, rounded down."""
        x = _CLASS[np.frombuffer(run.encode(), np.uint8)]
        natural = float(self.pair[x[:-1], x[1:]].sum())
        uniform = -(len(run) - 1) * math.log10(len(ENCODINGS[encoding(run)]))
        p = max(0.0, uniform - natural) + math.log10(len(run) / self.mean_length)
        return int(min(BINS - 1, max(0.0, p) / STEP))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        base = base_spans(text)
        return sorted(base + [(a, 3, b) for a, b, run in random_runs(text, base) if self.level(run) >= self.cut])


def scanned(docs: DataFrame, doc_id: str | None = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its base spans and runs; with a row's pair counts on the last row of each batch."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id") if doc_id else F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, base, runs, total = b.column(0), [], [], np.zeros(N_CLASSES**2, np.int64)
            for t in strings(b.column(1)):
                total += pairs(t)
                spans = base_spans(t)
                base.append([{"s": s, "k": k, "e": e} for s, k, e in spans])
                runs.append([{"s": s, "e": e, "r": r} for s, e, r in random_runs(t, spans)])
            seen = np.flatnonzero(total)
            counts = [None] * len(base)
            if counts:
                counts[-1] = [{"c": int(i), "n": int(total[i])} for i in seen]
            span = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
            cand = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("r", pa.string())]))
            tab = pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(base, span), pa.array(runs, cand), pa.array(counts, tab)], names=["doc_id", "base", "runs", "counts"])

    return map_arrow(docs, run, "doc_id long, base array<struct<s:int,k:int,e:int>>, runs array<struct<s:int,e:int,r:string>>, counts array<struct<c:int,n:long>>")


def fit(rows: DataFrame) -> Model:
    """rows: of ``scanned``. The driver gets at most 67 ** 2 pair counts and ``BINS`` grid counts."""
    got = rows.where("counts is not null").select(F.explode("counts").alias("p")).groupBy("p.c").agg(F.sum("p.n").alias("n")).collect()
    table = np.full(N_CLASSES**2, 0.5)
    for r in got:
        table[r["c"]] += r["n"]
    table = table.reshape(N_CLASSES, N_CLASSES)
    pair = np.log10(table / table.sum(1, keepdims=True))
    runs = rows.select(F.explode("runs").alias("r")).select("r.r")
    mean = runs.agg(F.avg(F.length("r"))).first()[0] or 16.0
    model = Model(pair, float(mean), BINS)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"level": pa.array([model.level(r) for r in b.column(0).to_pylist()], pa.int32())})

    per = np.zeros(BINS)
    for r in map_arrow(runs, levels, "level int").groupBy("level").agg(F.count("*").alias("n")).collect():
        per[r["level"]] = r["n"]
    above = per[::-1].cumsum()[::-1]  # runs at each level or beyond
    ok = np.flatnonzero((above > 0) & (10.0 ** (-STEP * np.arange(BINS)) <= Q * above / max(1.0, per.sum())))
    model.cut = int(ok[0]) if len(ok) else BINS
    return model


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(scanned(read_table(spark, sf_dir, "documents")), "secrets")
    model = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans = [(x["s"], x["k"], x["e"]) for x in base]
                kinds = [k for _, k, _ in spans]
                added = [(x["s"], 3, x["e"]) for x in runs if model.level(x["r"]) >= model.cut]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(spans).encode()).hexdigest(), written(spans + added), len(added)))
            cols = [*zip(*out, strict=True)] if out else [[]] * 6
            kind = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kind, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return map_arrow(rows.select("doc_id", "base", "runs"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """All rows and columns of ``docs``; every span (overlaps merged) in the text becomes ``mark``, n_chars follows."""
    model = fit(stage(scanned(docs, None, text), "secrets"))
    names, schema = docs.columns, docs.schema
    place, size = names.index(text), names.index("n_chars") if "n_chars" in names else None

    def clean(t: str) -> str:
        spans, out, at = model.spans(t), [], 0
        for a, _, b in spans:
            if a >= at:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join([*out, t[at:]]) if spans else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(place).to_pylist()
            new = [t and clean(t) for t in old]
            cols = list(b.columns)
            cols[place] = pa.array(new, cols[place].type)
            if size is not None:
                cols[size] = pa.array([n if a == t or t is None else len(t) for n, a, t in zip(cols[size].to_pylist(), old, new, strict=True)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return map_arrow(docs, run, schema)
