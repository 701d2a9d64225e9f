"""Quality rules by weak supervision.

Each rule looks at one measurement and votes good (2), bad (1) or abstains (0). The votes of a document form one
number in base 3, so the whole corpus shrinks to a table of vote patterns with counts, at most ``3 ** len(RULES)``
rows however large the corpus is. Expectation-maximisation over that table estimates how often each rule casts each
vote on good and on bad documents, with the share of good documents; the posterior of a pattern replaces
"every rule must pass".

Defined results: null or empty text has no words (base_failed, not kept); texts are read whole; repeated rows get the
same verdict; an empty table gives an empty result; columns other than the text and those asked for are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, stage, strings
from .textstats import measure

ABSTAIN, BAD, GOOD = 0, 1, 2

#: name: (value of the measurements, bad below, good from, good to, bad above); between the bounds the rule abstains.
RULES = {
    "symbols_per_word": (lambda s, n: s["n_symbols"] / n, -1.0, 0.0, 0.02, 0.1),
    "symbol_word_share": (lambda s, n: s["n_symbol_words"] / n, -1.0, 0.0, 0.05, 0.2),
    "repeated_share": (lambda s, n: s["n_repeat_words"] / n, -1.0, 0.0, 0.10, 0.35),
    "distinct_share": (lambda s, n: s["n_distinct"] / n * max(1.0, n / 400) ** 0.15, 0.30, 0.50, 9.0, 9.0),
    "longest_run": (lambda s, n: s["n_run"], -1.0, 0.0, 2.0, 4.0),
    "duplicate_lines": (lambda s, n: s["n_dup_lines"] / max(1, s["n_lines"]), -1.0, 0.0, 0.05, 0.35),
    "upper_share": (lambda s, n: s["n_upper"] / max(1, s["n_upper"] + s["n_lower"]), -1.0, 0.0, 0.10, 0.35),
    "shouting_marks": (lambda s, n: s["n_marks"] / n, -1.0, 0.0, 0.05, 0.3),
    "sentence_marks": (lambda s, n: s["n_stops"] / n, 0.02, 0.05, 0.45, 0.8),
    "short_word_share": (lambda s, n: s["n_short"] / n, 0.02, 0.12, 0.75, 0.95),
}
LEVELS = 3 ** len(RULES)


def votes(stats: dict) -> int:
    """The pattern of votes; a text without words abstains throughout."""
    n, code = stats["n_words"], 0
    for value, lo, good_lo, good_hi, hi in RULES.values():
        vote = ABSTAIN
        if n:
            x = value(stats, n)
            vote = BAD if x < lo or x > hi else GOOD if good_lo <= x <= good_hi else ABSTAIN
        code = code * 3 + vote
    return code


def unpack(codes: np.ndarray) -> np.ndarray:
    """(patterns, rules) of votes."""
    return np.stack([codes // 3 ** (len(RULES) - 1 - i) % 3 for i in range(len(RULES))], axis=1)


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over the pattern table.

    Returns the posterior of good for every one of the ``LEVELS`` patterns, P(vote | class) as (class, rule, vote)
    with class 1 good, and the share of good documents. Starts from, and is held with a tenth of the corpus's weight
    to, rules that are better than chance: a bad vote is rare on good documents, a good vote is rarer on bad ones.
    """
    k = len(RULES)
    start = np.empty((2, k, 3))
    start[1] = (0.095, 0.005, 0.90)
    start[0] = (0.15, 0.25, 0.60)
    weight = 0.1 * max(float(counts.sum()), 1.0) * start
    theta, share = start.copy(), 0.85
    v = unpack(codes)
    for _ in range(rounds):
        like = np.stack([np.log(theta[c][np.arange(k), v]).sum(1) for c in (0, 1)], 1) if len(v) else np.zeros((0, 2))
        z = like[:, 1] - like[:, 0] + np.log(share / (1 - share))
        good = counts / (1 + np.exp(-np.clip(z, -500, 500)))
        new = weight.copy()
        for c, w in ((1, good), (0, counts - good)):
            for r in range(k):
                new[c, r] += np.bincount(v[:, r], weights=w, minlength=3)
        new /= new.sum(2, keepdims=True)
        share = float(np.clip((good.sum() + 0.85) / (counts.sum() + 1), 0.01, 0.99))
        if np.abs(new - theta).max() < 1e-9:
            break
        theta = new
    every = unpack(np.arange(LEVELS))
    z = sum((1 if c else -1) * np.log(theta[c][np.arange(k), every]).sum(1) for c in (0, 1)) + np.log(share / (1 - share))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500))), theta, share


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with the base measurements and the vote pattern of each text."""
    docs = docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        for b in batches:
            found = [measure(t) for t in strings(b.column(b.num_columns - 1))]
            own = [pa.array([s[n] for s in found], pa.int64()) for n in names]
            fails = pa.array([base_failed(s["n_words"], s["n_repeat_words"]) for s in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own, fails, pa.array([votes(s) for s in found], pa.int32())], names=[*b.schema.names[:-1], *names, "base_failed", "pattern"])

    return map_arrow(docs, run, f"{kept}n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern int")


def fit(patterns: DataFrame) -> np.ndarray:
    """Posterior by pattern. Only the pattern table (at most ``LEVELS`` rows) reaches the driver."""
    got = patterns.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    return estimate(np.array([r["pattern"] for r in got], np.int64), np.array([r["n"] for r in got], float))[0]


def judged(rows: DataFrame, posterior: np.ndarray, least: float = 0.5) -> DataFrame:
    """Add ``posterior`` and ``kept``. The joined table has at most ``LEVELS`` rows of 12 bytes."""
    spark = rows.sparkSession
    table = spark.createDataFrame(pa.table({"pattern": pa.array(range(LEVELS), pa.int32()), "posterior": posterior}))
    return rows.join(F.broadcast(table), "pattern").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(measured(read_table(spark, sf_dir, "documents")), "rules")
    out = judged(rows, fit(rows))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Reads the texts twice, joins nothing by id."""
    posterior = fit(measured(docs, keep=()))
    verdict = posterior >= least
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = map(measure, strings(b.column(place)))
            yield b.filter(pa.array([not base_failed(s["n_words"], s["n_repeat_words"]) and bool(verdict[votes(s)]) for s in found], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
