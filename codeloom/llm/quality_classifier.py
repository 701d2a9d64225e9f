"""Quality classifier by positive-unlabelled learning.

Trusted positives P are texts labelled 1; the unlabelled set U is web text taken without looking at labels. With class
prior p the risk of a scorer g is estimated without negatives as

    p * R_P(g, +1) + max(0, R_U(g, -1) - p * R_P(g, -1))

(the non-negative unbiased estimator). g is a one-hidden-layer network over measurements of the whole text, trained in
numpy; when the bracket turns negative the step goes against it, as the estimator prescribes. The prior is estimated
from P and U alone: over thresholds of a first scorer that tells P from U, the smallest ratio of survival shares
U / P, with a binomial margin (a positive never scores lower than unlabelled text by more than the prior allows).

Only a bounded sample of rows (``SAMPLE`` of each kind, by hash order) is used to fit; scoring reads every text.

Defined results: null and empty texts get a score from their zero measurements; ties and repeated rows score alike; an
empty table scores nothing; without positives the score is 0.5 everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, stage, strings
from .textstats import FIELDS, measure

#: Most rows of each kind that are gathered to fit.
SAMPLE = 20_000
CUT = 0.3


def features(m: np.ndarray) -> np.ndarray:
    """(rows, features) from rows of ``FIELDS``."""
    c = {f: m[:, i].astype(float) for i, f in enumerate(FIELDS)}
    n, letters = np.maximum(c["n_words"], 1), np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.stack([
        np.log1p(c["n_words"]), np.minimum(c["word_chars"] / n, 20), np.minimum(c["n_symbols"] / n, 3), c["n_repeat_words"] / n,
        c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_distinct"] / n, np.log1p(c["n_run"]), c["n_top"] / n, c["n_upper"] / letters,
        np.minimum(c["n_marks"] / n, 2), np.minimum(c["n_stops"] / n, 2), c["n_short"] / n, np.minimum(c["n_digits"] / n, 2),
        np.log1p(n / np.maximum(c["n_lines"], 1)), (c["n_words"] < 1) * 1.0, (c["n_words"] < 50) * 1.0,
    ], axis=1)


class Net:
    """One hidden layer of tanh units; a plain callable on features."""

    def __init__(self, x: np.ndarray, hidden: int = 24, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.w = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, 0.1, hidden), np.zeros(1)]
        self.m = [np.zeros_like(p) for p in self.w]
        self.v = [np.zeros_like(p) for p in self.w]
        self.t = 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float = 3e-3) -> None:
        """One Adam step; slope: of the risk by each row's output."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.w[0] + self.w[1])
        back = slope[:, None] * self.w[2] * (1 - h * h)
        self.t += 1
        for i, g in enumerate((z.T @ back, back.sum(0), h.T @ slope, slope.sum(keepdims=True))):
            g = g + 1e-5 * self.w[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.w[i] = self.w[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in ``u`` by the least ratio of survival shares over cuts that keep enough positives."""
    cuts = np.quantile(p, np.linspace(0, 0.9, 91))
    sp, su = (np.array([(x >= c).mean() for c in cuts]) for x in (p, u))
    margin = np.sqrt(np.log(2 * len(cuts)) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    return float(np.clip(((su + margin / 2) / sp).min(), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 30, batch: int = 512, seed: int = 11) -> tuple[Net, float]:
    """The trained scorer and the estimated class prior."""
    r = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    first = Net(both, 16)
    for _ in range(10 * max(1, len(both) // batch)):
        a, b = positive[r.integers(0, len(positive), batch)], unlabelled[r.integers(0, len(unlabelled), batch)]
        x, y = np.concatenate([a, b]), np.repeat([1.0, 0.0], batch)
        first.step(x, (sigmoid(first(x)) - y) / len(x))
    prior = class_prior(first(positive), first(unlabelled))
    net = Net(both)
    for _ in range(rounds * max(1, len(both) // batch)):
        a, b = positive[r.integers(0, len(positive), batch)], unlabelled[r.integers(0, len(unlabelled), batch)]
        ga, gb = net(a), net(b)
        pa_, pb = sigmoid(ga), sigmoid(gb)
        # logistic losses: -log(s) for +1, -log(1 - s) for -1
        rest = np.logaddexp(0, gb).mean() - prior * np.logaddexp(0, ga).mean()
        if rest >= 0:
            slope = np.concatenate([prior * (pa_ - 1) / batch - prior * pa_ / batch, pb / batch])
        else:  # undo the overfit part
            slope = np.concatenate([prior * pa_ / batch, -pb / batch])
        net.step(np.concatenate([a, b]), slope)
    return net, prior


def fold(column: str, mod: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(measure(t).values()) for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "m"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, m array<long>")


def sampled(rows: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """Features of at most ``most`` rows, the same ones at every run: those of least hash.

    A hash range that holds them with a margin is cut out first, so tasks don't each send ``most`` rows.
    """
    n = rows.count()
    hashed = rows.select("m", F.xxhash64("doc_id", "m").alias("h"))
    if n > 4 * most:
        hashed = hashed.where(F.col("h") < F.lit(int(-(2**63) + 2**64 * min(1.0, 1.5 * most / n))))
    got = hashed.orderBy("h").limit(most).collect()
    return features(np.array([r["m"] for r in got], np.int64).reshape(-1, len(FIELDS)))


def train(rows: DataFrame, labels: DataFrame) -> Net | None:
    """rows: doc_id and m of the training fold; labels: doc_id and quality."""
    trusted = labels.where("quality = 1").select("doc_id").distinct()
    marked = labels.where("quality is not null").select("doc_id").distinct()
    p = sampled(rows.join(trusted, "doc_id", "left_semi"))
    u = sampled(rows.join(marked, "doc_id", "left_anti"))
    if not len(p):
        return None
    return fit(p, u if len(u) else p)[0]


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(measured(read_table(spark, sf_dir, "documents")), "quality")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    net = train(rows.where(~held), labels.where(fold("doc_id", 5) != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(np.array(b.column(2).to_pylist(), np.int64).reshape(-1, len(FIELDS)))
            s = sigmoid(net(x)) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(rows.select("doc_id", held.alias("held_out"), "m"), run, "doc_id long, held_out boolean, score double, predicted int")
