"""Shared helpers: input tables, staged tables, Arrow plumbing and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` splits on exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
LOWER_AZ = {i: i + 32 for i in range(65, 91)}
#: Widest table a driver may hold or broadcast without looking for another way.
SMALL_ROWS = 100_000
#: Most edges that one task takes up (about 100 MB in Python).
ONE_TASK = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, one of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(there)
    return files.makeQualified(there).toString()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage, survives lost executors and is columnar."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: whole texts can be long, and a batch is held several times over on its way.
BATCH_ROWS = "1000"


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(f, schema)


def strings(column) -> list[str]:
    """A batch's text column as Python strings; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def ensure_columns(df: DataFrame, *names: str) -> DataFrame:
    """Select by name, so extra columns (also ones with clashing names) never get in the way."""
    return df.select(*(F.col(n) for n in names))


def commonest(counts: DataFrame, value: str, most: int) -> list[tuple]:
    """(value, n) from a count up, as low as leaves at most ``most`` of them, in order of count.

    The driver sees bins of counts and those rows; no task sends more than its share of them. counts: value, n.
    """
    step = F.floor(F.log2("n") * 32)
    bins = sorted(((r["b"], r["k"]) for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = None, 0
    for b, k in bins:
        if total + k > most:
            break
        least, total = b, total + k
    if least is None:
        return []
    return sorted(((r[0], r[1]) for r in counts.where(step >= least).select(value, "n").collect()), key=lambda x: (-x[1], x[0]))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.random.default_rng(77).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.cumprod(np.append(np.ones(1, np.uint64), np.full(63, 0x9E3779B97F4A7C15, np.uint64)), dtype=np.uint64)


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of each word (run of anything but ASCII white space), all words of a text at once."""
    global _POWERS
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    if not len(b) or space.all():
        return np.empty(0, np.uint64)
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    b, space, first = b[first[0] :], space[first[0] :], first - first[0]
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    top = int(place.max()) + 1
    if top > len(_POWERS):
        _POWERS = np.cumprod(np.append(np.ones(1, np.uint64), np.full(2 * top, 0x9E3779B97F4A7C15, np.uint64)), dtype=np.uint64)
    v = _BYTE[b] * _POWERS[place]
    v[space] = 0
    return mix64(np.add.reduceat(v, first))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= h[i : len(h) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return mix64(out)


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up, path = self.up, []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition to stars around each part's least node, in bounded bites."""
    forest, held = Forest(), 0

    def out():
        nodes = [x for x in forest.up if forest.find(x) != x]
        return pa.RecordBatch.from_pydict({"a": pa.array(nodes, pa.int64()), "b": pa.array([forest.find(x) for x in nodes], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        held += batch.num_rows
        if held > 2_000_000:
            yield out()
            forest, held = Forest(), 0
    yield out()


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, nodes = Forest(), set()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
            nodes.update((a, b))
    every = list(nodes)
    for lo in range(0, len(every), 100_000):
        some = every[lo : lo + 100_000]
        yield pa.RecordBatch.from_pydict({"node": pa.array(some, pa.int64()), "root": pa.array([forest.find(x) for x in some], pa.int64())})


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): the least node reachable over ``edges`` (a, b), for every node that has an edge to another.

    Each partition first shrinks its edges to a spanning star forest. What is left is finished by one task's union-find
    if it has at most ``one_task`` edges. Beyond that, large-star and small-star rounds alternate over staged tables:
    all steps are equi-joins and minima per node, so nothing is gathered in one task or on the driver but a count.
    """
    e = stage(map_arrow(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), _contract, "a long, b long"), "cc")
    if e.count() <= one_task:
        return stage(map_arrow(e.coalesce(1), _roots, "node long, root long"), "cc")
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m")).where("x <> m").distinct()
        n = stage(small.select(F.col("x").alias("a"), F.col("m").alias("b")), "cc")
        # stars with one parent each whose parents are roots: done
        got = n.groupBy("a").agg(F.count("*").alias("n"))
        if got.where("n > 1").isEmpty() and n.join(n.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return n.select(F.col("a").alias("node"), F.col("b").alias("root")).union(n.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        e = n
