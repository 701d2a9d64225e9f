"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``points`` places on a ring of 64-bit hashes. A key (the rows of one text) belongs to the first place
clockwise of its hash. Under the law ``bytes`` a shard is full once it holds ``1 + slack`` times the mean; keys that come
later go on clockwise to the next shard that isn't. So no shard holds more than that and the rest of one batch, and only
the keys of full shards move.

"Later" has a meaning without a sequence: keys come in an order of their own, heavy ones first, then by a second hash,
in batches that shrink with what is left. Within a batch the full shards are those at its start. Which shards fill up when
follows from the bytes of each (arc of the ring, batch), at most ``shards * points`` times some 700 numbers, on the
driver. The answer is a table (state, arc, shard) with at most one more state than shards, joined to the rows by
broadcast. Nothing else is gathered, no key's rows are brought together, and texts are read once.

A key weighs what the rows of its text weigh together, if that is more than the slack of a shard (there are at most
``shards / slack`` such texts), else what its row weighs. A text with more than ``SPLIT`` of a shard's mean is no key as
a whole: its rows are dealt over as many keys as its bytes need, by doc_id, and where one doc_id alone has that much, row
by row. All other rows of one text stay in one shard.

Under the law ``key`` the ring takes doc_id as key and has no bound: doc_id and the number of shards decide, and one more
shard takes rows only into itself; ``grown_shard`` says which.

Slots count up from 0 within a shard: places within a written part, on top of the counts of the parts before it.

Cases: a null text has no bytes and counts 1; null ids are one id. Repeated rows count each and have slots of their own.
Two texts of one hash share a key. Fewer rows than shards leave shards empty; an empty table gives no rows. Other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, map_arrow, mix64, read_table, stage

#: Places on the ring: of each shard, and of all shards at least.
POINTS, RING = 16, 1024
#: A shard is full at this share above the mean.
SLACK = 0.002
#: The most of a shard's mean that one key may have.
SPLIT = 0.05
#: A batch is this part of what is left, and a quarter of a shard's slack at least.
PART = 64
#: Steps of the second hash within a power of two of the sizes.
STEPS = 1024
CLASSES = 64
_SHARD, _POINT, _SALT, _PLACE, _ORDER = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))


def ring(shards: int, points: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in order, and whose they are. A shard's places don't depend on the number of shards."""
    points = points or max(POINTS, RING // shards)
    shard, point = np.repeat(np.arange(shards, dtype=np.uint64), points), np.tile(np.arange(points, dtype=np.uint64), shards)
    places = mix64(mix64((shard + np.uint64(1)) * _SHARD) ^ ((point + np.uint64(1)) * _POINT))
    order = np.argsort(places)
    return places[order], shard[order].astype(np.int32)


def arcs(key: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Index of the first place clockwise of each key."""
    return (np.searchsorted(places, mix64(key ^ _PLACE)) % len(places)).astype(np.int32)


def cells(key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Order of the keys: heavier ones (by powers of two) first, then by a second hash."""
    power = np.frexp(weight.astype(np.float64))[1]
    return ((CLASSES - power) * STEPS + (mix64(key ^ _ORDER) >> np.uint64(54)).astype(np.int64)).astype(np.int32)


def clockwise(owner: np.ndarray, full: set[int]) -> np.ndarray:
    """Shard of each arc: that of its place or of the next place whose shard isn't full."""
    open_ = np.flatnonzero(~np.isin(owner, list(full)))
    return owner[open_[np.searchsorted(open_, np.arange(len(owner))) % len(open_)]]


def batches_of(sizes: np.ndarray, least: float) -> np.ndarray:
    """Batch of each cell, from the bytes of the cells in order."""
    out, left, held, b = np.zeros(len(sizes), np.int32), int(sizes.sum()), 0, 0
    for i, s in enumerate(sizes.tolist()):
        out[i] = b
        held += s
        if held >= max(left / PART, least):
            left, held, b = left - held, 0, b + 1
    return out


def fill(arc: np.ndarray, batch: np.ndarray, size: np.ndarray, owner: np.ndarray, most: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """State of each batch, and the shard of each arc in each state."""
    shards = int(owner.max()) + 1
    load, full, states, state = np.zeros(shards), set(), [clockwise(owner, set())], np.zeros(int(batch.max(initial=-1)) + 1, np.int32)
    order = np.argsort(batch, kind="stable")
    ends = np.searchsorted(batch[order], np.arange(len(state) + 1))
    for b in range(len(state)):
        state[b] = len(states) - 1
        these = order[ends[b] : ends[b + 1]]
        load += np.bincount(states[-1][arc[these]], size[these], shards)
        now = set(np.flatnonzero(load >= most).tolist())
        if now != full and len(now) < shards:
            full = now
            states.append(clockwise(owner, full))
    return state, states


def _keyed(batches: Iterator[pa.RecordBatch], places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id, size, text_crc32 with arc and cell from key, salt and weight."""
    for batch in batches:
        key = batch.column(3).to_numpy().astype(np.uint64) ^ (batch.column(4).to_numpy().astype(np.uint64) * _SALT)
        more = {"arc": arcs(key, places), "cell": cells(key, batch.column(5).to_numpy())}
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, more.values())], names=["doc_id", "size", "text_crc32", *more])


def salted(rows: DataFrame, slack: float, most: float) -> DataFrame:
    """Add salt and weight. Texts with more than ``slack`` bytes in all weigh that; those with more than ``most`` are dealt
    over several keys by their salt."""
    heavy = rows.groupBy("k").agg(F.sum("size").alias("all")).where(F.col("all") > slack)
    keys = F.ceil(F.col("all") / most)
    heavy = stage(heavy.select("k", keys.alias("keys"), F.ceil(F.col("all") / keys).alias("share")), "heavy")  # at most total / slack rows
    one = rows.join(F.broadcast(heavy.where("keys > 1")), "k").groupBy("k", "doc_id").agg(F.sum("size").alias("all")).where(F.col("all") > most)
    one = stage(one.select(F.col("k").alias("k1"), F.col("doc_id").alias("id1"), F.lit(True).alias("alone")), "alone")
    out = rows.join(F.broadcast(heavy), "k", "left").join(F.broadcast(one), (F.col("k") == F.col("k1")) & F.col("doc_id").eqNullSafe(F.col("id1")), "left")
    by = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.when(F.col("alone"), F.col("at")).otherwise(0))
    return out.select("doc_id", "size", "text_crc32", "k", F.coalesce(F.pmod(by, "keys"), F.lit(0)).alias("salt"), F.coalesce("share", "size").alias("weight"))


def table(spark: SparkSession, **columns) -> DataFrame:
    return spark.createDataFrame(pa.table(columns))


def bounded(rows: DataFrame, shards: int, slack: float) -> DataFrame:
    """doc_id, size, text_crc32, shard: no shard above ``1 + slack`` times the mean but by the rest of a batch."""
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    mean = total / shards
    places, owner = ring(shards)
    keyed = stage(map_arrow(salted(rows, max(1.0, slack * mean), max(1.0, SPLIT * mean)), lambda it: _keyed(it, places), "doc_id long, size long, text_crc32 long, arc int, cell int"), "keyed")
    step = keyed.groupBy("cell").agg(F.sum("size").alias("size")).orderBy("cell").toArrow()  # at most CLASSES * STEPS rows
    cell = step.column("cell").to_numpy()
    batch = batches_of(step.column("size").to_numpy(), slack * mean / 4)
    turns = table(spark, cell=cell, batch=batch)
    sums = keyed.join(F.broadcast(turns), "cell").groupBy("arc", "batch").agg(F.sum("size").alias("size")).toArrow()
    state, states = fill(*(sums.column(c).to_numpy() for c in ("arc", "batch", "size")), owner, (1 + slack) * mean)
    turns = table(spark, cell=cell, state=state[batch] if len(batch) else batch)
    goes = table(spark, state=np.repeat(np.arange(len(states), dtype=np.int32), len(owner)), arc=np.tile(np.arange(len(owner), dtype=np.int32), len(states)), shard=np.concatenate(states))
    return keyed.join(F.broadcast(turns), "cell").join(F.broadcast(goes), ["state", "arc"]).select("doc_id", "size", "text_crc32", "shard", F.lit(None).cast("int").alias("grown_shard"))


def _ringed(batches: Iterator[pa.RecordBatch], rings: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = batch.column(3).to_numpy().astype(np.uint64)
        at = [pa.array(owner[arcs(key, places)]) for places, owner in rings]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *at], names=["doc_id", "size", "text_crc32", "shard", "grown_shard"])


def by_key(rows: DataFrame, shards: int) -> DataFrame:
    """The plain ring: the hash of doc_id alone, with ``shards`` and one more."""
    points = max(POINTS, RING // shards)
    rings = [ring(shards, points), ring(shards + 1, points)]
    keyed = rows.select("doc_id", "size", "text_crc32", F.xxhash64(F.coalesce("doc_id", F.lit(-1))).alias("k"))
    return map_arrow(keyed, lambda it: _ringed(it, rings), "doc_id long, size long, text_crc32 long, shard int, grown_shard int")


def slotted(rows: DataFrame) -> DataFrame:
    """Add slot: 0, 1, 2 .. within each shard."""
    rows = stage(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    per = stage(per.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "parts")
    per = F.broadcast(per) if per.count() <= SMALL_ROWS else per
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at"))
    return rows.withColumn("within", within).join(per, ["shard", "part"]).withColumn("slot", F.col("first") + F.col("within") - 1).drop("part", "at", "within", "first")


def deal(docs: DataFrame, shards: int = 8, law: str = "bytes", slack: float = SLACK) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document. size: UTF-8 bytes and 1."""
    if law not in ("bytes", "key"):
        raise ValueError("law: bytes or key")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k"))
    rows = stage(rows.withColumn("at", F.monotonically_increasing_id()), "sizes")
    out = slotted(bounded(rows, shards, slack) if law == "bytes" else by_key(rows, shards))
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", "grown_shard")


def op11_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deal(read_table(spark, sf_dir, "documents"))
