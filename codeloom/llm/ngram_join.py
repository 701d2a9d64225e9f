"""N-gram Jaccard self-join with adaptive multi-match prefixes; exact links, components and link counts.

A document's set holds the hashes of its distinct ``words``-word shingles. Documents with equal sets form a class; the
join runs between classes. Two sets of sizes m and n with Jaccard at least t/100 overlap in at least ``ceil(t n / 100)``,
so with shingles in one global order (rare first) their prefixes of length ``n - ceil(t n / 100) + l`` share l shingles,
whatever l both can use. Each document picks its own l: a longer prefix is read at more cost, but then l shared shingles
are asked for, which by Markov leaves at most 1/l of the meetings to verify. l minimises
``POST * l + read + VERIFY * read / l`` with ``read`` the other documents on the prefix's lists, estimated from a bounded table of the commonest shingles (the
order and l only steer cost; any order gives the same links). A pair is a candidate if it shares ``min(l, l')``.

Lists of up to ``LIST`` classes yield their pairs; a longer list yields only a star, which says that all its members
may be alike. Candidates fall into connected blocks, and a block is cut into chunks of bounded size, alike sets (by
their least shingle hash) beside each other. Two chunks are compared, by counting, only if a candidate pair or a long list has a
member in both, so a chain of long lists doesn't make all its members meet, and no task's memory grows with a block.
In a large table shingles that no task saw often have long lists too, which tie unlike sets into one block. Where blocks
would be copied beyond the table's own sets, their long lists join the common shingles, which are read last, and lists
are made anew (``ROUNDS``).
Whole sets go to their own chunk once; to other chunks go slices of alike sets as their differences from what most of
a slice holds.
Of the links found, only spanning forests and counts leave a task.

Sets are named by 64-bit hashes. Defined results: texts without words link with nothing; fewer words than a shingle
form one shingle; rows with equal texts are linked; rows without doc_id have their size, no links and no component;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_ROWS, Forest, commonest, components, map_arrow, mix64, read_table, stage, strings, windows, word_hashes

#: Rows of the table of common shingles, meetings a verification costs, longest list that yields pairs.
COMMON, VERIFY, LIST = 100_000, 10, 200
#: Other documents expected on the list of a shingle that isn't in the table, and cost of one more posting.
CHANCE, POST = 0.05, 0.05
#: Documents from which on a common shingle's list is dealt over tasks, as a star around a node of its own.
HOT, DEALT = 5_000, 64
#: Bounds of a chunk: classes, shingles; and of a slice of one.
CHUNK, CHUNK_SHINGLES = 1_000, 500_000
SLICE, SLICE_SHINGLES = 64, 20_000
MOST = 8
#: Times that lists are made at most.
ROUNDS = 3


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter sequence is one shingle of its own kind."""
    if not len(h):
        return np.empty(0, np.uint64)
    if len(h) < n:
        return mix64(windows(h, len(h)) ^ np.uint64(0xABCD + len(h)))
    return np.unique(windows(h, n))


def needed(n: int, t: int) -> int:
    """Least overlap of a set of size n with any set that links with it."""
    return -(-t * n // 100)


def name_of(s: np.ndarray) -> int:
    """A set's name; 0 for the empty set."""
    import xxhash

    return (xxhash.xxh3_64_intdigest(s.tobytes()) >> 1) or 1 if len(s) else 0


class Shingler:
    def __init__(self, n: int):
        self.n = n

    def __call__(self, text: str) -> np.ndarray:
        return shingle_set(word_hashes(text.encode().lower()), self.n)


def described(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, s, least) of each row: its set's size, name and least shingle.

    Now and then a row also has the repeated shingles of those before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, fresh = Shingler(n), set(), []
        batches = iter(batches)
        b = next(batches, None)
        while b is not None:
            following = next(batches, None)
            sizes, names, least = [], [], []
            for t in strings(b.column(1)):
                s = shingles(t)
                sizes.append(len(s))
                names.append(name_of(s))
                least.append(int(s[0] >> np.uint64(1)) if len(s) else 0)
                if names[-1] not in seen:
                    seen.add(names[-1])
                    fresh.append(s)
            if len(seen) > 2_000_000:
                seen.clear()
            often: list = [None] * len(sizes)  # never on an empty batch
            if fresh and sizes and (following is None or sum(map(len, fresh)) > 4_000_000):
                every = np.sort(np.concatenate(fresh))
                head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                count = np.diff(np.append(head, len(every)))
                at = np.flatnonzero(count >= 3)
                fresh.clear()
                often[-1] = [{"h": h, "c": c} for h, c in zip(every[head[at]].view(np.int64).tolist(), count[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(least, pa.int64()), pa.array(often, pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())])))], names=["doc_id", "n_shingles", "s", "least", "often"])
            b = following

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, s long, least long, often array<struct<h:long,c:long>>")


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and estimated document counts of the commonest shingles, at most ``COMMON``."""
    per = rows.where("often is not null").select(F.explode("often").alias("o")).groupBy("o.h").agg(F.sum("o.c").alias("n"))
    got = commonest(stage(per, "common"), "h", COMMON)
    h = np.array([x for x, _ in got], np.int64).view(np.uint64)
    o = np.argsort(h)
    return h[o], np.array([n for _, n in got], np.int64)[o]


def with_long(common: np.ndarray, counts: np.ndarray, met: DataFrame, placed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles with those of the long lists, at most ``COMMON``, that reach blocks of several chunks."""
    wide = placed.where("parts > 1").select(F.col("s").alias("b"))
    got = commonest(stage(met.where("need = 0").join(wide, "b", "left_semi").groupBy("list").agg(F.count("*").alias("n")), "long"), "list", COMMON)
    more = {int(np.int64(h).view(np.uint64)): n for h, n in got}
    every = dict(zip(common.tolist(), counts.tolist(), strict=True))
    every.update((h, max(n, every.get(h, 0))) for h, n in more.items())
    h = np.sort(np.fromiter(every, np.uint64, len(every)))
    return h, np.array([every[x] for x in h.tolist()], np.int64)


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray, t: int) -> tuple[np.ndarray, int, np.ndarray]:
    """A set's prefix, its l, and which of the prefix's lists are surely long."""
    n = len(s)
    need = needed(n, t)
    freq = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        freq = np.where(common[at] == s, counts[at], 0)
    order = np.argsort(freq, kind="stable")  # ties stay in hash order
    read = np.cumsum(np.where(freq[order] > 0, freq[order] - 1, CHANCE))
    most = min(MOST, need)
    cost = [POST * k + read[n - need + k - 1] * (1 + VERIFY / k) for k in range(1, most + 1)]
    k = int(np.argmin(cost)) + 1
    own = order[: n - need + k]
    return s[own], k, freq[own] >= HOT


def postings(docs: DataFrame, n: int, t: int, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(h, s, n, l): the prefix of each set, once per task. l is 0 on lists that the common shingles show to be long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(n), set()
        for b in batches:
            hs, names, sizes, ls = [], [], [], []
            for text in strings(b.column(0)):
                s = shingles(text)
                name = name_of(s)
                if not name or name in seen:
                    continue
                seen.add(name)
                p, k, hot = prefix(s, common, counts, t)
                hs.append(p)
                names.append(np.full(len(p), name, np.int64))
                sizes.append(np.full(len(p), len(s), np.int32))
                ls.append(np.where(hot, 0, k).astype(np.int32))
            if len(seen) > 2_000_000:
                seen.clear()
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (names, sizes, ls))], names=["h", "s", "n", "l"])

    return map_arrow(docs.where("doc_id is not null").select("text"), run, "h long, s long, n int, l int")


def meetings(post: DataFrame, t: int) -> DataFrame:
    """(a, b, need, list): pairs that meet on short lists, and stars of long lists (need 0) with the list's shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        head, held, star = None, [], None  # the open list: its shingle, its members, its hub once it is long

        def close():
            if star is None and len(held) > 1:
                m = np.array(held)
                i, j = np.triu_indices(len(m), 1)
                lo, hi = np.minimum(m[i, 1], m[j, 1]), np.maximum(m[i, 1], m[j, 1])
                ok = lo * 100 >= hi * t
                a, b = m[i[ok], 0], m[j[ok], 0]
                out.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.minimum(m[i[ok], 2], m[j[ok], 2]), np.zeros(len(a), np.int64)], 1))

        def flush():
            rows = np.concatenate(out) if out else np.empty((0, 4), np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[:, i].copy()) for i in range(4)], names=["a", "b", "need", "list"])

        for b in batches:
            h, s, n, k = (b.column(i).to_numpy() for i in range(4))
            if not len(h):
                continue
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            ends = np.append(edge[1:], len(h))
            # lists inside the batch with one member yield nothing
            for lo, hi in zip(edge.tolist(), ends.tolist(), strict=True):
                if hi - lo == 1 and h[lo] != head and hi < len(h):
                    close()
                    head, held, star = None, [], None
                    continue
                if h[lo] != head:
                    close()
                    head, held, star = h[lo], [], None
                if not k[lo]:  # a long list, of which this task has a share; its node is below all set names
                    own = np.unique(s[lo:hi])
                    out.append(np.stack([np.full(len(own), -1 - (int(head) & 2**62 - 1)), own, np.zeros_like(own), np.full(len(own), head)], 1))
                    continue
                last = held[-1][0] if held else None
                for x in zip(s[lo:hi].tolist(), n[lo:hi].tolist(), k[lo:hi].tolist(), strict=True):
                    if x[0] == last:
                        continue
                    last = x[0]
                    if star is None:
                        held.append(x)
                        if len(held) > LIST:
                            star = held[0][0]
                            out.append(np.array([(star, y[0], 0, head) for y in held], np.int64))
                            held = [x]
                    else:
                        held = [x]
                        out.append(np.array([(star, x[0], 0, head)], np.int64))
            if sum(map(len, out)) > 200_000:
                yield flush()
        close()
        yield flush()

    share = F.when(F.col("l") == 0, F.pmod(F.xxhash64("s"), F.lit(DEALT))).otherwise(0)
    dealt = post.repartition("h", share).sortWithinPartitions("h", "s")
    return map_arrow(dealt, run, "a long, b long, need long, list long")


def pack(sets: list[np.ndarray]) -> tuple[list[int], bytes]:
    """(lengths, blob) of the shingles that more than half of the sets hold, then of where each set differs from them."""
    every, n = np.unique(np.concatenate(sets), return_counts=True)
    base = every[2 * n > len(sets)]
    parts = [base, *(np.setxor1d(base, x, assume_unique=True) for x in sets)]
    return [len(x) for x in parts], np.concatenate(parts).tobytes()


def unpack(lengths: list[int], blob: bytes) -> list[np.ndarray]:
    base, *parts = np.split(np.frombuffer(blob, np.int64), np.cumsum(lengths)[:-1])
    return [np.setxor1d(base, x, assume_unique=True) for x in parts]


def slices(rows: list[tuple]) -> Iterator[list[tuple]]:
    """A chunk's rows (s, chunk, weight, set) in slices of alike sets, bounded as a row must be."""
    out, n = [], 0
    for r in sorted(rows, key=lambda r: int(r[3][0])):
        if out and (len(out) >= SLICE or n + len(r[3]) > SLICE_SHINGLES):
            yield out
            out, n = [], 0
        out.append(r)
        n += len(r[3])
    yield out


def unit(rows: list[tuple], cross: bool, t: int) -> tuple[list, list]:
    """(links of a spanning forest, (s, weight of those linked with it)) among rows (s, chunk, weight, set).

    Shingles that more than half of the sets hold are counted by the sets that lack them: with D the difference from
    those ``usual`` shingles and h how many of them a set holds, an intersection is |D & D'| + h + h' - len(usual).
    """
    size = np.array([len(r[3]) for r in rows])
    m = len(rows)
    tok = np.concatenate([r[3] for r in rows])
    who = np.repeat(np.arange(m), size)
    order = np.argsort(tok, kind="stable")
    tok, who = tok[order], who[order]
    first = np.concatenate([[True], tok[1:] != tok[:-1]])
    lo = np.flatnonzero(first)
    cnt = np.diff(np.append(lo, len(tok)))
    group = np.cumsum(first) - 1
    usual = np.flatnonzero(2 * cnt > m)
    row = np.full(len(cnt), -1)
    row[usual] = np.arange(len(usual))
    at = row[group]
    has = np.zeros((len(usual), m), bool)
    has[at[at >= 0], who[at >= 0]] = True
    h = has.sum(axis=0)
    lack, lacking = np.nonzero(~has)
    g, d = np.concatenate([group[at < 0], usual[lack]]), np.concatenate([who[at < 0], lacking])
    order = np.argsort(g, kind="stable")
    g, d = g[order], d[order]
    first = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    lo = np.flatnonzero(first)
    cnt, group = np.diff(np.append(lo, len(g))), np.cumsum(first) - 1
    who = d  # per group, the sets that differ there
    shared = cnt[group] > 1
    d, g = d[shared], group[shared]
    by = np.argsort(d, kind="stable")
    d, g = d[by], g[by]
    cuts = np.searchsorted(d, np.arange(m + 1))
    side, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    forest, links, degree = Forest(), [], np.zeros(m, np.int64)
    for i in range(m):
        inter = h + (h[i] - len(usual))
        if cuts[i] < cuts[i + 1]:
            inter = inter + np.bincount(np.concatenate([who[lo[x] : lo[x] + cnt[x]] for x in g[cuts[i] : cuts[i + 1]].tolist()]), minlength=m)
        ok = inter * 100 >= t * (size + size[i] - inter)
        ok[: i + 1] = False
        if cross:
            ok &= side != side[i]
        js = np.flatnonzero(ok)
        if len(js):
            degree[i] += weight[js].sum()
            degree[js] += weight[i]
            for j in js.tolist():
                if forest.join(i, j):
                    links.append((rows[i][0], rows[j][0]))
    return links, [(rows[i][0], int(degree[i])) for i in np.flatnonzero(degree).tolist()]


FOUND = "a long, b long, d long"


def _found(links: list, degree: list) -> list[pa.Array]:
    a = [x[0] for x in links] + [x[0] for x in degree]
    return [pa.array(a, pa.int64()), pa.array([x[1] for x in links] + [None] * len(degree), pa.int64()), pa.array([None] * len(links) + [x[1] for x in degree], pa.int64())]


def within(t: int):
    """Streams sets sorted by (root, chunk, s): links within a chunk, and the slices of chunks that may meet others."""
    kinds = {"root": pa.int64(), "chunk": pa.int64(), "names": pa.list_(pa.int64()), "weights": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "blob": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done():
            cols = _found(*unit(held, False, t)) if len(held) > 1 else _found([], [])
            yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(cols[0]), k) for k in kinds.values())], names=["a", "b", "d", *kinds])
            if key[2] > 1:
                for some in slices(held):
                    row = (key[0], key[1], [r[0] for r in some], [r[2] for r in some], *pack([r[3] for r in some]))
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), *(pa.array([x], k) for x, k in zip(row, kinds.values(), strict=True))], names=["a", "b", "d", *kinds])

        for b in batches:
            for root, chunk, parts, s, weight, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (root, chunk, parts) != key:
                    if held:
                        yield from done()
                    key, held = (root, chunk, parts), []
                if not held or held[-1][0] != s:  # repeated rows
                    held.append((s, chunk, weight, np.frombuffer(blob, np.int64)))
        if held:
            yield from done()

    return run, f"{FOUND}, root long, chunk long, names array<long>, weights array<long>, lengths array<long>, blob binary"


def across(t: int):
    """Streams the slices of two chunks, sorted by (root, i, j): links between the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done():
            return pa.RecordBatch.from_arrays(_found(*unit(held, True, t)), names=["a", "b", "d"])

        for b in batches:
            for root, i, j, chunk, names, weights, lengths, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (root, i, j) != key:
                    if held:
                        yield done()
                    key, held = (root, i, j), []
                held += [(s, chunk, w, x) for s, w, x in zip(names, weights, unpack(lengths, blob), strict=True)]
        if held:
            yield done()

    return run


BITS = 24


def _spot(ids: np.ndarray) -> np.ndarray:
    return mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITS)


def unit_sets(docs: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """``placed`` (doc_id, s, ...) with the blob of each set. Rows pass a fixed-size bitmap of ids, then the join."""
    bits = np.zeros(2**BITS, bool)
    for r in map_arrow(placed.select("doc_id"), _spots, "p int").distinct().toLocalIterator():
        bits[r["p"]] = True
    packed = np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bits = Shingler(n), np.unpackbits(packed).astype(bool)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(bits[_spot(ids)])
            if not len(at):
                continue
            hit = b.take(pa.array(at))
            found = [shingles(t) for t in strings(hit.column(1))]
            yield pa.RecordBatch.from_arrays([hit.column(0), pa.array([name_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc_id", "s", "blob"])

    found = map_arrow(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, s long, blob binary")
    return found.join(F.broadcast(placed) if placed.count() <= SMALL_ROWS else placed, ["doc_id", "s"])


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_spot(b.column(0).to_numpy(zero_copy_only=False)).astype(np.int32))], names=["p"])


def met_chunks(met: DataFrame, pairs: DataFrame, placed: DataFrame) -> DataFrame | None:
    """(root, i, j), i < j: chunks that have to be compared. Blocks of one chunk need no look at what met."""
    at = stage(placed.where("parts > 1").select("s", "root", "chunk").distinct(), "chunks")
    if at.isEmpty():
        return None
    small = at.count() <= SMALL_ROWS
    look = lambda s: (F.broadcast(at) if small else at).select(F.col("s").alias(s), "root", F.col("chunk").alias(f"{s}_chunk"))
    direct = pairs.join(look("a"), "a").join(look("b"), ["b", "root"]).select("root", "a_chunk", "b_chunk")
    lists = met.where("need = 0").join(look("b"), "b").select("list", "root", "b_chunk").distinct()
    listed = lists.join(lists.withColumnRenamed("b_chunk", "a_chunk"), ["list", "root"]).select("root", "a_chunk", "b_chunk")
    both = direct.union(listed).where("a_chunk <> b_chunk")
    return both.select("root", F.least("a_chunk", "b_chunk").alias("i"), F.greatest("a_chunk", "b_chunk").alias("j")).distinct()


def unit_slices(found: DataFrame, need: DataFrame) -> DataFrame:
    """Slices of both chunks of each unit, unit by unit. They are what each unit takes a copy of, not whole sets."""
    sides = need.select("root", "i", "j", F.explode(F.array("i", "j")).alias("chunk"))
    both = found.where("blob is not null").join(F.broadcast(sides) if sides.count() <= SMALL_ROWS else sides, ["root", "chunk"])
    return both.select("root", "i", "j", "chunk", "names", "weights", "lengths", "blob").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "chunk")


def placing(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(root, doc_id, s, size, parts, chunk): the block of each set that met another, and its chunk there."""
    member = stage(stage(components(met.select("a", "b")), "blocks").select(F.col("node").alias("s"), "root").join(classes, "s"), "members")
    cut = member.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("parts"))
    # sets with one least shingle, as most near copies have, share a chunk unless they are too many
    alike = member.groupBy("root", "least").agg(F.count("*").alias("alike"))
    spot = F.pmod(F.xxhash64(F.when(F.col("alike") <= CHUNK, F.col("least")).otherwise(F.col("s"))), F.col("parts"))
    return member.select("doc_id", "s", "size", "root", "least").join(cut, "root").join(alike, ["root", "least"]).withColumn("chunk", spot).drop("least", "alike")


def classes_of(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, known). rows: doc_id, n_shingles, s of every row. known: s, root (names its component), c (its least
    doc_id), n_links of every set."""
    rows = stage(described(docs, words), "sets")
    classes = stage(rows.where("s <> 0 and doc_id is not null").groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("size"), F.first("n_shingles").alias("n"), F.first("least").alias("least")), "classes")
    enough = classes.count()
    common, counts = common_shingles(rows)
    copies = None
    for left in reversed(range(ROUNDS)):
        met = meetings(postings(docs, words, percent, common, counts), percent)
        met = stage(met.groupBy("a", "b", "list").agg(F.count("*").alias("got"), F.min("need").alias("need")).where("got >= need"), "met")
        placed = stage(placing(met, classes), "placed")
        # sets that units would take, were all chunks of a block compared
        before, copies = copies, (placed.groupBy("root").agg(F.first("parts").alias("p")).agg(F.sum(F.expr("p * (p - 1)"))).first()[0] or 0) * CHUNK
        if not left or copies <= enough or (before is not None and 2 * copies > before):
            break
        known = len(common)
        common, counts = with_long(common, counts, met, placed)
        if len(common) == known:
            break
    units = unit_sets(docs, placed, words).select("root", "chunk", "parts", "s", "size", "blob")
    found = stage(map_arrow(units.repartition("root", "chunk").sortWithinPartitions("root", "chunk", "s"), *within(percent)), "links")
    need = met_chunks(met, met.where("need > 0"), placed)
    if need is not None:
        need = stage(need, "units")
        met_slices = unit_slices(found, need)
        found = found.where("a is not null").select("a", "b", "d").union(stage(map_arrow(met_slices, across(percent), FOUND), "links"))

    comp = components(found.where("b is not null").select("a", "b"))
    comp = comp.select(F.col("node").alias("s"), "root").join(classes.select("s", "doc_id"), "s")
    least = comp.groupBy("root").agg(F.min("doc_id").alias("least"))
    linked = comp.join(least, "root").select("s", "root", "least")
    degree = found.where("d is not null").groupBy(F.col("a").alias("s")).agg(F.sum("d").alias("d"))
    known = classes.drop("least").join(linked, "s", "left").join(degree, "s", "left").select("s", F.coalesce("root", "s").alias("root"), F.coalesce("least", "doc_id").alias("c"), (F.coalesce("d", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    return rows, stage(known, "known")


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs`` (doc_id, text)."""
    rows, known = classes_of(docs, words, percent)
    out = rows.select("doc_id", "n_shingles", "s").join(known.drop("root"), "s", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked rows, one with the least doc_id; all columns kept.

    Rows are told apart by doc_id and set: of several texts under one doc_id each stays or goes by its own links, and
    of rows that repeat a doc_id and set one stays. Rows without words or doc_id stay.
    """
    rows, known = classes_of(docs, words, percent)
    mine = rows.where("s <> 0 and doc_id is not null").select("doc_id", "s").join(known.where("n_links > 0").select("s", "root"), "s")
    first = mine.groupBy("root").agg(F.min(F.struct("doc_id", "s")).alias("best"))
    gone = stage(mine.join(first, "root").where(F.struct("doc_id", "s") != F.col("best")).select("doc_id", "s").distinct(), "gone")
    again = stage(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    small = lambda df: F.broadcast(df) if df.count() <= SMALL_ROWS else df
    once = gone.join(small(again), "doc_id", "left_anti").select("doc_id")
    if again.isEmpty():
        return docs.join(small(once), "doc_id", "left_anti").select(docs.columns)
    out = docs.join(small(again), "doc_id", "left_anti").join(small(once), "doc_id", "left_anti").select(docs.columns)
    several = named_sets(docs.join(small(again), "doc_id", "left_semi").select(docs.columns), words)
    several = several.join(small(gone.withColumnRenamed("s", "__s")), ["doc_id", "__s"], "left_anti")
    held = several.where("__s <> 0").dropDuplicates(["doc_id", "__s"]).select(docs.columns)
    return out.union(held).union(several.where("__s = 0").select(docs.columns))


def named_sets(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with the name of each row's set as ``__s``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in batches:
            names = pa.array([name_of(shingles(t)) for t in strings(b.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, names], names=[*b.schema.names, "__s"])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("__s", T.LongType())]))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"), 4, 85)


#: The same rows by an equi-join of all shingles and a walk over the links.
OP8_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM l),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT DISTINCT a, a FROM p UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.c), m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id), d AS (SELECT a AS doc_id, count(*) AS n FROM p GROUP BY a)
SELECT l.doc_id, len(s) AS n_shingles, coalesce(m.c, l.doc_id) AS component_id, coalesce(d.n, 0) AS n_links FROM l LEFT JOIN m USING (doc_id) LEFT JOIN d USING (doc_id)"""
