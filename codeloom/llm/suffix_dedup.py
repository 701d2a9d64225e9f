"""Exact removal of repeated byte strings with per-shard suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id.

1. Anchors. Of every ``LENGTH``-byte window the least hash of a ``GRAM``-byte string in it is chosen (winnowing), so equal
   windows choose the same string at the same place. Anchors, with a hash of their context (all windows that hold the
   anchor), are dealt by hash as packed arrays. Copies of a context within a task are settled there, so a passage that
   every document holds leaves a task once.
2. Equal contexts (both hashes) are covered wholly in all documents but the first. Only where one anchor has several
   different contexts is it open which windows are shared; those contexts go on.
3. Shards. Contexts are dealt by anchor; each shard concatenates its distinct contexts and builds their suffix array by
   Larsson-Sadakane refinement (only groups that aren't yet single are sorted again, by the rank ``h`` further on, h
   doubling), then common prefixes by Kasai's rule, run over all contexts of the shard at once, column by column.
   Neighbours with a common prefix of ``LENGTH`` or more are one window; its first document keeps it.
4. A shard holds at most ``SHARD`` contexts; an anchor with more gets several shards, which are merged by binary search
   of each one's windows in the others.

Rows are told apart by doc_id and, where a doc_id repeats, by the number of the text among its texts. Equal contexts are
told by 45 bits or more of the anchor's hash and 64 of the context's (48 of its hash, two bytes of its sides).

Defined results: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose nothing; rows that repeat a
doc_id and text get the same result; different texts under one doc_id take nothing from each other, as neither id is
smaller; rows without doc_id lose nothing and take nothing from others; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, map_arrow, mix64, read_table, stage

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
HALF = LEFT // 2
SHARD, UNIT, BITE = 12_000, 2_000_000, 1_000_000
#: Text bytes to a bucket of anchors, and the most buckets.
BUCKET, MOST_BUCKETS = 4 << 20, 1 << 17
_TABLE = np.random.default_rng(2024).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_M = 0x9E3779B97F4A7C15
_TOP = np.uint64(2**64 - 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_M, n, 2**64))


def _sliding(a: np.ndarray, n: int, best) -> np.ndarray:
    """best over a[i : i + n]."""
    out, have = a, 1
    while have * 2 <= n:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(a) - n + 1], out[n - have :][: len(a) - n + 1]) if have < n else out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash of the anchor, hash of its context) of every anchor of every text."""
    import xxhash

    size = np.array([len(t) for t in texts], np.int64)
    raw = b"".join(texts)
    n = len(raw)
    end = np.repeat(np.cumsum(size), size)
    h = {1: _TABLE[np.frombuffer(raw + bytes(128), np.uint8)]}
    for k in (1, 2, 4, 8, 16, 32):
        x = h[k]
        h[2 * k] = x[:-k] * _power(k) + x[k:]
        if k in (2, 4, 8):
            del h[k]
    a = mix64(h[16][:n])
    place = np.arange(n)
    a[place + GRAM > end] = _TOP
    low = _sliding(np.concatenate([a, np.full(SPAN - 1, _TOP)]), SPAN, np.minimum)
    low[place + LENGTH > end] = 0
    top = _sliding(np.concatenate([np.zeros(SPAN - 1, np.uint64), low]), SPAN, np.maximum)
    at = np.flatnonzero((a == top) & (a != _TOP))
    which = np.searchsorted(np.cumsum(size), at, side="right")
    start, stop = np.cumsum(size)[which] - size[which], end[at]
    lo, hi = np.maximum(at - LEFT, start), np.minimum(at + LENGTH, stop)
    whole = hi - lo == LEFT + LENGTH
    context = np.empty(len(at), np.uint64)
    f = at[whole] - LEFT
    context[whole] = mix64(mix64(h[64][f]) * np.uint64(_M) + h[64][f + LEFT + LENGTH - 64])  # both ends of a context, which overlap
    for i in np.flatnonzero(~whole).tolist():
        context[i] = xxhash.xxh3_64_intdigest(raw[lo[i] : hi[i]])
    return which, at - start, a[at], _with_sides(context, h, at, start, stop)


def _with_sides(context: np.ndarray, h: dict[int, np.ndarray], at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Six bytes of the context's hash, then a byte each for the anchor with HALF bytes to its left and to its right.

    A window that holds an anchor reaches HALF bytes beyond it on one side at least, so contexts that share a window
    agree in one of the two bytes. 0: the text ends before.
    """
    side = lambda i: (mix64(h[32][i] * _power(1) + h[1][i + 32]) % np.uint64(255)) + np.uint64(1)
    left, right = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    some = at - HALF >= start
    left[some] = side(at[some] - HALF)
    some = at + GRAM + HALF <= stop
    right[some] = side(at[some])
    return (context & np.uint64(2**48 - 1)) | left << np.uint64(48) | right << np.uint64(56)


#: Bytes kept of an anchor's hash (beside its bucket) and of a context's.
FP_BYTES, CTX_BYTES = 5, 8


def _low(x: np.ndarray, n: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _wide(blob: bytes, count: int, n: int, at: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(blob, np.uint8, count * n, at).reshape(count, n)
    return out.view("<u8").ravel()


def _planes(x: np.ndarray, n: int = 4) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _from_planes(raw: bytes, count: int, n: int, at: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8, count * n, at).reshape(n, count).T
    return out.view("<u8").ravel().astype(np.int64)


def _pack(ids: np.ndarray, marks: np.ndarray, doc: np.ndarray, pos: np.ndarray, fp: np.ndarray, ctx: np.ndarray) -> bytes:
    """Documents used (as differences) with their marks, then each anchor's document and place, compressed in byte
    planes; then hashes, which can't be compressed. fp, ctx: may be empty."""
    import zstandard

    used, doc = np.unique(doc, return_inverse=True)
    order = np.argsort(doc, kind="stable")
    doc, pos = doc[order], pos[order]
    fp, ctx = (x[order] if len(x) else x for x in (fp, ctx))
    steps = np.diff(ids[used].astype(np.int64), prepend=0).astype(np.uint64)
    small = zstandard.ZstdCompressor(level=1).compress(b"".join([_planes(steps, 8), _planes(marks[used]), _planes(np.diff(doc, prepend=0)), _planes(pos)]))
    return b"".join([np.array([len(used), len(doc), len(fp), len(small)], "<i8").tobytes(), small, _low(fp, FP_BYTES), _low(ctx, CTX_BYTES)])


def _unpack(blob: bytes) -> list[np.ndarray]:
    """doc_id, mark, place, fp, ctx of each anchor."""
    import zstandard

    k, n, hashed, size = np.frombuffer(blob, "<i8", 4).tolist()
    raw = zstandard.ZstdDecompressor().decompress(blob[32 : 32 + size])
    ids = np.cumsum(_from_planes(raw, k, 8, 0))
    marks = _from_planes(raw, k, 4, 8 * k)
    doc = np.cumsum(_from_planes(raw, n, 4, 12 * k))
    at = 32 + size
    return [ids[doc], marks[doc], _from_planes(raw, n, 4, 12 * k + 4 * n), _wide(blob, hashed, FP_BYTES, at), _wide(blob, hashed, CTX_BYTES, at + FP_BYTES * hashed)]


def _first_of_class(doc: np.ndarray, fp: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by (fp, ctx, doc), and in that order: class heads, each row's class, each class's first document."""
    order = np.lexsort((doc, ctx, fp))
    f, c = fp[order], ctx[order]
    head = np.concatenate([[True], (f[1:] != f[:-1]) | (c[1:] != c[:-1])]) if len(order) else np.zeros(0, bool)
    cls = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    return order, at, cls, doc[order][at]


def packed_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, blob): anchors to compare (kind 0) and anchors already settled (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def unit():
            ids, marks = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            shift = np.cumsum([0] + [len(x[0]) for x in held])
            doc = np.concatenate([x[2] + s for x, s in zip(held, shift, strict=False)])
            pos, fp, ctx = (np.concatenate([x[i] for x in held]) for i in (3, 4, 5))
            held.clear()
            place = (fp % np.uint64(buckets)).astype(np.int64)
            fp = fp // np.uint64(buckets) & np.uint64(2 ** (8 * FP_BYTES) - 1)
            order, _, cls, first = _first_of_class(ids[doc], fp * np.uint64(buckets) + place.astype(np.uint64), ctx)
            settled = np.zeros(len(doc), bool)
            settled[order] = ids[doc][order] > first[cls]
            rows = []
            for kind, mask in ((0, ~settled), (1, settled)):
                some = np.flatnonzero(mask)
                some = some[np.argsort(place[some], kind="stable")]
                cut = np.searchsorted(place[some], np.arange(buckets + 1))
                for k in range(buckets):
                    i = some[cut[k] : cut[k + 1]]
                    if len(i):
                        rows.append((k, kind, _pack(ids, marks, doc[i], pos[i], fp[i] if not kind else fp[:0], ctx[i] if not kind else ctx[:0])))
            for lo in range(0, len(rows), 64):
                b, k, x = zip(*rows[lo : lo + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], names=["bucket", "kind", "blob"])

        for b in batches:
            ids, marks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = [t.encode() for t in b.column(2).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BITE):
                    size += len(texts[hi])
                    hi += 1
                which, pos, fp, ctx = anchors(texts[lo:hi])
                held.append((ids[lo:hi], marks[lo:hi], which, pos, fp, ctx))
                lo = hi
                if sum(len(x[4]) for x in held) > UNIT:
                    yield from unit()
        if held:
            yield from unit()

    return map_arrow(docs.where(F.length("text") > 0).where("doc_id is not null").select("doc_id", "mark", "text"), run, "bucket int, kind int, blob binary")


#: k of a row: mark (below 2 ** 30), then kind, then place (below 2 ** 31). Kinds: a context covered wholly, one still open, the text.
COVERED, OPEN, TEXT = 0, 1, 2


def _k(mark, kind: int, pos):
    return mark * 2**33 + kind * 2**31 + pos


def settle(packed: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, k, fp): contexts that are covered wholly and contexts still open."""

    def rows(doc, mark, pos, fp, kind):
        for lo in range(0, len(doc), 100_000):
            s = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(_k(mark[s], kind, pos[s])), pa.array(fp[s].view(np.int64))], names=["doc_id", "k", "fp"])

    def bucket(number: int, blobs: list[bytes]):
        doc, mark, pos, fp, ctx = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
        order = np.argsort(fp)
        f = fp[order]
        head = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        count = np.diff(np.append(head, len(f)))
        keep = order[np.repeat(count > 1, count)]
        doc, mark, pos, fp, ctx = (x[keep] for x in (doc, mark, pos, fp, ctx))
        if not len(doc):
            return
        order, at, cls, first = _first_of_class(doc, fp, ctx)
        d, f = doc[order], fp[order]
        covered = d > first[cls]
        yield from rows(d[covered], mark[order][covered], pos[order][covered], np.zeros(int(covered.sum()), np.uint64), COVERED)
        # Anchors with several contexts whose first documents differ: the first document's occurrences stay open.
        cf = f[at]
        g = np.concatenate([[True], cf[1:] != cf[:-1]])
        gid = np.cumsum(g) - 1
        lo, hi = np.minimum.reduceat(first, np.flatnonzero(g)), np.maximum.reduceat(first, np.flatnonzero(g))
        # Of those only contexts that agree with another one on a side can share a window with it.
        near = np.zeros(len(cf), bool)
        for shift in (48, 56):
            side = ctx[order][at] >> np.uint64(shift) & np.uint64(255)
            code = gid * 256 + side.astype(np.int64)
            by = np.argsort(code, kind="stable")
            run = np.flatnonzero(np.concatenate([[True], code[by][1:] != code[by][:-1]]))
            size = np.diff(np.append(run, len(by)))
            near[by] |= (np.repeat(size, size) > 1) & (side[by] > 0)
        open_ = ((lo < hi)[gid] & near)[cls] & ~covered
        yield from rows(d[open_], mark[order][open_], pos[order][open_], f[open_] * np.uint64(buckets) + np.uint64(number), OPEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for b in batches:
            for k, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if kind == 1:
                    doc, mark, pos = _unpack(blob)[:3]
                    yield from rows(doc, mark, pos, np.zeros(len(doc), np.uint64), COVERED)
                    continue
                if k != now:
                    if blobs:
                        yield from bucket(now, blobs)
                    now, blobs = k, []
                blobs.append(blob)
        if blobs:
            yield from bucket(now, blobs)

    return map_arrow(packed.repartition("bucket").sortWithinPartitions("bucket"), run, "doc_id long, k long, fp long")


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, neighbours that touch joined."""
    if not len(lo):
        return lo, hi
    o = np.argsort(lo, kind="stable")
    lo, hi = lo[o], np.maximum.accumulate(hi[o])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:] - 1, len(lo) - 1)]


def digest(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans, kept_sha256."""
    h, at = hashlib.sha256(), 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        h.update(raw[at:a])
        at = b
    h.update(raw[at:])
    return len(raw), int((hi - lo).sum()), len(lo), h.hexdigest()


def _squeezed(docs: DataFrame) -> DataFrame:
    """(doc_id, k, fp, packed): texts compressed before they are shuffled; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            k = _k(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), TEXT, 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k), pa.array(np.zeros(len(k), np.int64)), pa.array([squeeze((t or "").encode()) for t in b.column(2).to_pylist()], pa.binary())], names=["doc_id", "k", "fp", "packed"])

    return map_arrow(docs.select("doc_id", "mark", "text"), run, "doc_id long, k long, fp long, packed binary")


def _text(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _groups(batches: Iterator[pa.RecordBatch], numbers: int):
    """Per text row of a stream sorted by (doc_id, k): (doc_id, mark, packed, kinds, number columns) of the rows of its key.

    Columns: doc_id, k, then ``numbers`` number columns, then packed. Rows of a key that is still open are carried over.
    """
    held: list[np.ndarray] | None = None
    for b in batches:
        doc = b.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        cols = [doc, *(b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 2 + numbers))]
        packed = b.column(2 + numbers)
        shift = 0
        if held is not None:
            shift = len(held[0])
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        doc, k = cols[0], cols[1]
        mark, kind = k >> 33, (k >> 31) & 3
        head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]) if len(doc) else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(head, np.arange(len(doc)), 0))
        for t in np.flatnonzero(kind == TEXT).tolist():
            if t < shift:  # a text row that was served before its rows were carried over
                continue
            s = slice(int(begin[t]), t)
            own = kind[s] != TEXT
            yield (None if doc[t] == -(2**63) else int(doc[t])), int(mark[t]), packed[t - shift].as_py(), kind[s][own], [c[s][own] for c in cols[1:]], b
        last = int(begin[-1]) if len(doc) else 0
        held = [c[last:] for c in cols] if len(doc) else held


_R1 = "doc_id long, mark long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, packed binary, open binary"
_PLACE = 2**31 - 1


def _rows(found: Iterator[tuple], schema: list[tuple[str, pa.DataType]], most: int = 500) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in found:
        out.append(row)
        if len(out) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), schema, strict=True)], names=[n for n, _ in schema])
            out.clear()
    cols = [*zip(*out, strict=True)] if out else [[]] * len(schema)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])


def _with_spans(lo: np.ndarray, hi: np.ndarray, packed: bytes) -> bytes:
    return b"".join([np.array([len(lo)], "<i8").tobytes(), np.stack([lo, hi], 1).astype("<i8").tobytes(), packed])


def _split(both: bytes) -> tuple[np.ndarray, bytes]:
    n = int.from_bytes(both[:8], "little")
    return np.frombuffer(both, "<i8", 2 * n, 8).reshape(-1, 2), both[8 + 16 * n :]


def first_pass(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Each document with what is settled; one with open contexts keeps its text and their (fp, place)."""
    i, s, y = pa.int64(), pa.string(), pa.binary()
    schema = [("doc_id", i), ("mark", i), ("n_bytes", i), ("n_removed", i), ("n_spans", i), ("kept_sha256", s), ("packed", y), ("open", y)]

    def found(batches):
        for doc, mark, packed, kind, (k, fp), _ in _groups(batches, 1):
            raw = _text(packed)
            place = k & _PLACE
            p = place[kind == COVERED]
            lo, hi = merged(np.maximum(p - LEFT, 0), np.minimum(p + LENGTH, len(raw)))
            more = kind == OPEN
            if more.any():
                yield doc, mark, *digest(raw, lo, hi), _with_spans(lo, hi, packed), np.stack([fp[more], place[more]], 1).astype("<i8").tobytes()
            else:
                yield doc, mark, *digest(raw, lo, hi), None, None

    both = hits.withColumn("packed", F.lit(None).cast("binary")).union(_squeezed(docs))
    # rows without doc_id meet nothing, so they needn't meet in one task
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("packed")).otherwise(F.col("doc_id"))
    return map_arrow(both.repartition(spread).sortWithinPartitions("doc_id", "k"), lambda batches: _rows(found(batches), schema), _R1)


def open_contexts(one: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, pos, ctx) of the open contexts of the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, mark, packed, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = _text(_split(packed)[1])
                w = np.frombuffer(wanted, "<i8").reshape(-1, 2)
                ctx = [raw[max(0, q - LEFT) : q + LENGTH] for q in w[:, 1].tolist()]
                n = len(ctx)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, doc)), pa.array(np.full(n, mark)), pa.array(w[:, 0].copy()), pa.array(w[:, 1].astype(np.int32)), pa.array(ctx, pa.binary())], names=["doc_id", "mark", "fp", "pos", "ctx"])

    return map_arrow(one.select("doc_id", "mark", "packed", "open"), run, "doc_id long, mark long, fp long, pos int, ctx binary")


def suffix_array(body: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Suffixes in order, each cut at its ``stop`` (an end sorts before any byte); equal ones stay in place order."""
    n = len(body)
    place = np.arange(n)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([body, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in range(7):  # seven bytes and how many there are: a cut is not a zero byte
        key = (key << np.uint64(8)) | np.where(place + k < stop, padded[k : n + k], 0).astype(np.uint64)
    key = (key << np.uint64(8)) | np.minimum(stop - place, 7).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    s = key[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first + 1
    h, longest = 7, int((stop - place).max(initial=0))
    while h < longest:
        # groups that are still open, each sorted again by the rank h further on
        begins = np.flatnonzero(head)
        size = np.diff(np.append(begins, n))
        todo = np.flatnonzero(np.repeat(size > 1, size))
        if not len(todo):
            break
        i = order[todo]
        nxt = i + h
        far = np.where(nxt < stop[i], rank[np.minimum(nxt, n - 1)], 0)
        pair = rank[i] * np.int64(n + 2) + far
        o = np.argsort(pair, kind="stable")
        order[todo] = i[o]
        p = pair[o]
        new = np.concatenate([[True], p[1:] != p[:-1]])
        head[todo] = new
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order[todo]] = first[todo] + 1
        h *= 2
    return order


def common_prefixes(body: np.ndarray, start: np.ndarray, stop: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai: of each suffix and its left neighbour in ``order``, capped at LENGTH. start, stop: of the contexts.

    Along one context a common prefix drops by at most one; all contexts of the shard take a step together.
    """
    n = len(body)
    end = np.repeat(stop, stop - start)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    left = np.full(n, -1, np.int64)
    left[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    have = np.zeros(len(start), np.int64)
    for j in range(int((stop - start).max(initial=0))):
        live = np.flatnonzero(start + j < stop)
        i = start[live] + j
        q = left[i]
        have = np.maximum(have, 0)
        got = np.where(q >= 0, have[live], 0)
        room = np.where(q >= 0, np.minimum(np.minimum(end[i] - i, end[q] - q), LENGTH), 0)
        got = np.minimum(got, room)
        act = np.flatnonzero(got < room)
        while len(act):
            same = body[i[act] + got[act]] == body[q[act] + got[act]]
            act = act[same]
            got[act] += 1
            act = act[got[act] < room[act]]
        out[i] = got
        have[live] = got - 1
    return out[order]


def shard_windows(contexts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a shard in suffix order: (context, offset, group, first document of each group, a member of each)."""
    size = np.array([len(c) for c in contexts], np.int64)
    body = np.frombuffer(b"".join(contexts), np.uint8)
    stop = np.cumsum(size)
    start = stop - size
    order = suffix_array(body, np.repeat(stop, size))
    lcp = common_prefixes(body, start, stop, order)
    which = np.repeat(np.arange(len(contexts)), size)
    full = stop[which] - np.arange(len(body)) >= LENGTH
    group = np.cumsum(lcp < LENGTH)
    keep = full[order]
    suffix, group = order[keep], group[keep]
    if not len(suffix):
        z = np.empty(0, np.int64)
        return z, z, z, z, z
    head = np.concatenate([[True], group[1:] != group[:-1]])
    at = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    first = np.minimum.reduceat(docs[which[suffix]], at)
    return which[suffix], suffix - start[which[suffix]], group, first, suffix[at]


def covered_windows(contexts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) of each context: what its windows that a smaller document also has cover; hi is 0 if there are none.

    Windows of one context always overlap, so they cover one span. Shards are merged where there are several.
    """
    shards = []
    for lo in range(0, len(contexts), SHARD):
        part = contexts[lo : lo + SHARD]
        ctx, off, group, first, member = shard_windows(part, docs[lo : lo + SHARD])
        shards.append([lo, ctx, off, group, first, member, b"".join(part)])
    if len(shards) > 1:
        view = lambda s: np.array([s[6][m : m + LENGTH] + b"\x01" for m in s[5].tolist()], f"S{LENGTH + 1}")  # noqa: E731  suffix order is byte order
        for i, s in enumerate(shards):
            a = view(s)
            for t in shards[i + 1 :]:
                b = view(t)
                at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
                if len(a) and len(b):
                    met = np.flatnonzero(b[at] == a)
                    least = np.minimum(s[4][met], t[4][at[met]])
                    s[4][met] = least
                    t[4][at[met]] = least
    left, right = np.full(len(contexts), 2**31, np.int64), np.zeros(len(contexts), np.int64)
    for lo, ctx, off, group, first, _, _ in shards:
        hit = first[group] < docs[lo + ctx]
        np.minimum.at(left, lo + ctx[hit], off[hit])
        np.maximum.at(right, lo + ctx[hit], off[hit] + LENGTH)
    return left, right


def resolve(open_: DataFrame) -> DataFrame:
    """(doc_id, mark, lo, hi): spans covered by windows of open contexts. open_: doc_id, mark, fp, pos, ctx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def done():
            doc, mark, fp, pos = (np.concatenate([h[i] for h in held]) for i in range(4))
            ctx = [c for h in held for c in h[4]]
            held.clear()
            # distinct (anchor, context) with its first document; every row asks for its own
            number: dict = {}
            which = np.fromiter((number.setdefault(x, len(number)) for x in zip(fp.tolist(), ctx, strict=True)), np.int64, len(ctx))
            first = np.full(len(number), 2**63 - 1, np.int64)
            np.minimum.at(first, which, doc)
            lo, hi = covered_windows([c for _, c in number], first)
            some = np.flatnonzero(hi[which] > 0)
            base = np.maximum(0, pos[some].astype(np.int64) - LEFT)
            return pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(mark[some]), pa.array(base + lo[which[some]]), pa.array(base + hi[which[some]])], names=["doc_id", "mark", "lo", "hi"])

        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [*(b.column(i).to_numpy(zero_copy_only=False) for i in range(4)), b.column(4).to_pylist()]
            # a shard ends where an anchor does
            if size >= SHARD and held:
                last = held[-1][2][-1]
                cut = int(np.argmax(cols[2] != last)) if (cols[2] != last).any() else len(cols[2])
                if cut < len(cols[2]):
                    held.append([c[:cut] for c in cols])
                    yield done()
                    cols, size = [c[cut:] for c in cols], 0
            held.append(cols)
            size += len(cols[2])
        if held:
            yield done()

    return map_arrow(open_.repartition("fp").sortWithinPartitions("fp", "doc_id"), run, "doc_id long, mark long, lo long, hi long")


def last_pass(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that had open contexts, with all their spans."""
    i = pa.int64()
    schema = [("doc_id", i), ("n_bytes", i), ("n_removed", i), ("n_spans", i), ("kept_sha256", pa.string())]

    def found(batches):
        for doc, _, both, _, (k, hi), _ in _groups(batches, 1):
            own, packed = _split(both)
            yield doc, *digest(_text(packed), *merged(np.concatenate([own[:, 0], k & _PLACE]), np.concatenate([own[:, 1], hi])))

    rows = spans.select("doc_id", (F.col("mark") * 2**33 + F.col("lo")).alias("k"), F.col("hi"), F.lit(None).cast("binary").alias("packed"))
    texts = docs.select("doc_id", (F.col("mark") * 2**33 + TEXT * 2**31).alias("k"), F.lit(0).cast("long").alias("hi"), "packed")
    return map_arrow(rows.union(texts).repartition("doc_id").sortWithinPartitions("doc_id", "k"), lambda batches: _rows(found(batches), schema), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with mark: 0 where a doc_id has one row, else the number of the text among its texts."""
    again = stage(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return docs.withColumn("mark", F.lit(0).cast("long"))
    small = again.count() <= SMALL_ROWS
    # two hashes of 64 bits name a text; equal names under one id are one text
    named = docs.withColumn("__a", F.xxhash64("text")).withColumn("__b", F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"))
    texts = named.join(F.broadcast(again) if small else again, "doc_id", "left_semi").select("doc_id", "__a", "__b").distinct()
    numbers = stage(texts.withColumn("mark", F.row_number().over(Window.partitionBy("doc_id").orderBy("__a", "__b")).cast("long")), "marks")
    return named.join(F.broadcast(numbers) if numbers.count() <= SMALL_ROWS else numbers, ["doc_id", "__a", "__b"], "left").select("doc_id", "text", F.coalesce("mark", F.lit(0)).cast("long").alias("mark"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    docs = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(8, size // BUCKET))
    one = stage(first_pass(settle(packed_anchors(docs, buckets), buckets), docs), "settled")
    open_ = one.where("open is not null")
    spans = resolve(open_contexts(open_))
    done = one.where("open is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.union(last_pass(spans, open_.select("doc_id", "mark", "packed")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
