import hashlib
import random

import numpy as np
import pytest
from helpers import SF, awkward, documents, empty
from pyspark.sql import functions as F

from codeloom.llm import common, ngram_join, suffix_dedup


def plain_join(docs, words, percent):
    s = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        s[d] = frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    up, deg = {d: d for d in s}, dict.fromkeys(s, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                deg[a] += 1
                deg[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s[d]), find(d), deg[d]) for d in s}


def near_copies(n=60, seed=2):
    """A large group of copies with one to many words changed, and unrelated texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(150)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(r.randrange(0, 9)):
            t[r.randrange(150)] = r.choice(words)
        out.append((i, " ".join(t)))
    return out + [(n + i, " ".join(r.choice(words) for _ in range(r.randrange(0, 40)))) for i in range(40)]


def check(spark, rows, words, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_join(df, words, percent).collect()}
    assert got == plain_join(rows, words, percent)


def test_against_brute_force(spark):
    check(spark, [(r.doc_id, r.text) for r in documents(spark).collect()], 4, 85)
    check(spark, near_copies(), 3, 70)


def test_long_lists_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST", 5)
    monkeypatch.setattr(ngram_join, "CHUNK", 9)
    check(spark, near_copies(seed=3), 3, 70)
    monkeypatch.setattr(ngram_join, "HOT", 8)
    check(spark, near_copies(seed=4), 3, 70)


def test_units_take_differences_not_whole_sets(spark, monkeypatch):
    """Bytes that go to the comparisons between chunks, against those of all sets (14 others for each of 15 chunks)."""
    sent = []

    def seen(df, f, schema):
        if {"i", "j", "blob"} <= set(df.columns):
            sent.append(df.agg(F.sum(F.length("blob"))).first()[0])
        return common.map_arrow(df, f, schema)

    monkeypatch.setattr(ngram_join, "LIST", 5)
    monkeypatch.setattr(ngram_join, "CHUNK", 20)
    monkeypatch.setattr(ngram_join, "map_arrow", seen)
    rows = near_copies(300, seed=5)
    check(spark, rows, 3, 70)
    assert 0 < sum(sent) < 5 * sum(8 * n for n, _, _ in plain_join(rows, 3, 70).values())


def test_phrases_no_task_sees_often_make_no_large_block(spark, monkeypatch):
    """Unlike texts that share phrases, dealt so that no task holds one three times: their chunks aren't compared."""
    units = []

    def seen(found, need):
        units.append(need.count())
        return unit_slices(found, need)

    unit_slices = ngram_join.unit_slices
    monkeypatch.setattr(ngram_join, "LIST", 5)
    monkeypatch.setattr(ngram_join, "CHUNK", 9)
    monkeypatch.setattr(ngram_join, "unit_slices", seen)
    r = random.Random(6)
    phrases = [" ".join(f"p{i}x{j}" for j in range(8)) for i in range(12)]
    texts = [" ".join([" ".join(f"w{i}y{j}" for j in range(40)), *r.sample(phrases, 2)]) for i in range(150)]
    rows = list(enumerate(texts + [t + " end" for t in texts[:20]]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(200, "doc_id")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in ngram_join.jaccard_join(df, 3, 70).collect()}
    assert got == plain_join(rows, 3, 70) and sum(units) < 20


def test_slices_hold_their_sets(monkeypatch):
    r = np.random.default_rng(3)
    base = np.sort(r.integers(0, 2**62, 200))
    sets = [np.unique(np.concatenate([base[r.random(200) > 0.05], r.integers(0, 2**62, 5)])) for _ in range(30)] + [np.array([7]), base[:3]]
    lengths, blob = ngram_join.pack(sets)
    assert all(np.array_equal(a, b) for a, b in zip(ngram_join.unpack(lengths, blob), sets, strict=True)) and len(blob) < sum(x.nbytes for x in sets) / 4
    monkeypatch.setattr(ngram_join, "SLICE_SHINGLES", 500)
    cut = list(ngram_join.slices([(i, 0, 1, x) for i, x in enumerate(sets)]))
    assert sorted(x[0] for some in cut for x in some) == list(range(32)) and all(len(s) == 1 or sum(len(x[3]) for x in s) <= 500 for s in cut)


def test_keep_first_tells_texts_apart(spark):
    copy, other = (" ".join(f"{w}{i}" for i in range(30)) for w in "ab")
    rows = [(1, copy), (5, copy), (5, other), (7, other), (7, "x y"), (7, "x y"), (8, None), (8, ""), (None, copy)]
    got = ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, copy), (5, other), (7, "x y"), (8, None), (8, ""), (None, copy)], key=str)


def test_components_both_ways(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(230)]
    want = common.Forest()
    for a, b in edges:
        want.join(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    for limit in (10**6, 0):
        got = {x.node: x.root for x in common.components(df, one_task=limit).collect()}
        assert got == {x: want.find(x) for a, b in edges if a != b for x in (a, b)}


def test_join_awkward(spark):
    docs = awkward(spark)
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in ngram_join.jaccard_join(docs.select("doc_id", "text", "b", "s"), 4, 85).collect()), key=str)
    assert len(got) == 10 and (7, 6, 1) in got and (None, None, 0) in got and got.count((1, 1, 1)) == 2 and (3, 3, 0) in got
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 6, 8, None]
    assert ngram_join.jaccard_join(empty(spark)).count() == 0


def plain_removal(docs):
    first, out = {}, {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.get(b[i : i + 50], d) < d:
                cover[i : i + 50] = b"\1" * 50
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
        out[d] = (len(b), sum(cover), sum(cover[i] and not (i and cover[i - 1]) for i in range(len(b))), hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    return out


def check_removal(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == plain_removal(rows)


def spliced(seed, n=60):
    r = random.Random(seed)
    letters = "ab é"
    parts = ["".join(r.choice(letters) for _ in range(r.randrange(30, 200))) for _ in range(12)]
    rows = [(i, "".join(r.choice(parts) if r.random() < 0.6 else "".join(r.choice("cdefgh ") for _ in range(r.randrange(1, 70))) for _ in range(r.randrange(0, 9)))) for i in range(n)]
    return rows + [(n, "ab" * 200), (n + 1, "x" + "ab" * 150), (n + 2, ""), (n + 3, "c" * 49), (n + 4, "c" * 50), (n + 5, "c" * 51), (n + 6, "\0" * 60), (n + 7, "\0" * 80)]


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_against_brute_force(spark, seed):
    check_removal(spark, spliced(seed))


def test_removal_merges_shards(spark, monkeypatch):
    rows = spliced(5)
    contexts = sorted({t.encode()[i : i + 84] for _, t in rows for i in range(0, max(0, len(t.encode()) - 84), 11)})
    docs = np.array([(i * 7) % 50 for i in range(len(contexts))])
    whole = suffix_dedup.covered_windows(contexts, docs)
    monkeypatch.setattr(suffix_dedup, "SHARD", 17)
    parts = suffix_dedup.covered_windows(contexts, docs)
    assert (parts[1] == whole[1]).all() and (parts[0] == whole[0]).all() and whole[1].any()


def test_suffix_array_and_prefixes():
    r = random.Random(9)
    parts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 90))).encode() for _ in range(40)]
    body = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    stop = np.cumsum(size)
    order = suffix_dedup.suffix_array(body, np.repeat(stop, size))
    ends = np.repeat(stop, size)
    text = [bytes(body[i : ends[i]]) for i in range(len(body))]
    assert [text[i] for i in order] == sorted(text)
    lcp = suffix_dedup.common_prefixes(body, stop - size, stop, order)
    for k in range(1, len(order)):
        a, b = text[order[k - 1]], text[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(n, 50)


def test_removal_awkward(spark):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(awkward(spark).select("doc_id", "text", "b")).collect()), key=str)
    assert len(got) == 10 and (2, 0, 0) in got and (3, 0, 0) in got
    assert len({g for g in got if g[0] == 1}) == 1 and [g[2] for g in got if g[0] in (1, None)] == [0, 0, 0]
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_texts_of_one_id_stay_apart(spark):
    r = random.Random(4)
    part = lambda: "".join(r.choice("abcdefgh ") for _ in range(120))
    first = part()
    texts = [first + part() for _ in range(40)] + [part() for _ in range(40)]
    rows = [(1, first)] + [(7, t) for t in texts] + [(7, texts[0])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for d, t in rows:
        b, f = t.encode(), first.encode()
        cover = bytearray(len(b))
        for i in range(len(b) - 49) if d == 7 else ():
            if b[i : i + 50] in f:
                cover[i : i + 50] = b"\1" * 50
        want.append((d, sum(cover), hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()))
    assert sorted((x.doc_id, x.n_removed, x.kept_sha256) for x in got) == sorted(want)


def test_query_against_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op10_suffix_dedup(spark, SF).collect()}
    assert got == plain_removal([(r.doc_id, r.text) for r in documents(spark).collect()])
