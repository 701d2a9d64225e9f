import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from helpers import SF, awkward, documents, empty
from pyspark.sql import functions as F

from codeloom.llm import attention_lm as lm
from codeloom.llm import lm_scoring as ls
from codeloom.llm import token_counts as tc
from codeloom.llm.subwords import END, VOCABULARY, encoder


def test_counts_match_direct(spark):
    got = {r.doc_id: r.n_tokens for r in tc.op9_token_counts(spark, SF).collect()}
    e = encoder()
    assert got == {r.doc_id: len(e.encode_ordinary(r.text)) for r in documents(spark).collect()}


def test_scan_blocks(spark, tmp_path):
    r = np.random.default_rng(0)
    want = []
    for f in range(4):
        parts, n = [], int(r.integers(0, 9))
        for k in range(n):
            size = int(r.integers(0, 40))
            parts += [1] * size + [END]
            want.append((f"{f}.bin", k, size))
        tail = int(r.integers(0, 3)) * 7
        parts += [1] * tail
        want += [(f"{f}.bin", n, tail)] if tail else []
        np.array(parts, "<u2").tofile(tmp_path / f"{f}.bin")
    for block in (1, 5, 1000):
        assert sorted(map(tuple, tc.scan_token_files(spark, f"file://{tmp_path}", block=block).collect())) == sorted(want)


def test_small_files_and_awkward(spark, tmp_path):
    m = tc.write_token_files(awkward(spark).select("doc_id", "text", "b"), f"file://{tmp_path}", file_bytes=200)
    got = tc.scan_token_files(spark, f"file://{tmp_path}").join(m, ["file", "ordinal"])
    assert got.count() == 10 and {r.n_tokens for r in got.where("doc_id in (2, 3)").collect()} == {0}
    (tmp_path / "none").mkdir()
    assert tc.write_token_files(empty(spark), f"file://{tmp_path}/none").count() == 0
    assert tc.scan_token_files(spark, f"file://{tmp_path}/none").count() == 0


def small_model():
    r = np.random.default_rng(1)
    counts = np.zeros(END + 1)
    counts[r.integers(0, 5000, 300)] = r.integers(1, 50, 300)
    counts[END] = 10
    v = lm.Vocabulary(counts)
    p = {k: (x + r.normal(0, 0.1, x.shape)).astype(np.float64) for k, x in lm.start(v).items()}
    return r, v, p


def test_probabilities_sum_to_one():
    r, v, p = small_model()
    z = np.repeat(r.normal(size=(1, lm.DIM)), END + 1, axis=0)
    q = lm.log_probabilities(p, v, z, np.arange(END + 1))
    assert abs(np.exp(q.astype(np.float64)).sum() - 1) < 1e-3


def test_gradients_match_differences():
    r, v, p = small_model()
    texts = [r.integers(0, 5000, n) for n in (3, 70, 0, 31, 32, 33)]
    index, scored, rows, target = next(iter(lm.prepared(texts, END, v)))
    g, _ = lm.gradients(p, v, rows[index], target[index], scored)
    for k, shape in lm.SPECS.items():
        at = (int(rows[index[0, 1]]), 1) if k == "E" else tuple(int(r.integers(0, n)) for n in shape)
        loss = []
        for step in (1e-4, -1e-4):
            q = {n: x.copy() for n, x in p.items()}
            q[k][at] += step
            loss.append(lm.gradients(q, v, rows[index], target[index], scored)[1])
        assert abs(g[k][at] - (loss[0] - loss[1]) / 2e-4) < 1e-4 * max(1, abs(g[k][at]))


def test_each_place_scored_once_and_causal():
    r, v, p = small_model()
    texts = [r.integers(0, 5000, n) for n in (0, 1, 31, 32, 59, 60, 61, 200)]
    for index, scored, rows, _ in lm.prepared(texts, END, v):
        assert (np.bincount(index[scored], minlength=len(rows)) == 1).all()
    a = [x.copy() for x in lm.score_ids(p, v, texts, END)]
    texts[-1] = texts[-1].copy()
    texts[-1][150] = 7
    b = list(lm.score_ids(p, v, texts, END))
    assert np.allclose(a[-1][:150], b[-1][:150]) and not np.allclose(a[-1], b[-1])


def test_training_lowers_loss():
    r, v, _ = small_model()
    texts = [np.resize([5, 17, 99, 4], int(r.integers(20, 90))) for _ in range(200)]
    p = lm.start(v)
    before = sum(x.sum() for x in lm.score_ids(p, v, texts, END))
    t = lm.Trainer(p, v, 1e-2, windows=16)
    t.learn(texts, END)
    assert sum(x.sum() for x in lm.score_ids(t.p, v, texts, END)) > 0.6 * before


def test_words_and_ids():
    words = [w for t in ("Über the  thing", "a　 b c", "it's 12,5 x") for w in ls.words_of(t)]
    ids, size = ls.encode_words(words, VOCABULARY)
    assert len(size) == len(words) and size.sum() == len(ids)
    e = ls.Encoder(words[:3], *ls.encode_words(words[:3], VOCABULARY), VOCABULARY)
    place, many, got, rare = e(words + words[:2])
    assert got.tolist() == ls.encode_words(words + words[:2], VOCABULARY)[0].tolist() and (place[:3] == [0, 1, 2]).all() and rare == words[3:]


def test_query_base_scores(spark):
    docs = {r.doc_id: r.text.encode().lower().split() + [b" "] for r in documents(spark).collect()}
    c = Counter(w for d, ws in docs.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in ls.op5_lm_scoring(spark, SF).collect()}
    assert set(got) == set(docs)
    for d, ws in docs.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in c for w in ws), n, zlib.crc32(str(d).encode()) % 10 == 0)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6 * abs(r.base_score)
        assert r.score < 0


def test_scoring_awkward(spark):
    docs = awkward(spark).withColumn("held_out", ls.remainder() == 0).withColumn("learn", ~F.col("held_out"))
    encoded, counts, words, params, v = ls.learned(docs, VOCABULARY, ("doc_id", "b", "size"), "learn")
    got = ls.score_texts(encoded, counts, words, params, v, ("doc_id", "b", "size")).collect()
    assert len(got) == 10 and {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert len({(r.base_score, r.score) for r in got if r.doc_id == 1}) == 1
    for some in (docs.limit(0), docs.withColumn("learn", F.lit(False))):  # no rows; nothing to learn from
        encoded, counts, words, params, v = ls.learned(some, VOCABULARY, ("doc_id",), "learn")
        got = ls.score_texts(encoded, counts, words, params, v, ("doc_id",)).collect()
        assert len(got) == some.count() and all(r.n_known == r.train_tokens == 0 and r.score < 0 for r in got)


def test_attention_alone(spark):
    docs = documents(spark).withColumn("learn", F.lit(True))
    encoded, counts, words, params, v = ls.learned(docs, VOCABULARY, ("doc_id", "text"), "learn")
    got = ls.score_texts(encoded, counts, words, params, v, ("doc_id", "text"), mix=0.0).collect()
    for r in got[:20]:
        ids = ls.encode_words(ls.words_of(r.text), VOCABULARY)[0]
        want = float(sum(x.sum(dtype=float) for x in lm.score_ids(params, v, [ids], END))) / math.log(10)
        assert abs(r.score - want) < 1e-3 * abs(want)


def test_every_training_text_is_learned_from(spark):
    texts = [" ".join(f"word{i} likes {k}" for k in range(40)) for i in range(3)]
    for t in texts:  # alone, so that the parameters move only if this text reaches the model
        docs = spark.createDataFrame([(1, t, True)], "doc_id long, text string, learn boolean")
        _, counts, _, params, v = ls.learned(docs, VOCABULARY, ("doc_id",), "learn")
        assert not np.array_equal(lm.flatten(params), lm.flatten(lm.start(v, *ls.id_counts(counts, VOCABULARY)[1:])))
    parts = ls.learned(documents(spark).withColumn("learn", ls.remainder() != 0), VOCABULARY, ("doc_id",), "learn")[0]
    assert all((r.part >= 0) == bool(zlib.crc32(str(r.doc_id).encode()) % 10) for r in parts.collect())


def test_later_windows_keep_context():
    r, v, _ = small_model()
    for index, scored, _, _ in lm.prepared([r.integers(0, 5000, 200)], END, v):
        assert (np.argmax(scored[index[:, 0] > 0], axis=1) >= 8).all()


def test_sums_beyond_float32():
    z, w, c = np.ones((3, 4), np.float32), np.zeros((4, 8), np.float32), np.zeros(8, np.float32)
    for far in (-300.0, 300.0):
        w[:] = far
        w[0, 2] = far + 2
        got = lm._chosen(z, w, c, np.array([2, 0, 2]))
        assert np.allclose(got, [-math.log1p(7 * math.exp(-2)), -2 - math.log1p(7 * math.exp(-2)), -math.log1p(7 * math.exp(-2))], atol=1e-3)


def test_training_that_runs_away_is_left_out():
    r, v, p = small_model()
    t = lm.Trainer(p, v, 1e-2, windows=16)
    t.learn([r.integers(0, 5000, 400)], END)
    assert t.sane()
    t.loss = 2 * t.first
    assert not t.sane()
    t.loss, t.p["E"][0, 0] = t.first, np.nan
    assert not t.sane()


def test_a_bad_model_does_not_sink_scores(spark):
    docs = documents(spark).withColumn("held_out", ls.remainder() == 0).withColumn("learn", ~F.col("held_out"))
    encoded, counts, words, params, v = ls.learned(docs, VOCABULARY, ("doc_id", "held_out"), "learn")
    far = {k: x * np.float32(40) for k, x in params.items()}
    rows = [r for r in ls.score_texts(encoded, counts, words, far, v, ("doc_id", "held_out")).collect() if r.held_out]
    assert rows and all(math.isfinite(r.score) for r in rows)
    assert sum(r.score for r in rows) > 1.5 * sum(r.base_score for r in rows)


def plain_states(p, v, text):
    """Each place's state worked out alone, with the context of the window that scores it."""
    rows = v.row[np.concatenate([[END], text]).astype(int)]
    out = []
    for i in range(len(rows)):
        first = 0 if i < lm.WIDTH else -(-(i - lm.WIDTH + 1) // lm.STRIDE) * lm.STRIDE
        x = p["E"][rows[first : i + 1]]
        q, k, val = np.split(x @ p["QKV"], 3, axis=1)
        a = np.exp(k @ q[-1] / lm.DIM**0.5 + p["R"][i - first :: -1][: i - first + 1])
        h = x[-1] + (a / a.sum()) @ val @ p["O"]
        out.append(h + np.maximum(h @ p["W1"] + p["b1"], 0) @ p["W2"])
    return np.array(out)


def test_scores_equal_plain_windows():
    r, v, p = small_model()
    texts = [r.integers(0, 5000, n) for n in (0, 1, 6, 7, 8, 22, 23, 24, 30, 31, 32, 47, 54, 55, 56, 57, 200)]
    for got, t in zip(lm.score_ids(p, v, texts, END, windows=3), texts, strict=True):
        want = lm.log_probabilities(p, v, plain_states(p, v, t), np.append(t, END))
        assert np.allclose(got, want, atol=1e-6)


def test_only_scored_places_ask(monkeypatch):
    r, v, p = small_model()
    texts, asked, exp = [r.integers(0, 5000, 24 * 200 - 1)], [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: (asked.append(x.size if x.shape[-1] != lm.SIDE else 0), exp(x, *a, **k))[1])
    list(lm.score_ids(p, v, texts, END))
    assert sum(asked) < 1.02 * lm.WIDTH * 24 * 200  # a window's other places would make it a third more


def test_steps_reuse_their_arrays():
    r, v, p = small_model()
    t = lm.Trainer({k: x.astype(np.float32) for k, x in p.items()}, v, 1e-2, windows=64)
    texts = [r.integers(0, 5000, 64 * lm.WIDTH - 1)]
    t.learn(texts, END)
    tracemalloc.start()
    t.learn(texts, END)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the gradients and sums per input row remain; the logits alone of 64 windows take 256 kB, their backward pass as much
    assert most < 3_000_000


def test_gradients_beyond_float32():
    r, v, p = small_model()
    texts = [r.integers(0, 5000, n) for n in (3, 70, 40)]
    index, scored, rows, target = next(iter(lm.prepared(texts, END, v)))
    want, loss = lm.gradients(p, v, rows[index], target[index], scored)
    for far in (-300, 300):  # the same shares, from sums that float32 can't hold
        q = {k: x.astype(np.float32) for k, x in p.items()} | {"c": (p["c"] + far).astype(np.float32), "t": (p["t"] + far).astype(np.float32)}
        got, other = lm.gradients(q, v, rows[index], target[index], scored)
        assert abs(other - loss) < 1e-3 * loss
        assert all(np.allclose(got[k], want[k], atol=1e-3 * np.abs(want[k]).max()) for k in want)


def test_rare_words_of_a_text_are_told_once(spark):
    docs = spark.createDataFrame([(1, "known words", True), (2, "zz " * 50 + "yy known", False), (3, None, False)], "doc_id long, text string, learn boolean")
    encoded, counts, words, params, v = ls.learned(docs, VOCABULARY, ("doc_id",), "learn")
    assert {r.doc_id: sorted(r.often) for r in encoded.collect()} == {1: [], 2: [1, 50], 3: []}
    got = {r.doc_id: r for r in ls.score_texts(encoded, counts, words, params, v, ("doc_id",)).collect()}
    below = 3 + 0.1 * 4
    assert got[2].n_tokens == 53 and got[2].n_known == 2
    assert abs(got[2].base_score - (51 * math.log10(0.1 / below) + 2 * math.log10(1.1 / below))) < 1e-9
