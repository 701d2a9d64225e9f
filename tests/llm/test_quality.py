import numpy as np
from helpers import SF, awkward, documents, empty

from codeloom.llm import quality_classifier as qc
from codeloom.llm import quality_rules as qr
from codeloom.llm.textstats import measure, repeated_words


def plain_repeats(words, n=3):
    seen, hit = {}, set()
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(i + k for i in at for k in range(n))
    return len(hit)


def test_measures(spark):
    for r in documents(spark).collect():
        words = r.text.encode().split()
        assert repeated_words(words) == plain_repeats(words)
    m = measure("a b\n#c\na b\n\n$ |\xa0x")
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_symbol_words"]) == (7, 10, 3, 1, 3)
    assert set(measure("").values()) == {0}


def test_em_finds_planted_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20_000) < 0.8
    k = len(qr.RULES)
    v = np.where(good[:, None], np.where(r.random((20_000, k)) < 0.02, qr.BAD, qr.GOOD), np.where(r.random((20_000, k)) < 0.5, qr.BAD, qr.GOOD))
    code = (v * 3 ** np.arange(k)[::-1]).sum(1)
    u, n = np.unique(code, return_counts=True)
    posterior, _, share = qr.estimate(u, n.astype(float))
    assert abs(share - 0.8) < 0.02
    assert ((posterior[code] > 0.5) == good).mean() > 0.98


def test_rules_query(spark):
    got = qr.op6_quality_rules(spark, SF).toPandas()
    assert len(got) == documents(spark).count()
    assert not (got.kept & got.base_failed).any()
    assert (got.base_failed == ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words))).all()


def test_keep_good_awkward(spark):
    docs = awkward(spark)
    out = qr.keep_good(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} <= {1, None, 5, 8}
    assert qr.keep_good(empty(spark)).count() == 0


def test_positive_unlabelled_on_made_data():
    r = np.random.default_rng(0)
    k = qc.features(np.zeros((1, len(qc.FIELDS)), np.int64)).shape[1]
    pos, neg = r.normal(1, 1, (4000, k)), r.normal(-1, 1, (1000, k))
    net, prior = qc.fit(pos[:2000], np.concatenate([pos[2000:], neg]))
    assert 0.5 < prior < 0.85
    a, b = net(r.normal(1, 1, (500, k))), net(r.normal(-1, 1, (500, k)))
    assert (a[:, None] > b[None, :]).mean() > 0.97


def test_classifier_awkward(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = qc.measured(awkward(spark))
    assert rows.count() == 10 and len(qc.sampled(rows, 3)) == 3
    assert qc.train(rows, labels.where("quality = 9")) is None
    assert qc.train(rows, labels) is not None


def test_classifier_query(spark):
    got = qc.op4_quality_classifier(spark, SF)
    rows = got.collect()
    assert len(rows) == documents(spark).count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_top_and_run_match_a_plain_loop(spark):
    many = [f"w{i}" for i in range(124)]
    planted = " ".join(many[:60] + ["again"] * 60 + many[60:] + many[:16])  # 200 words, 125 distinct
    texts = [r.text for r in documents(spark).collect()] + [planted, "", "one", "a a", "a b b", "a a b", "é é x"]
    for text in texts:
        words = text.encode().split()
        top = max((words.count(w) for w in set(words)), default=0) if len(words) < 2000 else None
        longest = run = 0
        for i, w in enumerate(words):
            run = run + 1 if i and words[i - 1] == w else 1
            longest = max(longest, run)
        m = measure(text)
        assert m["n_run"] == longest and top in (None, m["n_top"])
    m = measure(planted)
    assert (m["n_words"], m["n_distinct"], m["n_top"], m["n_run"]) == (200, 125, 60, 60)
    assert qr.unpack(np.array([qr.votes(m)]))[0, list(qr.RULES).index("longest_run")] == qr.BAD
