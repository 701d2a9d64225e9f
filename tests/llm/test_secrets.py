import hashlib
import random
import re

from helpers import SF, awkward, documents, empty

from codeloom.llm import secrets as sc


def plain_base(t):
    spans = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(spans)


def test_base_spans(spark):
    texts = ["", 'é PassWord="abcd1234" x', "api_key=short token : 0123456789abcdef0123456789abcdef", "toKen=x" + "1" * 9, "AKIA1234567890AB AKIASHORT", "ſecret=abcdefgh1"]
    for t in texts + [r.text for r in documents(spark).collect()]:
        assert sc.base_spans(t) == plain_base(t)


def test_query(spark):
    got = {r.doc_id: r for r in sc.op1_secret_scan(spark, SF).collect()}
    for d in documents(spark).collect():
        want = plain_base(d.text)
        r = got[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_method_finds_random_runs_only(spark):
    r = random.Random(3)
    words = "the quick brown fox jumps over lazy dogs while internationalization organisations notwithstanding".split()
    rows, planted = [], {}
    for i in range(400):
        t = " ".join(r.choice(words) for _ in range(80))
        if i % 20 == 0:
            key = "".join(r.choice(sc.ENCODINGS["base62"]) for _ in range(40))
            planted[i] = f"random:{len(t) + 1}:{len(t) + 41}"
            t = f"{t} {key} end"
        rows.append((i, t + " card 4284828396583018 mail1 a_name_in_2020_with_parts"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = sc.fit(sc.scanned(df))
    found = {i: sc.written(model.spans(t)) for i, t in rows}
    assert {i: s for i, s in found.items() if s} == planted


def test_battery_is_calibrated():
    r = random.Random(5)
    p = [sc.battery("".join(r.choice(sc.ENCODINGS["base36"]) for _ in range(64)), "base36") for _ in range(800)]
    assert sum(x < 0.05 for x in p) / 800 < 0.12
    assert sc.battery("ab" * 20, "hex") < 1e-6


def test_redact(spark):
    docs = awkward(spark)
    out = sc.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    bad = spark.createDataFrame([(1, "x password=abcdefgh12 y", 23), (2, None, None), (3, "", 0)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in sc.redact(bad).orderBy("doc_id").collect()] == [(1, "x [secret] y", 12), (2, None, None), (3, "", 0)]
    assert sc.redact(empty(spark)).count() == 0
