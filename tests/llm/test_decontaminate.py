from helpers import SF, awkward, documents, empty

from codeloom.llm import decontaminate as dc

ITEM = "Last week the farmer Tom Miller sold 12 kg of apples to Anna for 30 dollars and then Anna gave 12 kg of apples to the old school near the river."
AGAIN = "Last week the farmer Bob Stone sold 45 lb of apples to Maria for 99 dollars and then Maria gave 45 lb of apples to the old school near the river."
BROKEN = "Last week the farmer Bob Stone sold 45 kg of apples to Maria for 99 dollars and then Peter gave 17 kg of apples to the old school near the river."
OTHER = "Nobody knows why the green boat went up the hill last spring without any wind at all, yet people still talk of it often in town."


def pairs(spark, docs, items):
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "1 as w", "2 as item_id", "3 as key")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.changed for r in dc.leaks(d, b).collect()}


def test_reparameterised(spark):
    docs = {1: "Intro here. " + ITEM, 2: "Intro here. " + AGAIN.replace("lb", "g") + " More follows.", 3: OTHER, 4: None, 5: "", 6: ITEM.upper().replace("TOM MILLER", "Tom Miller")}
    got = pairs(spark, docs, {7: ITEM, 8: None, 9: ""})
    assert got[1, 7] is False and got[2, 7] is True and (3, 7) not in got and not {k for k in got if k[1] != 7}


def test_inconsistent_slots_count_less(spark):
    plain, broken = (dc.consistent(m) for m in (windows(AGAIN), windows(BROKEN)))
    assert plain[1] > broken[1]


def windows(text):
    c = dc.Canon()
    (wi, ai, n, vi, _), (wd, ad, _, vd, _) = (dc.template_windows(c, t, (8,), False)[0] for t in (ITEM, text))
    return [{"d_at": int(a), "at": int(b), "n": n, "d_slots": vd[a : a + n], "slots": vi[b : b + n]} for x, a in zip(wd, ad, strict=True) for y, b in zip(wi, ai, strict=True) if x == y]


def test_short_item(spark):
    assert set(pairs(spark, {1: "We said: blue cats sleep softly. Yes", 2: "blue dogs sleep softly"}, {5: "Blue cats sleep softly"})) == {(1, 5)}


def test_query_finds_whole_passages(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in dc.op7_decontaminate(spark, SF).collect()}
    want = {(d.doc_id, i) for d in documents(spark).collect() for i, t in items.items() if t in d.text}
    assert want and want <= got


def test_drop_awkward(spark):
    docs, bench = awkward(spark), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert dc.drop_leaks(docs, bench).count() == docs.count()
    assert dc.drop_leaks(docs, bench.limit(0)).columns == docs.columns
    assert dc.leaks(empty(spark), bench).count() == 0
    bad = docs.limit(3).selectExpr("doc_id", f"'{ITEM}' as text")
    assert dc.drop_leaks(bad, bench).count() == 0


def test_dense_items(spark):
    items = {
        1: "Evaluate 12 + 34 * 56 - 78 / 9 + 10 - 11 + 40",
        2: "Sort 5 3 8 1 9 2 7 4 in order",
        3: "17 23 5 99 41 8 64 30 12 77",
        4: "The baker sold bread to the mill. " + " ".join(str(i * 37 % 101) for i in range(1, 41)),
        5: "The quiet farmer walked along the long river toward town with 3 4 5 6 7 8 9 10 11 12 13 14",
    }
    docs = {10 + i: f"Intro to it here. {t}. More words follow." for i, t in items.items()}
    docs[21] = "Evaluate 1 + 2 * 3 - 4 / 5 + 6 - 7 + 8"
    docs[22] = "Sort 15 13 18 11 19 12 17 14 in order"
    docs[25] = "The quiet farmer walked along the long river toward town and slept"
    docs[30] = "Totals: 201 202 203 204 205 206 207 208 209 210 211 212 213 214 215 216 217 218 219 220"
    got = pairs(spark, docs, items)
    assert {(10 + i, i) for i in items} <= set(got) and not any(got[10 + i, i] for i in items)
    assert got[21, 1] and got[22, 2] and (25, 5) in got
    assert not {k for k in got if k[0] == 30}


def plain_tokens(text):
    """(template token, value) by a plain loop."""
    raw, out, before = dc.TOKEN.findall(text), [], None
    for tok in raw:
        low = tok.lower()
        if tok[0] in ".!?:;\n":
            before = "stop"
        elif tok[0].isdigit() or low in dc.NUMBERS:
            out.append(["<num>", low])
            before = "num"
        elif low in dc.UNITS and before == "num":
            out.append(["<unit>", low])
            before = "unit"
        elif tok[0].isupper() and low not in dc.UNITS and before not in (None, "stop"):
            if before == "name":
                out[-1][1] += " " + low
            else:
                out.append(["<name>", low])
            before = "name"
        else:
            out.append([low, ""])
            # a capitalised word may go on a name only if it stood inside a sentence itself
            before = "word"
    return out


def plain_leaks(docs, items):
    got = set()
    texts = {d: plain_tokens(t or "") for d, t in docs}
    for item, t in items:
        own = plain_tokens(t or "")
        n = min(dc.WINDOW, len(own))
        if not n:
            continue
        every = range(len(own) - n + 1)
        cover = lambda at: len({j for a in at for j in range(a, a + n)})
        rich = [a for a in every if sum(not v for _, v in own[a : a + n]) >= min(dc.LITERALS, n)]
        use = rich if cover(rich) >= dc.COVER * len(own) else list(every)
        where = {}
        for a in use:
            where.setdefault(tuple(k for k, _ in own[a : a + n]), []).append(a)
        for d, tok in texts.items():
            found = []
            for i in range(len(tok) - n + 1):
                for a in where.get(tuple(k for k, _ in tok[i : i + n]), ()):
                    found.append({"d_at": i, "at": a, "n": n, "d_slots": [v for _, v in tok[i : i + n]], "slots": [v for _, v in own[a : a + n]]})
            count, covered, _, _ = dc.consistent(found)
            if count and covered >= dc.COVER * cover(use):
                got.add((d, item))
    return got


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.item_id) for r in dc.op7_decontaminate(spark, SF).collect()} == plain_leaks(docs, items)


def test_made_texts_against_brute_force(spark):
    docs = [(1, "Intro. " + ITEM), (2, AGAIN), (3, BROKEN), (4, OTHER), (5, None), (6, "Der Bauer verkauft zwölf Kilo Äpfel und fünf Liter Milch an die alte Schule am Fluss."), (7, ITEM + " " + OTHER * 300)]
    items = [(7, ITEM), (8, OTHER), (9, "Der Bauer verkauft 3 Gramm Äpfel und zwanzig Pfund Milch an die alte Schule am Fluss."), (9, ITEM), (10, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(d, b).collect()}
    assert got == plain_leaks(docs, items) and (6, 9) in got and (7, 7) in got
