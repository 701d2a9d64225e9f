"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: lower-cased words, with numbers, units after numbers, and names (capitalised words
inside a sentence, neighbours merged) replaced by typed placeholders that remember their values. Windows of ``WINDOW``
template tokens of the benchmark items (shorter items: the whole item) are joined by hash with those of the documents.
Of the windows that meet, only those whose slots are consistent count: within a document and item one item value maps
to one document value of the same type and the other way round, so a question asked anew with other numbers, names
and units is caught while chance meetings of placeholders are not. A document leaks an item if the consistent windows
cover at least ``COVER`` of the item's usable tokens, those inside the windows it uses.

Before the join, documents' windows pass a bitmap of the benchmark's window hashes. It has a fixed size and only ever
lets too much through; the join decides. Windows with fewer than ``LITERALS`` plain words name little, and an item
doesn't use them, unless its richer windows hold less than ``COVER`` of its tokens: then it uses all its windows.
Documents offer all theirs. Where no window with a plain word meets, a window counts only with unchanged values, as any
row of numbers would do otherwise.

Defined results: null or empty texts leak nothing and null or empty items are never leaked; repeated rows give repeated
pairs once per distinct (doc_id, text); an empty table on either side gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL_ROWS, map_arrow, mix64, read_table, stage, strings, windows

WINDOW, LITERALS, COVER, BITS = 8, 4, 0.5, 24
TOKEN = re.compile(r"[^\W_]+(?:[.,'’][^\W_]+)*|[.!?:;\n]")
#: Spelled numbers of English, German, Spanish and French; words that are also articles are left out. Fixed values.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty "
    "forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig "
    "vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta "
    "cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille".split()
)
#: Units in the same languages, counted as such only after a number. Fixed values.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces oz pound pounds lb lbs "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars cent cents euro euros usd eur kmh mph kb mb gb tb hz khz mhz w kw kwh v volts watts joules newtons "
    "meter kilometer zentimeter meile meilen gramm kilo kilogramm tonne tonnen pfund sekunde sekunden minuten stunde stunden tag tage tagen woche wochen "
    "monat monate monaten jahr jahre jahren prozent grad "
    "metro metros kilómetro kilómetros milla millas gramo gramos kilos tonelada toneladas libra libras litro litros segundo segundos minuto minutos hora "
    "horas día días semana semanas mes meses año años grado grados dólar dólares céntimos "
    "mètre mètres kilomètre kilomètres gramme grammes livre livres seconde secondes heure heures jour jours semaine semaines mois an ans degré degrés".split()
)
WORD_, CAP, NUM, UNIT, STOP = range(5)
_PLACEHOLDER = {NUM: "\x00num", UNIT: "\x00unit", CAP: "\x00name"}


class _Tokens(dict):
    """Raw token to its hash, whose last three bits are its kind; works out what it doesn't know."""

    def __missing__(self, raw: str) -> int:
        import xxhash

        low = raw.lower()
        if raw[0] in ".!?:;\n":
            kind = STOP
        elif raw[0].isdigit() or low in NUMBERS:
            kind = NUM
        elif low in UNITS:
            kind = UNIT
        else:
            kind = CAP if raw[0].isupper() else WORD_
        self[raw] = out = xxhash.xxh3_64_intdigest(low.encode()) & ~7 | kind
        return out


class Canon:
    """Template tokens of texts, with what is known about raw tokens kept up to a bound."""

    def __init__(self, limit: int = 500_000):
        import xxhash

        self.known, self.limit = _Tokens(), limit
        self.mark = {k: np.uint64(xxhash.xxh3_64_intdigest(v.encode()) & ~7) for k, v in _PLACEHOLDER.items()}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(hashes, kinds, raw values) of the template tokens; a value is empty but for placeholders."""
        raw = TOKEN.findall(text)
        if len(self.known) > self.limit:
            self.known.clear()
        if not raw:
            return np.empty(0, np.uint64), np.empty(0, np.int8), []
        h = np.fromiter(map(self.known.__getitem__, raw), np.uint64, len(raw))
        kind = (h & np.uint64(7)).astype(np.int8)
        h &= ~np.uint64(7)
        before = np.concatenate([[STOP], kind[:-1]])
        name = (kind == CAP) & (before != STOP)
        kind = np.where((kind == CAP) & ~name, WORD_, kind)
        kind = np.where((kind == UNIT) & (before != NUM), WORD_, kind).astype(np.int8)
        for k, mark in self.mark.items():
            h[kind == k] = mark
        follows = name & np.concatenate([[False], name[:-1]])  # later words of one name
        keep = np.flatnonzero((kind != STOP) & ~follows)
        values = [""] * len(keep)
        for i in np.flatnonzero(kind[keep] != WORD_).tolist():
            j = int(keep[i])
            k = j + 1
            while kind[j] == CAP and k < len(raw) and follows[k]:
                k += 1
            values[i] = " ".join(raw[j:k]).lower()
        return h[keep], kind[keep], values


def template_windows(canon: Canon, text: str, lengths: tuple[int, ...], own: bool) -> list[tuple[np.ndarray, np.ndarray, int, list[str], np.ndarray]]:
    """(hashes, positions, length, values, kinds) per window length; own: an item's, which picks its length itself."""
    h, kind, values = canon(text)
    out = []
    for n in ((min(WINDOW, len(h)),) if own else lengths):
        if n < 1 or len(h) < n:
            continue
        plain = np.concatenate([[0], np.cumsum(kind == WORD_)])
        rich = plain[n:] - plain[:-n] >= min(LITERALS, n)
        w = mix64(windows(h, n) ^ np.uint64(n))
        at = np.flatnonzero(rich) if own and usable(np.flatnonzero(rich), n) >= COVER * len(h) else np.arange(len(w))
        out.append((w[at], at, n, values, kind))
    return out


def usable(at: np.ndarray, n: int) -> int:
    """Tokens inside the windows of ``n`` tokens at these ascending places."""
    return int(np.minimum(np.diff(at), n).sum()) + n if len(at) else 0


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(w, item_id, n_tokens, at, n, slots) of every benchmark window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for b in batches:
            cols: dict[str, list] = {k: [] for k in ("w", "item_id", "n_tokens", "at", "n", "slots")}
            for item, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                for w, at, n, values, _ in template_windows(canon, text, (), True):
                    total = usable(at, n)
                    for x, a in zip(w.view(np.int64).tolist(), at.tolist(), strict=True):
                        for k, v in zip(cols, (x, item, total, a, n, values[a : a + n]), strict=True):
                            cols[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.list_(pa.string()) if k == "slots" else pa.int32() if k in ("at", "n", "n_tokens") else pa.int64()) for k, v in cols.items()})

    return map_arrow(benchmark.select(F.col("item_id").cast("long"), "text"), run, "w long, item_id long, n_tokens int, at int, n int, slots array<string>")


def bitmap(items: DataFrame) -> np.ndarray:
    """Packed bits of the window hashes' top ``BITS`` bits; distinct places only, so at most 2 ** BITS reach the driver."""
    bits = np.zeros(2**BITS, bool)
    for r in items.select(F.shiftrightunsigned("w", 64 - BITS).alias("p")).distinct().toLocalIterator():
        bits[r["p"]] = True
    return np.packbits(bits)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, item_id, n_windows, covered, n_slots, changed): what each text leaks; key is the text's md5."""
    items = stage(item_windows(benchmark), "items")
    lengths = tuple(sorted(r["n"] for r in items.select("n").distinct().collect()))
    packed = bitmap(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        canon, bits = Canon(), np.unpackbits(packed).astype(bool)
        for b in batches:
            cols: dict[str, list] = {k: [] for k in ("w", "doc_id", "key", "d_at", "d_slots")}
            for i, t in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                key = None
                for w, at, n, values, _ in template_windows(canon, t, lengths, False):
                    hit = np.flatnonzero(bits[w >> np.uint64(64 - BITS)])
                    if len(hit):
                        key = key or hashlib.md5(t.encode()).hexdigest()
                        for j in hit.tolist():
                            a = int(at[j])
                            for k, v in zip(cols, (int(w[j].view(np.int64)), i, key, a, values[a : a + n]), strict=True):
                                cols[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.list_(pa.string()) if k == "d_slots" else pa.string() if k == "key" else pa.int32() if k == "d_at" else pa.int64()) for k, v in cols.items()})

    cand = map_arrow(docs.select(F.col(doc_id).cast("long"), F.col(text)), run, "w long, doc_id long, key string, d_at int, d_slots array<string>")
    met = cand.join(F.broadcast(items) if items.count() <= SMALL_ROWS else items, "w")
    sets = met.groupBy("doc_id", "key", "item_id").agg(F.max("n_tokens").alias("n_tokens"), F.collect_set(F.struct("d_at", "at", "n", "d_slots", "slots")).alias("met"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, key, item, total, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, covered, slots, changed = consistent(found)
                if n and covered >= COVER * total:
                    rows.append((doc, key, item, n, covered / total, slots, changed))
            cols = [*zip(*rows, strict=True)] if rows else [[]] * 7
            kind = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kind, strict=True)], names=["doc_id", "key", "item_id", "n_windows", "covered", "n_slots", "changed"])

    return map_arrow(sets, check, "doc_id long, key string, item_id long, n_windows long, covered double, n_slots long, changed boolean")


def consistent(found: list[dict]) -> tuple[int, int, int, bool]:
    """(windows, item tokens covered, slots, whether a value differs) of the windows whose slots agree.

    Windows are tried in page order from each place where an item may begin in the document, those without a plain word
    last; the best place counts.
    """
    bare = lambda m: all(m["slots"])
    best = (0, 0, 0, False)
    starts: dict[int, list[dict]] = {}
    for m in found:
        starts.setdefault(m["d_at"] - m["at"], []).append(m)
    merged, last = [], None
    for s in sorted(starts):  # a few tokens put in or left out shift the later windows
        if last is not None and s - last <= 8:
            merged[-1] += starts[s]
        else:
            merged.append(list(starts[s]))
        last = s
    for group in merged:
        there, back, cover, n, changed, named = {}, {}, set(), 0, False, False
        for m in sorted(group, key=lambda m: (bare(m), m["at"], m["d_at"])):
            pairs = [(a, d) for a, d in zip(m["slots"], m["d_slots"], strict=True) if a or d]
            if bare(m) and not named and any(a != d for a, d in pairs):
                continue
            if all(there.get(a, d) == d and back.get(d, a) == a for a, d in pairs) and len({a for a, _ in pairs}) == len({d for _, d in pairs}):
                there.update(pairs)
                back.update((d, a) for a, d in pairs)
                cover.update(range(m["at"], m["at"] + m["n"]))
                n += 1
                changed = changed or any(a != d for a, d in pairs)
                named = named or not bare(m)
        best = max(best, (n, len(cover), len(there), changed), key=lambda x: (x[1], x[0]))
    return best


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, with all their columns; joined by the text's md5."""
    bad = stage(leaks(docs, benchmark).select(F.col("key").alias("__key")).distinct(), "leaks")
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.withColumn("__key", key).join(F.broadcast(bad) if bad.count() <= SMALL_ROWS else bad, "__key", "left_anti").drop("__key")
