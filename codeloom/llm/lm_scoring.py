"""LM scoring: a causal self-attention model over subword ids, learned from the corpus, scores every whole text.

1. Word counts over all training texts (``groupBy``); base scores come from them. The ``HEAVY`` commonest words go to
   the workers as a table of that fixed size; all other words of a document are joined with the counts in Spark.
2. Id counts follow from the distinct words and their counts. Every text is encoded once; its ids are staged.
3. The attention model (``attention_lm``) is trained by synchronous local steps: in each round every partition trains
   on its training texts of that round (every training text belongs to one round) and the parameters are averaged by
   ids seen, first in ``REDUCERS`` tasks, then on the driver.
4. A text's probability is the product over its words of ``MIX`` x (share among all counts) + ``1 - MIX`` x (product of
   the model's probabilities of the word's ids). The shares leave words beyond the table what is theirs, and as much as
   there are distinct words (Witten and Bell); a word's part of that is the product of its ids' shares. Both are
   distributions over words, and so is the mixture. The end of a text counts as a word.

A task whose training runs away (loss up by a tenth, or not finite) leaves the round's parameters as they were. float32
products round a row by where it stands, so rows of equal texts get the least of their scores.

Words beyond the table are joined by their 64-bit hash. Words are lower-cased (A-Z) runs of anything but ASCII white space, encoded as " word" each by a public vocabulary file.

Defined results: null and empty texts hold only their end; a null doc_id has no remainder, is not held out and trains;
repeated rows are scored each; an empty table gives an empty result; without training texts every count is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm as lm
from .common import commonest, map_arrow, read_table, stage, strings
from .subwords import END, VOCABULARY, encoder

HEAVY, REDUCERS, MIX = 1 << 18, 16, 0.3
#: Training texts are dealt to the rounds by hash, so each text trains in one round.
RATES = (60e-3, 40e-3, 8e-3)
#: Stands for the end among the words; no word holds a space.
END_WORD = " "


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def remainder(doc_id: str = "doc_id", mod: int = 10) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod, F.lit(-1))


def word_counts(texts: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(word, n) over all texts, ends included. Tasks add up what they see, in bites of ``most`` distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in strings(b.column(0)):
                seen.update(words_of(t))
                seen[b" "] += 1
            if len(seen) > most:
                yield out()
                seen.clear()
        yield out()

    return map_arrow(texts, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(counts: DataFrame, vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of subword ids, of ids that begin a word, of ids that end one, and (a, b, n) of neighbours within words.

    Follows from the distinct words and their counts. What reaches the driver is bounded by the pairs of ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = END + 1
        total, first, last = (np.zeros(k, np.int64) for _ in range(3))
        pairs: Counter = Counter()
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            ids, size = encode_words([w.encode() for w in words if w != END_WORD], vocabulary)
            n = n[[i for i, w in enumerate(words) if w != END_WORD]]
            each = np.repeat(n, size)
            np.add.at(total, ids, each)
            stop = np.cumsum(size)
            np.add.at(first, ids[stop - size], n)
            np.add.at(last, ids[stop - 1], n)
            inner = np.ones(len(ids), bool)
            inner[stop - 1] = False
            at = np.flatnonzero(inner)
            code, where = np.unique(ids[at].astype(np.int64) * k + ids[at + 1], return_inverse=True)
            pairs.update(dict(zip(code.tolist(), np.bincount(where, weights=each[at]).astype(np.int64).tolist(), strict=True)))
        code, n = np.array(list(pairs), np.int64), list(pairs.values())
        at = [np.flatnonzero(x) for x in (total, first, last)]
        a = np.concatenate([*(np.full(len(x), -1 - i) for i, x in enumerate(at)), code // k])
        out = np.concatenate([*at, code % k])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(out, pa.int32()), pa.array(np.concatenate([total[at[0]], first[at[1]], last[at[2]], np.array(n, np.int64)]))], names=["a", "b", "n"])

    got = map_arrow(counts.select("word", "n"), run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    t = got.toArrow()
    a, b, n = (t.column(i).to_numpy() for i in range(3))
    out = [np.bincount(b[a == k], weights=n[a == k], minlength=END + 1) for k in (-1, -2, -3)]
    ends = counts.where(F.col("word") == END_WORD).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out[0][END] = ends
    return (*out, np.stack([a, b, n], 1)[a >= 0])


def encode_words(words: list[bytes], vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, how many each word has); each is encoded as " word"."""
    enc, begins = encoder(vocabulary), _begins(vocabulary)
    ids = np.array(enc.encode_ordinary(" " + b" ".join(words).decode()) if words else [], np.int32)
    at = np.flatnonzero(begins[ids])
    if len(at) == len(words):
        return ids, np.diff(np.append(at, len(ids)))
    each = [enc.encode_ordinary(" " + w.decode()) for w in words]  # white space beyond ASCII can run pieces together
    return np.array([i for e in each for i in e], np.int32), np.array([len(e) for e in each], np.int64)


class Encoder:
    """Words to table places and ids, batch by batch: words of the table by look-up, all others by the vocabulary."""

    def __init__(self, table: list[bytes], flat: np.ndarray, size: np.ndarray, vocabulary: str):
        self.place = {w: i for i, w in enumerate(table)}
        self.flat, self.size, self.vocabulary = flat, size, vocabulary
        self.first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(place in the table or -1, ids per word, all ids, the words that aren't in the table)."""
        get = self.place.get
        place = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        out = np.flatnonzero(place < 0)
        rare = [words[i] for i in out.tolist()]
        ids, size = encode_words(rare, self.vocabulary)
        many, first = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        known = place >= 0
        many[known], first[known] = self.size[place[known]], self.first[place[known]]
        many[out], first[out] = size, len(self.flat) + np.cumsum(size) - size
        ends = np.cumsum(many)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - many - first, many)
        return place, many, np.concatenate([self.flat, ids])[at], rare


_BEGINS: dict[str, np.ndarray] = {}


def _begins(vocabulary: str) -> np.ndarray:
    """Which ids begin with a space."""
    if vocabulary not in _BEGINS:
        enc = encoder(vocabulary)
        _BEGINS[vocabulary] = np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(END)] + [False])
    return _BEGINS[vocabulary]


def train(encoded: DataFrame, counts: tuple[np.ndarray, ...]) -> tuple[dict[str, np.ndarray], lm.Vocabulary]:
    """encoded: part, ids. Each row whose part is the number of a round trains in that round."""
    v = lm.Vocabulary(counts[0])
    now = lm.flatten(lm.start(v, *counts[1:]))
    for turn, rate in enumerate(RATES):

        def learn(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            trainer = lm.Trainer(lm.unflatten(now), v, rate)
            for b in batches:
                trainer.learn([np.frombuffer(x, "<u2") for x in b.column(0).to_pylist()], END)
            if trainer.seen and trainer.sane():
                yield pa.RecordBatch.from_arrays([pa.array([trainer.seen], pa.int64()), pa.array([lm.flatten(trainer.p).astype(np.float32).tobytes()], pa.binary())], names=["n", "p"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0.0, 0
            for b in batches:
                for w, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    total, n = total + w * np.frombuffer(p, np.float32).astype(np.float64), n + w
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "p"])

        learned = map_arrow(encoded.where(F.col("part") == turn).select("ids"), learn, "n long, p binary")
        got = map_arrow(learned.repartition(REDUCERS), average, "n long, p binary").collect()
        if got:
            weight = np.array([r["n"] for r in got], float)
            now = (np.stack([np.frombuffer(r["p"], np.float32) for r in got]) * (weight / weight.sum())[:, None]).sum(0).astype(np.float32)
    return lm.unflatten(now), v


class Words:
    """The commonest words and what follows from the counts. counts: staged."""

    def __init__(self, counts: DataFrame, vocabulary: str):
        sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.total, self.distinct = sums["n"], sums["v"]
        self.below = 0.1 * (sums["v"] + 1) + self.total
        heavy = [(w.encode(), n) for w, n in commonest(counts.where(F.col("word") != END_WORD), "word", HEAVY)]
        end_count = next((r["n"] for r in counts.where(F.col("word") == END_WORD).collect()), 0)
        self.table = [w for w, _ in heavy]
        self.flat, self.size = encode_words(self.table, vocabulary)
        #: counts of the table's words, then the end's
        self.number = np.array([n for _, n in heavy] + [end_count], np.float64)


def encode_texts(docs: DataFrame, words: Words, vocabulary: str, keep: tuple[str, ...], learn: str) -> DataFrame:
    """``keep`` columns with row, part, n_tokens and sums of the base score, the ids and words of every text, and the
    64-bit hashes of its words beyond the table, each once, with how often it occurs. part: the training round, by the
    text's hash; -1 where not ``learn``."""
    part = F.when(F.col(learn), F.pmod(F.xxhash64("text"), F.lit(len(RATES)))).otherwise(-1).cast("int")
    docs = docs.select(*(F.col(k) for k in keep), part.alias("__part"), F.col("text").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-2])
    table, flat, size, number = words.table, words.flat, words.size, words.number
    base, last = np.log10((number + 0.1) / words.below), len(words.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        encode = Encoder(table, flat, size, vocabulary)
        for b in batches:
            texts, lo, out = strings(b.column(b.num_columns - 1)), 0, []
            while lo < len(texts):
                some, n, chars = [], [], 0
                while lo < len(texts) and (not n or chars < 2_000_000):
                    own = words_of(texts[lo])
                    some += own
                    n.append(len(own))
                    chars += len(texts[lo])
                    lo += 1
                out += described(encode, some, np.array(n))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            cols = [*zip(*out, strict=True)] if out else [[]] * len(kinds)
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], b.column(b.num_columns - 2), pa.array(rows), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*b.schema.names[:-2], "part", "row", "n_tokens", "heavy_known", "heavy_base", "ids", "place", "many", "rare", "often"])

    def described(encode, some, n):
        import xxhash

        place, many, ids, rare = encode(some)
        marks = iter([xxhash.xxh64_intdigest(w, seed=42) for w in rare])
        ends = np.cumsum(n)
        id_ends, ids = np.concatenate([[0], np.cumsum(many)]), ids.astype("<u2")
        for a, z in zip((ends - n).tolist(), ends.tolist(), strict=True):
            p, m = place[a:z], many[a:z]
            known = p[p >= 0]
            own, often = np.unique(np.array([next(marks) for _ in range(z - a - len(known))], np.uint64).view(np.int64), return_counts=True)
            wide = np.uint8 if not len(m) or m.max() < 256 else np.uint32
            yield z - a + 1, len(known) + int(number[last] > 0), float(base[known].sum() + base[last]), ids[id_ends[a] : id_ends[z]].tobytes(), p.astype("<i4").tobytes(), m.astype(wide).tobytes(), own, often.astype(np.int32)

    return stage(map_arrow(docs, run, f"{fields}, part int, row long, n_tokens long, heavy_known long, heavy_base double, ids binary, place binary, many binary, rare array<long>, often array<int>"), "encoded")


def score_texts(encoded: DataFrame, counts: DataFrame, words: Words, params: dict[str, np.ndarray], v: lm.Vocabulary, keep: tuple[str, ...], mix: float = MIX) -> DataFrame:
    """``keep`` columns with n_tokens, n_known, train_tokens, base_score and score of every row. counts: staged.

    mix: the weight of the words' shares; 0 leaves the attention model alone.
    """
    number, last = words.number, len(words.table)
    every = max(1.0, float(words.total + words.distinct))
    # for places -1 (not in the table) and last (the end) too
    with np.errstate(divide="ignore"):
        share = np.log(np.append(number / every, 0.0) * mix)
        rest = float(np.log(mix * (1 - number.sum() / every)))
    alone = np.append(v.alone, 0.0)  # the end is in the table
    rows = encoded.select(*keep, "row", "n_tokens", "heavy_known", "heavy_base", F.xxhash64("ids", "place", "many").alias("__mark"), "ids", "place", "many")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n_tokens").to_numpy() - 1
            ids, place, many = (b.column(k).to_pylist() for k in ("ids", "place", "many"))
            score, lo = np.empty(len(n)), 0
            while lo < len(n):
                hi, size = lo, 0
                while hi < len(n) and (hi == lo or size < 400_000):
                    size += len(ids[hi])
                    hi += 1
                score[lo:hi] = some(n[lo:hi], ids[lo:hi], place[lo:hi], many[lo:hi])
                lo = hi
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(score)], names=[*b.schema.names[:-3], "score"])

    def some(n, ids, place, many):
        ids = [np.frombuffer(x, "<u2") for x in ids]
        logs = np.concatenate(list(lm.score_ids(params, v, ids, END))).astype(np.float64)
        # per word, the end of each text after its words
        is_word = np.ones(int(n.sum()) + len(n), bool)
        is_word[np.cumsum(n) + np.arange(len(n))] = False
        where, length = np.full(len(is_word), last, np.int64), np.ones(len(is_word), np.int64)
        where[is_word] = np.frombuffer(b"".join(place), "<i4")
        length[is_word] = np.concatenate([np.frombuffer(x, np.uint8 if len(x) == k else "<u4") for x, k in zip(many, n.tolist(), strict=True)])
        first = np.cumsum(length) - length
        model = np.add.reduceat(logs, first)
        spelled = np.add.reduceat(alone[np.concatenate([x for t in ids for x in (t, (END,))])], first)
        spelled[~is_word] = -np.inf
        mixed = np.logaddexp(model + np.log1p(-mix), np.logaddexp(share[where], spelled + rest))
        return np.bincount(np.repeat(np.arange(len(n)), n + 1), weights=mixed, minlength=len(n)) / np.log(10)

    rows = map_arrow(rows, run, f"{fields}, score double")
    light = encoded.select("row", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("row", F.col("x.rare").alias("w"), F.col("x.often").alias("tf"))
    light = light.join(counts.select(F.xxhash64("word").alias("w"), "n"), "w", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    light = light.groupBy("row").agg(F.sum(F.col("tf") * F.log10((F.col("c") + 0.1) / F.lit(words.below))).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    out = rows.join(light, "row", "left")
    out = out.select(*keep, "__mark", "n_tokens", (F.col("heavy_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), (F.col("heavy_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score")
    out = stage(out, "scored")
    low = [F.min(c).alias(f"__{c}") for c in ("base_score", "score")]
    alike = out.groupBy("__mark").agg(*low, F.max("base_score").alias("b"), F.max("score").alias("s")).where("__base_score < b or __score < s").drop("b", "s")
    return out.join(alike, "__mark", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in ("base_score", "score")}).drop("__mark", "__base_score", "__score")


def learned(docs: DataFrame, vocabulary: str, keep: tuple[str, ...], learn: str):
    """(encoded texts, word counts, Words, parameters, Vocabulary) with all learned from the rows where ``learn``."""
    counts = stage(word_counts(docs.where(learn).select("text")), "words")
    words = Words(counts, vocabulary)
    encoded = encode_texts(docs, words, vocabulary, keep, learn)
    return encoded, counts, words, *train(encoded, id_counts(counts, vocabulary))


def op5_lm_scoring(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY, mix: float = MIX) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (remainder() == 0).alias("held_out")).withColumn("learn", ~F.col("held_out"))
    encoded, counts, words, params, v = learned(docs, vocabulary, ("doc_id", "held_out"), "learn")
    return score_texts(encoded, counts, words, params, v, ("doc_id", "held_out"), mix)
