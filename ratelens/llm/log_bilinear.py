"""Language-model scores: an add-one unigram base, and a log-bilinear neural model trained with noise contrast.

Every word belongs to a class: each of the most frequent words is a class of its own, and every other word,
seen or not, is in the class of its ending (its last bytes, hashed). The model predicts a token's class from
the classes of the two tokens before it: their vectors, scaled by place, are summed and multiplied with the
vectors of all classes. Inside a class a word has its add-one share of the class's training tokens. Both
factors are normalised exactly, so the probabilities of all words and of one unseen word of each class add
up to one; no token is outside the model. The number of classes follows the root of the number of tokens, up to
``MOST`` (what grows without bound are the words' counts, which stay in a table).

Training documents are dealt into shards of about ``SHARD`` tokens by their row keys, and the copies of a row that
repeats more than ``COPIES`` times over several shards. Each shard trains the model
by itself, with noise words drawn by the class frequencies, and the results are averaged by tokens, ``ROUNDS``
times; a shard's steps do not depend on how many shards there are. Seeds come from the shard's number, so neither
partitions nor tasks change the result but for the order in which floats are added, and for how many copies of a
repeated row a shard gets. A number for each pair of
context classes, the normaliser, is tabulated by matrix products.

Defined results: null or empty text is the end token alone; a null doc_id hashes as "null"; without training
tokens all words are unseen; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import LOWER, keyed, shuffle_width, slices, stored, utf8

#: Classes: least and most, half of them single words; their square is the size of the normalisers' table.
LEAST, MOST = 256, 2048
#: Bytes at the end of a word that choose its class.
ENDING = 2
WIDTH = 16
NOISE = 25
BATCH = 8192
ROUNDS = 2
RATE = 0.05
#: Training tokens of a shard, and the steps that a shard takes at least.
SHARD, STEPS = 1 << 22, 400
#: Rows of one key that stay together; more are dealt into several shards, by copy.
COPIES = 64
#: Words with at least one in so many of all tokens are counted in each task, the others by a join.
FREQUENT = 1 << 20
#: The end token's hash: that of a space, which no word holds.
END = xxhash.xxh3_64_intdigest(b" ")
#: Places from here on number words that are not frequent.
_RARE = 1 << 40


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def ending(word: bytes) -> int:
    """16 bits of a hash of the word's last bytes."""
    return xxhash.xxh3_64_intdigest(word[-ENDING:]) & 0xFFFF


def word_counts(docs: DataFrame) -> DataFrame:
    """h, e, c: the tokens of each word, by hash, in the training documents, and its ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        ends = 0

        def rows() -> pa.RecordBatch:
            hashes = np.array([*map(xxhash.xxh3_64_intdigest, seen), END], dtype=np.uint64).view(np.int64)
            endings = np.array([*map(ending, seen), ending(b" ")], dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(endings), pa.array(np.array([*seen.values(), ends], dtype=np.int64))], ["h", "e", "c"])

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                if not held_out(doc):
                    seen.update(text.translate(LOWER).split())
                    ends += 1
            if len(seen) > 800_000:
                yield rows()
                seen, ends = Counter(), 0
        if ends:
            yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, "h long, e int, c long").groupBy("h").agg(F.min("e").alias("e"), F.sum("c").alias("c"))


@dataclass
class Words:
    """What is known of words: those counted in each task (the single ones first), and the classes' normalisers.

    Class 0 is the start of a text, then come the single words, then the endings."""

    hashes: np.ndarray
    counts: np.ndarray
    singles: int
    endings: int
    tokens: int
    distinct: int
    frequency: np.ndarray
    log_z: np.ndarray

    def classes_of(self, code: np.ndarray) -> np.ndarray:
        place, end = code >> np.uint64(_ENDING_BITS), (code & np.uint64((1 << _ENDING_BITS) - 1)).astype(np.int64)
        single = place < np.uint64(self.singles)
        return np.where(single, place.astype(np.int64) + 1, 1 + self.singles + end % self.endings)


def known_words(counts: DataFrame, frequent: int = FREQUENT, classes: int | None = None) -> Words:
    """The bounded part of the counts, and the classes' totals."""
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = row["n"], row["v"]
    size = classes or min(MOST, max(LEAST, 1 << max(0, round(math.log2(max(n, 1)) / 2 - 3))))
    top = counts.filter(F.col("c") * frequent >= n).toArrow()
    h, e, c = (top.column(x).to_numpy() for x in ("h", "e", "c"))
    order = np.lexsort((h.view(np.uint64), -c))
    h, e, c = h[order].view(np.uint64), e[order].astype(np.int64), c[order]
    singles, endings = min(size // 2, len(h)), size // 2
    totals = counts.groupBy(F.pmod("e", F.lit(endings)).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    many, words = np.zeros(endings), np.zeros(endings)
    k = totals.column("k").to_numpy()
    many[k], words[k] = totals.column("n").to_numpy(), totals.column("v").to_numpy()
    np.subtract.at(many, e[:singles] % endings, c[:singles])
    np.subtract.at(words, e[:singles] % endings, 1)
    # A single word is its class; in the class of an ending one unseen word has a share too.
    log_z = np.concatenate([np.zeros(1 + singles), np.log10(many + words + 1)])
    return Words(h, c, singles, endings, n, v, np.concatenate([[0], c[:singles], many]), log_z)


_ENDING_BITS = 16


class _Codes(dict):
    """Words by code: above the ending, the place among the frequent words or a number past all places; and hashes of the others."""

    def __init__(self, words: Words):
        self.places = dict(zip(words.hashes.tolist(), range(len(words.hashes)), strict=True))
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        place = self.places.get(h)
        if place is None:
            place = _RARE + len(self.hashes)
            self.hashes.append(h)
        self[word] = code = place << _ENDING_BITS | ending(word)
        return code

    def bounded(self) -> None:
        if len(self) > 300_000:
            self.clear()
            self.hashes = []


_TOKENS = "uid long, doc_id long, rid long, held_out boolean, n_tokens long, n_frequent long, frequent_log double, other_log double, classes binary, rare binary, rare_times binary"


def tokens(docs: DataFrame, words: Words) -> DataFrame:
    """Each document's classes, its rare words, and what frequent words contribute."""
    logs = np.log10(words.counts + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, uid = _Codes(words), TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            codes.bounded()
            end = codes[b" "]
            out: list[list] = [[] for _ in range(11)]
            for doc, rid, text in zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), utf8(batch.column("text")), strict=True):
                split = text.translate(LOWER).split()
                code = np.fromiter(map(codes.__getitem__, split), dtype=np.uint64, count=len(split))
                code = np.append(code, np.uint64(end))
                place = code >> np.uint64(_ENDING_BITS)
                known = place < np.uint64(_RARE)
                rare, times = np.unique(place[~known], return_counts=True)
                rare = np.array([codes.hashes[k - _RARE] for k in rare.tolist()], dtype=np.uint64)
                place = place[known].astype(np.int64)
                log = logs[place]
                values = (uid, doc, rid, held_out(doc), len(code), len(place), float(log.sum()), float(log[place >= words.singles].sum()), words.classes_of(code).astype("<u2").tobytes(), rare.tobytes(), times.astype("<i4").tobytes())
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                uid += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [c.split()[0] for c in _TOKENS.split(", ")])

    return stored(docs.select("doc_id", "rid", "text").mapInArrow(run, _TOKENS), "tokens")


def rare_words(table: DataFrame) -> DataFrame:
    """uid, rare_log, rare_known: what rare words contribute to each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(x, dtype=np.int64) for x in batch.column("rare").to_pylist()]
            times = [np.frombuffer(x, dtype="<i4") for x in batch.column("rare_times").to_pylist()]
            n = np.array([len(x) for x in hashes])
            train = np.repeat(~np.array(batch.column("held_out").to_pylist(), dtype=bool), n)
            uid = np.repeat(batch.column("uid").to_numpy(), n)
            t = np.concatenate([*times, np.zeros(0, dtype="<i4")])
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(np.concatenate([*hashes, np.zeros(0, dtype=np.int64)])), pa.array(t), pa.array(np.where(train, t, 0).astype(np.int32))], ["uid", "h", "times", "training"])

    rows = table.select("uid", "held_out", "rare", "rare_times").mapInArrow(run, "uid long, h long, times int, training int")
    # Counted where they are, and joined by keys, which can be split: a word may be in very many held-out texts only.
    counts = rows.groupBy("h").agg(F.sum("training").alias("c"))
    counted = rows.join(counts, "h").select("uid", "times", "c")
    found = counted.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    return stored(found, "rare")


class Model:
    """Vectors of context words and of predicted words, scales of the two places, and biases."""

    def __init__(self, frequency: np.ndarray, width: int = WIDTH):
        self.size, self.width = len(frequency), width
        # Class 0, the start of a text, is context only: it is neither drawn nor predicted.
        share = frequency + 1.0
        share[0] = 0
        self.noise = share / share.sum()
        rng = np.random.default_rng(7)
        n = self.size * width
        self.flat = np.concatenate([rng.normal(0, 0.1, 2 * n), np.ones(width), np.full(width, 0.5), [0.0], np.log(self.noise[1:])]).astype(np.float32)

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        n, w = self.size * self.width, self.width
        return [flat[:n].reshape(self.size, w), flat[n : 2 * n].reshape(self.size, w), flat[2 * n : 2 * n + w], flat[2 * n + w : 2 * n + 2 * w], flat[2 * n + 2 * w :]]

    def train(self, classes: np.ndarray, before: np.ndarray, before2: np.ndarray, rate: float, squares: np.ndarray, rng: np.random.Generator) -> None:
        """A pass over tokens with their contexts, by batches, with steps scaled by past gradients."""
        for at in range(0, len(classes), BATCH):
            w, a, b = (x[at : at + BATCH] for x in (classes, before, before2))
            context, target, one, two, bias = self.parts(self.flat)
            drawn = rng.choice(self.size, NOISE, p=self.noise)
            ra, rb = context[a], context[b]
            q = ra * one + rb * two
            log_noise = np.log(NOISE * np.maximum(self.noise, 1e-300)).astype(np.float32)
            real = 1 / (1 + np.exp((q * target[w]).sum(axis=1) + bias[w] - log_noise[w]))  # 1 - P(data)
            fake = 1 / (1 + np.exp(-(q @ target[drawn].T + bias[drawn] - log_noise[drawn])))  # P(data)
            dq = real[:, None] * target[w] - fake @ target[drawn]
            flat = np.zeros_like(self.flat)
            d_context, d_target, d_one, d_two, d_bias = self.parts(flat)
            for dim in range(self.width):
                d_context[:, dim] = np.bincount(a, dq[:, dim] * one[dim], self.size) + np.bincount(b, dq[:, dim] * two[dim], self.size)
                d_target[:, dim] = np.bincount(w, real * q[:, dim], self.size)
            np.subtract.at(d_target, drawn, fake.T @ q)
            d_bias += np.bincount(w, real, self.size).astype(np.float32)
            np.subtract.at(d_bias, drawn, fake.sum(axis=0))
            d_one += (dq * ra).sum(axis=0)
            d_two += (dq * rb).sum(axis=0)
            squares += flat * flat
            self.flat += rate * flat / np.sqrt(squares + 1e-6)

    def log_normalisers(self, first: int) -> np.ndarray:
        """For a word just before and every word before that: log of the sum over all predictions."""
        context, target, one, two, bias = self.parts(self.flat)
        scores = ((context[first] * one + context * two) @ target.T + bias)[:, 1:]
        top = scores.max(axis=1, keepdims=True)
        return (np.log(np.exp(scores - top).sum(axis=1)) + top[:, 0]).astype(np.float32)


def _contexts(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of documents end to end, the classes one and two before (0 at the start), and the documents' starts."""
    each = [np.frombuffer(x, dtype="<u2") for x in rows]
    starts = np.cumsum([0, *map(len, each)])[:-1]
    classes = np.concatenate(each).astype(np.int64)
    before, before2 = np.zeros_like(classes), np.zeros_like(classes)
    before[1:], before2[2:] = classes[:-1], classes[:-2]
    before[starts] = before2[starts] = 0
    second = starts + 1
    second = second[second < len(classes)]
    before2[second] = 0
    return classes, before, before2, starts


def fit(table: DataFrame, words: Words, rounds: int = ROUNDS, shard: int = SHARD) -> Model:
    """Train on all training documents of ``table``: every shard on its own, then the average by tokens."""
    frequency = words.frequency
    model = Model(frequency)
    spark = table.sparkSession
    shards = max(1, -(-words.tokens // shard))
    rows = table.filter(~F.col("held_out")).select("uid", "rid", "classes")
    # Rows that repeat share their key: those of many copies are dealt by copy.
    many = rows.groupBy("rid").agg(F.count("*").alias("copies")).filter(F.col("copies") > COPIES)
    rows = rows.join(many, "rid", "left").withColumn("copy", F.pmod("uid", F.ceil(F.coalesce("copies", F.lit(1)) / COPIES)))
    dealt = rows.select(F.pmod(F.xxhash64("rid", "copy"), F.lit(shards)).alias("shard"), "rid", "classes")
    dealt = dealt.repartition(max(shuffle_width(spark), -(-shards // 4)), "shard").sortWithinPartitions("shard", "rid")
    for k in range(rounds):
        rate = RATE / (k + 1)

        def run(batches: Iterator[pa.RecordBatch], model: Model = model, rate: float = rate, k: int = k) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(len(model.flat)), 0

            def trained(number: int, rows: list[bytes]) -> None:
                nonlocal total, seen
                own, squares, rng = Model(frequency), np.zeros_like(model.flat), np.random.default_rng([k, number])
                own.flat = model.flat.copy()
                classes, before, before2, _ = _contexts(rows)
                for _ in range(min(STEPS, max(1, STEPS * BATCH // len(classes)))):
                    order = rng.permutation(len(classes))
                    own.train(classes[order], before[order], before2[order], rate, squares, rng)
                total += own.flat.astype(np.float64) * len(classes)
                seen += len(classes)

            number, rows = -1, []
            for batch in batches:
                for s, row in zip(batch.column("shard").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                    if s != number and rows:
                        trained(number, rows)
                        rows = []
                    number = s
                    rows.append(row)
            if rows:
                trained(number, rows)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), float(seen)))], ["place", "value", "weight"])

        parts = dealt.mapInArrow(run, "place int, value double, weight double")
        mean = parts.groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow()
        if mean.num_rows:
            flat = model.flat.copy()
            flat[mean.column("place").to_numpy()] = mean.column("value").to_numpy()
            model = Model(frequency)
            model.flat = flat

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([model.log_normalisers(i).tobytes() for i in ids], pa.binary())], ["id", "norm"])

    # Bounded by the vocabulary, whatever the input: a number for each pair of classes.
    rows = spark.range(0, model.size, 1, shuffle_width(spark)).mapInArrow(norms, "id long, norm binary").collect()
    model.norm = np.stack([np.frombuffer(r["norm"], dtype=np.float32) for r in sorted(rows, key=lambda r: r["id"])])
    return model


def _scored(table: DataFrame, model: Model, words: Words) -> DataFrame:
    """The log10 probability of each document's classes, less the logarithms of the classes' totals."""
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_frequent", "frequent_log", "other_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, target, one, two, bias = model.parts(model.flat)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                w, a, b, starts = _contexts(batch.column("classes").to_pylist())
                log = np.zeros(len(w))
                for k in range(0, len(w), 1 << 15):
                    on = slice(k, k + (1 << 15))
                    q = context[a[on]] * one + context[b[on]] * two
                    log[on] = (np.einsum("ij,ij->i", q, target[w[on]]) + bias[w[on]] - model.norm[a[on], b[on]]) / math.log(10) - words.log_z[w[on]]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.add.reduceat(log, starts))], [*names, "class_log"])

    schema = table.select(*names).withColumn("class_log", F.lit(0.0)).schema
    return table.select(*names, "classes").mapInArrow(run, schema)


def train(docs: DataFrame, frequent: int = FREQUENT, rounds: int = ROUNDS, classes: int | None = None, shard: int = SHARD) -> tuple[DataFrame, Words, Model]:
    """The documents' tokens, what is known of words, and the model, from the training documents among ``docs``."""
    rows = keyed(docs)
    words = known_words(stored(word_counts(rows), "word-counts"), frequent, classes)
    table = tokens(rows, words)
    return table, words, fit(table, words, rounds, shard)


def score_texts(docs: DataFrame, frequent: int = FREQUENT, rounds: int = ROUNDS, classes: int | None = None, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    return scores(*train(docs, frequent, rounds, classes, shard))


def scores(table: DataFrame, words: Words, model: Model) -> DataFrame:
    n, v = words.tokens, words.distinct
    scored = _scored(table, model, words).join(rare_words(table), "uid", "left")
    rare_log, rare_known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    base = F.col("frequent_log") + rare_log - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return scored.select("doc_id", "held_out", "n_tokens", (F.col("n_frequent") + rare_known).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("class_log") + F.col("other_log") + rare_log).alias("score"))
