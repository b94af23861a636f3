"""Spelling variants: words within one edit of each other, by an index of variable-length grams.

*Dictionary.* The substrings of ``QMIN`` to qmax characters of all distinct words (between a start and an end mark)
are counted; qmax follows the logarithm of the number of places (4 from a million places on, 5 from 34 million), so
that lists do not grow with the vocabulary. Those that more than a threshold of places hold are frequent; the threshold follows the number
of places, so that at most (qmax - QMIN + 1) x ``PLACES`` grams are, whatever the input. A rare gram is selective
enough as it is; a frequent one is pruned in favour of longer ones.

*Decomposition.* At each place of a word stands one gram: the shortest that is not frequent, or one of qmax
characters, or what is left of the word. It depends on its own characters only, so an edit leaves every gram
alone that does not cover it.

*Bound and merging.* A word's affected-gram bound is the most grams that cover one of its characters. Of a word
with g grams and bound b, a word within one edit has at least g - b, at the same distance from the start or from
the end. So the g - b - 1 longest lists are set aside: both words stand together in the list of one of the b + 1
rarest grams of each. Lists are kept by gram and place; a pair of equal length meets at the same distance from the
start, so in lists by distance from the end only lengths that differ are compared. The candidates of a list are compared character by
character, many at a time. A list of more than ``BIG`` words is cut: its words meet by what is left of them when
one character is deleted, which words within one edit share, and which few words can have in common.

A word's form is its near word with the largest count, if that is large enough; roots follow forms, whose counts
rise tenfold with each step, by doubling.

Defined results: null texts have no words; rows that repeat count as often as they stand there; a null doc_id is
written ``null`` where the damage rule needs it; words of any length are compared; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import LOWER, keyed, shuffle_width, slices, stored, utf8

QMIN, LONGEST = 2, 7
PLACES = 1 << 16
#: Grams below so many places are never frequent.
RARE = 16
BIG = 1024
#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, after lower-casing; and what such runs can only stand in.
_RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")
_AROUND = re.compile(rb"[a-z\x80-\xbf\xc3]++")
#: Longer words are compared one by one.
_WIDE = 30


def damaged(run: bytes, doc: int, every: int | None) -> bytes:
    """A run (Latin-1) without one character, if the checksum of document and run says so. ``doc`` is the crc32 of
    the document's part of the key."""
    if every:
        h = zlib.crc32(run.decode("latin-1").encode(), doc)
        if h % every == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def runs(text: bytes, least: int) -> list[bytes]:
    """The runs of a text as Latin-1, but those of fewer than ``least`` bytes in UTF-8."""
    out = []
    for w in _AROUND.findall(text.translate(LOWER)):
        if len(w) >= least:
            if w.isascii():
                out.append(w)
            else:
                out += [x.decode().encode("latin-1") for x in _RUN.findall(w)]
    return out


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, damage: int | None = None) -> DataFrame:
    """word, n: the words of all texts. With ``damage``, one run in so many of a document loses a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                crc = zlib.crc32(b"%s:" % (b"null" if doc is None else str(doc).encode()))
                for w, n in Counter(runs(text, min_length)).items():
                    if len(w) >= min_length and len(w := damaged(w, crc, damage)) >= min_length:
                        total[w] += n
            if len(total) > 200_000:
                yield flush()
                total.clear()
        if total:
            yield flush()

    found = keyed(docs).select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def gram_dictionary(words: DataFrame, size: int, qmin: int, qmax: int, places: int = PLACES) -> dict[bytes, int]:
    """The frequent grams with their counts over distinct words, which have ``size`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for w in _latin(batch.column("word")):
                s = b"\x01" + w + b"\x02"
                for q in range(qmin, qmax + 1):
                    total.update([s[p : p + q] for p in range(len(s) - q + 1)])
            if len(total) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

    counts = words.select("word").mapInArrow(run, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    frequent = counts.filter(F.col("n") > max(RARE, size // places)).toArrow()
    return dict(zip(frequent.column("gram").to_pylist(), frequent.column("n").to_pylist(), strict=True))


def grams(word: bytes, frequent: dict[bytes, int], qmin: int = QMIN, qmax: int = 4) -> list[tuple[int, bytes]]:
    """Place and gram at each place of a word between its marks."""
    s, out = b"\x01" + word + b"\x02", []
    for p in range(len(s) - qmin + 1):
        e = p + qmin
        while e < len(s) and e - p < qmax and s[p:e] in frequent:
            e += 1
        out.append((p, s[p:e]))
    return out


def affected(word: bytes, parts: list[tuple[int, bytes]]) -> int:
    """The most grams that one edit can change: those that cover one character."""
    change = [0] * (len(word) + 3)
    for p, g in parts:
        change[p] += 1
        change[p + len(g)] -= 1
    cover = most = 0
    for k, x in enumerate(change):
        cover += x
        if 1 <= k <= len(word):
            most = max(most, cover)
    return most


def list_keys(word: bytes, frequent: dict[bytes, int], qmin: int = QMIN, qmax: int = 4) -> list[int]:
    """The lists of a word: its rarest grams at their distances from the start and from the end."""
    parts = grams(word, frequent, qmin, qmax)
    rarity = lambda x: (frequent.get(x[1], 0), frequent.get(x[1][1:], 0), x[1], x[0])
    first = sorted(parts, key=rarity)[: affected(word, parts) + 1]
    h = xxhash.xxh3_64_intdigest
    # The lowest bit says from which end a list counts.
    return [h(b"%s\x00%d" % (g, at)) & ~1 | side for p, g in first for side, at in ((0, p), (1, len(word) - p))]


def inserted(s: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether rows of ``t``, of n + 1 characters, are those of ``s`` with one more; both are filled up with zeros, one
    column to spare."""
    unequal = s != t
    # Behind the first difference the longer one must go on like the shorter one.
    first = unequal.argmax(axis=1)
    behind = np.arange(s.shape[1] - 1)
    return ~((s[:, :-1] != t[:, 1:]) & (behind >= first[:, None]) & (behind < n[:, None])).any(axis=1)


def _one_edit(a: bytes, b: bytes) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return len(b) == len(a) + 1 and a[k:] == b[k + 1 :]


def list_pairs(keys: np.ndarray, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i < j) of words one edit apart that share a key; keys are sorted, and their lists bounded."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = min(_WIDE, int(size.max(initial=0))) + 2
    matrix = np.frombuffer(b"".join([w[: width - 2].ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(-1, width)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.concatenate([starts[1:], [len(keys)]])
    last = np.repeat(ends, ends - starts)  # the end of each row's list
    more = last - np.arange(len(keys)) - 1
    begin = 0
    while begin < len(keys):
        # Rows whose partners behind them in their lists are about so many pairs.
        stop = begin + max(1, int(np.searchsorted(np.cumsum(more[begin:]), 1 << 18)))
        k = more[begin:stop]
        i = np.repeat(np.arange(begin, begin + len(k)), k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        begin += len(k)
        longer = size[i] - size[j]
        close = (np.abs(longer) == 1) | (longer == 0) & (keys[i] & 1 == 0)
        i, j, longer = i[close], j[close], longer[close]
        wide = np.maximum(size[i], size[j]) > _WIDE
        hit = np.zeros(len(i), dtype=bool)
        same = np.flatnonzero(~wide & (longer == 0))
        hit[same] = np.count_nonzero(matrix[i[same]] != matrix[j[same]], axis=1) == 1
        other = np.flatnonzero(~wide & (longer != 0))
        short, long = np.where(longer[other] < 0, i[other], j[other]), np.where(longer[other] < 0, j[other], i[other])
        hit[other] = inserted(matrix[short], matrix[long], size[short])
        for at in np.flatnonzero(wide).tolist():
            hit[at] = _one_edit(words[i[at]], words[j[at]])
        yield i[hit], j[hit]


def near_pairs(words: DataFrame, qmin: int = QMIN, qmax: int | None = None, places: int = PLACES, big: int = BIG) -> DataFrame:
    """a, na, b, nb: all pairs of ``words`` (word, n) one edit apart, once each, a before b."""
    spark = words.sparkSession
    size = words.agg(F.coalesce(F.sum(F.char_length("word") + 1), F.lit(0)).alias("places"), F.coalesce(F.min(F.char_length("word")), F.lit(LONGEST)).alias("shortest")).first()
    # No longer than the shortest word, so that an edit leaves a gram of every word alone.
    qmax = min(size["shortest"], qmax or max(3, min(LONGEST, int(math.log(max(2, size["places"]), 32)))))
    frequent = gram_dictionary(words, size["places"], qmin, qmax, places)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_ = _latin(batch.column("word"))
            keys = [np.unique(np.array(list_keys(w, frequent, qmin, qmax), dtype=np.uint64)).view(np.int64) for w in words_]
            row = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, dtype=np.int64)])), pa.array(words_, pa.binary()).take(row), batch.column("n").take(row)], ["key", "w", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys = []
            for key, w in zip(batch.column("key").to_pylist(), batch.column("w").to_pylist(), strict=True):
                left = {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}
                keys.append(np.array([h(b"%d:%s" % (key, x)) & ~1 | key & 1 for x in left], dtype=np.uint64).view(np.int64))
            row = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, dtype=np.int64)])), batch.column("w").take(row), batch.column("n").take(row)], ["key", "w", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def found(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i, j in list_pairs(rows.column("key").to_numpy(), rows.column("w").to_pylist()):
                sides = [rows.take(pa.array(x)) for x in (i, j)]
                yield pa.RecordBatch.from_arrays([x.column(c) for x in sides for c in ("w", "n")], ["a", "na", "b", "nb"])

        for batch in batches:
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            # The last list may go on in the next batch.
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield from found(batch.slice(0, last))
            held = batch.slice(last)
        if held is not None:
            yield from found(held)

    row = "key long, w binary, n long"
    posted = stored(words.mapInArrow(post, row), "gram-lists")
    long = posted.groupBy("key").agg(F.count("*").alias("len")).filter(F.col("len") > big).select("key")
    lists = posted.join(long, "key", "left_anti").unionByName(posted.join(long, "key", "left_semi").mapInArrow(cut, row))
    lists = lists.repartition(shuffle_width(spark), "key").sortWithinPartitions("key")
    pairs = lists.mapInArrow(compare, "a binary, na long, b binary, nb long")
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    once = pairs.select(pick("b", "a").alias("a"), pick("nb", "na").alias("na"), pick("a", "b").alias("b"), pick("na", "nb").alias("nb")).distinct()
    # Latin-1 keeps the order of code points.
    return once.select(*(F.decode(c, "ISO-8859-1").alias(c) if c in "ab" else c for c in once.columns))


def follow(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of forms (word, form) ends. Each round doubles the steps that are taken."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        if roots.join(ahead, "root", "left_semi").isEmpty():
            return roots
        roots = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "roots")


def group_variants(words: DataFrame, ratio: int = 10, qmin: int = QMIN, qmax: int | None = None, places: int = PLACES, big: int = BIG) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n): the words of a table, once each.

    Words must be distinct and have at least two characters."""
    words = stored(words, "words")
    pairs = stored(near_pairs(words, qmin, qmax, places, big), "near")
    ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("x"))
    enough = -F.col("x.m") >= F.col("n") * ratio
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("x.other")).alias("form"), F.when(enough, -F.col("x.m")).alias("form_n"))
    judged = stored(judged, "forms")
    roots = follow(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
