"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a few megabytes of documents. Its index is a row of a table in the shared folder: the shard's
words, and over the sequence of their numbers a Burrows-Wheeler transform in a wavelet matrix with suffix
positions sampled at every sixteenth place. Every document ends in a symbol of its own, so nothing matches
across documents and suffixes differ at the latest where a document ends.

The benchmark's windows are a table too, and neither goes through the driver. A window can occur only in a
shard that holds all its words, so it is sent to the shards that hold its rarest word, counted over all
shards. A shard's index searches its windows backwards all at once, locates their occurrences by walking to
the next sampled position, and merges their spans. Windows of a large benchmark go in blocks of ``BLOCK``.

Defined results: null text, of a document or an item, has no words; an item without words has no window;
repeated items count once by item_id, which may be of any type; a null item_id is left out of the items but
its windows are hits; an empty benchmark hits nothing; rows that share doc_id and text get the same result;
other columns are carried, never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import ALNUM, fresh, keyed, row_key, shuffle_width, slices, stored, utf8

SAMPLE = 16
SHARD_BYTES = 4 << 20
#: Windows that one group searches.
BLOCK = 1 << 18
_INDEX = "shard long, doc_ids array<long>, rids array<long>, n_words array<int>, starts binary, words binary, shape binary, levels binary, marks binary, sampled binary"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a sequence of non-negative integers.

    Suffixes are sorted by as many symbols as fit into 62 bits; those that are still equal are sorted again by
    the ranks of what follows, twice as far each time."""
    n, bits = len(text), max(1, int(text.max()).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for k in range(width):
        key <<= bits
        key[: max(0, n - k)] |= text[k:]
    # A suffix that ends inside its key is told from one that goes on in zeros: no symbol is 0 but the last.
    order = np.argsort(key, kind="stable")
    fresh_row = np.concatenate([[True], np.diff(key[order]) != 0])
    rank = np.empty(n, dtype=np.int64)
    start = np.maximum.accumulate(np.where(fresh_row, np.arange(n), 0))
    rank[order] = start
    tied = ~(fresh_row & np.concatenate([fresh_row[1:], [True]]))
    slots = np.flatnonzero(tied)
    while len(slots):
        at = order[slots]
        after = at + width
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        fresh_row = np.concatenate([[True], np.diff(key) != 0])
        rank[at] = slots[np.maximum.accumulate(np.where(fresh_row, np.arange(len(at)), 0))]
        slots = slots[~(fresh_row & np.concatenate([fresh_row[1:], [True]]))]
        width *= 2
    return order


class Bits:
    """Bits with ranks: set ones before a place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def packed(bits: np.ndarray) -> np.ndarray:
        raw = np.packbits(bits, bitorder="little").tobytes()
        return np.frombuffer(raw + bytes(8 - len(raw) % 8), dtype="<u8")

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class FMIndex:
    """Backward search over a sequence of positive integers."""

    def __init__(self, size: int, bits: int, ones: list[Bits], marks: Bits, sampled: np.ndarray):
        self.size, self.bits, self.ones, self.marks, self.sampled = size, bits, ones, marks, sampled
        self.zeros = [size - int(b.before[-1]) for b in ones]

    @classmethod
    def build(cls, text: np.ndarray, sample: int = SAMPLE) -> FMIndex:
        text = np.concatenate([text, [0]]).astype(np.int64)
        suffixes, n = suffix_array(text), len(text)
        last, bits = text[suffixes - 1].astype(np.int32), max(1, int(text.max()).bit_length())
        # Wavelet matrix: level by level, from the highest bit, zeros go first.
        ones = []
        for level in range(bits - 1, -1, -1):
            bit = (last >> level) & 1 == 1
            ones.append(Bits(Bits.packed(bit)))
            last = np.concatenate([last[~bit], last[bit]])
        marked = suffixes % sample == 0
        return cls(n, bits, ones, Bits(Bits.packed(marked)), suffixes[marked])

    def pack(self) -> dict[str, bytes]:
        shape = np.array([self.size, self.bits], dtype="<i8")
        return {"shape": shape.tobytes(), "levels": b"".join(b.words.tobytes() for b in self.ones), "marks": self.marks.words.tobytes(), "sampled": self.sampled.astype("<i4").tobytes()}

    @classmethod
    def unpack(cls, row: dict[str, bytes]) -> FMIndex:
        size, bits = np.frombuffer(row["shape"], dtype="<i8").tolist()
        levels = np.frombuffer(row["levels"], dtype="<u8").reshape(bits, -1)
        return cls(size, bits, [Bits(x) for x in levels], Bits(np.frombuffer(row["marks"], dtype="<u8")), np.frombuffer(row["sampled"], dtype="<i4").astype(np.int64))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smaller symbols in the whole transform, and occurrences of each symbol in its first ``at`` places."""
        lo, hi = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = self.ones[k].rank(lo), self.ones[k].rank(hi)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return lo, hi - lo

    def before(self, symbol: np.ndarray) -> np.ndarray:
        """How many smaller symbols the text has: a walk that adds the zeros passed on the way down."""
        out, lo, hi = np.zeros_like(symbol), np.zeros_like(symbol), np.full_like(symbol, self.size)
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = self.ones[k].rank(lo), self.ones[k].rank(hi)
            out += np.where(one, (hi - lo) - (b - a), 0)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return out

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            bit, ones = self.ones[k].get(at), self.ones[k].rank(at)
            out = out * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return out

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows of each right-aligned pattern; empty ranges for those that do not occur."""
        lo, hi = np.zeros(len(words), dtype=np.int64), np.full(len(words), self.size, dtype=np.int64)
        symbols, place = np.unique(words, return_inverse=True)
        before = self.before(np.minimum(symbols, (1 << self.bits) - 1))[place.reshape(words.shape)]
        width = words.shape[1]
        for k in range(width - 1, -1, -1):
            on = np.flatnonzero((lo < hi) & (lengths >= width - k))
            if not len(on):
                break
            s, first = words[on, k], before[on, k]
            known = s < 1 << self.bits
            s = np.where(known, s, 0)
            lo[on], hi[on] = first + self.rank(s, lo[on])[1], np.where(known, first + self.rank(s, hi[on])[1], 0)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row."""
        rows, steps, out = rows.copy(), np.zeros_like(rows), np.full(len(rows), -1, dtype=np.int64)
        left = np.arange(len(rows))
        while len(left):
            found = self.marks.get(rows[left]) == 1
            hit = left[found]
            out[hit] = self.sampled[self.marks.rank(rows[hit])] + steps[hit]
            left = left[~found]
            at = rows[left]
            s = self.symbol(at)
            rows[left], steps[left] = self.before(s) + self.rank(s, at)[1], steps[left] + 1
        return out


class _Numbers(dict):
    """Words numbered from 1 as they come up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def build_shard(texts: list[bytes]) -> dict[str, bytes]:
    """A shard's index: words are numbered from 1, ends of documents come after them."""
    vocab = _Numbers()
    split = [t.translate(ALNUM).split() for t in texts]
    n = np.array([len(w) for w in split], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(n + 1)])
    text = np.zeros(starts[-1], dtype=np.int64)
    get = vocab.__getitem__
    for at, words in zip(starts[:-1].tolist(), split, strict=True):
        text[at : at + len(words)] = np.fromiter(map(get, words), dtype=np.int64, count=len(words))
    text[starts[1:] - 1] = len(vocab) + 1 + np.arange(len(split))
    return FMIndex.build(text).pack() | {"starts": starts.astype("<i8").tobytes(), "words": b" ".join(vocab)}


def index_shards(docs: DataFrame) -> DataFrame:
    """The table of all shards' indexes, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=SHARD_BYTES):
            row = build_shard(utf8(batch.column("text")))
            ids = [pa.array([batch.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "rid")]
            counts = pa.array([(np.diff(np.frombuffer(row["starts"], dtype="<i8")) - 1).astype(np.int32)], pa.list_(pa.int32()))
            names = ["starts", "words", "shape", "levels", "marks", "sampled"]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *ids, counts, *(pa.array([row[c]], pa.binary()) for c in names)], ["shard", "doc_ids", "rids", "n_words", *names])
            shard += 1

    return stored(keyed(docs).mapInArrow(run, _INDEX), "fm-index")


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """win (words joined by a space, UTF-8), item_id: the windows of each item, once each; written to the shared folder."""
    kind = benchmark.select("item_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            wins: list[bytes] = []
            row: list[int] = []
            for k, text in enumerate(utf8(batch.column("text"))):
                words = text.translate(ALNUM).split()
                own = dict.fromkeys(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1) if words else 0))
                wins += own
                row += [k] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(wins, pa.binary()), batch.column("item_id").take(pa.array(row, pa.int64()))], ["win", "item_id"])

    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, f"win binary, item_id {kind}").distinct(), "windows")


def _word_hashes(table: DataFrame, column: str, key: str) -> DataFrame:
    """key, h: the hash of every word in a column of words joined by spaces."""
    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [x.split(b" ") if x else [] for x in batch.column(column).to_pylist()]
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), dtype=np.uint64).view(np.int64)
            row = np.repeat(np.arange(len(words)), [len(w) for w in words])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), pa.array(hashes)], [key, "h"])

    return table.select(key, column).mapInArrow(run, f"{key} {kind}, h long")


def window_shards(index: DataFrame, wins: DataFrame) -> DataFrame:
    """shard, win: the shards that hold the rarest word of a window, for windows whose words all occur somewhere."""
    words = _word_hashes(wins.withColumn("text", F.col("win")), "text", "win")
    held = stored(_word_hashes(index, "words", "shard").join(words.select("h").distinct(), "h", "left_semi"), "held")
    counts = held.groupBy("h").agg(F.count("*").alias("n"))
    rated = words.join(counts, "h", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("x"))
    return rated.filter("x.n > 0").select("win", F.col("x.h").alias("h")).join(held, "h").select("shard", "win")


def search_shard(row: dict, wins: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of the windows in a shard: number of the window, number of the document, first word there."""
    vocab = {w: k for k, w in enumerate(row["words"].split(b" "), 1)}
    split = [[vocab.get(w, 0) for w in x.split(b" ")] for x in wins]
    able = [k for k, ids in enumerate(split) if all(ids)]
    none = np.zeros(0, dtype=np.int64)
    if not able:
        return none, none, none
    lengths = np.array([len(split[k]) for k in able], dtype=np.int64)
    words = np.zeros((len(able), int(lengths.max())), dtype=np.int64)
    for k, n in enumerate(lengths.tolist()):
        words[k, words.shape[1] - n :] = split[able[k]]
    index = FMIndex.unpack(row)
    lo, hi = index.search(words, lengths)
    times = np.maximum(hi - lo, 0)
    window = np.repeat(np.array(able), times)
    rows = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
    place = index.locate(rows)
    starts = np.frombuffer(row["starts"], dtype="<i8")
    doc = np.searchsorted(starts, place, side="right") - 1
    return window, doc, place - starts[doc]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """Maximal intervals of those given, which are sorted by their starts."""
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[first].tolist(), reach[np.concatenate([first[1:], [len(start)]]) - 1].tolist()


def met(index: DataFrame, packed: DataFrame) -> DataFrame:
    """The indexes of shards beside their lists of windows (shard, asked). Both are dealt by shard, once, and read on in
    another stage than the one that reads whole columns of indexes from files; lists are too long to go everywhere."""
    dealt = index.drop("doc_ids", "rids", "n_words").repartition(shuffle_width(index.sparkSession), "shard")
    return dealt.join(packed.hint("merge"), "shard")


_HITS = "shard long, k int, starts array<int>, ends array<int>, wins array<binary>"


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, block: int = BLOCK) -> DataFrame:
    """doc_id, rid, n_words, spans (array of hit word intervals, start and end) and items (array of item_id) of every row."""
    index, windows = index_shards(docs), benchmark_windows(benchmark, width)
    wins = windows.select("win").distinct()
    asked = stored(window_shards(index, wins), "asked")
    blocks = max(1, -(-wins.count() // block))
    # A shard's windows are lists of about ``block``; the index meets them once, and is searched as it is read.
    packed = asked.groupBy("shard", F.pmod(F.xxhash64("win"), F.lit(blocks)).alias("block")).agg(F.collect_list("win").alias("asked")).drop("block")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()))
        for batch in batches:
            for row in (row for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist()):
                out: list[tuple] = []
                wins = row["asked"]
                window, doc, at = search_shard(row, wins)
                order = np.lexsort((at, doc))
                window, doc, at = window[order], doc[order], at[order]
                end = at + np.array([wins[w].count(b" ") + 1 for w in window.tolist()], dtype=np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]]).tolist()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a < b:
                        starts, ends = merged(at[a:b], end[a:b])
                        out.append((row["shard"], int(doc[a]), starts, ends, [wins[w] for w in np.unique(window[a:b]).tolist()]))
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in _HITS.split(", ")])

    hits = met(index, packed).mapInArrow(probe, _HITS)
    hits = stored(hits, "hits")
    found = hits.groupBy("shard", "k").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    named = hits.select("shard", "k", F.explode("wins").alias("win")).join(windows, "win").filter(F.col("item_id").isNotNull())
    named = named.groupBy("shard", "k").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    kind = windows.schema["item_id"].dataType.simpleString()
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "rids", "n_words")).alias("k", "x"))
    both = rows.join(found.mapInArrow(_union, "shard long, k int, spans array<struct<start:int,end:int>>"), ["shard", "k"], "left").join(named, ["shard", "k"], "left")
    spans, items = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), F.coalesce("items", F.array().cast(f"array<{kind}>"))
    return both.select(F.col("x.doc_ids").alias("doc_id"), F.col("x.rids").alias("rid"), F.col("x.n_words").cast("long").alias("n_words"), spans.alias("spans"), items.alias("items"))


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a document from several blocks of windows, merged."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = []
        for start, end in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            order = np.argsort(start, kind="stable")
            pairs = zip(*merged(np.array(start)[order], np.array(end)[order]), strict=True)
            spans.append([{"start": a, "end": b} for a, b in pairs])
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("k"), pa.array(spans, kind)], ["shard", "k", "spans"])


_WORD = re.compile(rb"[^ ]+")


def cut(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of its spans and what stands between neighbouring ones."""
    words = [m.span() for m in _WORD.finditer(text.translate(ALNUM))]
    out, at = [], 0
    for span in spans:
        out.append(text[at : words[span["start"]][0]])
        at = words[span["end"] - 1][1]
    return b"".join([*out, text[at:]])


def remove_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` with the hit words cut out of their texts; texts without a hit are unchanged."""
    names = docs.columns
    rid, hit_id, hit_rid, spans = fresh(names, "rid", "hit_id", "hit_rid", "spans")
    found = find_hits(docs, benchmark, width).filter(F.size("spans") > 0)
    found = found.groupBy(F.col("doc_id").alias(hit_id), F.col("rid").alias(hit_rid)).agg(F.any_value("spans").alias(spans))
    rows = docs.withColumn(rid, row_key())
    joined = rows.join(found, rows["doc_id"].cast("long").eqNullSafe(found[hit_id]) & (rows[rid] == found[hit_rid]), "left").select(*(rows[c] for c in names), spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, hits = batch.column("text"), batch.column(spans)
            if hits.null_count < batch.num_rows:
                new = [t if s is None else cut(t, s) for t, s in zip(text.cast(pa.binary()).to_pylist(), hits.to_pylist(), strict=True)]
                text = pa.array(new, pa.binary()).cast(text.type)
            # With the fields as they came: a task's batches must not differ in what may be null.
            fields = [batch.schema.field(c) for c in names]
            yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in names], schema=pa.schema(fields))

    return joined.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
