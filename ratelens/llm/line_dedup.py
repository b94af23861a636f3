"""Line dedup: lines that many documents share are dropped from all of them.

Distinct line hashes (128 bits) are counted over all documents. They are dealt into shards, and each shard
gets a minimal perfect hash: one slot per line, which indexes an array of fingerprints and an array of
saturated counts. Documents send their distinct line hashes to the shards, where they stream past these arrays and
probe them; no line text is joined, and no group of them gathered. Lines that a large share of all documents hold are at most ``HEAVY`` in number whatever the
input, so they form one more small structure that every task gets, and no shard has a hot key.

Defined results: null or empty text is one empty line; lines whose key is shorter than ``min_chars`` stay;
rows that repeat a doc_id count as one document; a null doc_id counts as one document of its own; an empty
table gives an empty result; other columns of the input are carried with their values, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import LOWER, SPACES, fresh, keyed, mix64, row_key, shuffle_width, slices, stored, utf8

HEAVY = 65_536
#: Distinct lines a shard holds at most, on average.
SHARD_KEYS = 1 << 18
#: Documents' lines that are asked of a shard at most, on average; a single line adds no more than pairs / ``HEAVY``.
SHARD_PAIRS = 1 << 22
_TRIM = SPACES.encode()
_LEVELS = 48


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line of a text."""
    return [line.strip(_TRIM) for line in text.translate(LOWER).split(b"\n")]


def _hashes(keys: list[bytes], min_chars: int) -> np.ndarray:
    """Rows (h1, h2) of the keys; (0, 0) for those too short to count."""
    short = (lambda k: not k) if min_chars == 1 else (lambda k: len(k.decode("utf-8", "replace")) < min_chars)
    none = bytes(16)
    return np.frombuffer(b"".join(none if short(k) else xxhash.xxh3_128_digest(k) for k in keys), dtype="<u8").reshape(-1, 2)


class LineIndex:
    """A minimal perfect hash over distinct 128-bit keys with a fingerprint and a count for each.

    Level by level, every key left picks a bit; a bit picked once belongs to its key, the others go on to the
    next level. A key's slot is the rank of its bit. Keys that no level places (none in practice) are listed.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, prints: np.ndarray, counts: np.ndarray, rest: np.ndarray):
        self.keys: np.ndarray | None = None
        self.sizes, self.words, self.prints, self.counts, self.rest = sizes, words, prints, counts, rest
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum((sizes + 63) // 64)]).astype(np.int64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys[:, 0] + mix64(keys[:, 1] ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, limit: int, gamma: float = 1.5, exact: bool = False) -> LineIndex:
        """keys: (n, 2) unsigned; counts: documents of each. Counts are kept up to ``limit``.

        An index that is asked for keys it does not hold must be ``exact``: it keeps the keys themselves by slot
        (in memory only, they are not packed). The fingerprint alone would take one such key in 65,536 for its own.
        """
        left, sizes, words = np.arange(len(keys)), [], []
        while len(left) and len(sizes) < _LEVELS:
            size = max(64, int(len(left) * gamma))
            at = cls._place(keys[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.zeros((size + 63) // 64 * 64, dtype=np.uint8)
            bits[:size] = alone
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        kind = np.uint8 if limit <= 255 else np.uint32
        index = cls(np.array(sizes, dtype=np.int64), np.concatenate(words) if words else np.zeros(0, dtype=np.uint64), np.zeros(len(keys), dtype=np.uint16), np.zeros(len(keys), dtype=kind), np.ascontiguousarray(keys[left]))
        slot = index.slots(keys)
        index.prints[slot] = keys[:, 1] & np.uint64(0xFFFF)
        index.counts[slot] = np.minimum(counts, limit)
        if exact:
            index.keys = np.zeros((len(keys), 2), dtype=np.uint64)
            index.keys[slot] = keys
        return index

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that was not built in, any slot or -1."""
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                return out
            at = self._place(keys[left], level, size)
            word, bit = self.starts[level] + (at >> 6), (at & 63).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = self.ranks[word[hit]] + below[hit]
            left = left[~hit]
        placed = int(self.ranks[-1])
        for k, key in enumerate(self.rest):
            out[left[(keys[left] == key).all(axis=1)]] = placed + k
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Documents of each key up to the limit; 0 for a key whose fingerprint (or, in an exact index, key) differs."""
        if not len(self.counts):
            return np.zeros(len(keys), dtype=np.int64)
        slot = self.slots(keys)
        same = self.prints[slot] == (keys[:, 1] & np.uint64(0xFFFF)) if self.keys is None else (self.keys[slot] == keys).all(axis=1)
        found = (slot >= 0) & same
        return np.where(found, self.counts[slot], 0).astype(np.int64)

    def pack(self) -> dict[str, bytes]:
        return {"sizes": self.sizes.tobytes(), "words": self.words.tobytes(), "prints": self.prints.tobytes(), "counts": self.counts.tobytes(), "rest": self.rest.tobytes(), "wide": b"1" if self.counts.dtype == np.uint32 else b"0"}

    @classmethod
    def unpack(cls, x: dict[str, bytes]) -> LineIndex:
        of = np.frombuffer
        return cls(of(x["sizes"], np.int64), of(x["words"], np.uint64), of(x["prints"], np.uint16), of(x["counts"], np.uint32 if x["wide"] == b"1" else np.uint8), of(x["rest"], np.uint64).reshape(-1, 2))


_INDEX = "shard int, sizes binary, words binary, prints binary, counts binary, rest binary, wide binary"


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The distinct rows but (0, 0)."""
    rows = rows[rows.any(axis=1)]
    if len(rows) < 2:
        return rows
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]


def _pairs(docs: DataFrame, min_chars: int, without: LineIndex | None = None, shards: int = 1) -> DataFrame:
    """A row for each document and each of its distinct lines, but those in ``without``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [_distinct(_hashes(line_keys(t), min_chars)) for t in utf8(batch.column("text"))]
            n = np.array([len(x) for x in found], dtype=np.int64)
            keys = np.concatenate([*found, np.zeros((0, 2), dtype=np.uint64)])
            row = np.repeat(np.arange(batch.num_rows), n)
            if without is not None:
                rare = without.count(keys) == 0
                keys, row = keys[rare], row[rare]
            shard = pa.array((keys[:, 0].view(np.int64) % shards).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), batch.column("rid").take(pa.array(row)), shard, pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64))], ["doc_id", "rid", "shard", "h1", "h2"])

    return docs.select("doc_id", "rid", "text").mapInArrow(run, "doc_id long, rid long, shard int, h1 long, h2 long")


def _keys(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")], axis=1) if table.num_rows else np.zeros((0, 2), dtype=np.uint64)


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """h1, h2, n: the number of documents that hold each distinct line."""
    pairs = _pairs(keyed(docs), min_chars).withColumn("doc", F.coalesce("doc_id", F.lit(-(2**63))))
    return pairs.groupBy("h1", "h2").agg(F.count_distinct("doc").cast("long").alias("n"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shard_keys: int = SHARD_KEYS, heavy: int = HEAVY) -> DataFrame:
    """Drop every line whose key at least ``min_docs`` documents hold, in all of them.

    Returns the columns of ``docs`` with the new text (null stays null where no line goes) and, as the last two,
    the number of lines and of dropped ones, long: ``line_n`` and ``line_dropped``, or ``fresh`` names.
    """
    spark = docs.sparkSession
    counts = stored(line_counts(docs, min_chars), "line-counts")
    size = counts.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).first()
    shards = max(shuffle_width(spark), -(-size["keys"] // shard_keys), -(-size["pairs"] // SHARD_PAIRS))
    # Each has at least pairs / heavy of the pairs, so there are at most ``heavy`` of them.
    top = counts.filter((F.col("n") >= min_docs) & (F.col("n") * heavy > size["pairs"])).toArrow()
    # It is asked for every line, so it compares whole keys; a shard is asked only for lines that were counted.
    heavy_index = LineIndex.build(_keys(top), top.column("n").to_numpy(), min_docs, exact=True)

    def build(table: pa.Table) -> pa.Table:
        index = LineIndex.build(_keys(table), table.column("n").to_numpy(), min_docs)
        return pa.table({"shard": table.column("shard").slice(0, 1)} | {k: pa.array([v], pa.binary()) for k, v in index.pack().items()})

    shard_of = F.pmod("h1", F.lit(shards)).cast("int")
    index = stored(counts.select(shard_of.alias("shard"), "h1", "h2", "n").groupBy("shard").applyInArrow(build, _INDEX), "line-index")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's index comes first, then all that is asked of it, batch by batch: no group is gathered."""
        shard, here = None, None
        for batch in batches:
            shards, asked = batch.column("shard").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (asked[1:] != asked[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if not asked[a]:
                    shard, here = shards[a], LineIndex.unpack(part.slice(0, 1).to_pylist()[0])
                elif shard == shards[a]:
                    found = here.count(_keys(part)) >= min_docs
                    yield part.filter(pa.array(found)).select(["doc_id", "rid", "h1", "h2"])

    names = docs.columns
    *new, rid, hit_id, hit_rid, own = fresh(names, "line_n", "line_dropped", "rid", "hit_id", "hit_rid", "hits")
    here = docs.withColumn(rid, row_key())
    asked = _pairs(keyed(docs), min_chars, heavy_index, shards)
    both = asked.withColumn("asked", F.lit(True)).unionByName(index.withColumn("asked", F.lit(False)), allowMissingColumns=True)
    both = both.repartition(shuffle_width(spark), "shard").sortWithinPartitions("shard", "asked")
    hits = both.mapInArrow(probe, "doc_id long, rid long, h1 long, h2 long")
    gone = hits.groupBy(F.col("doc_id").alias(hit_id), F.col("rid").alias(hit_rid)).agg(F.collect_set(F.struct("h1", "h2")).alias(own))
    joined = here.join(gone, here["doc_id"].cast("long").eqNullSafe(gone[hit_id]) & (here[rid] == gone[hit_rid]), "left").select(*(here[c] for c in names), own)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, null, hits in zip(utf8(batch.column("text")), batch.column("text").is_null().to_pylist(), batch.column(own).to_pylist(), strict=True):
                lines, keys = text.split(b"\n"), _hashes(line_keys(text), min_chars)
                drop = heavy_index.count(keys) >= min_docs
                if hits:
                    bad = {(h["h1"], h["h2"]) for h in hits}
                    drop |= np.fromiter((k in bad for k in map(tuple, keys.view(np.int64).tolist())), dtype=bool, count=len(keys))
                drop &= keys.any(axis=1)
                gone = int(drop.sum())
                texts.append(None if null and not gone else text if not gone else b"\n".join(x for x, d in zip(lines, drop.tolist(), strict=True) if not d))
                n_lines.append(len(lines))
                n_dropped.append(gone)
            kept = pa.array(texts, pa.binary()).cast(batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([kept if c == "text" else batch.column(c) for c in names] + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, *new])

    schema = docs.select(*names, *(F.lit(0).cast("long").alias(c) for c in new)).schema
    return joined.mapInArrow(cut, schema)


def digest(kept: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is kept."""
    n, dropped = kept.columns[-2:]
    return kept.select("doc_id", F.col(n).alias("n_lines"), F.col(dropped).alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
