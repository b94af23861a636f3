"""Token-ID files in Simple-8b: writing and reading.

Documents are dealt into shards by ranges of doc_id and sorted, so shard after shard they stand in ascending
order. A file's row is a block of consecutive documents. Its payload is 64-bit words: the upper four bits
select how many ids of how many bits the other 60 hold. Every document starts a new word, and the block lists
the documents' ids, token counts and word offsets, so any document can be read alone and a whole block is
decoded in one pass over arrays, a selector at a time. An id of 2^60 or more is an escape: its place holds
zero, and the block lists its index and value. The container is Parquet, which Spark can write to and read
from any store; a shard is written by one task, all or nothing.

Texts are encoded with the tokenizers library. The pre-tokenizer never joins what a letter run and the space
before it hold with what follows, so a text is cut into such chunks, and each worker asks the library once
for each chunk. A special token's string in a text becomes that token, as the library does it by default; with
``special=False`` it is ordinary text, which is safer for texts of unknown origin.

Ids of this vocabulary have up to 16 bits, so most words hold three or four of them (15 bits or less: four);
escapes are for ids of 2^60 or more, which only other numberings have.

Defined results: null or empty text is the end id alone; rows with a null doc_id come first; rows with the
same doc_id follow each other in the order of their texts; an empty table writes no block.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm.common import keyed, shared_dir, shuffle_width, slices

TOKENIZER = "byte_bpe_50k.json"
END = 2
#: Ids of a block, but for a longer document.
BLOCK = 1 << 16
#: The packings, fixed values of the format: ids a word and bits an id, by selector.
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_LARGEST = (1 << 60) - 1
#: Bits of the small ids.
_BITS = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.int8)
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_CHUNK = re.compile(f" ?[{_LETTERS}]+(?=[{_WHITE}.,;:!?]|$)| ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_WORD = re.compile(f" ?[{_LETTERS}]+")
#: Chunks that a worker remembers.
MEMORY = 1_000_000


def pack(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of runs of unsigned ids, ``counts`` to a run, and each run's word offset (one more for the end)."""
    pad = PACKINGS[0][0]
    starts = np.concatenate([[0], np.cumsum(counts + pad)]).astype(np.int64)
    wide = np.zeros(starts[-1] + pad, dtype=np.uint64)
    wide[np.repeat(starts[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
    # The largest packing that fits from each place on; what fits one packing also fits all with fewer ids.
    if int(wide.max()) < len(_BITS):
        bits = _BITS[wide.view(np.int64)]
    else:
        bits = np.frexp((wide >> np.uint64(30)).astype(np.float64))[1].astype(np.int8)
        bits = np.where(bits > 0, bits + 30, np.frexp((wide & np.uint64((1 << 30) - 1)).astype(np.float64))[1]).astype(np.int8)
    best = np.full(len(wide), len(PACKINGS) - 1, dtype=np.int8)
    at, most, seen = np.arange(len(wide) - pad), bits[: len(wide) - pad].copy(), 1
    for selector in range(len(PACKINGS) - 2, -1, -1):
        n, width = PACKINGS[selector]
        for k in range(seen, n):
            np.maximum(most, bits[k : k + len(at)] if len(at) == len(wide) - pad else bits[at + k], out=most)
        seen, on = n, most <= width
        if not on.all():
            at, most = at[on], most[on]
        best[at] = selector
        if not len(at):
            break
    step = np.array([n for n, _ in PACKINGS], dtype=np.uint8)[best].tobytes()
    places, offsets = [], [0]
    for a, n in zip(starts[:-1].tolist(), counts.tolist(), strict=True):
        end = a + n
        while a < end:
            places.append(a)
            a += step[a]
        offsets.append(len(places))
    place = np.array(places, dtype=np.int64)
    selectors = best[place]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors).tolist():
        n, width = PACKINGS[selector]
        on = np.flatnonzero(selectors == selector)
        values = wide[place[on][:, None] + np.arange(n)] << (np.arange(n) * width).astype(np.uint64)
        words[on] |= np.bitwise_or.reduce(values, axis=1)
    return words, np.array(offsets, dtype=np.int64)


def unpack(words: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of all runs, one run after the other."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    sizes = np.array([n for n, _ in PACKINGS])[selectors]
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(first[-1], dtype=np.uint64)
    for selector in np.unique(selectors).tolist():
        n, width = PACKINGS[selector]
        on = np.flatnonzero(selectors == selector)
        out[first[on][:, None] + np.arange(n)] = (words[on][:, None] >> (np.arange(n) * width).astype(np.uint64)) & np.uint64((1 << width) - 1)
    starts = first[offsets[:-1]]
    return out[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]


def pack_block(runs: list[np.ndarray]) -> dict:
    """A block's payload, offsets and escapes for the ids of its documents."""
    counts = np.array([len(r) for r in runs], dtype=np.int64)
    ids = np.concatenate([*runs, np.zeros(0, dtype=np.uint64)]).astype(np.uint64)
    over = np.flatnonzero(ids > np.uint64(_LARGEST))
    escapes = ids[over]
    ids[over] = 0
    words, offsets = pack(ids, counts)
    return {"n_tokens": counts, "offsets": offsets, "words": words.astype("<u8").tobytes(), "escape_at": over, "escapes": escapes.astype("<u8").tobytes()}


def unpack_block(block: dict) -> list[np.ndarray]:
    counts = np.asarray(block["n_tokens"], dtype=np.int64)
    ids = unpack(np.frombuffer(block["words"], dtype="<u8"), np.asarray(block["offsets"], dtype=np.int64), counts)
    ids[np.asarray(block["escape_at"], dtype=np.int64)] = np.frombuffer(block["escapes"], dtype="<u8")
    return np.split(ids, np.cumsum(counts)[:-1])


class _Numbers(dict):
    """Chunks by number; a new one is numbered and noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Encoder:
    """A tokenizer with a memory of the chunks it has encoded."""

    def __init__(self, path: str, special: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()} if special else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        # Bytes that print stand for themselves in the model's alphabet, the others for characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: 256 + k for k, b in enumerate(hidden)}
        self.space = chr(self.alphabet[32])
        self.numbers, self.size, self.ids, self.used = _Numbers(), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.int32), 0
        self.start, self.uses = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def forget(self) -> None:
        """Keep only the chunks that came up again."""
        keep = np.flatnonzero(self.uses[: len(self.numbers)] > 1)
        if len(keep) > MEMORY // 2:
            keep = keep[:0]
        names = list(self.numbers)
        sizes = self.size[keep].astype(np.int64)
        ends = np.cumsum(sizes)
        self.used = int(ends[-1]) if len(ends) else 0
        self.ids[: self.used] = self.ids[np.repeat(self.start[keep] - (ends - sizes), sizes) + np.arange(self.used)]
        self.start[: len(keep)], self.size[: len(keep)] = ends - sizes, sizes
        self.uses[:] = 0
        self.numbers = _Numbers()
        self.numbers.update(zip(map(names.__getitem__, keep.tolist()), range(len(keep)), strict=True))

    def chunks(self, text: str) -> list[str]:
        """The text's chunks; a special token is one of its own."""
        if self.cut is None or not any(s in text for s in self.special):
            return _CHUNK.findall(text)
        return [c for part in self.cut(text) for c in ([part] if part in self.special else _CHUNK.findall(part))]

    def _chunk(self, chunk: str) -> list[int]:
        if chunk in self.special:
            return [self.special[chunk]]
        if _WORD.fullmatch(chunk):
            if chunk.isascii():
                shown = self.space + chunk[1:] if chunk[0] == " " else chunk
            else:
                shown = chunk.encode().decode("latin-1").translate(self.alphabet)
            return [t.id for t in self.model.tokenize(shown)]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def _solve(self) -> None:
        """Encode the chunks that were numbered since."""
        chunks, self.numbers.new = self.numbers.new, []
        found = [self._chunk(c) for c in chunks]
        n, k, sizes = len(self.numbers) - len(chunks), len(chunks), np.array([len(f) for f in found], dtype=np.int64)
        total = int(sizes.sum())
        for name, need in (("start", n + k), ("size", n + k), ("uses", n + k), ("ids", self.used + total)):
            old = getattr(self, name)
            if len(old) < need:
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.start[n : n + k], self.size[n : n + k] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + total] = list(chain.from_iterable(found))
        self.used += total

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.numbers) > MEMORY:
            self.forget()
        number, each = self.numbers.__getitem__, []
        for text in texts:
            chunks = self.chunks(text)
            each.append(np.fromiter(map(number, chunks), dtype=np.int64, count=len(chunks)))
        self._solve()
        at = np.concatenate([*each, np.zeros(0, dtype=np.int64)])
        self.uses += np.bincount(at, minlength=len(self.uses)).astype(np.int32)
        sizes = self.size[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        ids = self.ids[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, each)])]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_LOADED: dict[tuple[str, bool], Encoder] = {}


def encoder(name: str, special: bool) -> Encoder:
    if (name, special) not in _LOADED:
        _LOADED[name, special] = Encoder(public_tokenizers.path(name), special)
    return _LOADED[name, special]


_BLOCKS = "shard int, block int, shard_start long, total long, doc_ids array<long>, n_tokens array<int>, offsets array<int>, words binary, escape_at array<int>, escapes binary"


def _rows(blocks: list[dict]) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "block": pa.int32(), "shard_start": pa.int64(), "total": pa.int64(), "doc_ids": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int32()), "offsets": pa.list_(pa.int32()), "words": pa.binary(), "escape_at": pa.list_(pa.int32()), "escapes": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([b[k] for b in blocks], t) for k, t in kinds.items()], list(kinds))


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, shards: int | None = None, block: int = BLOCK, special: bool = True) -> None:
    """Write the token ids of all texts to a new folder, in ascending order of doc_id."""
    shards = shards or shuffle_width(docs.sparkSession)
    # The text's head splits rows of one doc_id, in the order in which they are sorted.
    ordered = keyed(docs).select("doc_id", "text").repartitionByRange(shards, "doc_id", F.left("text", F.lit(32))).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, number, total = encoder(tokenizer, special), TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        runs: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            return _rows([pack_block(runs) | {"shard": shard, "block": number, "shard_start": total, "total": size, "doc_ids": ids}])

        for batch in slices(batches):
            for doc, found in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                if runs and size + len(found) + 1 > block:
                    yield closed()
                    number, total, ids, runs, size = number + 1, total + size, [], [], 0
                ids.append(doc)
                runs.append(np.append(found, end))
                size += len(found) + 1
        if runs:
            yield closed()

    ordered.mapInArrow(run, _BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (array) of every document in the files."""
    return _decoded(spark, path, lambda ids: pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), "ids array<long>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_tokens``, with the CRC-32 of the ids as little-endian unsigned 32-bit integers in their place."""
    return _decoded(spark, path, lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), "ids_crc32 long")


def _decoded(spark: SparkSession, path: str, last, column: str) -> DataFrame:
    blocks = spark.read.schema(_BLOCKS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                n = np.array(b["n_tokens"], dtype=np.int64)
                start = b["base"] + b["shard_start"] + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(b["doc_ids"], pa.int64()), pa.array(start), pa.array(n), last(unpack_block(b))], ["doc_id", "start", "n_tokens", column.split()[0]])

    # One small row a shard: the ids of all shards before it.
    sizes = blocks.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("total")).alias("size")).collect()
    base, at = [], 0
    for row in sorted(sizes, key=lambda r: r["shard"]):
        base.append((row["shard"], at))
        at += row["size"]
    bases = spark.createDataFrame(base, "shard int, base long")
    return blocks.join(F.broadcast(bases), "shard").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def write_and_digest(docs: DataFrame) -> DataFrame:
    """Write the files to the shared folder, and return what reading them back gives."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return token_digests(docs.sparkSession, path)
