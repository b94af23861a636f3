"""Substring dedup: words in long windows that an earlier document also has are removed.

Every window of 50 words gets a Rabin-Karp hash, from prefix sums of word hashes times powers of a base. A
task puts equal windows of its documents together, and sends on only those of the smallest doc_id; later ones
are decided on the spot, so that a passage which very many documents share arrives once a task. The rest is
dealt by hash, in packed rows of delta-coded bytes, and counted: a window whose hash a smaller doc_id also
sent is repeated. Answers are dealt by document in the same form, merged into maximal intervals, and joined
to the texts by document.

Equality is by hash. Its length follows the number of windows: so many bytes that the number of false matches to
be expected in the whole input is below 2^-20 (9 bytes and the part at 10^8 windows, 11 at 10^13). Parts hold about
``PART`` windows, answers of at most twice as many, whatever the width of the shuffle.

Defined results: words are what ASCII space does not hold; null text has none; a document below ``width``
words loses none; rows with a null doc_id are neither searched nor cut; rows that share doc_id and text get
the same result and do not remove each other's words; rows that share doc_id alone are told apart by their whole
row key; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import keyed, mix64, shuffle_width, slices, utf8

WIDTH = 50
#: Windows that a task holds before it sends them on.
CHUNK = 1 << 19
#: Windows that a group counts, on average.
PART = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_PACKED = "part int, kind int, n int, first long, body binary, hashes binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in 7-bit groups, least first; the high bit says that more follow."""
    values = values.astype(np.uint64)
    if not len(values):
        return b""
    size = np.ones(len(values), dtype=np.int64)
    limit = 1 << 7
    while limit < 1 << 64 and (more := values >= np.uint64(limit)).any():
        size += more
        limit <<= 7
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max())):
        on = np.flatnonzero(size > k)
        out[start[on] + k] = ((values[on] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[on] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    end = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], end[:-1] + 1])
    size, out = end - start + 1, np.zeros(len(end), dtype=np.uint64)
    for k in range(int(size.max())):
        on = np.flatnonzero(size > k)
        out[on] |= (raw[start[on] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out.view(np.int64)


class _Hashes(dict):
    """Word hashes of a task, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Roller:
    """Window hashes: the words' hashes times ascending powers, summed, divided by the first power."""

    def __init__(self, width: int):
        self.width, self.words = width, _Hashes()
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = pow(_BASE, -1, 1 << 64)
            steps = [np.full(size, b, dtype=np.uint64) for b in (_BASE, inverse)]
            for s in steps:
                s[0] = 1
            self.up, self.down = map(np.cumprod, steps)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each window: one to tell windows apart, one to deal them."""
        n, w = len(words), self.width
        if n < w:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self._powers(n)
        one = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=n)
        out = []
        for value in (one, mix64(one)):
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value * self.up[:n])])
            out.append(mix64((total[w:] - total[:-w]) * self.down[: n - w + 1]))
        return out[0], out[1]


def _deltas(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, size: np.ndarray | None) -> tuple[int, bytes]:
    """Sorted places, packed: 0 for the row before, else 1 + the step of doc_id and the row's tag; then the
    position, relative inside a row; then, where asked for, the length."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    step = np.where(new, np.diff(doc, prepend=doc[0]).view(np.uint64) + np.uint64(1), np.uint64(0))
    where = np.where(new, pos, np.diff(pos, prepend=0)).view(np.uint64)
    streams = [pack(step), pack(tag[new]), pack(where), *([pack(size)] if size is not None else [])]
    heads = np.array([len(x) for x in streams], dtype="<u4").tobytes()
    return int(doc[0]), bytes([len(streams)]) + heads + b"".join(streams)


def _places(first: int, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, tag, position and length of what ``_deltas`` packed."""
    k = body[0]
    ends = 1 + 4 * k + np.concatenate([[0], np.cumsum(np.frombuffer(body, dtype="<u4", count=k, offset=1).astype(np.int64))])
    step, tags, where, *size = (unpack(body[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    new = step != 0
    row = np.cumsum(new) - 1
    doc = first + np.cumsum(np.where(new, step - 1, 0))
    total = np.cumsum(where)
    at_new = np.flatnonzero(new)
    pos = total - (total[at_new] - where[at_new])[row]
    return doc, tags[row], pos, size[0] if size else np.ones(len(doc), dtype=np.int64)


def _part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(doc.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _runs(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places sorted and merged into maximal intervals of window starts."""
    if not len(doc):
        return doc, tag, pos, size
    order = np.lexsort((pos, tag, doc))
    doc, tag, pos, end = doc[order], tag[order], pos[order], (pos + size)[order]
    row = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))])
    # Ends grow inside a row only; a step between rows keeps them apart under one running maximum.
    lift = row * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    fresh = np.concatenate([[True], (pos + lift)[1:] > reach[:-1]])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], tag[first], pos[first], (reach - lift)[last] - pos[first]


def _dealt(kind: int, part: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, size: np.ndarray | None, hashes: np.ndarray | None) -> Iterator[tuple]:
    """Packed rows, one for each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            on = order[a:b]
            first, body = _deltas(doc[on], tag[on], pos[on], None if size is None else size[on])
            low = b"" if hashes is None else hashes[on].tobytes()
            yield int(part[a]), kind, b - a, first, body, low


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "kind", "n", "first", "body", "hashes"])


def hash_bytes(windows: int, parts: int) -> int:
    """Bytes beside the part that leave less than 2^-20 false matches to be expected among so many windows."""
    return min(16, max(4, math.ceil((2 * math.log2(max(windows, 2)) + 19 - math.log2(parts)) / 8)))


def _cut(one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    """The first bytes of both hashes together, a row a window; those of the second from its top."""
    both = np.stack([one.astype("<u8"), two.byteswap()], axis=1)
    return both.view(np.uint8).reshape(-1, 16)[:, :size]


def _chunk(docs: list[tuple[int, int, np.ndarray, np.ndarray]], parts: int, answers: int, size: int) -> Iterator[pa.RecordBatch]:
    """What a task sends for a chunk of documents (doc_id, tag, and two hashes a window)."""
    docs.sort(key=lambda d: d[:2])
    n = np.array([len(d[2]) for d in docs])
    doc, tag = (np.repeat(np.array([d[k] for d in docs], dtype=np.int64), n) for k in (0, 1))
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    one, two = (np.concatenate([d[k] for d in docs]) for k in (2, 3))
    order = np.argsort(one, kind="stable")
    same = np.concatenate([[False], (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    late = np.zeros(len(order), dtype=bool)
    late[order] = doc[order] > doc[order][first]
    on = np.flatnonzero(~late)
    rows = list(_dealt(0, (two[on] % np.uint64(parts)).astype(np.int64), doc[on], tag[on], pos[on], None, _cut(one[on], two[on], size)))
    on = np.flatnonzero(late)
    if len(on):
        doc, tag, pos, length = _runs(doc[on], tag[on], pos[on], np.ones(len(on), dtype=np.int64))
        rows += _dealt(1, _part_of(doc, answers), doc, tag, pos, length, None)
    yield _batch(rows)


def measured(docs: DataFrame) -> tuple[int, bool]:
    """About how many words there are (white space between words counted, so rather more than less), and whether doc_ids are unique."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gaps = F.octet_length(text) - F.octet_length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))) + 1
    row = docs.agg(F.sum(gaps.cast("long")).alias("words"), F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    return row["words"] or 0, row["n"] == row["ids"]


def repeated_starts(docs: DataFrame, width: int = WIDTH, parts: int | None = None, chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """doc_id, tag (the row key, 0 where doc_ids are unique), spans: packed intervals (start, length) of the window starts that are repeated."""
    words, unique = measured(docs)
    parts = parts or max(shuffle_width(docs.sparkSession), -(-words // part))
    # Answers are intervals, of which there are at most as many as windows: twice a part's to each, whatever is repeated.
    answers, size = max(1, -(-words // (2 * part))), hash_bytes(words, parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, held, n = Roller(width), [], 0
        for batch in slices(batches):
            for doc, rid, text in zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), utf8(batch.column("text")), strict=True):
                one, two = roll(text.split())
                if doc is not None and len(one):
                    held.append((doc, 0 if unique else rid, one, two))
                    n += len(one)
                if n >= chunk:
                    yield from _chunk(held, parts, answers, size)
                    held, n = [], 0
        if held:
            yield from _chunk(held, parts, answers, size)

    def count(table: pa.Table) -> pa.Table:
        asked, passed = [], []
        for row in table.to_pylist():
            places = _places(row["first"], row["body"])
            if row["kind"]:
                passed.append(places)
            else:
                low = np.zeros((row["n"], 16), dtype=np.uint8)
                low[:, :size] = np.frombuffer(row["hashes"], dtype=np.uint8).reshape(-1, size)
                asked.append((*places[:3], *low.view("<u8").T.copy()))
        if asked:
            doc, tag, pos, low, high = (np.concatenate([x[k] for x in asked]) for k in range(5))
            del asked
            order = np.lexsort((doc, high, low) if size > 8 else (doc, low))
            same = np.concatenate([[False], (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1])])
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            on = order[doc[order] > doc[order][first]]
            passed.append((doc[on], tag[on], pos[on], np.ones(len(on), dtype=np.int64)))
        doc, tag, pos, length = _runs(*(np.concatenate([x[k] for x in passed]) for k in range(4)))
        return pa.Table.from_batches([_batch(list(_dealt(1, _part_of(doc, answers), doc, tag, pos, length, None)))])

    def merge(table: pa.Table) -> pa.Table:
        found = [_places(row["first"], row["body"]) for row in table.select(["first", "body"]).to_pylist()]
        doc, tag, pos, length = _runs(*(np.concatenate([x[k] for x in found]) for k in range(4)))
        cuts = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])) + 1, [len(doc)]]).tolist()
        spans = [np.stack([pos[a:b], length[a:b]], axis=1).astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"doc_id": pa.array(doc[cuts[:-1]]), "tag": pa.array(tag[cuts[:-1]]), "spans": pa.array(spans, pa.binary())})

    sent = keyed(docs).mapInArrow(send, _PACKED)
    return sent.groupBy("part").applyInArrow(count, _PACKED).groupBy("part").applyInArrow(merge, "doc_id long, tag long, spans binary")


def remove_repeats(docs: DataFrame, width: int = WIDTH, parts: int | None = None, chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """doc_id, n_words, n_removed, removed (array of word intervals, start and end), kept_text (the words that
    stay, joined by one space) of every row."""
    spans, rows = repeated_starts(docs, width, parts, chunk, part).withColumnRenamed("doc_id", "span_id"), keyed(docs)
    joined = rows.join(spans, (rows["doc_id"] == spans["span_id"]) & ((spans["tag"] == 0) | (rows["rid"] == spans["tag"])), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, removed, kept, gone = [], [], [], []
            for text, packed in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                ends = [[a, a + k + width - 1] for a, k in np.frombuffer(packed or b"", dtype="<i4").reshape(-1, 2).tolist()]
                merged: list[list[int]] = []
                for a, b in ends:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                n.append(len(words))
                gone.append([{"start": a, "end": b} for a, b in merged])
                for a, b in reversed(merged):
                    del words[a:b]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(gone, spans), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
