"""The scan of large files on many cores: one task inflates a file into blocks, all cores cut the blocks.

1. A file's task only inflates, and writes raw blocks of a fixed size.
2. Each block is summarised by itself as a transition: from each of three starting states (outside a string, in
   one, in one behind a backslash) to the state at its end, and by how many brackets the depth changes.
3. Summaries, a few numbers a block, are composed file by file: now each block's own state and depth are known. They
   are one row a file, a byte or two for each block, which the blocks look up: blocks are not shuffled for it.
4. Each block marks what separates the elements of top-level arrays (their brackets, and the commas at depth two),
   and gives back how many it has and the file's skeleton: what stands above depth two, a few keys. Skeletons are
   put together and read as JSON, which names the sections and says whether the file is whole.
5. Blocks are cut at their separators. An element within a block is a row; pieces of one that crosses borders are
   joined by the number of separators before them, which is the same for all.

The rows are those of ``read_elements``, in any order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ratelens.schemas import RAW
from ratelens.sources import sinks
from ratelens.sources.mrf import SCALARS, SECTIONS, BrokenFile, Counted, dealt, inflated, opened

BLOCK = 16 << 20
#: Small blocks that are handed over at once.
_BATCH = 4 << 20
#: What each byte is: an opening bracket 1, a closing one -1, a comma 2, anything else 0.
_KIND = bytes(1 if c in b"{[" else 255 if c in b"}]" else 2 if c == 44 else 0 for c in range(256))
_STEP = _KIND.replace(b"\x02", b"\x00")
_SPACE = b" \t\r\n"
_WHOLE = re.compile(rb'"(?:[^"\\]++|\\.)*+"|[^,\[\]{}"\s]++', re.S)


def marked(data: bytes, state: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Bytes, which of them stand in strings, and the state at the end; an opening quote stands in its string."""
    view = np.frombuffer(data, dtype=np.uint8)
    if state == 2:
        view = np.concatenate([np.array([92], dtype=np.uint8), view])
    quote, pending = view == 34, False
    slash = np.flatnonzero(view == 92)
    if len(slash):
        # Every second backslash of a run, from its first, takes the meaning from the byte behind it.
        first = np.concatenate([[True], np.diff(slash) != 1])
        run = np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))
        behind = slash[(np.arange(len(slash)) - run) % 2 == 0] + 1
        pending = bool(behind[-1] == len(view))
        quote[behind[behind < len(view)]] = False
    inside = np.logical_xor.accumulate(quote) ^ (state > 0)
    if state == 2:
        view, inside = view[1:], inside[1:]
    end = (2 if pending else 1) if (inside[-1] if len(inside) else state > 0) else 0
    return view, inside, end


def _change(data: bytes, inside: np.ndarray) -> tuple[int, int]:
    """By how much the brackets outside and inside strings change the depth."""
    step = np.frombuffer(data.translate(_STEP), dtype=np.int8)
    at = np.flatnonzero(step)
    step, inside = step[at], inside[at]
    return int(step[~inside].sum(dtype=np.int64)), int(step[inside].sum(dtype=np.int64))


def summary(data: bytes) -> list[int]:
    """End state and change of depth from each starting state."""
    _, inside, end = marked(data)
    outside, within = _change(data, inside)
    # A start in a string turns inside and outside round; a start behind a backslash matters to these first bytes only.
    pending = (len(data) - len(data.rstrip(b"\\"))) % 2
    other = [0 if end else 1 + pending, within]
    out = [end, outside, *other]
    if data[:1] in (b'"', b"\\"):
        _, inside, end = marked(data, 2)
        other = [end, _change(data, inside)[0]]
    return out + other


class Marks:
    """Where a block's separators are, given its starting state and depth."""

    def __init__(self, data: bytes, state: int, depth: int):
        _, inside, _ = marked(data, state)
        kind = np.frombuffer(data.translate(_KIND), dtype=np.int8)
        at = np.flatnonzero((kind != 0) & ~inside)
        kind = kind[at]
        level = np.cumsum(np.where(kind == 2, 0, kind), dtype=np.int32) + depth
        opens, closes = (kind == 1) & (level == 2), (kind == -1) & (level == 1)
        here = opens | closes | ((kind == 2) & (level == 2))
        #: Places of separators: the brackets of depth two, and commas there.
        self.at = at[here]
        self.brackets = np.flatnonzero((opens | closes)[here])
        # From each bracket or comma to the next, the depth is the same.
        low, bounds = np.concatenate([[depth], level]) <= 1, [0, *at.tolist(), len(data)] if depth <= 1 or opens.any() or (level <= 1).any() else []
        shown = np.flatnonzero(low | np.concatenate([[False], opens])).tolist() if bounds else []
        self.skeleton = b"".join(data[bounds[k] : bounds[k + 1] if low[k] else bounds[k] + 1] for k in shown)
        #: Pieces (piece k lies before separator k) behind an opening bracket, here or in an earlier block, with something in them.
        edges = [0, *self.at.tolist(), len(data)]
        self.filled = [k for k in (0, *(np.flatnonzero(opens[here]) + 1).tolist()) if data[edges[k] + (k > 0) : edges[k + 1]].strip(_SPACE)]
        #: Where values with brackets begin at depth two.
        self.values = at[(kind == 1) & (level == 3)]


def inflate(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """file_seq, source_file, block, data: the bytes of each file in blocks, written to the shared folder. A task takes
    one large file, or several small ones one after the other (``dealt``)."""

    def rows(path: str, length: int | None) -> Iterator[bytes]:
        with opened(path) as stream:
            counted, held, n = Counted(stream), [], 0
            for chunk in inflated(counted):
                held.append(chunk)
                n += len(chunk)
                if n >= size:
                    data = b"".join(held)
                    for at in range(0, n - size + 1, size):
                        yield data[at : at + size]
                    held, n = [data[n - n % size :]], n % size
            if n or counted.n == 0:
                yield b"".join(held)
            if length and counted.n != length:
                raise BrokenFile(f"read {counted.n} of {length} bytes")

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], ["file_seq", "source_file", "block", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            for seq, path, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for k, data in enumerate(rows(path, n)):
                    held.append((seq, path, k, data))
                    weight += len(data)
                    if weight >= _BATCH or len(held) >= 10_000:
                        yield batch_of(held)
                        held, weight = [], 0
        if held:
            yield batch_of(held)

    out = dealt(files).mapInArrow(run, "file_seq int, source_file string, block int, data binary")
    path = sinks.work_path(files.sparkSession, "blocks")
    # Sizes are looked at after each row, as one row may be a block: a file becomes many row groups, which many tasks read.
    out.write.option("parquet.page.size.row.check.min", 1).option("parquet.block.size", max(size, 1 << 20)).parquet(path)
    return files.sparkSession.read.schema(out.schema).parquet(path)


def _packed(numbers: list[int]) -> bytes:
    """Numbers from zero in as few bytes each as the largest needs, behind one byte that says how many."""
    width = next(w for w in (1, 2, 4, 8) if max(numbers, default=0) < 1 << 8 * w)
    return bytes([width]) + np.array(numbers, dtype=f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1)


def _written(df: DataFrame, label: str) -> DataFrame:
    path = sinks.work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_file(rows: DataFrame) -> GroupedData:
    """Groups of few small rows each: by their bytes they would all be one task's, however many files there are."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "file_seq").groupBy("file_seq")


def _states(blocks: DataFrame) -> DataFrame:
    """file_seq, begins: how each block of a file begins, in their order: three times its depth, and its state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary(x) for x in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("file_seq"), batch.column("block"), pa.array(found, pa.list_(pa.int64()))], ["file_seq", "block", "turn"])

    def compose(table: pa.Table) -> pa.Table:
        state, depth, begins = 0, 0, []
        for turn in table.sort_by("block").column("turn").to_pylist():
            if depth < 0:
                break
            begins.append(3 * depth + state)
            state, depth = turn[2 * state], depth + turn[2 * state + 1]
        if state or depth:
            raise BrokenFile("the file is cut off" if depth >= 0 else "the file has more closing brackets than opening ones")
        return pa.table([table.column("file_seq").slice(0, 1), pa.array([_packed(begins)], pa.binary())], ["file_seq", "begins"])

    turns = blocks.select("file_seq", "block", "data").mapInArrow(run, "file_seq int, block int, turn array<bigint>")
    return _written(_by_file(turns).applyInArrow(compose, "file_seq int, begins binary"), "block-states")


def _named(skeleton: bytes, sections: tuple[str, ...]) -> list[tuple[str, int, int | None, str | None]]:
    """(section, its place, which container it is, or else its single value) of the wanted keys of a file's skeleton."""
    try:
        top = json.loads(skeleton, object_pairs_hook=tuple)
    except ValueError as e:
        raise BrokenFile(f"the file is cut off, or goes on after its object: {e}") from e
    if not isinstance(top, tuple):
        raise BrokenFile("expected '{'")
    out, container, order, scalars = [], 0, 0, 0
    for key, value in top:
        held = isinstance(value, (list, tuple))
        if key in sections and key in SCALARS:
            out.append((key, scalars, container if held else None, None if held else json.dumps(value)))
            scalars += 1
        elif key in sections:
            if value is not None and not isinstance(value, list):
                raise BrokenFile(f"{key} is not an array")
            out.append((key, order, None if value is None else container, None))
            order += 1
        container += held
    return out


_SPAN = pa.struct([("section", pa.string()), ("ord", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("pos", pa.int64())])
_SINGLE = pa.struct([("section", pa.string()), ("ord", pa.int32()), ("pos", pa.int64()), ("raw", pa.string())])


def _plan(blocks: DataFrame, states: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """file_seq, source_file, begins, counts, spans, single of each file: how its blocks begin, how many separators each
    has, where sections lie among these, and the rows that stand for sections and single values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins = [int(_unpacked(x)[k]) for x, k in zip(*(batch.column(c).to_pylist() for c in ("begins", "block")), strict=True)]
            found = [Marks(data, x % 3, x // 3) for data, x in zip(batch.column("data").to_pylist(), begins, strict=True)]
            keep = [batch.column(c) for c in ("file_seq", "source_file", "block")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(begins, pa.int64()), pa.array([len(m.at) for m in found], pa.int64()), *(pa.array(y, pa.list_(pa.int64())) for y in ([m.brackets.tolist() for m in found], [m.filled for m in found])), pa.array([m.skeleton for m in found], pa.binary())], ["file_seq", "source_file", "block", "begin", "n", "brackets", "filled", "skeleton"])

    def put_together(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        n = np.array(table.column("n").to_pylist(), dtype=np.int64)
        base = np.cumsum(n) - n
        at = [int(b) + x for b, own in zip(base, table.column("brackets").to_pylist(), strict=True) for x in own]
        filled = {int(b) + x for b, own in zip(base, table.column("filled").to_pylist(), strict=True) for x in own}
        named, spans, single, counts = _named(b"".join(table.column("skeleton").to_pylist()), sections), [], [], dict.fromkeys(sections, 0)
        for key, order, container, value in named:
            if key in SCALARS:
                if value is None:
                    raise BrokenFile(f"{key} is not a single value")
                single.append({"section": key, "ord": -1, "pos": order, "raw": value})
                continue
            single.append({"section": key, "ord": order, "pos": -1, "raw": None})
            if container is not None:
                first, last = at[2 * container] + 1, at[2 * container + 1]
                spans.append({"section": key, "ord": order, "first": first, "last": last, "pos": counts[key]})
                counts[key] += last - first + (last > first or first in filled)
        packed = [pa.array([_packed(x)], pa.binary()) for x in (table.column("begin").to_pylist(), n.tolist())]
        columns = [table.column("file_seq").slice(0, 1), table.column("source_file").slice(0, 1), *packed, pa.array([spans], pa.list_(_SPAN)), pa.array([single], pa.list_(_SINGLE))]
        return pa.table(columns, ["file_seq", "source_file", "begins", "counts", "spans", "single"])

    marks = blocks.join(states, "file_seq").select("file_seq", "source_file", "block", "begins", "data")
    counted = marks.mapInArrow(run, "file_seq int, source_file string, block int, begin bigint, n bigint, brackets array<bigint>, filled array<bigint>, skeleton binary")
    schema = "file_seq int, source_file string, begins binary, counts binary, spans array<struct<section:string,ord:int,first:bigint,last:bigint,pos:bigint>>, single array<struct<section:string,ord:int,pos:bigint,raw:string>>"
    return _written(_by_file(counted).applyInArrow(put_together, schema), "block-plan")


def _element(text: bytes, values: int, alone: bool) -> bytes | None:
    """An element without white space around it; None for an array with nothing in it."""
    text = text.strip(_SPACE)
    if not text:
        if alone:
            return None
        raise BrokenFile("an element is missing")
    if not (values == 1 and text[:1] in b"{[" and text[-1:] in b"}]" if values else _WHOLE.fullmatch(text)):
        raise BrokenFile(f"expected ',' near {text[:40]!r}")
    return text


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements and pieces of elements of blocks: whole ones are checked, pieces come as they are."""
    names = ["file_seq", "source_file", "section", "section_ord", "pos", "block", "piece", "alone", "n_values", "raw"]
    plan, begins, bases = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if plan != (row["begins"], row["counts"]):
                plan = row["begins"], row["counts"]
                begins, bases = _unpacked(plan[0]).tolist(), [0, *np.cumsum(_unpacked(plan[1]), dtype=np.int64).tolist()]
            data, base, begin = row["data"], bases[row["block"]], begins[row["block"]]
            m = Marks(data, begin % 3, begin // 3)
            edges = np.concatenate([[0], m.at, [len(data)]])
            values = np.searchsorted(m.values, edges)
            held, weight = [], 0
            for s in row["spans"]:
                # Piece k of a block lies between its separators k - 1 and k.
                for k in range(max(0, s["first"] - base), min(len(m.at), s["last"] - base) + 1):
                    text, n, alone = data[edges[k] + (k > 0) : edges[k + 1]], int(values[k + 1] - values[k]), s["first"] == s["last"]
                    pos, piece = s["pos"] + base + k - s["first"], k in (0, len(m.at))
                    if not piece and (text := _element(text, n, alone)) is None:
                        continue
                    held.append((row["file_seq"], row["source_file"], s["section"], s["ord"], pos, row["block"], piece, alone, n, text))
                    weight += len(text)
                    if weight > 8 << 20 or len(held) >= 10_000:
                        yield _batch(held, names)
                        held, weight = [], 0
            if held:
                yield _batch(held, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_element(*x) for x in zip(batch.column("raw").to_pylist(), batch.column("n_values").to_pylist(), batch.column("alone").to_pylist(), strict=True)]
        keep = pa.array([x is not None for x in found], pa.bool_())
        raw = pa.array([x for x in found if x is not None], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in ("file_seq", "source_file", "section", "section_ord", "pos")), raw], ["file_seq", "source_file", "section", "section_ord", "pos", "raw"])


def read_split(files: DataFrame, sections: tuple[str, ...] = SECTIONS, size: int = BLOCK) -> DataFrame:
    """Raw elements of all files of a table (file_seq, source_file, maybe length), as ``read_elements`` gives them.

    For files that are too large for one task. A broken file fails the job. The elements stand in the shared folder by
    section: what is read of them again is not cut again."""
    spark = files.sparkSession
    blocks = inflate(files, size)
    plan, cut_path = _plan(blocks, _states(blocks), sections), sinks.work_path(spark, "elements")
    asked = blocks.join(plan.select("file_seq", "begins", "counts", "spans"), "file_seq")
    schema = "file_seq int, source_file string, section string, section_ord int, pos bigint, block int, piece boolean, alone boolean, n_values bigint, raw binary"
    asked.mapInArrow(_cut, schema).write.partitionBy("piece", "section").parquet(cut_path)
    rows = spark.read.schema(f"{schema.replace('piece boolean, ', '').replace('section string, ', '')}, piece boolean, section string").parquet(cut_path)
    columns = [c.split()[0] for c in RAW.split(", ")]
    # A piece is as long as its element at most, and an element as a task can hold.
    pieces = rows.filter("piece").groupBy("file_seq", "source_file", "section", "section_ord", "pos").agg(F.sort_array(F.collect_list(F.struct("block", "raw"))).alias("p"), F.first("alone").alias("alone"), F.sum("n_values").alias("n_values"))
    whole = F.aggregate(F.transform("p", lambda x: x["raw"]), F.lit(b""), lambda a, x: F.concat(a, x))
    crossing = pieces.withColumn("raw", whole).mapInArrow(_joined, "file_seq int, source_file string, section string, section_ord int, pos bigint, raw binary")
    # Elements are written once where they are cut; few cross borders, and these are put together once.
    path = sinks.work_path(spark, "crossing")
    crossing.write.partitionBy("section").parquet(path)
    crossing = spark.read.schema(crossing.schema).parquet(path).select(*crossing.columns)
    found = rows.filter("not piece").select("file_seq", "source_file", "section", "section_ord", "pos", "raw").unionByName(crossing)
    single = plan.select("file_seq", "source_file", F.explode("single").alias("s")).select("file_seq", "source_file", "s.section", F.col("s.ord").alias("section_ord"), "s.pos", "s.raw")
    return found.withColumn("raw", F.make_valid_utf8(F.col("raw").cast("string"))).select(*columns).unionByName(single.select(*columns))
