"""Source of rate files: one large JSON object, maybe gzipped, as a row for each element of its sections.

A file cannot be split, so it is one task; but the task holds one element at a time, and finds only where
elements end. Decoding is left to ``from_json`` after a repartition, on all cores.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ratelens.schemas import RAW

SECTIONS = ("provider_references", "in_network")
#: The sections of a table of contents; the name is a single value, not an array.
TOC_SECTIONS = ("reporting_structure", "reporting_entity_name")
SCALARS = {"reporting_entity_name"}
#: A longer element fails its file with a clear message.
MAX_ELEMENT = 512 << 20
_READ = 1 << 20
#: What stands between two brackets outside strings, and the bracket.
_STEP = re.compile(rb'(?:[^"{}\[\]]++|"(?:[^"\\]++|\\.)*+")*+([{}\[\]])', re.S)
_SPACE = re.compile(rb"[ \t\r\n]*+")
_SCALAR = re.compile(rb"[^,\]}\s]++")


class BrokenFile(ValueError):
    """The file's own syntax is broken: not an object, or cut off."""


def opened(path: str) -> BinaryIO:
    from pyarrow import fs

    if "://" not in path:
        path = re.sub("^file:", "", path)
        return fs.LocalFileSystem().open_input_stream(path, compression=None)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression=None)


class Counted:
    """A stream that knows how many bytes were read from it."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.n = stream, 0

    def read(self, size: int) -> bytes:
        data = self.stream.read(size)
        self.n += len(data)
        return data


def inflated(stream: BinaryIO) -> Iterator[bytes]:
    """The bytes of a stream, through gzip if they begin like it. Each member's length and checksum are compared; a
    gzip stream that ends early, or goes on with anything but another member, fails."""
    data = stream.read(_READ)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = stream.read(_READ)
        return
    gz, ended = zlib.decompressobj(31), False
    while data:
        try:
            out = gz.decompress(data, _READ)
        except zlib.error as e:
            raise BrokenFile(f"gzip stream is damaged: {e}") from e
        if out:
            yield out
        if gz.eof:
            ended, data = True, gz.unused_data
            if data or (data := stream.read(_READ)):
                gz, ended = zlib.decompressobj(31), False
        else:
            data = gz.unconsumed_tail or stream.read(_READ)
    if not ended:
        raise BrokenFile("gzip stream is cut off")


#: What each byte adds to the depth.
_DEPTH = np.zeros(256, dtype=np.int8)
_DEPTH[list(b"{[")], _DEPTH[list(b"}]")] = 1, -1


def complete(data: bytes, at: int) -> list[tuple[int, int]]:
    """Start and end of the bracketed values that stand whole between ``at`` and the end of the data or of the
    array around them; worked out over all bytes at once."""
    view = np.frombuffer(data, dtype=np.uint8, offset=at)
    depth = _DEPTH[view]
    if data.find(b'"', at) >= 0:
        quote = view == 34
        if data.find(b"\\", at) >= 0:
            slash = np.flatnonzero(view == 92)
            # Every second backslash of a run, from its first, takes the meaning from the byte behind it.
            first = np.concatenate([[True], np.diff(slash) != 1])
            run = np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))
            behind = slash[(np.arange(len(slash)) - run) % 2 == 0] + 1
            quote[behind[behind < len(quote)]] = False
        depth[np.logical_xor.accumulate(quote)] = 0
    place = np.flatnonzero(depth)
    step = depth[place]
    level = np.cumsum(step, dtype=np.int64)
    ends = np.flatnonzero(level < 0)
    if len(ends):
        place, step, level = place[: ends[0]], step[: ends[0]], level[: ends[0]]
    closed = place[level == 0]
    opened_at = place[(level == 1) & (step == 1)][: len(closed)]
    return list(zip((opened_at + at).tolist(), (closed + at + 1).tolist(), strict=True))


class Cursor:
    """A reading position in a stream of bytes, with only the current element in memory."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.data, self.at = chunks, b"", 0

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.data, self.at = self.data[self.at :] + chunk, 0
        if len(self.data) > MAX_ELEMENT + _READ:
            raise BrokenFile(f"an element is longer than {MAX_ELEMENT} bytes")
        return True

    def peek(self) -> bytes:
        """The next byte after white space."""
        while True:
            self.at = _SPACE.match(self.data, self.at).end()
            if self.at < len(self.data):
                return self.data[self.at : self.at + 1]
            if not self.more():
                raise BrokenFile("the file is cut off")

    def take(self, wanted: bytes) -> None:
        found = self.peek()
        if found != wanted:
            raise BrokenFile(f"expected {wanted.decode()!r}, found {found!r}")
        self.at += 1

    def value(self) -> bytes:
        """The next whole value, as it stands."""
        first = self.peek()
        if first not in b"{[":
            return self._scalar(first)
        offset, depth = 0, 0
        while True:
            m = _STEP.match(self.data, self.at + offset)
            if m is None:
                if not self.more():
                    raise BrokenFile("the file is cut off")
                continue
            depth += 1 if m[1] in b"{[" else -1
            offset = m.end() - self.at
            if not depth:
                out, self.at = self.data[self.at : m.end()], m.end()
                return out

    def items(self) -> Iterator[bytes]:
        """The elements of an array whose bracket is taken, and its end.

        Elements with brackets are cut out as many at a time as the buffer holds; a longer one is looked at again
        once twice as much is there."""
        comma = False
        while True:
            for start, end in complete(self.data, self.at):
                if self.data[self.at : start].strip(b" \t\r\n") != (b"," if comma else b""):
                    break
                self.at, comma = end, True
                yield self.data[start:end]
            if self.peek() == b"]":
                self.at += 1
                return
            if comma:
                self.take(b",")
                comma = False
            if self.peek() not in b"{[":
                yield self.value()
                comma = True
            elif not self.fill(2 * (len(self.data) - self.at)):
                # No more to come: the element is whole, or the file is cut off.
                yield self.value()
                comma = True

    def fill(self, size: int) -> bool:
        """Read until so many bytes are ahead; False if nothing was left to read."""
        parts, ahead = [self.data[self.at :]], len(self.data) - self.at
        while ahead < size and (chunk := next(self.chunks, None)) is not None:
            parts.append(chunk)
            ahead += len(chunk)
            if ahead > MAX_ELEMENT + 2 * _READ and len(parts[0]) > MAX_ELEMENT // 2:
                raise BrokenFile(f"an element is longer than {MAX_ELEMENT} bytes")
        self.data, self.at = b"".join(parts), 0
        return len(parts) > 1

    def end(self) -> None:
        """Read what is left, which must be white space."""
        while True:
            self.at = _SPACE.match(self.data, self.at).end()
            if self.at < len(self.data):
                raise BrokenFile(f"text after the object: {self.data[self.at : self.at + 20]!r}")
            if not self.more():
                return

    def _scalar(self, first: bytes) -> bytes:
        pattern = re.compile(rb'"(?:[^"\\]++|\\.)*+"', re.S) if first == b'"' else _SCALAR
        while True:
            m = pattern.match(self.data, self.at)
            if m and (first == b'"' or m.end() < len(self.data)):
                self.at = m.end()
                return m[0]
            if not self.more():
                raise BrokenFile("the file is cut off")


def elements(chunks: Iterator[bytes], sections: tuple[str, ...]) -> Iterator[tuple[str, int, int, bytes | None]]:
    """(section, its place among the sections of the file, position, element); other keys are skipped. Positions
    go on where a section stands a second time, so they are unique in a file and section.

    A section that is there gives a row of position -1 first, so that empty ones and their order are known. A
    wanted single value gives a row each time that it stands there. The stream is read to its end, where only white
    space may follow the object.
    """
    c, order, values, counts = Cursor(chunks), 0, 0, dict.fromkeys(sections, 0)
    c.take(b"{")
    if c.peek() == b"}":
        c.at += 1
        return c.end()
    while True:
        key = json.loads(c.value())
        c.take(b":")
        if key not in sections:
            if c.peek() == b"[":
                c.at += 1
                for _ in c.items():
                    pass
            else:
                c.value()
        elif key in SCALARS:
            yield key, -1, values, c.value()
            values += 1
        elif c.peek() != b"[":
            if c.value() != b"null":
                raise BrokenFile(f"{key} is not an array")
            yield key, order, -1, None
            order += 1
        else:
            c.take(b"[")
            yield key, order, -1, None
            for raw in c.items():
                yield key, order, counts[key], raw
                counts[key] += 1
            order += 1
        if c.peek() == b"}":
            break
        c.take(b",")
    c.take(b"}")
    c.end()


_ROW = tuple[str, int, int, bytes | None]


def _rows_of(file_seq: int, path: str, rows: Iterable[_ROW], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of one file in batches of bounded size."""
    held: list[_ROW] = []
    weight = 0

    def batch() -> pa.RecordBatch:
        section, order, pos, raw = zip(*held, strict=True)
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([file_seq] * n, pa.int32()), pa.array([path] * n), pa.array(section), pa.array(order, pa.int32()), pa.array(pos, pa.int64()), pa.array([None if r is None else r.decode("utf-8", "replace") for r in raw], pa.string())],
            ["file_seq", "source_file", "section", "section_ord", "pos", "raw"],
        )

    for row in rows:
        held.append(row)
        weight += len(row[3] or b"")
        if weight > size or len(held) >= 10_000:
            yield batch()
            held, weight = [], 0
    if held:
        yield batch()


def file_elements(path: str, sections: tuple[str, ...], length: int | None = None) -> Iterator[_ROW]:
    """The elements of a file. ``length``, if known, is the number of bytes that must have been read."""
    with opened(path) as stream:
        counted = Counted(stream)
        yield from elements(inflated(counted), sections)
        if length and counted.n != length:
            raise BrokenFile(f"read {counted.n} of {length} bytes")


#: Stored bytes of small files that a task takes one after the other, what opening a file counts for, and a file of unknown length.
TASK_BYTES, OPEN_BYTES, UNKNOWN_BYTES = 32 << 20, 256 << 10, 4 << 20
#: Rows of a list that are summed by themselves.
_LIST = 1 << 16


def dealt(files: DataFrame) -> DataFrame:
    """file_seq, source_file, length of files (length null where ``files`` has none), so that a task gets a run of files
    that begin within ``TASK_BYTES``, or less where the files are few: many small ones, or a large one and what
    stands before it.

    Starts are running sums over the list. Blocks of the list are summed first; only their sums, one row for 65,536
    numbers, are added up in one place."""
    spark = files.sparkSession
    length = F.col("length").cast("long") if "length" in files.columns else F.lit(None).cast("long")
    asked = files.select(F.col("file_seq").cast("int").alias("file_seq"), "source_file", length.alias("length"))
    weight = F.when(F.col("length") > 0, F.col("length") + OPEN_BYTES).otherwise(UNKNOWN_BYTES)
    listed = asked.withColumn("weight", weight).withColumn("block", F.floor(F.coalesce("file_seq", F.lit(0)) / _LIST))
    total = listed.agg(F.sum("weight")).first()[0] or 0
    size = max(1, min(TASK_BYTES, total // (4 * spark.sparkContext.defaultParallelism)))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = listed.groupBy("block").agg(F.sum("weight").alias("w")).select("block", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy("file_seq", "source_file").rowsBetween(Window.unboundedPreceding, -1)
    placed = listed.withColumn("before", F.coalesce(F.sum("weight").over(within), F.lit(0))).join(blocks, "block")
    task = F.floor((F.col("base") + F.col("before")) / size).cast("int")
    return placed.repartitionById(max(1, -(-total // size)), task).select("file_seq", "source_file", "length")


def by_file(files: DataFrame, rows: Callable[[str, int | None], Iterable[_ROW]]) -> DataFrame:
    """``rows(path, length)`` of each file of a table (file_seq, source_file and maybe length); a file is in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, path, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                yield from _rows_of(seq, path, rows(path, size))

    return dealt(files).mapInArrow(run, RAW)


def read_elements(files: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """Raw elements of all files of a table (file_seq, source_file); a path listed twice is read twice.

    A broken file fails the job, and so does one whose bytes are not as many as a ``length`` column says (none, or
    zero: not known). A task takes one large file, or several small ones one after the other (``dealt``)."""
    return by_file(files, lambda path, length: file_elements(path, sections, length))


class _File(InputPartition):
    def __init__(self, seq: int, path: str):
        super().__init__(seq)
        self.seq, self.path = seq, path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], sections: tuple[str, ...]):
        self.paths, self.sections = list(enumerate(paths)), sections
        self.only = set(sections)

    def partitions(self) -> list[InputPartition]:
        return [_File(k, p) for k, p in self.paths] if self.only else []

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # Spark asks once with nothing where there are no partitions
            rows = file_elements(partition.path, self.sections)
            yield from _rows_of(partition.seq, partition.path, (r for r in rows if r[0] in self.only))


class _FilteringReader(_Reader):
    """Filters on ``section`` and ``file_seq`` (equal to, or one of) are done here: other files are not opened, elements
    of other sections not handed over."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("section",):
                self.only &= wanted
            elif wanted is not None and f.attribute == ("file_seq",):
                self.paths = [(k, p) for k, p in self.paths if k in wanted]
            else:
                yield f


class MrfDataSource(DataSource):
    """``spark.read.format("mrf").load(path)``; options: paths (JSON list), sections (comma list)."""

    @classmethod
    def name(cls) -> str:
        return "mrf"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return self.reads(paths, tuple(self.options.get("sections", ",".join(SECTIONS)).split(",")))

    reads: type[_Reader] = _Reader


class MrfFilteredDataSource(MrfDataSource):
    """``format("mrf_filtered")``: the same, with filters taken by the source. Spark hands the filters of one use of a
    loaded table to all its uses, so it must be loaded anew for each filter."""

    reads = _FilteringReader

    @classmethod
    def name(cls) -> str:
        return "mrf_filtered"


def register(spark: SparkSession) -> None:
    """Make the formats known, and let Spark hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MrfDataSource)
    spark.dataSource.register(MrfFilteredDataSource)


def once(value: Column) -> Column:
    """The value as it is, worked out once for each row: filters and further columns on it do not repeat its expression."""
    return F.explode(F.array(value))


def parsed(schema: str) -> Column:
    """The raw element by the whole schema, with ``_bad`` set where it does not fit."""
    return F.from_json("raw", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def decode(raw: DataFrame, schema: str, *keep: str) -> DataFrame:
    """Typed rows of raw elements. An element that does not fit the schema is dropped, the others stay."""
    rows = raw.filter(F.col("raw").isNotNull()).select(*keep, once(parsed(schema)).alias("x"))
    return rows.filter(F.col("x").isNotNull() & F.col("x._bad").isNull()).select(*keep, "x.*").drop("_bad")
