"""WARC files, and fixity audits of their replicas with Merkle trees.

``write_warc`` writes web pages as WARC records (type resource) in the order of their ids; an archive holds a
range of 1,024 ids and is one file. A record of another's file, which has no page id, takes its place from the name
of its file and its number there, so that a changed one is found as changed (and all behind a lost one are). Spark's text writer puts the two line breaks behind every record, and its
gzip makes a file one member, so offsets count the bytes of the uncompressed stream. ``read_warc`` reads such
files, and those of others with many members, which are inflated one after the other, and hashes every record where it
stands; a file's stored bytes are read whole, so that any store of Spark's will do, and are 2 GB at most.

A tree has 32 children a node over ranges of the order: the hash of a node covers its children's hashes, their
places, and the bytes that their range of offsets spans. Two replicas are compared from the root; only the
children of nodes that differ are looked at, level by level, down to the records that are changed, missing or
extra, with their offsets in both.

Defined results: a null id is replaced by 30 bits of a hash of the record, and may share a leaf; null fields
are empty; line breaks in a URL become spaces; records with the same id share a leaf, in the order of their
hashes; bytes that are no record stand as a damaged one, of the place after the record before; two empty
replicas agree; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm.common import bounded_batches, stored

#: Bits of order that a level takes: 32 children a node.
FAN = 5
#: Bits of order within an archive.
ARCHIVE = 10
#: The pages have no date of their own.
DATE = "2024-01-01T00:00:00Z"
_MASK = (1 << 63) - 1
_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")
_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def record_text(page: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """A WARC record but for the two line breaks behind it. Its id is made from the page's id and URL."""
    body, number, target = F.coalesce(html, F.lit("")), F.coalesce(page.cast("string"), F.lit("")), F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]+", " ")
    digest = F.md5(F.concat_ws(" ", number, target).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    fields = [("WARC-Type", F.lit("resource")), ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", target), ("Page-ID", number)]
    fields += [("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length(body).cast("string"))]
    return F.concat(F.lit("WARC/1.0\r\n"), *[F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields], F.lit("\r\n"), body)


def _placed(pages: DataFrame) -> DataFrame:
    """place, record: the order and text of each page."""
    page = F.col("page_id").cast("long")
    rows = pages.select(page.alias("page"), record_text(page, F.col("url").cast("string"), F.col("html").cast("string")).alias("record"))
    return rows.select(F.coalesce(F.col("page").bitwiseAND(F.lit(_MASK)), F.xxhash64("record").bitwiseAND(F.lit((1 << 30) - 1))).alias("place"), "record")


def _write(rows: DataFrame, path: str, *order: str) -> None:
    """rows: archive and record; every archive's rows are in one partition."""
    sorted_rows = rows.sortWithinPartitions("archive", *order).select("archive", F.col("record").alias("value"))
    sorted_rows.write.partitionBy("archive").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def write_warc(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as WARC files, a folder for each archive."""
    rows = _placed(pages).withColumn("archive", F.shiftright("place", ARCHIVE))
    _write(rows.repartition("archive"), path, "place", "record")


def parse(data: bytes, more: bool = False) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """(start, end, header fields or None, body) of every record of an archive. If there is ``more`` to come, it stops
    before a record that may go on there."""
    at = 0
    while at < len(data):
        head = _HEAD.match(data, at)
        fields = {k.decode("utf-8", "replace").lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(head[1])} if head else {}
        size = fields.get("content-length", "")
        end = head.end() + int(size) if head and size.isascii() and size.isdigit() else -1
        if more and end + 4 > len(data):
            return
        if end >= 0 and data[end : end + 4] == b"\r\n\r\n":
            yield at, end + 4, fields, data[head.end() : end]
            at = end + 4
            continue
        following = data.find(b"\r\n\r\nWARC/1.", at + 1)
        if more and following < 0:
            return
        end = len(data) if following < 0 else following + 4
        yield at, end, None, data[at:end]
        at = end


def members(data: bytes) -> Iterator[bytes]:
    """The bytes of a file, gzip member by member if it has such; of one that is cut off what there is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view = memoryview(data)
    while bytes(view[:2]) == b"\x1f\x8b":
        member, out, at = zlib.decompressobj(31), [], 0
        try:
            # Pieces, so that what follows a member is not copied with it.
            while at < len(view) and not member.eof:
                out.append(member.decompress(view[at : at + (1 << 20)]))
                at = min(len(view), at + (1 << 20))
        except zlib.error:
            break
        finally:
            yield b"".join(out)
        view = view[at - len(member.unused_data) :]


def records(chunks: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str] | None, bytes, bytes]]:
    """(start, header fields or None, body, all bytes) of the records of a file that comes in pieces; what is held is a
    piece and the record that goes on in the next."""
    data, base = b"", 0
    for chunk in chunks:
        data, done = data + chunk, 0
        for start, done, fields, body in parse(data, more=True):
            yield base + start, fields, body, data[start:done]
        data, base = data[done:], base + done
    for start, end, fields, body in parse(data):
        yield base + start, fields, body, data[start:end]


def foreign_place(path: str, number: int) -> int:
    """The place of a record in a file of others: by its file's name, and by its number there."""
    return 1 << 62 | (zlib.crc32(path.rsplit("/", 1)[-1].encode()) >> 2) << 32 | number


_RECORDS = "archive long, start long, bytes long, place long, page_id long, url string, hash string, body string"


def read_warc(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """archive, start, bytes, place (in the order), page_id, url, hash (SHA-256 of the record), body (null unless asked for)."""
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, path, content in zip(*(batch.column(c).to_pylist() for c in ("archive", "path")), batch.column("content"), strict=True):
                rows, last, size = [], archive << ARCHIVE, 0
                for k, (start, fields, body, raw) in enumerate(records(members(content.as_py()))):
                    own = fields is not None and "page-id" in fields
                    number = fields["page-id"] if own else ""
                    page = int(number) if re.fullmatch("-?[0-9]{1,18}", number) else None
                    place = page & _MASK if page is not None else -1 if own else last + 1 if fields is None and last >> 62 == 0 else foreign_place(path, k)
                    url = (fields or {}).get("warc-target-uri")
                    rows.append((archive, start, len(raw), place, page, url, hashlib.sha256(raw).hexdigest(), body.decode("utf-8", "replace") if bodies else None, raw[:-4] if place < 0 else b""))
                    last = place if place >= 0 else archive << ARCHIVE
                    size += len(body) if bodies else 100
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.coalesce(F.try_to_number(F.regexp_extract("path", "archive=([0-9]+)", 1), F.lit("9" * 19)).cast("long"), F.lit(0).cast("long")).alias("archive"), "path", "content")
    rows = named.mapInArrow(run, _RECORDS + ", raw binary")
    place = F.when(F.col("place") >= 0, F.col("place")).otherwise(F.xxhash64(F.col("raw").cast("string")).bitwiseAND(F.lit((1 << 30) - 1)))
    return rows.withColumn("place", place).drop("raw")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 5, *[pa.string()] * 3, pa.binary()]
    names = [c.split()[0] for c in _RECORDS.split(", ")] + ["raw"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def leaves(records: DataFrame) -> DataFrame:
    """node, hash, bytes, start: a leaf for each place, with the bytes of its records and where the first one starts."""
    # Records of one place are folded by count and hash, so that any number of equal copies is one entry.
    folded = records.groupBy(F.col("place").alias("node"), "hash", "bytes").agg(F.count("*").alias("n"), F.min("start").alias("start"))
    one = F.col("x")[0]
    return folded.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("hash", "n"))).alias("x"), F.sum(F.col("bytes") * F.col("n")).alias("bytes"), F.min("start").alias("start")).select(
        "node", F.when((F.size("x") == 1) & (one["n"] == 1), one["hash"]).otherwise(F.sha2(F.to_json("x").cast("binary"), 256)).alias("hash"), "bytes", "start"
    )


def parents(nodes: DataFrame) -> DataFrame:
    """The level above."""
    child = F.struct("node", "hash", "bytes")
    return nodes.groupBy(F.shiftright("node", FAN).alias("node")).agg(F.array_sort(F.collect_list(child)).alias("x"), F.sum("bytes").alias("bytes")).select(
        "node", F.sha2(F.array_join(F.transform("x", lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"], c["bytes"].cast("string"))), "\n").cast("binary"), 256).alias("hash"), "bytes"
    )


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    names = [c for c in a.columns if c != "node"]
    both = a.withColumnsRenamed({c: f"{c}_a" for c in names}).join(b.withColumnsRenamed({c: f"{c}_b" for c in names}), "node", "full")
    return both.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """record, archive, start_a, start_b, size_a, size_b, sha_a, sha_b, status of every place in which two replicas
    (tables of ``read_warc``) differ. Of a replica that lacks the record, start is null, size 0 and sha empty."""
    levels = [[stored(leaves(x), "merkle")] for x in (first, second)]
    tops = [x[0].agg(F.coalesce(F.max("node"), F.lit(0)).alias("top")).first()["top"] for x in levels]
    depth = max(1, -(-max(tops).bit_length() // FAN))
    for x in levels:
        for _ in range(depth):
            x.append(stored(parents(x[-1]), "merkle"))
    bad = _differing(levels[0][depth], levels[1][depth])
    for level in range(depth - 1, -1, -1):
        up = stored(bad.select(F.col("node").alias("up")), "mismatch")
        bad = _differing(*(x[level].join(up, F.shiftright(x[level]["node"], FAN) == up["up"], "left_semi") for x in levels))
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return bad.select(
        F.col("node").alias("record"), F.shiftright("node", ARCHIVE).alias("archive"), "start_a", "start_b",
        *(F.coalesce(f"bytes_{x}", F.lit(0)).alias(f"size_{x}") for x in "ab"), *(F.coalesce(f"hash_{x}", F.lit("")).alias(f"sha_{x}") for x in "ab"), status.alias("status"),
    )


def damaged_copy(spark: SparkSession, path: str, to: str) -> None:
    """Write a second replica with known damage: some payloads altered, some cut short, some records lost, some new.

    Archives are copied as they stand, each by one task, without a shuffle; new records stand in archives of their own."""
    k, body = F.col("page_id"), F.col("body")
    rows = read_warc(spark, path, bodies=True).filter(F.coalesce(k % 389 != 11, F.lit(True)))
    body = F.when(k % 97 == 5, F.concat(body, F.lit("\0"))).when(k % 193 == 7, F.left(body, F.char_length(body) - 1)).otherwise(body)
    far = F.lit(1 << 30)
    same = F.struct("archive", k.alias("page_id"))
    more = F.struct((F.col("archive") + F.lit(1 << (30 - ARCHIVE))).alias("archive"), (k + far).alias("page_id"))
    copies = rows.select("start", "url", body.alias("body"), F.explode(F.when(k % 499 == 13, F.array(same, more)).otherwise(F.array(same))).alias("x"))
    _write(copies.select("x.archive", "start", record_text(F.col("x.page_id"), F.col("url"), F.col("body")).alias("record")), to, "start")
