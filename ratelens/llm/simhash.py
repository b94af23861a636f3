"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit for each of 64 positions, set if over half of its word shingles' hashes have it.
Equal fingerprints are one class. Classes at two or fewer differing bits are linked by the rule of multi-index
hashing: cut the fingerprint into two segments of 32 bits; two bits in all leave one differing bit at most in
the first segment, or none in the second. So every class enumerates the Hamming ball of radius 1 (33 values)
of its first segment and looks up its second segment as it is, and full distances are verified among what
meets in a bucket. A bucket returns a spanning forest of its links, never all pairs. A bucket of more than
``BIG`` classes (counted by those that stand there themselves; the 33 values of balls come on top) is cut by the same
rule on the other segment's halves. A cut bucket can still hold every fingerprint that agrees with it but for two
balls and the 16 bits that are left, 33 x 17 x 65,536 at most; nothing is capped.

Components are found by alternating large and small stars on written tables.

Defined results: null or empty text has fingerprint zero, and such texts are linked; a null doc_id is never a
component's id unless all its members have none; repeated rows are members like others; an empty table gives
an empty result; other columns are carried, never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import LOWER, fresh, keyed, row_key, shuffle_width, slices, stored, utf8

BIG = 4096
BITS = 2


def shingles(words: list[bytes], shingle: int) -> bytes:
    """The hash of every shingle, 8 bytes each; of all words where they are no more than one."""
    if len(words) <= shingle:
        return xxhash.xxh64_digest(b" ".join(words), 42) if words else b""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
    xx = xxhash.xxh64_digest
    return b"".join([xx(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])


def fingerprint(text: bytes, shingle: int = 3) -> bytes:
    """The fingerprint, 8 bytes, most significant first."""
    return majority(shingles(text.translate(LOWER).split(), shingle))


def majority(digests: bytes) -> bytes:
    """The bits that over half of the hashes have."""
    if len(digests) <= 8:
        return digests or bytes(8)
    hashes = np.frombuffer(digests, dtype=np.uint8)
    n, total = len(hashes) // 8, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        # 64 counters of one byte, eight to a machine word: no sum of 255 rows overflows.
        lanes = np.unpackbits(hashes[8 * at : 8 * (at + (1 << 16))]).view(np.uint64).reshape(-1, 8)
        total += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, rid, fp (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = b"".join(fingerprint(t, shingle) for t in utf8(batch.column("text")))
            fp = pa.array(np.frombuffer(found, dtype=">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), fp], ["doc_id", "rid", "fp"])

    return keyed(docs).mapInArrow(run, "doc_id long, rid long, fp long")


def spanning(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (parents, children) of a spanning forest of all pairs at ``bits`` or fewer differing bits."""
    left, parents, children = np.unique(fps), [], []
    queue: list = []
    while len(left) and (len(left) > 1 or queue):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= bits
        if near.any():
            found = left[near]
            parents.append(np.full(len(found), at))
            children.append(found)
            queue.extend(found)
            left = left[~near]
    none = np.zeros(0, dtype=fps.dtype)
    return (np.concatenate(parents), np.concatenate(children)) if parents else (none, none)


def _ball(value: Column, bits: int) -> Column:
    """The values at one or no differing bit."""
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << k)) for k in range(bits)])


def links(classes: DataFrame, big: int = BIG) -> DataFrame:
    """a, b: links of distinct fingerprints ``fp`` that connect all within reach of each other."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    own = classes.select("fp", F.explode(F.array(F.struct(F.lit(0).cast("byte").alias("seg"), high.alias("key")), F.struct(F.lit(1).cast("byte").alias("seg"), low.alias("key")))).alias("x")).select("fp", "x.*")
    sizes = own.groupBy("seg", "key").agg(F.count("*").alias("size"))
    asked = F.concat(F.transform(_ball(high, 32), lambda k: F.struct(F.lit(0).cast("byte").alias("seg"), k.alias("key"))), F.array(F.struct(F.lit(1).cast("byte").alias("seg"), low.alias("key"))))
    probes = classes.select("fp", F.explode(asked).alias("x")).select("fp", "x.*")
    # Spark takes an exploded row for one, so it would broadcast 34 rows a class where it sees the bytes of one.
    met = probes.join(sizes.hint("merge"), ["seg", "key"])
    # In a large bucket the other segment's halves are looked up the same way; 0 marks a small bucket.
    rest = F.when(F.col("seg") == 0, low).otherwise(high)
    half = rest.bitwiseAND(F.lit(0xFFFF))
    cut = F.concat(F.transform(_ball(F.shiftrightunsigned(rest, 16), 16), lambda k: k + F.lit(1)), F.array(half + F.lit(1 + (1 << 16))))
    met = met.withColumn("sub", F.explode(F.when(F.col("size") <= big, F.array(F.lit(0).cast("long"))).otherwise(cut)))
    dealt = met.select("seg", "key", "sub", "fp").repartition(shuffle_width(classes.sparkSession), "seg", "key", "sub").sortWithinPartitions("seg", "key", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("seg", "key", "sub", "fp")], axis=1)
            if held and len(rows) and (held[-1][-1, :3] == rows[0, :3]).all() and (rows[0, :3] == rows[-1, :3]).all():
                held.append(rows)  # still one bucket
                continue
            rows = np.concatenate([*held, rows])
            if not len(rows):
                continue
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            last = cuts[-1] if len(cuts) else 0
            yield from _linked(rows[:last], cuts[:-1])
            held = [rows[last:]]
        if held:
            yield from _linked(np.concatenate(held), np.zeros(0, dtype=np.int64))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _linked(rows: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    bounds = np.concatenate([[0], cuts, [len(rows)]])
    fps, found = np.ascontiguousarray(rows[:, 3]).view(np.uint64), []
    for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
        found.append(spanning(fps[bounds[k] : bounds[k + 1]]))
    if found:
        a, b = (np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of ``edges`` (a, b) with the smallest node that it reaches."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now


def near_duplicates(docs: DataFrame, shingle: int = 3, big: int = BIG) -> DataFrame:
    """doc_id, rid, fp, component_id of every row: the smallest doc_id that is reachable."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), big))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.select("fp", "root").join(named, "root").drop("root"), "fp")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest doc_id."""
    found = near_duplicates(docs, shingle)
    rid, keep_id, keep_rid = fresh(docs.columns, "rid", "keep_id", "keep_rid")
    kept = stored(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "rid", "component_id"), "kept")
    sure = kept.groupBy("component_id").agg(F.min(F.struct("doc_id", "rid")).alias("x"), F.count("*").alias("n"))
    rows, one = docs.withColumn(rid, row_key()), sure.select(F.col("x.doc_id").alias(keep_id), F.col("x.rid").alias(keep_rid))
    out = rows.join(one, rows["doc_id"].cast("long").eqNullSafe(one[keep_id]) & (rows[rid] == one[keep_rid]), "left_semi")
    if not sure.filter("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", rid])
    return out.select(*docs.columns)
