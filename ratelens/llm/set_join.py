"""Jaccard join of shingle sets: prefix lists by size block, skipped by position, and answers derived from similar sets.

Every document is the set of its distinct word shingles (64-bit hashes; a wrong decision needs a collision within
one pair's few thousand shingles). Documents with equal sets are one class, named by its earliest document.

*Order.* All sets are sorted by one order, rare shingles first: a table of ``BUCKETS`` counts over all documents'
shingles, of a fixed size whatever the input, ranks a shingle's bucket, and the hash breaks ties. Any order gives
the same result; rare-first keeps shared passages out of the lists.

*Skipping index lists.* Two sets at ``percent`` share a shingle among the first n - ceil(percent * n) + 1 of each.
Such a shingle is posted under (shingle, size block), where a block's sizes span one similarity threshold, so a
partner stands in the same block or the one next to it. A posting goes to a block only if its position leaves
enough shingles behind it for some size of that block: what stands too deep skips the block. Within a list a
pair is passed on only if sizes, positions and a 64-bit parity map of both sets still allow the threshold, and
compared only if maps of half a bit a shingle do (512 bits at least), so that the maps of long texts tell as much
as those of short ones.

*Deriving answers.* In each list, every set is first compared with the earliest one alone (linear work); such a
verified pair also keeps the difference of both sets. Sets that are linked so far need no more comparisons among
each other: a list within one component is skipped whole, and of the others only pairs across components are
asked. Such a pair (c, b) is answered from b's verified leader A: the overlap of c and A is computed once, and
that of c and b follows from the few shingles in which b differs from A.

All counts, lists and joins are equi-joins and pre-aggregated counts on Spark; no list is gathered in a task. Joins
of what grows with the input are merge joins at every size, so that the plan does not change with it.

Defined results: words are lower-cased (A-Z) and split at ASCII space; a text of fewer words than a shingle is one
shingle; a text without words, empty or null, has an empty set and no links; a null doc_id counts as later than
all others and is a component's id only if no member has one; repeated rows are members of one class; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import LOWER, keyed, shuffle_width, slices, stored, utf8
from ratelens.llm.simhash import components, majority, shingles

#: Counters of shingles over the whole corpus: 4 MB as ranks of a byte, sent to the tasks.
BUCKETS = 1 << 22
_CHUNK = 4096
#: Bits of the filter that says which documents' sets are needed: 8 MB.
FILTER_BITS = 1 << 26


def text_digests(text: bytes, shingle: int) -> bytes:
    """The hashes of a text's shingles, repeats included."""
    return shingles(text.translate(LOWER).split(), shingle)


def hash_set(digests: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(digests, dtype="<u8"))


def parity_map(found: np.ndarray) -> bytes:
    """A set's parities of shingles by their hashes' lowest bits: a power of two of bits, at least half as many as shingles."""
    size = max(512, 1 << max(0, len(found) // 2 - 1).bit_length())
    counts = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def map_distance(x: bytes, y: bytes) -> int:
    """Bits in which two maps differ, the longer one folded to the length of the other."""
    a, b = (np.frombuffer(m, dtype="<u8") for m in (x, y))
    n = min(len(a), len(b))
    return int(np.bitwise_count(np.bitwise_xor.reduce(a.reshape(-1, n)) ^ np.bitwise_xor.reduce(b.reshape(-1, n))).sum())


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return counts.astype(next(f"<u{k}" for k in (1, 2, 4, 8) if counts.max(initial=0) < 1 << 8 * k)).tobytes()


def shingle_ranks(docs: DataFrame, shingle: int, buckets: int = BUCKETS) -> np.ndarray:
    """A byte for each bucket of shingle hashes: eight times the binary logarithm of its count over all documents.

    Tasks count their own rows, and the counts are added up in ranges of buckets as they stream in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(buckets, dtype=np.int64), [], 0
        for batch in slices(batches):
            held += [hash_set(text_digests(t, shingle)) for t in utf8(batch.column("text"))]
            size += sum(map(len, held[-batch.num_rows :]))
            if size >= buckets // 4:
                total += np.bincount((np.concatenate(held) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
                held, size = [], 0
        if held:
            total += np.bincount((np.concatenate(held) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        chunk = at // _CHUNK
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(at)]]) if len(at) else np.zeros(1, dtype=np.int64)
        for first in range(0, len(bounds) - 1, 64):
            spans = list(zip(bounds[first : first + 65][:-1].tolist(), bounds[first : first + 65][1:].tolist(), strict=True))
            ids = [(at[a:b] % _CHUNK).astype("<u2").tobytes() for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array([int(chunk[a]) for a, _ in spans], pa.int32()), pa.array(ids, pa.binary()), pa.array([_packed(total[at[a:b]]) for a, b in spans], pa.binary())], ["chunk", "ids", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, ids, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                total = sums.setdefault(chunk, np.zeros(_CHUNK, dtype=np.int64))
                at = np.frombuffer(ids, dtype="<u2")
                total[at] += np.frombuffer(counts, dtype=f"<u{len(counts) // len(at)}")
        if sums:
            ranks = [np.minimum(8 * np.log2(x + 1), 255).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], ["chunk", "ranks"])

    counted = keyed(docs).select("text").mapInArrow(count, "chunk int, ids binary, counts binary")
    summed = counted.repartition(shuffle_width(docs.sparkSession), "chunk").mapInArrow(add, "chunk int, ranks binary").toArrow()
    out = np.zeros(buckets, dtype=np.uint8)
    for chunk, ranks in zip(summed.column("chunk").to_pylist(), summed.column("ranks").to_pylist(), strict=True):
        out[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(ranks, dtype=np.uint8)
    return out


def size_blocks(percent: int) -> np.ndarray:
    """The smallest size of each block; sets at ``percent`` stand in the same block or in neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-100 * out[-1] // percent)))
    return np.array(out, dtype=np.int64)


def describe(docs: DataFrame, ranks: np.ndarray, shingle: int, percent: int, with_fp: bool = False) -> DataFrame:
    """doc_id, rid, cls, n, blk, bits, map, prefix (array), fp of every row. ``bits`` and ``map`` are parity maps. ``fp`` is a SimHash fingerprint or null."""
    starts, mask = size_blocks(percent), np.uint64(len(ranks) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cls, sizes, maps, prefixes, fps = [], [], [], [], []
            for text in utf8(batch.column("text")):
                digests = text_digests(text, shingle)
                found = hash_set(digests)
                n = len(found)
                cls.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(n)
                maps.append(parity_map(found))
                # A set that only its own equals can be linked with no other class.
                k = n - -(-percent * n // 100) + 1 if n * 100 >= percent * (n + 1) else 0
                key = ranks[(found & mask).astype(np.int64)].astype(np.uint64) << np.uint64(56) | found >> np.uint64(8)
                prefixes.append(found[np.argsort(key, kind="stable")[:k]].view(np.int64))
                fps.append(majority(digests) if with_fp else bytes(8))
            n = np.array(sizes, dtype=np.int64)
            blk = np.searchsorted(starts, n, side="right") - 1
            # The exclusive or of a map's words is a map of 64 bits.
            bits = np.array([np.bitwise_xor.reduce(np.frombuffer(m, dtype="<i8")) for m in maps], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*prefixes, np.zeros(0, dtype=np.int64)])))
            fp = pa.array(np.frombuffer(b"".join(fps), dtype=">i8").astype(np.int64)) if with_fp else pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(cls, pa.binary()), pa.array(n), pa.array(blk.astype(np.int32)), pa.array(bits), pa.array(maps, pa.binary()), prefix, fp], ["doc_id", "rid", "cls", "n", "blk", "bits", "map", "prefix", "fp"])

    return keyed(docs).mapInArrow(run, "doc_id long, rid long, cls binary, n long, blk int, bits long, map binary, prefix array<long>, fp long")


def classes_of(rows: DataFrame) -> DataFrame:
    """id, cls, late, doc_id, rid, copies, and the columns of a set: one row for each distinct set, with its earliest
    document. Ids are numbers in the order of these documents."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rid", "n", "blk", "bits", "map", "prefix", "fp"))
    classes = rows.groupBy("cls").agg(first.alias("x"), F.count("*").alias("copies")).select("cls", "copies", "x.*")
    # Numbers of a range-sorted table rise from partition to partition; once it is written, they stay.
    return stored(classes.orderBy("late", "doc_id", "rid").withColumn("id", F.monotonically_increasing_id()), "classes")


def _need(a: Column, b: Column, percent: int) -> Column:
    """The smallest overlap of sets of these sizes at the threshold."""
    return F.floor(((a + b) * percent + (99 + percent)) / (100 + percent))


def may_pair(x: str, y: str, percent: int) -> Column:
    """Whether two postings of one list can be a pair at the threshold, by sizes, positions and parity maps."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    need = _need(a, b, percent)
    differ = F.bit_count(F.col(f"{x}.bits").bitwiseXOR(F.col(f"{y}.bits")))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (F.least(a - F.col(f"{x}.pos"), b - F.col(f"{y}.pos")) >= need) & (differ <= a + b - 2 * need) & (F.col(f"{x}.own") | F.col(f"{y}.own"))


def folded(classes: DataFrame) -> DataFrame:
    """id, wide: the parity map of each class folded to eight words, for joins that pair many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.bitwise_xor.reduce(np.frombuffer(m, dtype="<i8").reshape(-1, 8)) for m in batch.column("map").to_pylist()]
            offsets = pa.array(np.arange(0, 8 * batch.num_rows + 1, 8, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*words, np.zeros(0, dtype=np.int64)])))], ["id", "wide"])

    return classes.select("id", "map").mapInArrow(run, "id long, wide array<long>")


def maps_allow(x: str, y: str, a: Column, b: Column, percent: int) -> Column:
    """Whether the folded maps ``x`` and ``y`` of sets of sizes ``a`` and ``b`` allow the threshold."""
    differ = [F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(8)]
    return reduce(Column.__add__, differ) <= a + b - 2 * _need(a, b, percent)


def still_possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity maps allow the threshold: each shingle that only one set has changes one bit, so
    sets differ in as many shingles as bits at least."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("map").alias(f"m{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most, x, y = (batch.column(c).to_pylist() for c in ("most", "ma", "mb"))
            keep = pa.array([map_distance(*maps) <= m for m, *maps in zip(most, x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in "ab"], ["a", "b"])

    most = (F.col("na") + F.col("nb") - 2 * _need(F.col("na"), F.col("nb"), percent)).cast("long")
    return pairs.select("a", "b", most.alias("most"), "ma", "mb").mapInArrow(run, "a long, b long")


def posting_lists(classes: DataFrame, percent: int) -> DataFrame:
    """key, p (own, id, n, pos, bits), head, len: the postings under (shingle, size block) of lists of several sets, with
    the earliest set of the list where it may be similar, and the list's length."""
    posted = classes.select("id", "n", "blk", "bits", F.posexplode("prefix").alias("pos", "token"))
    # Most shingles stand in one prefix only: those are gone before anything else is done.
    shared = posted.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1").select("token")
    met = posted.join(shared.hint("merge"), "token")
    starts = F.array(*[F.lit(int(x)) for x in size_blocks(percent)])
    low, least = F.element_at(starts, F.col("blk") + 1), F.ceil(F.col("n") * percent / 100)
    at = lambda own, blk: F.struct(F.xxhash64("token", blk).alias("key"), F.struct(F.lit(own).alias("own"), "id", "n", "pos", "bits").alias("p"))
    # In its own block a set's smallest partner has max(low, least) shingles, in the block before it one of ``least``.
    own = F.when(F.col("n") - F.col("pos") >= _need(F.col("n"), F.greatest(low, least), percent), at(True, F.col("blk")))
    before = F.when(low - 1 >= least, at(False, F.col("blk") - 1))
    lists = stored(met.select(F.explode(F.array_compact(F.array(own, before))).alias("x")).select("x.key", "x.p"), "postings")
    h = F.struct(F.col("p.id").alias("id"), F.col("p.own").alias("own"), F.col("p.n").alias("n"), F.col("p.pos").alias("pos"), F.col("p.bits").alias("bits"))
    heads = lists.groupBy("key").agg(F.count("*").alias("len"), F.min(F.when(F.col("p.own"), h)).alias("h")).filter("len > 1 and h is not null")
    return lists.join(heads.hint("merge"), "key").select("key", "p", F.when((F.col("p.id") != F.col("h.id")) & may_pair("p", "h", percent), F.col("h.id")).alias("head"), "len")


def _filter(classes: DataFrame) -> np.ndarray:
    """Bits of the row keys of classes, as a table of fixed size."""
    bit = F.pmod(F.xxhash64("rid"), F.lit(FILTER_BITS))
    words = classes.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, hashes (binary) of the named classes. Texts stay where they are read: a filter of fixed size passes those of
    the classes' documents and a few others, and only their sets are joined."""
    named = stored(classes.join(ids.select("id").distinct(), "id", "left_semi").select("id", "late", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "rid", "copies"), "named")
    words = _filter(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for part in slices(iter([batch])):
                sets = [hash_set(text_digests(t, shingle)).tobytes() for t in utf8(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("late"), part.column("doc_id"), part.column("rid"), pa.array(sets, pa.binary())], ["late", "doc_id", "rid", "hashes"])

    texts = keyed(docs).select(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "rid", "text", F.pmod(F.xxhash64("rid"), F.lit(FILTER_BITS)).alias("bit"))
    found = texts.mapInArrow(run, "late boolean, doc_id long, rid long, hashes binary")
    found = stored(found.join(named, ["late", "doc_id", "rid"]).select("id", "hashes", "copies"), "shingle-sets")
    # Only a class of several rows can name rows that are equal in doc_id and text.
    return found.filter("copies = 1").select("id", "hashes").unionByName(found.filter("copies > 1").select("id", "hashes").dropDuplicates(["id"]))


def _numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype="<u8")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, minus, plus of the pairs (a, b) at the threshold: what b lacks of a, and what it has besides."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, minus, plus = [], [], []
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                x, y = _numbers(x), _numbers(y)
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    continue
                both = np.intersect1d(x, y, assume_unique=True)
                if len(both) * 100 >= percent * (len(x) + len(y) - len(both)):
                    keep.append(k)
                    minus.append(np.setdiff1d(x, both, assume_unique=True).tobytes())
                    plus.append(np.setdiff1d(y, both, assume_unique=True).tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(minus, pa.binary()), pa.array(plus, pa.binary())], ["a", "b", "minus", "plus"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, minus binary, plus binary")


def derive(pairs: DataFrame, links: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) at the threshold, where b's answer comes from its leader's: rows of one (a, leader) stand
    together, a's set and its overlap with the leader first, then what each b differs in; they stream, whatever their number."""
    lead = links.groupBy("b").agg(F.min(F.struct("a", "minus", "plus")).alias("l"))
    asked = pairs.join(lead, "b", "left")
    empty = F.lit(b"")
    asked = stored(asked.select("a", F.coalesce("l.a", "b").alias("leader"), "b", F.coalesce("l.minus", empty).alias("x"), F.coalesce("l.plus", empty).alias("y")), "asked")
    base = asked.select("a", "leader").distinct()
    sets = sets_of(docs, classes, base.select(F.explode(F.array("a", "leader")).alias("id")), shingle)
    known = base.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")).hint("merge"), "a").join(sets.select(F.col("id").alias("leader"), F.col("hashes").alias("y")).hint("merge"), "leader")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shared = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                sizes.append(len(y) // 8)
                shared.append(len(np.intersect1d(_numbers(x), _numbers(y), assume_unique=True)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("leader"), batch.column("x"), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())], ["a", "leader", "x", "size", "shared"])

    # The leader's own set goes no further than this.
    known = known.select("a", "leader", "x", "y").mapInArrow(overlap, "a long, leader long, x binary, size long, shared long")
    none = F.lit(None).cast("long")
    rows = known.select("a", "leader", F.lit(0).alias("kind"), F.col("a").alias("b"), "x", empty.alias("y"), "size", "shared")
    rows = rows.unionByName(asked.select("a", "leader", F.lit(1).alias("kind"), "b", "x", "y", none.alias("size"), none.alias("shared")))
    # A leader's followers may be many: they are dealt by parts, and each part gets a's set.
    parts = asked.groupBy("a", "leader").agg(F.ceil(F.count("*") / 4096).cast("int").alias("parts")).filter("parts > 1")
    rows = rows.join(parts, ["a", "leader"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")))
    rows = rows.withColumn("part", F.explode(part)).select("a", "leader", "part", "kind", "b", "x", "y", "size", "shared")
    rows = rows.repartition(shuffle_width(docs.sparkSession), "a", "leader", "part").sortWithinPartitions("a", "leader", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, size, shared = np.zeros(0, dtype="<u8"), 0, 0
        for batch in batches:
            keep = []
            for k, (kind, x, y, n, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "x", "y", "size", "shared")), strict=True)):
                if kind == 0:
                    mine, size, shared = _numbers(x), n, m
                    continue
                minus, plus = _numbers(x), _numbers(y)
                n = size - len(minus) + len(plus)
                both = shared - int(np.isin(minus, mine).sum()) + int(np.isin(plus, mine).sum())
                if both * 100 >= percent * (len(mine) + n - both):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return rows.select("a", "b", "kind", "x", "y", "size", "shared").mapInArrow(run, "a long, b long")


def first_links(docs: DataFrame, classes: DataFrame, lists: DataFrame, shingle: int, percent: int, more: DataFrame | None = None) -> DataFrame:
    """Verified links (a earlier than b) of every set with the earliest of its lists, and of ``more`` pairs."""
    pairs = lists.filter("head is not null").select(F.least("head", "p.id").alias("a"), F.greatest("head", "p.id").alias("b"))
    pairs = stored(still_possible((pairs if more is None else pairs.unionByName(more)).distinct(), classes, percent), "pairs")
    sets = sets_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("id")), shingle)
    return stored(verify(pairs, sets, percent), "similar")


def join_components(docs: DataFrame, shingle: int = 3, percent: int = 90, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: sets are linked at a Jaccard similarity of ``percent``."""
    rows = stored(describe(docs, shingle_ranks(docs, shingle, buckets), shingle, percent), "sets")
    classes = classes_of(rows)
    lists = stored(posting_lists(classes, percent), "lists")
    links = first_links(docs, classes, lists, shingle, percent)
    roots = stored(components(links.select("a", "b")), "roots")
    here = lists.join(roots.withColumnRenamed("node", "id"), F.col("p.id") == F.col("id"), "left").select("key", "p", F.coalesce("root", "p.id").alias("root"))
    # Lists of several components; pairs within the largest one are not asked.
    tally = here.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("root", "k").alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    mixed = stored(here.join(tally, "key").select("key", "p", "root", (F.col("root") == F.col("main")).alias("main")), "mixed-lists")
    x, y = mixed.filter("not main").select("key", F.col("p").alias("x"), F.col("root").alias("rx")), mixed.select("key", F.col("p").alias("y"), F.col("root").alias("ry"), "main")
    across = (F.col("rx") != F.col("ry")) & (F.col("main") | (F.col("x.id") < F.col("y.id"))) & may_pair("x", "y", percent)
    # The side in the larger component is the one whose answer is derived.
    pairs = x.join(y, "key").filter(across).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    found = stored(still_possible(pairs, classes, percent), "pairs")
    if not found.isEmpty():
        links = links.select("a", "b").unionByName(derive(found, links, docs, classes, shingle, percent))
        roots = stored(components(links), "roots")
    roots = roots.withColumnRenamed("node", "id").join(classes.select(F.col("id").alias("root"), F.col("doc_id").alias("reached")), "root").select("id", "reached")
    named = classes.filter("n > 0").join(roots, "id", "left").filter("copies > 1 or reached is not null").select("cls", F.coalesce("reached", "doc_id").alias("reached"))
    out = rows.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("reached", "doc_id").alias("component_id"))
