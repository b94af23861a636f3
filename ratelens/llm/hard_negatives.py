"""Hard negatives by an inverted multi-index over quantised vectors.

*Index.* Vectors are cut into two halves. Each half space has a codebook of up to 64 centres, fitted by k-means on
the ``SAMPLE`` rows with the smallest hashes of their ids; every row is indexed, in the cell of its two nearest
centres. Rows are kept in shards by cell, neighbouring cells together; a cell of more than ``SHARD_ROWS`` rows is
split by the hash of vec_id. Centres, radii and the rows of each of the at most 4,096 cells are all that the
driver holds.

*Search.* In a shard, a half-score of an anchor with a centre, plus the anchor's length times the radius of the
centre's rows there, bounds what the half can add to any row's score. A heap visits the cells by the sum of both
bounds (the multi-sequence algorithm), and rows of visited cells are scored exactly. An anchor is done in a shard
once the best bound left is below its last wanted score: then no row that was not visited can belong to the answer.
First the positives are found, then, for the windows of scores that they give, the negatives: rows above a window
are passed over, and a window is certified once its last wanted row is above the best bound left, or the bound is
below the window. Shards whose cells lie below all windows get no anchor.

Anchors of a shard stream through its task in blocks, so neither side is gathered beyond ``SHARD_ROWS`` rows.
Each (anchor, shard) answers with the wanted number of rows at most, which are merged by anchor.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors
of fewer components count as filled up with zeros; rows that repeat (id, label and vector) count once; rows that
share an id but differ are rows of their own, and no positives of each other; an empty table gives an empty result;
scores that do not fit a long fail the job; other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import bounded_batches, shuffle_width, stored

SAMPLE = 8192
MOST_CENTRES = 64
SHARD_ROWS = 1 << 16
#: Anchors of one shard that one task takes.
BLOCK = 1 << 16


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, q: usable rows with the floors of their scaled components."""
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    real = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    usable = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").filter(whole).filter(real)
    return usable.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def _centres(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows; centres that lose all their points stay."""
    c = points[np.linspace(0, len(points) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        at = _nearest(points, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, points)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(axis=1) - 2 * points @ c.T, axis=1)


def _padded(column: pa.Array, dim: int) -> np.ndarray:
    n = len(column)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim), dtype=np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


class Shard:
    """The rows of one shard by cell, with the radii of each half's centres among them."""

    def __init__(self, centres: tuple[np.ndarray, np.ndarray], cells: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        _, first = np.unique(np.column_stack([ids, labels, x]), axis=0, return_index=True) if len(np.unique(ids)) < len(ids) else (0, np.arange(len(ids)))
        order = first[np.argsort(cells[first], kind="stable")]
        self.ids, self.labels, self.whole = ids[order], labels[order], x[order]
        cells = cells[order]
        self.centres, self.k = centres, len(centres[1])
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, dtype=np.int64)
        self.spans = {int(cells[a]): (int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(cells)], strict=True)}
        half = len(centres[0][0])
        self.used, self.radii = [], []
        for code, part, c in ((cells // self.k, self.whole[:, :half], centres[0]), (cells % self.k, self.whole[:, half:], centres[1])):
            far = np.zeros(len(c))
            np.maximum.at(far, code, np.sqrt(((part - c[code]) ** 2).sum(axis=1)))
            self.used.append(np.unique(code))
            # A little more than any rounding.
            self.radii.append(far * (1 + 1e-9) + 1e-6)
        self.norm = float(np.sqrt((self.whole.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
        self.kinds: dict[type, np.ndarray] = {}

    def scored(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchor and all rows in the smallest type in which every sum of products is exact."""
        most = self.norm * float(np.sqrt((a.astype(np.float64) ** 2).sum()))
        if most >= 2**62:
            raise ValueError("a score does not fit a long")
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        if kind not in self.kinds:
            self.kinds[kind] = self.whole.astype(kind)
        return self.kinds[kind], a.astype(kind)

    def visits(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Places and exact scores of rows, and the best bound of all that come later; best cells first."""
        half = len(self.centres[0][0])
        x, mine = self.scored(a)
        order, bounds = [], []
        for part, c, used, radii in zip((a[:half], a[half:]), self.centres, self.used, self.radii, strict=True):
            part = part.astype(np.float64)
            b = c[used] @ part + radii[used] * np.sqrt(part @ part)
            at = np.argsort(-b, kind="stable")
            order.append(used[at].tolist())
            bounds.append((b[at] + np.abs(b[at]) * 1e-9 + 1e-3).tolist())
        (u, v), (bu, bv) = order, bounds
        heap, batch, size, wanted = ([(-(bu[0] + bv[0]), 0, 0)] if u and v else []), [], 0, 256
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(v):
                heapq.heappush(heap, (-(bu[i] + bv[j + 1]), i, j + 1))
            if not j and i + 1 < len(u):
                heapq.heappush(heap, (-(bu[i + 1] + bv[0]), i + 1, 0))
            span = self.spans.get(u[i] * self.k + v[j])
            if span:
                batch.append(span)
                size += span[1] - span[0]
            if batch and (size >= wanted or not heap):
                at = np.concatenate([np.arange(p, q) for p, q in batch])
                scores = np.concatenate([x[p:q] @ mine for p, q in batch]).astype(np.int64)
                yield at, scores, -heap[0][0] if heap else -np.inf
                batch, size, wanted = [], 0, 2 * wanted

    def positives(self, anchor: int, label: int, a: np.ndarray, wanted: int) -> list[tuple[int, int]]:
        """(score, id) of the best other rows of the label."""
        best_s, best_i = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for at, scores, left in self.visits(a):
            same = (self.labels[at] == label) & (self.ids[at] != anchor)
            if len(best_s) == wanted:
                same &= scores >= best_s[-1]
            if same.any():
                best_s, best_i = np.concatenate([best_s, scores[same]]), np.concatenate([best_i, self.ids[at[same]]])
                top = np.lexsort((best_i, -best_s))[:wanted]
                best_s, best_i = best_s[top], best_i[top]
            if len(best_s) == wanted and left < best_s[-1]:
                break
        return list(zip(best_s.tolist(), best_i.tolist(), strict=True))

    def negatives(self, label: int, a: np.ndarray, windows: list[tuple[int, int]], wanted: int) -> list[list[tuple[int, int]]]:
        """For each window (lowest and highest score), the best rows of other labels within it."""
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in windows]
        open_ = list(range(len(windows)))
        for at, scores, left in self.visits(a):
            lowest, highest = min(windows[w][0] for w in open_), max(windows[w][1] for w in open_)
            other = (scores >= lowest) & (scores <= highest) & (self.labels[at] != label)
            s, i = scores[other], self.ids[at[other]]
            for w in list(open_):
                low, high = windows[w]
                inside = (s >= low) & (s <= high)
                if inside.any():
                    all_s, all_i = np.concatenate([found[w][0], s[inside]]), np.concatenate([found[w][1], i[inside]])
                    top = np.lexsort((all_i, -all_s))[:wanted]
                    found[w] = all_s[top], all_i[top]
                if left < low or len(found[w][0]) == wanted and left < found[w][0][-1]:
                    open_.remove(w)
            if not open_:
                break
        return [list(zip(s.tolist(), i.tolist(), strict=True)) for s, i in found]


class Index:
    """Codebooks and shards of the usable rows (vec_id, label, q)."""

    def __init__(self, rows: DataFrame, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE, centres: int | None = None):
        spark = rows.sparkSession
        bounded_batches(spark)
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dim"), F.coalesce(F.max(F.array_max(F.transform("q", lambda x: F.abs(x)))), F.lit(0)).alias("most")).first()
        if size["most"] >= 2**62:
            raise ValueError("a component does not fit a long")
        n, self.dim = size["n"], max(2, size["dim"])
        self.kind = np.int16 if size["most"] < 2**15 else np.int32 if size["most"] < 2**31 else np.int64
        k = centres or min(MOST_CENTRES, max(2, isqrt(n // 256)))
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("q").toArrow().column("q").combine_chunks()
        points = _padded(some, self.dim).astype(np.float64) if len(some) else np.zeros((1, self.dim))
        half = self.dim // 2
        self.centres = tuple(_centres(p, min(k, len(points))) for p in (points[:, :half], points[:, half:]))
        dim, kind, books, codes = self.dim, self.kind, self.centres, len(self.centres[1])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _padded(batch.column("q"), dim)
                cells = _nearest(x[:, :half].astype(np.float64), books[0]) * codes + _nearest(x[:, half:].astype(np.float64), books[1])
                packed = x.astype(kind).tobytes()
                width = dim * np.dtype(kind).itemsize
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(cells.astype(np.int32)), pa.array([packed[p : p + width] for p in range(0, len(packed), width)], pa.binary())], ["vec_id", "label", "cell", "q"])

        self.rows = stored(rows.select("vec_id", "label", "q").mapInArrow(assign, "vec_id long, label long, cell int, q binary"), "cells")
        counts = {r["cell"]: r["n"] for r in self.rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        most = min(shard_rows, max(512, -(-n // shuffle_width(spark))))
        #: First shard and number of shards of each cell.
        self.plan: dict[int, tuple[int, int]] = {}
        shard, filled = 0, 0
        for cell in sorted(counts):
            parts = -(-counts[cell] // most)
            if parts > 1 or filled + counts[cell] > most:
                shard, filled = shard + (filled > 0), 0
            self.plan[cell] = shard, parts
            filled += counts[cell]
            if parts > 1:
                shard, filled = shard + parts, 0
        self.shards = shard + (filled > 0)
        self.radii = self._radii()

    def _radii(self) -> tuple[np.ndarray, np.ndarray]:
        """The largest distance from each half's centre over all rows: two numbers a centre."""
        dim, kind, books, codes, half = self.dim, self.kind, self.centres, len(self.centres[1]), self.dim // 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            far = [np.zeros(len(c)) for c in books]
            for batch in batches:
                x, cells = np.frombuffer(b"".join(batch.column("q").to_pylist()), dtype=kind).reshape(-1, dim).astype(np.float64), batch.column("cell").to_numpy()
                for s, (code, part) in enumerate(((cells // codes, x[:, :half]), (cells % codes, x[:, half:]))):
                    np.maximum.at(far[s], code, np.sqrt(((part - books[s][code]) ** 2).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(f) for f in far]), pa.int32()), pa.array(np.concatenate([np.arange(len(f)) for f in far]), pa.int32()), pa.array(np.concatenate(far))], ["side", "centre", "far"])

        out = [np.zeros(len(c)) for c in books]
        for r in self.rows.select("cell", "q").mapInArrow(run, "side int, centre int, far double").groupBy("side", "centre").agg(F.max("far").alias("far")).collect():
            out[r["side"]][r["centre"]] = r["far"] * (1 + 1e-9) + 1e-6
        return tuple(out)

    def shard_of(self):
        """Column: the shard of a row."""
        cells = sorted(self.plan)
        if not cells:
            return F.lit(0)
        first, parts = (F.array(*[F.lit(x) for x in column]) for column in ([self.plan.get(c, (0, 1))[k] for c in range(cells[-1] + 1)] for k in (0, 1)))
        at = F.col("cell") + 1
        return F.element_at(first, at) + F.pmod(F.xxhash64("vec_id"), F.element_at(parts, at)).cast("int")

    def router(self) -> Callable[[np.ndarray, float], list[int]]:
        """A function of an anchor and a score: the shards with a cell whose bound reaches that score."""
        half, codes, centres, radii, plan = self.dim // 2, len(self.centres[1]), self.centres, self.radii, self.plan

        def routes(a: np.ndarray, lowest: float) -> list[int]:
            bound, out = [], set()
            for part, c, r in zip((a[:half].astype(np.float64), a[half:].astype(np.float64)), centres, radii, strict=True):
                b = c @ part + r * np.sqrt(part @ part)
                bound.append(b + np.abs(b) * 1e-9 + 1e-3)
            for cell, (shard, parts) in plan.items():
                if bound[0][cell // codes] + bound[1][cell % codes] >= lowest:
                    out.update(range(shard, shard + parts))
            return sorted(out)

        return routes


def _streamed(index: Index, asked: DataFrame, answer: Callable[[Shard, pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: str, block: int) -> DataFrame:
    """``answer(shard, rows of asked)`` for every shard with what is asked of it: columns aid, vec_id, label, q, scores
    and shard of ``asked``. A shard's rows come first in its task, then what is asked, batch by batch."""
    spark = asked.sparkSession
    blocks = max(1, -(-asked.groupBy("shard").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] // block))
    none = F.array().cast("array<bigint>")
    rows = index.rows.select(index.shard_of().alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "cell", "vec_id", "label", "q", F.lit(0).cast("long").alias("aid"), none.alias("scores"))
    asks = asked.select("shard", F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), F.lit(0).alias("cell"), "vec_id", "label", "q", "aid", F.col("scores").cast("array<bigint>").alias("scores"))
    dealt = rows.unionByName(asks).repartition(shuffle_width(spark), "shard", "block").sortWithinPartitions("shard", "block", "kind", "cell")
    dim, kind, centres = index.dim, index.kind, index.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        here, shard = None, None

        def vectors(b: pa.RecordBatch | pa.Table) -> np.ndarray:
            return np.frombuffer(b"".join(b.column("q").to_pylist()), dtype=kind).reshape(-1, dim)

        for batch in batches:
            place = batch.column("shard").to_numpy().astype(np.int64) * (1 << 31) + batch.column("block").to_numpy()
            kinds = batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), batch.num_rows]
            for p, q in zip(cuts, cuts[1:]):
                if p == q:
                    continue
                part = batch.slice(p, q - p)
                if kinds[p] == 0:
                    if here != place[p]:
                        held, here = [], place[p]
                    held.append(part)
                    shard = None
                    continue
                if here != place[p]:
                    continue  # no rows in this shard
                if shard is None:
                    t = pa.Table.from_batches(held)
                    shard = Shard(centres, t.column("cell").to_numpy().astype(np.int64), t.column("vec_id").to_numpy(), t.column("label").to_numpy(), vectors(t).astype(np.int64) if kind == np.int64 else vectors(t))
                    held = []
                yield from answer(shard, part, vectors(part))

    return dealt.mapInArrow(run, schema)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, shard_rows: int = SHARD_ROWS, block: int = BLOCK, centres: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` and ``anchors`` have vec_id, label, q (see ``quantised``). An anchor's positives are its best other rows of
    the same label; a positive's negatives are the best rows of other labels with low * positive <= 100 * negative
    <= high * positive."""
    index = Index(rows, shard_rows, centres=centres)
    dim, kind = index.dim, index.kind

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, width = _padded(batch.column("q"), dim).astype(kind).tobytes(), dim * np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([packed[p : p + width] for p in range(0, len(packed), width)], pa.binary())], ["vec_id", "label", "q"])

    asked = anchors.select("vec_id", "label", "q").mapInArrow(pack, "vec_id long, label long, q binary").distinct()
    asked = stored(asked.withColumn("aid", F.xxhash64("vec_id", "label", "q")), "anchors")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(max(0, index.shards - 1)))).alias("shard")

    def near(shard: Shard, batch: pa.RecordBatch, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for aid, vec_id, label, a in zip(batch.column("aid").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), vectors, strict=True):
            out += [(aid, s, i) for s, i in shard.positives(vec_id, label, a, positives)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["aid", "positive_score", "positive_id"])

    found = _streamed(index, asked.select("*", F.array().alias("scores"), everywhere), near, "aid long, positive_score long, positive_id long", block)
    # Ties at one id are rows of one id; either gives the same.
    best = Window.partitionBy("aid").orderBy(F.desc("positive_score"), "positive_id")
    chosen = stored(found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives), "positives")
    # Below zero a window's ends are the wrong way round, so it is empty.
    windows = chosen.filter("positive_score >= 0").groupBy("aid").agg(F.collect_set("positive_score").alias("scores"))
    wanted, routes = asked.join(windows, "aid"), index.router()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [routes(np.frombuffer(q, dtype=kind), min(-(-low * s // 100) for s in scores)) for q, scores in zip(batch.column("q").to_pylist(), batch.column("scores").to_pylist(), strict=True)]
            at = pa.array(np.repeat(np.arange(len(to)), [len(x) for x in to]))
            yield pa.RecordBatch.from_arrays([pa.array([s for x in to for s in x], pa.int32()), *[batch.column(c).take(at) for c in ("aid", "vec_id", "label", "q", "scores")]], ["shard", "aid", "vec_id", "label", "q", "scores"])

    def far(shard: Shard, batch: pa.RecordBatch, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        for aid, label, scores, a in zip(batch.column("aid").to_pylist(), batch.column("label").to_pylist(), batch.column("scores").to_pylist(), vectors, strict=True):
            spans = [(-(-low * s // 100), high * s // 100) for s in scores]
            for s, rows_ in zip(scores, shard.negatives(label, a, spans, negatives), strict=True):
                out += [(aid, s, t, i) for t, i in rows_]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["aid", "positive_score", "negative_score", "negative_id"])

    routed = wanted.select("aid", "vec_id", "label", "q", "scores").mapInArrow(route, "shard int, aid long, vec_id long, label long, q binary, scores array<bigint>")
    routed = stored(routed, "routed")
    hard = _streamed(index, routed, far, "aid long, positive_score long, negative_score long, negative_id long", block)
    rank = Window.partitionBy("aid", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(rank).cast("int")).filter(F.col("rank") <= negatives)
    ids = asked.select("aid", F.col("vec_id").alias("anchor_id"))
    return chosen.join(hard, ["aid", "positive_score"]).join(ids, "aid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
