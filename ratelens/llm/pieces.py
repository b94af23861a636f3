"""SentencePiece encoding with N-best segmentations, and decoding.

Pieces are scored by unigram log-probabilities that are estimated on all texts: every chunk is cut by longest
match, its pieces are counted in Spark, and each piece of the vocabulary gets log((c + 1) / (n + v)).

A text becomes a chunk for each run of spaces with the word behind it; no piece of the vocabulary reaches over
such a boundary, so the lattice of a text is the lattices of its chunks in a row. Distinct chunks of a task
are solved together: a trie walk finds all pieces at all places, and a forward Viterbi pass over arrays gives
each chunk's best segmentation. With the best scores from both ends, the best path through every arc is known,
and so by how much the second-best segmentation falls short. For the N best of a text only the N - 1 chunks
with the smallest such gap can differ from the best; these are searched backwards with A*, whose exact
heuristic is the forward Viterbi score, and their alternatives are merged into the N best of the text.

Characters without a piece are spelled in byte pieces, at ten below the lowest score for each byte. A space is
U+2581 as in SentencePiece; a literal U+2581 is spelled in bytes, so that it does not decode as a space.
The model file's own scores are merge ranks of a BPE vocabulary, so its library's segmentation differs.

Defined results: null or empty text has no pieces and one segmentation, of score 0; texts with fewer than N
segmentations list fewer; of segmentations with equal scores any come first; repeated rows give repeated
results; ids that are not in the vocabulary decode to nothing; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import keyed, slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581; no valid text holds it, and it takes as many bytes.
LITERAL = "\ud800"
#: Chunks of up to so many characters are solved in arrays, longer ones one by one.
WIDE = 40
#: Solved chunks that a worker remembers.
MEMORY = 450_000
#: Places of the arrays in which chunks are solved together.
ROOM = 1 << 20
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
#: For vocabularies without a piece in which a full stop or comma follows a letter: these start a chunk too.
_FINE = re.compile(f"{SPACE}*[{_LETTERS}]+(?![^{SPACE}.,\n])|{_CHUNK.pattern}")


class Pieces:
    """The vocabulary: scores (the model's own, or log-probabilities), a trie in arrays, and the bytes of each piece."""

    def __init__(self, path: str, logs: np.ndarray | None = None):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self.names = [m.id_to_piece(i) for i in range(size)]
        self.bytes = [b""] * size
        self.byte_id = [0] * 256
        self.ids: dict[str, int] = {}
        self.score = np.zeros(size)
        for i, name in enumerate(self.names):
            if m.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.bytes[i] = bytes([int(name[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[name] = i
                self.score[i] = m.get_score(i) if logs is None else logs[i]
                self.bytes[i] = name.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.ids))
        #: The longest piece that begins with these two characters, or is the first of them.
        self.reach: dict[str, int] = {}
        for name in self.ids:
            for head in (name[:2], name[:1]):
                self.reach[head] = max(self.reach.get(head, 0), len(name) if head == name[:2] else 1)
        self.chunks = (_CHUNK if any(re.search(f"[{_LETTERS}][.,]|[^{SPACE}]{SPACE}|.\n|\n.", name) for name in self.ids) else _FINE).findall
        self.byte_score = float(self.score[list(self.ids.values())].min()) - 10
        #: Nodes are numbered from 1; an edge's key is node * 2^21 + character.
        edges: dict[int, int] = {}
        piece = [-1, -1]
        for name, i in self.ids.items():
            node = 1
            for c in name:
                key = node << 21 | ord(c)
                if key not in edges:
                    edges[key] = len(piece)
                    piece.append(-1)
                node = edges[key]
            piece[node] = i
        self.piece = np.array(piece)
        slots = 1 << (4 * len(edges)).bit_length()
        self.mask, self.keys, self.nodes = slots - 1, np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
        #: The nodes of first characters, without a search.
        self.root = np.zeros(0x110000, dtype=np.int32)
        for key, node in edges.items():
            if key >> 21 == 1:
                self.root[key & 0x1FFFFF] = node
            at = self._slot(key)
            while self.keys[at]:
                at = (at + 1) & self.mask
            self.keys[at], self.nodes[at] = key, node

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 15) & self.mask

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node, 0 where there is none."""
        key = node << 21 | char
        at = self._slot(key)
        here = self.keys[at]
        out = np.where(here == key, self.nodes[at], 0)
        left = np.flatnonzero((here != key) & (here != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            here = self.keys[at[left]]
            found = here == key[left]
            out[left[found]] = self.nodes[at[left[found]]]
            left = left[~found & (here != 0)]
        return out

    def spell(self, c: str) -> list[int]:
        return [self.byte_id[b] for b in (SPACE if c == LITERAL else c).encode("utf-8", "surrogatepass")]

    def split(self, text: str) -> list[str]:
        """The chunks of a text."""
        if SPACE in text:
            text = text.replace(SPACE, LITERAL)
        return self.chunks(SPACE + text.replace(" ", SPACE)) if text else []

    def longest_match(self, chunk: str) -> list[int]:
        """Piece ids by longest match from the left."""
        get, reach, out, at, n = self.ids.get, self.reach.get, [], 0, len(chunk)
        while at < n:
            for end in range(min(n, at + reach(chunk[at : at + 2], 1)), at, -1):
                p = get(chunk[at:end])
                if p is not None:
                    out.append(p)
                    break
            else:
                out += self.spell(chunk[at])
                end = at + 1
            at = end
        return out

    def arcs(self, chunk: str) -> list[list[tuple[int, int, float]]]:
        """For each end: (start, piece, score) of the pieces there; piece -1 spells one character in bytes."""
        out: list = [[] for _ in range(len(chunk) + 1)]
        get, score = self.ids.get, self.score
        for i in range(len(chunk)):
            for j in range(i + 1, min(len(chunk), i + self.longest) + 1):
                p = get(chunk[i:j])
                if p is not None:
                    out[j].append((i, p, float(score[p])))
                elif j == i + 1:
                    out[j].append((i, -1, self.byte_score * len(chunk[i].encode("utf-8", "surrogatepass"))))
        return out

    def n_best(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations with their scores, best first: A* from the end, guided by Viterbi scores."""
        arcs, best = self.arcs(chunk), [0.0]
        for j in range(1, len(chunk) + 1):
            best.append(max(best[i] + s for i, _, s in arcs[j]))
        heap, found, k = [(-best[-1], 0, len(chunk), 0.0, ())], [], 0
        while heap and len(found) < n:
            _, _, at, tail, path = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while path:
                    (start, p), path = path
                    ids += self.spell(chunk[start]) if p < 0 else [p]
                found.append((tail, ids))
                continue
            for i, p, s in arcs[at]:
                k += 1
                heapq.heappush(heap, (-(best[i] + s + tail), k, i, s + tail, ((i, p), path)))
        return found


class Solved:
    """Best segmentations of the chunks seen so far, in growing arrays."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.index = pieces, {}
        self.start, self.size, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, "<u4")
        self.score, self.gap, self.uses, self.used = np.zeros(1 << 12), np.zeros(1 << 12), np.zeros(1 << 12, np.int32), 0
        self.more: dict[tuple[str, int], list[tuple[float, list[int], bool]]] = {}

    def _room(self, names: tuple[str, ...], need: int) -> None:
        for name in names:
            old = getattr(self, name)
            if len(old) < need:
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def forget(self) -> None:
        """Keep only the chunks that came up again."""
        keep = np.flatnonzero(self.uses[: len(self.index)] > 1)
        if len(keep) > MEMORY // 2:
            keep = keep[:0]
        names, sizes = list(self.index), self.size[keep].astype(np.int64)
        ends = np.cumsum(sizes)
        self.used = int(ends[-1]) if len(ends) else 0
        self.ids[: self.used] = self.ids[np.repeat(self.start[keep] - (ends - sizes), sizes) + np.arange(self.used)]
        self.start[: len(keep)] = ends - sizes
        for values in (self.size, self.score, self.gap):
            values[: len(keep)] = values[keep]
        self.uses[:] = 0
        self.index = dict(zip(map(names.__getitem__, keep.tolist()), range(len(keep)), strict=True))
        self.more.clear()

    def add(self, chunks: list[str]) -> None:
        """Solve chunks that are not in the index."""
        by_size: dict[int, list[str]] = {}
        for c in chunks:
            by_size.setdefault(len(c), []).append(c)
        for size, group in by_size.items():
            step = max(100, ROOM // (size * min(size, self.pieces.longest)))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                self._put(part, *(self._arrays(part, size) if size <= WIDE else self._single(part)))

    def _put(self, chunks: list[str], score: np.ndarray, gap: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        n, k = len(self.index), len(chunks)
        self._room(("start", "size", "score", "gap", "uses"), n + k)
        self._room(("ids",), self.used + len(flat))
        self.index.update(zip(chunks, range(n, n + k), strict=True))
        self.start[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + k], self.score[n : n + k], self.gap[n : n + k] = sizes, score, gap
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def _single(self, chunks: list[str]):
        found = [self.pieces.n_best(c, 2) for c in chunks]
        score = np.array([f[0][0] for f in found])
        gap = np.array([f[0][0] - f[1][0] if len(f) > 1 else np.inf for f in found])
        return score, gap, np.array([len(f[0][1]) for f in found]), np.concatenate([f[0][1] for f in found])

    def _arrays(self, chunks: list[str], size: int):
        v, n = self.pieces, len(chunks)
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, size).astype(np.int64)
        width = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        low = -np.inf
        # arc[i][k]: piece and score of the arc over characters i .. i + k; -1 with a score spells one character.
        piece = np.full((size, min(size, v.longest), n), -2, dtype=np.int32)
        gain = np.full(piece.shape, low)
        reach = 1
        for i in range(size):
            alive = np.arange(n)
            for k in range(min(size - i, v.longest)):
                node = v.step(node, chars[alive, i + k]) if k else v.root[chars[:, i]].astype(np.int64)
                on = node > 0
                alive, node = alive[on], node[on]
                if not len(alive):
                    break
                p = v.piece[node]
                has = p >= 0
                piece[i, k, alive[has]], gain[i, k, alive[has]] = p[has], v.score[p[has]]
                reach = max(reach, k + 1)
            none = piece[i, 0] < 0
            piece[i, 0, none], gain[i, 0, none] = -1, v.byte_score * width[none, i]
        piece, gain = piece[:, :reach], gain[:, :reach]
        ahead, back = np.full((size + 1, n), low), np.zeros((size + 1, n), dtype=np.int64)
        ahead[0] = 0
        for j in range(1, size + 1):
            for k in range(min(j, piece.shape[1])):
                value = ahead[j - 1 - k] + gain[j - 1 - k, k]
                better = value > ahead[j]
                ahead[j, better], back[j, better] = value[better], k
        behind = np.full((size + 1, n), low)
        behind[size] = 0
        for i in range(size - 1, -1, -1):
            for k in range(min(size - i, piece.shape[1])):
                np.maximum(behind[i], gain[i, k] + behind[i + 1 + k], out=behind[i])
        # Walk the best path from the end, take it out, and look for the best path through any other arc.
        rows, at = np.arange(n), np.full(n, size)
        path: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        off = gain.copy()
        while len(rows):
            k = back[at, rows]
            i = at - 1 - k
            path.append((rows, i, piece[i, k, rows]))
            off[i, k, rows] = low
            rows, at = rows[i > 0], i[i > 0]
        second = np.full(n, low)
        for i in range(size):
            for k in range(min(size - i, piece.shape[1])):
                np.maximum(second, ahead[i] + off[i, k] + behind[i + 1 + k], out=second)
        row, place, ids = (np.concatenate([p[x] for p in path]) for x in range(3))
        times = np.where(ids < 0, width[row, place], 1)
        order = np.lexsort((place, row))
        row, place, ids, times = row[order], place[order], ids[order], times[order]
        flat, ends = np.repeat(ids, times), np.cumsum(times)
        for x in np.flatnonzero(ids < 0).tolist():
            flat[ends[x] - times[x] : ends[x]] = v.spell(chunks[row[x]][place[x]])
        return ahead[size], ahead[size] - second, np.bincount(row, weights=times, minlength=n).astype(np.int64), flat

    def others(self, chunk: str, n: int) -> list[tuple[float, list[int], bool]]:
        """How far each of the n best segmentations but the best falls short of it, its ids, and whether they decode alike."""
        if (chunk, n) not in self.more:
            best, k = self.pieces.n_best(chunk, n), self.index[chunk]
            # Where several are best, the one that is kept need not be the first found here.
            own = self.ids[self.start[k] : self.start[k] + self.size[k]].tolist()
            text = [b"".join(map(self.pieces.bytes.__getitem__, ids)) for ids in (own, *(ids for _, ids in best))]
            self.more[chunk, n] = [(best[0][0] - s, ids, t == text[0]) for (s, ids), t in zip(best, text[1:], strict=True) if ids != own][: n - 1]
        return self.more[chunk, n]

    def numbered(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the texts' chunks, which count as used."""
        each = [np.fromiter(map(self.index.__getitem__, chunks), dtype=np.int64, count=len(chunks)) for chunks in texts]
        if each:
            self.uses += np.bincount(np.concatenate(each), minlength=len(self.uses)).astype(np.int32)
        return each

    def encode(self, chunks: list[str], at: np.ndarray, n: int) -> tuple[list[np.ndarray], list[float], bool]:
        """The ids and scores of the n best segmentations of a text's chunks, best first, and whether all decode alike."""
        if not chunks:
            return [np.zeros(0, self.ids.dtype)], [0.0], True
        sizes, score = self.size[at].astype(np.int64), float(self.score[at].sum())
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(ends[-1])]
        gap, few = self.gap[at], min(n - 1, len(chunks))
        # What each falls short of the best, and the chunks in which it differs, by place.
        short: list[tuple[float, dict[int, list[int]]]] = [(0.0, {})]
        alike = True
        for k in np.argpartition(gap, few - 1)[:few].tolist() if few else []:
            if np.isfinite(gap[k]):
                others = self.others(chunks[k], n)
                alike = alike and all(x for _, _, x in others)
                more = [(a + b, swaps | {k: other}) for a, swaps in short for b, other, _ in others]
                short = sorted(short + more, key=lambda x: x[0])[:n]
        found = [ids]
        for _, swaps in short[1:]:
            parts, last = [], 0
            for k in sorted(swaps):
                parts += [ids[last : ends[k] - sizes[k]], np.array(swaps[k], dtype=ids.dtype)]
                last = ends[k]
            found.append(np.concatenate([*parts, ids[last:]]))
        return found, [score - x for x, _ in short], alike


_LOADED: dict[str, tuple[int, Solved]] = {}


def solver(path: str, logs: np.ndarray | None = None) -> Solved:
    """This worker's solver; it forgets what did not come up again once it remembers too much."""
    version = 0 if logs is None else zlib.crc32(logs.tobytes())
    if path not in _LOADED or _LOADED[path][0] != version:
        _LOADED[path] = version, Solved(Pieces(path, logs))
    solved = _LOADED[path][1]
    if len(solved.index) > MEMORY or len(solved.more) > MEMORY // 8:
        solved.forget()
    return solved


class _Matches(dict):
    """Chunks by number, and the pieces of their longest matches, which are found for many chunks at once."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.new, self.solved = pieces, [], 0
        self.found: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n

    def solve(self) -> None:
        chunks, self.new, v = self.new, [], self.pieces
        if not chunks:
            return
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        end = np.repeat(ends, sizes)
        best, length = np.full(len(chars), -1, dtype=np.int32), np.ones(len(chars), dtype=np.int64)
        alive, node, k = np.arange(len(chars)), v.root[chars].astype(np.int64), 0
        while len(alive):
            on = node > 0
            alive, node = alive[on], node[on]
            p = v.piece[node]
            has = p >= 0
            k += 1
            best[alive[has]], length[alive[has]] = p[has], k
            on = alive + k < end[alive]
            alive, node = alive[on], node[on]
            node = v.step(node, chars[alive + k])
        at, owner = ends - sizes, self.solved + np.arange(len(chunks), dtype=np.int32)
        self.solved += len(chunks)
        while len(at):
            none = best[at] < 0
            self.found.append(best[at[~none]])
            self.owner.append(owner[~none])
            for place, chunk in zip(at[none].tolist(), owner[none].tolist(), strict=True):
                spelt = v.spell(chr(chars[place]))
                self.found.append(np.array(spelt, dtype=np.int32))
                self.owner.append(np.full(len(spelt), chunk, dtype=np.int32))
            on = at + length[at] < end[at]
            at, owner = (at + length[at])[on], owner[on]

    def counted(self, uses: np.ndarray) -> np.ndarray:
        """Uses of all pieces, given those of the chunks."""
        self.found, self.owner = ([np.concatenate([*x, np.zeros(0, dtype=np.int32)])] for x in (self.found, self.owner))
        on = self.owner[0] < len(uses)
        return np.bincount(self.found[0][on], weights=uses[self.owner[0][on]], minlength=len(self.pieces.names)).astype(np.int64)


_MATCHED: dict[str, _Matches] = {}


def piece_logs(docs: DataFrame, model: str = MODEL) -> np.ndarray:
    """The log-probability of every piece, from counts over all texts; bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is matched is kept for the worker's next tasks; uses are counted by task.
        seen = _MATCHED.get(model) or _MATCHED.setdefault(model, _Matches(Pieces(public_tokenizers.path(model))))
        pieces, uses = seen.pieces, np.zeros(len(seen), dtype=np.int64)
        total = np.zeros(len(pieces.names), dtype=np.int64)

        for batch in slices(batches, limit=2 << 20):
            each = [pieces.split(t or "") for t in batch.column("text").to_pylist()]
            at = np.concatenate([np.fromiter(map(seen.__getitem__, chunks), dtype=np.int64, count=len(chunks)) for chunks in each])
            now = np.bincount(at, minlength=len(seen))
            now[: len(uses)] += uses
            uses = now
            seen.solve()
            if len(seen) > MEMORY + MEMORY // 2:
                total += seen.counted(uses)
                seen = _MATCHED[model] = _Matches(pieces)
                uses = np.zeros(0, dtype=np.int64)
        if len(uses):
            total += seen.counted(uses)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(total[on])], ["piece", "c"])

    found = keyed(docs).select("text").mapInArrow(run, "piece int, c long").groupBy("piece").agg(F.sum("c").alias("c")).toArrow()
    pieces = Pieces(public_tokenizers.path(model))
    counts = np.zeros(len(pieces.names))
    counts[found.column("piece").to_numpy()] = found.column("c").to_numpy()
    return np.log((counts + 1) / (counts.sum() + len(counts)))


def decode(ids: np.ndarray, pieces: Pieces) -> bytes:
    """The text of piece ids, UTF-8, without the space that encoding puts in front."""
    return b"".join(map(pieces.bytes.__getitem__, ids.tolist()))[1:]


_COLUMNS = "doc_id long, n_pieces long, ids_crc32 long, best_score double, nbest_scores array<double>, nbest_crc32 array<long>, round_trip boolean"


def encode_pieces(docs: DataFrame, n: int = 4, model: str = MODEL, with_ids: bool = False, with_nbest: bool = False, logs: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the best ids as little-endian unsigned 32-bit integers), best_score,
    nbest_scores and nbest_crc32 (best first), round_trip (every one of the N decodes to the text), and with
    ``with_ids`` piece_ids, with ``with_nbest`` nbest_ids (the ids of all N). ``logs`` are scores of all pieces, by default ``piece_logs`` of the texts."""
    logs = piece_logs(docs, model) if logs is None else logs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = public_tokenizers.path(model)
        for batch in slices(batches, limit=2 << 20):
            solved, texts = solver(path, logs), [t or "" for t in batch.column("text").to_pylist()]
            split = list(map(solved.pieces.split, texts))
            new: dict[str, None] = {}
            for chunks in split:
                new.update(dict.fromkeys(chunks))
            solved.add([c for c in new if c not in solved.index])
            out: list[list] = [[] for _ in range(6)]
            for t, chunks, at in zip(texts, split, solved.numbered(split), strict=True):
                found, scores, alike = solved.encode(chunks, at, n)
                sums = [zlib.crc32(np.ascontiguousarray(ids)) for ids in found]
                raw = t.encode("utf-8", "surrogatepass")
                values = (len(found[0]), sums[0], scores, sums, alike and decode(found[0], solved.pieces) == raw, found)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            names = [c.split()[0] for c in _COLUMNS.split(", ")]
            scores = pa.array(out[2], pa.list_(pa.float64()))
            arrays = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([s[0] for s in out[2]], pa.float64()), scores, pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.bool_())]
            if with_ids:
                arrays.append(_lists([f[0] for f in out[5]]))
                names.append("piece_ids")
            if with_nbest:
                ends = np.cumsum([0, *map(len, out[5])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), _lists([ids for f in out[5] for ids in f])))
                names.append("nbest_ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return keyed(docs).select("doc_id", "text").mapInArrow(run, _COLUMNS + ", piece_ids array<int>" * with_ids + ", nbest_ids array<array<int>>" * with_nbest)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, dtype=np.int32)]).astype(np.int32)))


def decode_pieces(encoded: DataFrame, ids: str = "piece_ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of the piece ids in column ``ids``; null ids give null text."""
    names = [c for c in encoded.columns if c != text]
    schema = encoded.select(*names).withColumn(text, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(public_tokenizers.path(model))
        for batch in batches:
            texts = []
            for row in batch.column(ids).to_pylist():
                known = None if row is None else np.array([i for i in row if i is not None and 0 <= i < len(pieces.bytes)], dtype=np.int64)
                texts.append(None if known is None else decode(known, pieces).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, text])

    return encoded.mapInArrow(run, schema)
