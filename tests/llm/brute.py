"""Plain forms of the operators' results, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {i: i + 32 for i in range(65, 91)}
WHITE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = list(zip(w, w[1:], w[2:]))
    times, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if times[x] > 1:
            covered |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def line_dedup(rows, least=10):
    """rows: (doc_id, text); a null id is one document."""
    key = lambda x: x.strip(WHITE).translate(AZ)
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(docs[key(x)]) >= least)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def fingerprint(text):
    w = WORD.findall((text or "").translate(AZ))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def groups(values, bits=2):
    """For each value the smallest position that it reaches."""
    v, root = np.array(values, dtype=np.uint64), list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k in range(len(v)):
        for m in np.flatnonzero(np.bitwise_count(v[:k] ^ v[k]) <= bits):
            a, b = sorted((find(k), find(int(m))))
            root[b] = a
    return [find(k) for k in range(len(v))]


def hit_words(text, benchmark, width=10):
    """Words of a text, places of its hit words, and the items they come from."""
    w, hit, items = ALNUM.findall((text or "").translate(AZ)), set(), set()
    at = defaultdict(list)
    for k, x in enumerate(w):
        at[x].append(k)
    for item, body in benchmark:
        b = ALNUM.findall((body or "").translate(AZ))
        for k in range(max(1, len(b) - width + 1) if b else 0):
            x = b[k : k + width]
            for p in at.get(x[0], ()):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    items.add(item)
    items.discard(None)
    return w, hit, items


def contamination(text, benchmark):
    w, hit, items = hit_words(text, benchmark)
    return len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit)


def without_hits(text, benchmark):
    """The text without its hit words and what stands between two of them in a row."""
    _, hit, _ = hit_words(text, benchmark)
    if not hit:
        return text
    spans, out, at = [m.span() for m in ALNUM.finditer(text.translate(AZ))], [], 0
    for k in sorted(hit):
        out.append("" if k - 1 in hit else text[at : spans[k][0]])
        at = spans[k][1]
    return "".join([*out, text[at:]])


def substrings(rows, width=50):
    """rows: (doc_id, text); null ids take no part."""
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - width + 1):
            if i is not None:
                x = tuple(w[k : k + width])
                first[x] = min(first.get(x, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def held_out(i):
    return zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2


def jaccard_groups(rows, shingle=3, percent=90):
    """rows: (doc_id, text); the size of each set and the smallest doc_id that links reach (null last)."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(AZ))
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    at = defaultdict(list)
    for k, own in enumerate(sets):
        shared = Counter(j for x in own for j in at[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                root[find(k)] = find(j)
        for x in own:
            at[x].append(k)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        g = find(k)
        least[g] = i if least[g] is None else least[g] if i is None else min(i, least[g])
    return [(i, len(own), least[find(k)]) for k, ((i, _), own) in enumerate(zip(rows, sets))]


def variants(rows, least=7, damage=31, ratio=10, min_count=2):
    """word, form, root, n, n_near, form_n; rows: (doc_id, text)."""
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = w.translate(AZ)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if damage and h % damage == 0 else w
            n[w] += len(w) >= least
    return variants_of({w: k for w, k in n.items() if k >= min_count}, ratio)


def variants_of(n, ratio=10):
    def one(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    left, near, form = defaultdict(set), defaultdict(set), {}
    for w in n:
        for x in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            left[x].add(w)
    for group in left.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one(a, b)}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= ratio * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), k, len(near[w]), n.get(form.get(w))) for w, k in n.items()]


def hard_negatives(rows, anchors, positives=5, negatives=3):
    """rows: (vec_id, label, components), all usable and whole numbers; anchors: ids."""
    rows = sorted({(i, int(label), tuple(map(int, v))) for i, label, v in rows})
    dim, out = max((len(v) for _, _, v in rows), default=0), set()
    q = np.array([list(v) + [0] * (dim - len(v)) for _, _, v in rows], dtype=object)
    for k, (i, label, _) in enumerate(rows):
        if i not in anchors:
            continue
        score = [int(sum(a * b for a, b in zip(x, q[k]))) for x in q]
        same = sorted((-s, j) for s, (j, own, _) in zip(score, rows) if own == label and j != i)[:positives]
        for p, j in same:
            inside = sorted((-s, m) for s, (m, own, _) in zip(score, rows) if own != label and 50 * -p <= 100 * s <= 95 * -p)[:negatives]
            out |= {(i, j, r, m, -p, -s) for r, (s, m) in enumerate(inside, 1)}
    return out
