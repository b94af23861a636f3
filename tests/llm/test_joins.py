"""Hard negatives, spelling variants and the Jaccard join against plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.llm import hard_negatives, queries, set_join, spelling
from ratelens.llm.common import read_table
from tests.llm import brute
from tests.llm.test_llm import docs, none, rows_of, same, small  # noqa: F401

rng = random.Random(13)


def test_jaccard_join(docs, none, small):  # noqa: F811
    for table in (docs, small):
        same(set_join.join_components(table).collect(), brute.jaccard_groups(rows_of(table)))
    assert set_join.join_components(none).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_sets_near_the_threshold(spark, percent):
    texts = ["a b c d e f g h i", "a b c d e f g h i j", "a b", "A  b", "a b c", "b c"]
    for _ in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 90))]
        for changes in (0, 1, 1, 2, 3, 5, 8):
            copy = list(words)
            for at in rng.sample(range(len(words)), min(changes, len(words))):
                copy[at : at + rng.randrange(2)] = [f"w{rng.randrange(400)}"] * rng.randrange(3)
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    # A chain over many texts, each linked with the next ones only.
    for buckets in (1 << 12, set_join.BUCKETS):
        same(set_join.join_components(table, percent=percent, buckets=buckets).collect(), brute.jaccard_groups(rows, percent=percent))


def test_chains_and_two_large_groups(spark):
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base[k : k + 100]) for k in range(60)]
    # Two groups whose members are all near each other, joined by one text in the middle.
    one, two = [f"u{k}" for k in range(100)], [f"u{k}" for k in range(96)] + [f"v{k}" for k in range(4)]
    texts += [" ".join([*one, f"x{k}"]) for k in range(40)] + [" ".join([*two, f"y{k}"]) for k in range(40)] + [" ".join(f"u{k}" for k in range(98))]
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    same(set_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute.jaccard_groups(rows))


def test_spelling_variants(docs, none, small):  # noqa: F811
    for table in (docs, small):
        rows = rows_of(table)
        same(spelling.group_variants(spelling.word_counts(table, damage=31)).collect(), brute.variants(rows))
        same(spelling.group_variants(spelling.word_counts(table, min_length=4, min_count=1)).collect(), brute.variants(rows, 4, None, min_count=1))
    assert spelling.group_variants(spelling.word_counts(none)).count() == 0


@pytest.mark.parametrize("big,places,qmax", [(2, 4, None), (8, 1 << 16, 7), (spelling.BIG, 64, 5)])
def test_variants_of_alike_words(spark, big, places, qmax):
    words = {"x" * 40: 3, "x" * 41: 40, "x" * 42: 500, "y" + "x" * 40: 5, "aaaaaaa": 1, "aaaaaaaa": 20, "aaaaaaaaa": 300, "\u00e9t\u00ffaaaa": 4, "\u00e9taaaa\u00e9": 5}
    for _ in range(300):
        w = "".join(rng.choices("ab\u00e9", k=rng.randint(7, 9)))
        words[w] = rng.choice([1, 2, 10, 25, 300])
    for stem in ("consider", "nation", "interest"):
        for k in range(60):
            words[stem + "".join(rng.choices("abcde", k=3))] = rng.choice([1, 10, 100])
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    same(spelling.group_variants(table, big=big, places=places, qmax=qmax).collect(), brute.variants_of(words))


def test_an_edit_leaves_as_many_grams_alone_as_the_bound_says():
    frequent = {"".join(rng.choices("ab", k=k)).encode(): 9 for k in (2, 3, 4) for _ in range(9)}
    for _ in range(3000):
        a = "".join(rng.choices("abc", k=rng.randint(7, 10))).encode()
        k, kind = rng.randrange(len(a)), rng.randrange(3)
        b = a[:k] + (b"", b"c", b"c" + a[k : k + 1])[kind] + a[k + 1 :]
        one, two = spelling.grams(a, frequent), spelling.grams(b, frequent)
        alike = sum((p, g) in two or (p + len(b) - len(a), g) in two for p, g in one)
        assert alike >= max(len(one) - spelling.affected(a, one), len(two) - spelling.affected(b, two))
        assert a == b or len(b) < 7 or set(spelling.list_keys(a, frequent)) & set(spelling.list_keys(b, frequent))


def _vectors(spark, rows):
    schema = "vec_id long, label int, embedding array<float>, q string, cell int, aid long"
    return spark.createDataFrame([(i, label, v, "x", 1, 1) for i, label, v in rows], schema)


def _mined(table, rows, anchors, **more):
    whole = hard_negatives.quantised(table)
    got = [tuple(r) for r in hard_negatives.mine(whole, whole.filter(F.col("vec_id").isin(anchors)), **more).collect()]
    usable = [(i, label, [np.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    assert len(set(got)) == len(got)
    assert set(got) == brute.hard_negatives(usable, set(anchors))
    return got


def test_hard_negatives(spark):
    nan, inf = float("nan"), float("inf")
    centre = [[rng.gauss(0, 1) for _ in range(9)] for _ in range(6)]
    rows = [(k, rng.randrange(3), [x + rng.gauss(0, rng.choice([0.05, 0.5])) for x in centre[rng.randrange(6)]]) for k in range(400)]
    rows += [(500 + k, k % 3, centre[0]) for k in range(90)]  # one vector very often: ties
    rows += [(1, 1, [nan] * 9), (2, None, centre[1]), (3, 1, None), (4, 1, [None] * 9), (5, 1, [inf] * 9), (None, 1, centre[2]), (6, 2, []), (7, 0, [1.0]), (600, 1, [0.0] * 9), (601, 2, [0.0] * 9), (602, 1, [-x for x in centre[3]])]
    rows += [rows[8], rows[8], (8, 0, centre[4]), (8, 0, centre[5]), (500, 0, centre[0])]
    table = _vectors(spark, rows).repartition(5)
    anchors = [*range(0, 400, 9), 6, 7, 500, 501, 600, 602]
    for more in ({}, {"shard_rows": 40, "block": 3}, {"centres": 1}, {"shard_rows": 30, "centres": 20}):
        assert _mined(table, rows, anchors, **more)
    assert _mined(table.filter("vec_id < 0"), [], [0]) == []
    large = [(k, k % 2, [x * 2.0 ** rng.randrange(12, 18) for x in centre[k % 6]]) for k in range(60)]
    assert _mined(_vectors(spark, large), large, [0, 7, 31])
    with pytest.raises(Exception, match="does not fit a long"):
        _mined(_vectors(spark, [(0, 0, [3e38]), (1, 0, [3e38])]), [], [0])


def test_hard_negatives_of_the_table(spark, sf_dir):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [np.floor(256 * x) for x in r["embedding"]]) for r in read_table(spark, sf_dir, "embeddings").collect()]
    got = [tuple(r) for r in queries.op11_hard_negatives(spark, sf_dir).collect()]
    assert set(got) == brute.hard_negatives(rows, {i for i, _, _ in rows if i % 50 == 0}) and len(got) == len(set(got)) > 50


def test_parity_maps_never_say_more_than_sets_differ():
    rng = np.random.default_rng(5)
    for n in (0, 1, 511, 1023, 1024, 1025, 2050, 20_000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for k in (0, 1, 7, n // 20):
            other = np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)]))
            x, y = set_join.parity_map(base), set_join.parity_map(other)
            assert len(x) * 8 >= max(512, len(base) // 2) and set_join.map_distance(x, x) == 0
            assert set_join.map_distance(x, y) == set_join.map_distance(y, x) <= len(np.setxor1d(base, other))
    # Maps of different lengths are folded, and long sets without a common shingle are told apart.
    a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (4090, 4200))
    assert len(set_join.parity_map(a)) < len(set_join.parity_map(b))
    assert set_join.map_distance(set_join.parity_map(a), set_join.parity_map(np.concatenate([a, b[:160]]))) <= 160
    assert set_join.map_distance(set_join.parity_map(a), set_join.parity_map(b)) > 0.11 * len(a)


def test_folded_maps_never_say_more_than_sets_differ(spark):
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 3, 300, 1024, 3000, 20_000)]
    sets = [*base, *(np.unique(np.concatenate([x[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for x in base for k in (1, 40))]
    table = spark.createDataFrame([(k, bytearray(set_join.parity_map(x))) for k, x in enumerate(sets)], "id long, map binary")
    wide = {r["id"]: np.array(r["wide"], dtype=np.int64) for r in set_join.folded(table).collect()}
    distance = lambda a, b: int(np.bitwise_count((wide[a] ^ wide[b]).view(np.uint64)).sum())
    assert all(distance(a, b) <= len(np.setxor1d(x, y)) for a, x in enumerate(sets) for b, y in enumerate(sets))
    assert distance(2, 3) > 150
    sizes = spark.createDataFrame([(wide[a].tolist(), wide[b].tolist(), len(sets[a]), len(sets[b])) for a, b in ((2, 2), (2, 6 + 4), (3, 6 + 6), (2, 3))], "x array<long>, y array<long>, a long, b long")
    assert [r[0] for r in sizes.select(set_join.maps_allow("x", "y", F.col("a"), F.col("b"), 80)).collect()] == [True, True, True, False]
