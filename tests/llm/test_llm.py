"""The training-data operators against plain forms, on the small tables and on odd rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ratelens.llm import decontaminate, license_scan, line_dedup, log_bilinear, pieces, quality_rules, queries, set_join, similar, simhash, substring_dedup, token_files, warc_fixity
from ratelens.llm.common import read_table, stored
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, h string, n int, words int, spans int, hit_words int, component_id int, line_n int"
rng = random.Random(5)
PASSAGE = " ".join(f"w{k}" for k in range(70))
LONG = " ".join(rng.choice(["the", "of", "an", "x%d" % k]) for k in range(30_000))


def odd():
    texts = ["", None, " \t\n", "a", "A b", "Ab c D", PASSAGE, PASSAGE + " tail é", "Head " + PASSAGE + "\nLicensed under CC BY-NC 4.0.\n", LONG, "é日 ▁ \x1c\x85 x\r\n Y", "#*$ a\na\na\n\n", PASSAGE.upper()]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(None, PASSAGE), (None, None), (None, "a"), (3, "a"), (6, PASSAGE), (6, PASSAGE), (6, "other words"), (-4, PASSAGE + " tail é"), (2**62, PASSAGE), (2**62 + 1, "a\nSame line\n")]
    rows += [(100 + k, f"  Same LINE\t\nown {k}") for k in range(12)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = odd()
    return spark.createDataFrame([(i, t, None, None if k % 5 == 0 else "s", None, "x", None, 1, 1, 1, 1, 1, 1) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return stored(read_table(spark, sf_dir, "documents"), "small")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, expected):
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


def test_token_files(spark, docs, none, small, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    marked = docs.unionByName(docs.filter("doc_id = 4").withColumn("text", F.lit("a <|endoftext|>b<|endoftext|><|endoftext|> <|endo")).withColumn("doc_id", F.lit(50).cast("long")))
    for table in (marked, small):
        expected, start = [], 0
        for i, t in sorted(rows_of(table), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
            ids = [*plain.encode(t or "", add_special_tokens=False).ids, token_files.END]
            expected.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
        same(token_files.write_and_digest(table).collect(), expected)
    assert token_files.write_and_digest(none).count() == 0
    token_files.write_tokens(docs.filter("doc_id = 4"), str(tmp_path / "t"))
    assert token_files.read_tokens(spark, str(tmp_path / "t")).first()["ids"] == [*plain.encode("A b", add_special_tokens=False).ids, 2]


def test_chunks_encode_like_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.TOKENIZER)
    tools = [(Tokenizer.from_file(path), token_files.Encoder(path, special)) for special in (True, False)]
    tools[1][0].encode_special_tokens = True
    alphabet = [*"ab é.,'s \n\t\r\x1c\x85\xa0​ 日²Ⅷ5_-!?<|>́", "<|endoftext|>", "'re", "  "]
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        for plain, own in tools:
            assert plain.encode(text, add_special_tokens=False).ids == own([text])[0].tolist(), repr(text)


def test_simple8b_blocks():
    for _ in range(100):
        runs = [np.array([rng.getrandbits(rng.choice([1, 3, 7, 15, 16, 16, 31, 60, 64])) for _ in range(rng.randint(0, 150))], dtype=np.uint64) for _ in range(rng.randint(1, 5))]
        back = token_files.unpack_block(token_files.pack_block(runs))
        assert [x.tolist() for x in back] == [x.tolist() for x in runs]
    assert len(token_files.pack_block([np.ones(120, dtype=np.uint64)])["words"]) == 16  # sixty to a word


def test_quality_rules(docs, none, small):
    for table in (docs, small):
        expected = [(i, *brute.quality(t)) for i, t in rows_of(table)]
        got = quality_rules.judge(table)
        same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect(), expected)
        assert got.filter("base_failed <> (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) OR (kept AND base_failed)").count() == 0
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def above_limit(rows, percent=2, floor=3):
    """Lines above the limit by host; rows: (doc_id, text, source)."""
    docs, hosts = {}, {}
    for i, t, s in rows:
        hosts.setdefault(s or "", set()).add(i)
        for x in (t or "").split("\n"):
            docs.setdefault((s or "", x.strip(brute.WHITE).translate(brute.AZ)), set()).add(i)
    return {k for k, ids in docs.items() if k[1] and len(ids) > floor and 100 * len(ids) > percent * len(hosts[k[0]])}


def test_lines_above_the_limit(docs, none, small):
    for table in (docs, small):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
        above, expected, left = above_limit(rows, floor=1), [], []
        for i, t, s in rows:
            gone = [x for x in (t or "").split("\n") if (s or "", x.strip(brute.WHITE).translate(brute.AZ)) in above]
            lost, n = sum(len(brute.WORD.findall(x)) for x in gone), brute.quality(t)
            kept = not (n[0] < 50 or 100 * n[4] > 50 * n[0]) and n[0] - lost >= 50 and 100 * (n[0] - lost) >= 20 * n[0]
            expected.append((i, lost, kept))
            if kept:
                left.append((i, "\n".join(x for x in t.split("\n") if x not in gone)))
        same(quality_rules.judge(table, floor=1).select("doc_id", "lost_words", "kept").collect(), expected)
        same(rows_of(quality_rules.keep_good(table, floor=1)), left)
        assert any(lost for _, lost, _ in expected)
    assert quality_rules.lines_above(none).count() == 0


def test_depleted_documents(spark):
    common = " ".join(f"c{k}" for k in range(60))
    own = lambda n: " ".join(f"d{n}w{m}" for m in range(60))
    rows = [(k, f"{common}\nown {k}", "hot") for k in range(6)] + [(10 + k, f"{common}\n{own(k)}", "hot") for k in range(3)] + [(10, f"{common}\n{own(0)}", "hot"), (20, f"{common}\nx", "cold"), (21, common, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.judge(table, floor=5).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == {10, 11, 12, 20, 21}
    assert {r["lost_words"] for r in got if r["doc_id"] <= 12} == {60}
    left = {r["doc_id"]: r["text"] for r in quality_rules.keep_good(table, floor=5).collect()}
    assert left == {10: own(0), 11: own(1), 12: own(2), 20: f"{common}\nx", 21: common}
    assert quality_rules.judge(table, floor=9).filter("kept").count() == len(rows)


def test_line_dedup(docs, none, small):
    for table in (docs, small):
        expected = brute.line_dedup(rows_of(table))
        for heavy, keys in ((line_dedup.HEAVY, line_dedup.SHARD_KEYS), (1, 50)):
            kept = line_dedup.drop_common_lines(table, heavy=heavy, shard_keys=keys)
            same(line_dedup.digest(kept).collect(), expected)
    assert line_dedup.drop_common_lines(none).count() == 0
    own = docs.select("*", F.lit(77).alias("line_dropped"), F.lit(5).alias("__hits"), F.lit(6).alias("hit_rid")).withColumn("line_n", F.lit(77))
    kept = line_dedup.drop_common_lines(own)
    assert kept.columns == [*own.columns, "_line_n", "_line_dropped"]
    assert tuple(kept.select("line_n", "line_dropped", "__hits", "hit_rid").distinct().collect()[0]) == (77, 77, 5, 6)
    assert kept.agg(F.sum("_line_dropped")).first()[0] == sum(e[2] for e in brute.line_dedup(rows_of(docs))) > 0
    piped = corpus_pipeline.lines(docs.sparkSession, own, "")
    assert piped.columns == own.columns and {tuple(r) for r in piped.select("line_n", "line_dropped").collect()} == {(77, 77)}


def test_line_index():
    keys = np.random.default_rng(1).integers(0, 2**63, (50_000, 2)).astype(np.uint64)
    counts = np.arange(50_000)
    index = line_dedup.LineIndex.unpack(line_dedup.LineIndex.build(keys, counts, 1000).pack())
    assert sorted(index.slots(keys).tolist()) == list(range(50_000))
    assert (index.count(keys) == np.minimum(counts, 1000)).all()
    assert (index.count(keys + np.uint64(1)) > 0).mean() < 0.001
    assert len(index.words) * 64 < 4 * 50_000


def test_foreign_keys_are_no_heavy_lines():
    random_keys = np.random.default_rng(3)
    keys = random_keys.integers(0, 2**63, (160, 2)).astype(np.uint64)
    index = line_dedup.LineIndex.build(keys, np.full(160, 99), 10, exact=True)
    assert (index.count(keys) == 10).all()
    assert not index.count(random_keys.integers(0, 2**63, (1_000_000, 2)).astype(np.uint64)).any()


def test_own_lines_stay_when_fingerprints_collide(spark):
    common = [b"common %d" % k for k in range(50)]
    index = line_dedup.LineIndex.build(line_dedup._hashes(common, 1), np.full(50, 12), 10)
    own = [b"own %d" % k for k in range(400_000)]
    own = [own[k].decode() for k in np.flatnonzero(index.count(line_dedup._hashes(own, 1)))]
    assert own  # lines that the fingerprint alone takes for common ones
    shared = "\n".join(x.decode() for x in common)
    rows = [(k, shared) for k in range(12)] + [(100 + k, f"{shared}\n{x}") for k, x in enumerate(own)]
    kept = {r["doc_id"]: r for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(kept[100 + k]["text"] == x and kept[100 + k]["line_dropped"] == 50 for k, x in enumerate(own))


def simhash_expected(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    prints = [brute.fingerprint(rows[k][1]) for k in order]
    return [(rows[k][0], f"{p:016x}", rows[order[g]][0]) for k, p, g in zip(order, prints, brute.groups(prints))]


def test_simhash(docs, none, small):
    for table in (docs, small):
        same(simhash.digest(simhash.near_duplicates(table)).collect(), simhash_expected(rows_of(table)))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_one_of_each_group_stays(docs, small):
    for table in (docs, small):
        rows = rows_of(table)
        firsts = {(c, None if c is not None else "null") for _, _, c in simhash_expected(rows)}
        kept = simhash.keep_first(table)
        assert kept.columns == table.columns
        found = rows_of(kept)
        assert {i for i, _ in found} == {c for c, _ in firsts}
        assert len({(i, t) for i, t in found}) == len(found)


def test_links_in_large_buckets(spark):
    base, prints = rng.getrandbits(64), {0, (1 << 64) - 1}
    for _ in range(400):
        x = base
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    values = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in values], "fp long")
    expected = {}
    for x, g in zip(values, brute.groups(values)):
        expected.setdefault(g, set()).add(signed(x))
    for big in (3, simhash.BIG):
        found = {}
        for r in simhash.components(simhash.links(table, big)).collect():
            found.setdefault(r["root"], set()).add(r["node"])
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)


def under_broadcasts(df):
    """The operators below each broadcast of a plan that has run."""
    df.collect()
    lines = [(len(x) - len(x.lstrip(" :+-*")), x) for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    at = [k for k, (_, x) in enumerate(lines) if "BroadcastExchange" in x]
    return ["".join(x for _, x in itertools.takewhile(lambda y, d=lines[k][0]: y[0] > d, lines[k + 1 :])) for k in at]


def test_exploded_rows_are_not_broadcast(spark):
    fps = stored(spark.range(3000).select(F.xxhash64("id").alias("fp")), "fps")
    assert under_broadcasts(simhash.links(fps)) == []


def grams(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_pipeline_drops_similar_texts_only(spark):
    dice, texts = random.Random(8), []
    for _ in range(60):
        words = [f"w{dice.randrange(5000)}" for _ in range(300)]
        for changes in (0, 1, 2, 4, 6, 9, 14, 25):
            copy = list(words)
            for at in dice.sample(range(300), changes):
                copy[at] = f"new{dice.randrange(10**9)}"
            texts.append(" ".join(copy))
    dice.shuffle(texts)
    sets = [grams(t) for t in texts]
    near = {k for k in range(len(texts)) if any(len(sets[k] & s) >= 0.8 * len(sets[k] | s) for s in sets[:k])}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = set(range(len(texts))) - {i for i, _ in rows_of(corpus_pipeline.near_duplicates(spark, table, ""))}
    assert gone == near and len(near) > 200
    # Without the last step some may stay, and none goes that should not; a small table of counts changes nothing.
    assert {i for i, _ in rows_of(similar.keep_first(table, exact=False))} >= set(range(len(texts))) - near
    assert {i for i, _ in rows_of(similar.keep_first(table, buckets=1 << 12))} == set(range(len(texts))) - near


def test_work_follows_the_texts_of_a_group(spark):
    """Thousands of near copies: pairs that are compared are a few for each, not all of the group's."""
    words = [f"w{k}" for k in range(120)]
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit(" ".join(words[:60])), F.lit(" n"), F.col("id"), F.lit(" "), F.lit(" ".join(words[60:]))).alias("text"))
    classes = set_join.classes_of(set_join.describe(rows, set_join.shingle_ranks(rows, 5), 5, 80, with_fp=True))
    lists = stored(set_join.posting_lists(classes, 80), "lists")
    heads = lists.filter("head is not null")
    assert lists.groupBy("key").count().agg(F.max("count")).first()[0] == 6000
    assert heads.select("head", "p.id").distinct().count() <= 2 * 6000
    links = set_join.first_links(rows, classes, lists, 5, 80)
    assert links.select("b").distinct().count() == 5999
    assert [i for i, _ in rows_of(similar.keep_first(rows))] == [0]


BENCH = [(1, PASSAGE[:80]), (2, "cc BY nc"), (3, None), (4, ""), (None, "own"), (2, "cc by NC"), (30, "w40 " * 3 + " ".join(f"w{k}" for k in range(41, 60))), (5, "!!")]


def test_index_is_shuffled_once_at_most(spark, small, sf_dir):
    index = decontaminate.index_shards(small)
    wins = decontaminate.benchmark_windows(read_table(spark, sf_dir, "benchmark"), 10).select("win").distinct()
    packed = decontaminate.window_shards(index, wins).groupBy("shard").agg(F.collect_list("win").alias("asked"))
    joined = decontaminate.met(index, packed)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    assert sum("Exchange" in lines[k - 1] for k in range(1, len(lines)) if "levels" in lines[k]) <= 1


def test_blocks_of_windows_give_the_same(small, spark, sf_dir):
    benchmark = read_table(spark, sf_dir, "benchmark")
    want = decontaminate.digest(decontaminate.find_hits(small, benchmark)).collect()
    same(decontaminate.digest(decontaminate.find_hits(small, benchmark, block=7)).collect(), want)


def test_copies_of_a_row_are_dealt(spark):
    rows = spark.range(700).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one text of seven words in all").alias("text"))
    table, words, model = log_bilinear.train(rows, shard=64)
    got = log_bilinear.scores(table, words, model).collect()
    assert len(got) == 700 and len({r["base_score"] for r in got}) == 1
    rare = log_bilinear.rare_words(table)
    assert rare.filter("rare_known < 0").count() == 0


def test_many_documents_of_each_line(spark):
    """A hundred documents hold each line: what a shard is asked streams past its index, whatever their number."""
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.lit("line "), (F.col("doc_id") % 30) * 10 + k)), "\n")
    rows = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("text", F.concat(lines, F.lit("\nown "), F.col("doc_id")))
    kept = line_dedup.drop_common_lines(rows, heavy=1)
    assert kept.filter("line_dropped <> 10 OR line_n <> 11").count() == 0
    assert kept.filter(F.col("text") != F.concat(F.lit("own "), F.col("doc_id"))).count() == 0
    assert line_dedup.drop_common_lines(rows, min_docs=101, heavy=1).filter("line_dropped > 0").count() == 0


def test_decontamination(spark, docs, none, small, sf_dir):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    named = bench.withColumn("item_id", F.concat(F.lit("item "), F.col("item_id").cast("string")))
    for table, items in ((docs, bench), (docs, named), (small, read_table(spark, sf_dir, "benchmark"))):
        listed = [(r["item_id"], r["text"]) for r in items.collect()]
        rows = rows_of(table)
        expected = [(i, *brute.contamination(t, listed)) for i, t in rows]
        for block in (decontaminate.BLOCK, 7):
            same(decontaminate.digest(decontaminate.find_hits(table, items, block=block)).collect(), expected)
        clean = decontaminate.remove_hits(table, items)
        assert clean.columns == table.columns
        cut = {(i, t): brute.without_hits(t, listed) for i, t in rows}
        same(rows_of(clean), [(i, cut[i, t]) for i, t in rows])
    assert decontaminate.find_hits(none, bench).count() == 0
    assert decontaminate.digest(decontaminate.find_hits(docs, bench.filter("false"))).filter("contaminated").count() == 0
    kept = decontaminate.remove_hits(docs.filter("doc_id = 8"), bench).first()["text"]
    assert "w0 w1" not in kept and kept.startswith("Head ") and "Licensed under" in kept and "BY" not in kept


def test_batches_with_and_without_hits_in_a_task(spark):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    table = spark.createDataFrame([(k, PASSAGE if k % 2 else "own words") for k in range(6)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert {t for _, t in rows_of(decontaminate.remove_hits(table, bench))} == {"", "own words"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fm_index():
    for _ in range(30):
        text = np.array([rng.randint(1, 4) for _ in range(rng.randint(1, 200))])
        assert decontaminate.suffix_array(np.append(text, 0)).tolist() == sorted(range(len(text) + 1), key=lambda k: [*text[k:].tolist(), 0])
        index = decontaminate.FMIndex.unpack(decontaminate.FMIndex.build(text).pack())
        patterns = [[rng.randint(1, 9) for _ in range(rng.randint(1, 4))] for _ in range(40)]
        words = np.array([[0] * (4 - len(p)) + p for p in patterns])
        lo, hi = index.search(words, np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, lo, hi):
            expected = [k for k in range(len(text) - len(p) + 1) if text[k : k + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == expected


def test_substring_dedup(docs, none, small):
    for table in (docs, small):
        expected = brute.substrings(rows_of(table))
        for parts, chunk, part in ((None, substring_dedup.CHUNK, substring_dedup.PART), (3, 100, 2000)):
            same(substring_dedup.digest(substring_dedup.remove_repeats(table, parts=parts, chunk=chunk, part=part)).collect(), expected)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_hash_length_follows_the_input():
    for windows, parts in ((10, 1), (10**8, 48), (10**13, 10**6)):
        bits = 8 * substring_dedup.hash_bytes(windows, parts)
        assert windows**2 / 2 / 2.0**bits / parts < 2.0**-20
    assert substring_dedup._cut(np.array([0x0102030405060708], dtype=np.uint64), np.array([0x1112131415161718], dtype=np.uint64), 10).tolist() == [[8, 7, 6, 5, 4, 3, 2, 1, 0x11, 0x12]]


def test_packed_integers():
    values = np.array([0, 1, 127, 128, 2**14, 2**35, 2**63, 2**64 - 1], dtype=np.uint64)
    assert (substring_dedup.unpack(substring_dedup.pack(values)).view(np.uint64) == values).all()
    assert len(substring_dedup.unpack(b"")) == 0


def segmentations(vocabulary, text, n):
    """Scores of the n best paths of the whole lattice."""
    text = pieces.SPACE + text.replace(pieces.SPACE, pieces.LITERAL).replace(" ", pieces.SPACE) if text else ""
    arcs, best = vocabulary.arcs(text), [[0.0]]
    for j in range(1, len(text) + 1):
        best.append(sorted((b + s for i, _, s in arcs[j] for b in best[i]), reverse=True)[:n])
    return best[-1]


def ids_score(vocabulary, ids):
    return sum(vocabulary.byte_score if i in set(vocabulary.byte_id) else vocabulary.score[i] for i in ids)


def test_n_best_of_a_chunk():
    vocabulary = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    for chunk in ("▁the", "▁hello", "日本", "▁▁", "\n", "x" * 60):
        found = vocabulary.n_best(chunk, 6)
        assert all(b"".join(vocabulary.bytes[i] for i in ids).decode() == chunk.replace("▁", " ") for _, ids in found)
        assert len({tuple(ids) for _, ids in found}) == len(found)
        best = [[0.0]]
        arcs = vocabulary.arcs(chunk)
        for j in range(1, len(chunk) + 1):
            best.append(sorted((b + s for i, _, s in arcs[j] for b in best[i]), reverse=True)[:6])
        assert [s for s, _ in found] == pytest.approx(best[-1])


def test_pieces(docs, none, small):
    for table in (docs, small):
        logs = pieces.piece_logs(table)
        vocabulary = pieces.Pieces(public_tokenizers.path(pieces.MODEL), logs)
        counts = Counter(i for _, t in rows_of(table) for c in vocabulary.split(t or "") for i in vocabulary.longest_match(c))
        total = sum(counts.values()) + len(logs)
        assert np.exp(logs).sum() == pytest.approx(1.0) and logs == pytest.approx(np.array([math.log((counts[i] + 1) / total) for i in range(len(logs))]))
        encoded = pieces.encode_pieces(table, with_ids=True, with_nbest=True, logs=logs)
        texts, found = dict.fromkeys(t or "" for _, t in rows_of(table)), encoded.collect()
        assert len(found) == table.count() and all(r["round_trip"] for r in found)
        # The N best of the whole lattice, not only of its chunks, for every row.
        expected = {t: segmentations(vocabulary, t, 4) for t in texts}
        by_crc = {}
        for r in pieces.decode_pieces(encoded).collect():
            t = r["text"]
            assert r["nbest_scores"] == pytest.approx(expected[t]) and r["best_score"] == r["nbest_scores"][0]
            assert r["nbest_ids"][0] == r["piece_ids"] and len(r["piece_ids"]) == r["n_pieces"] and len({tuple(x) for x in r["nbest_ids"]}) == len(r["nbest_ids"])
            assert [zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in r["nbest_ids"]] == r["nbest_crc32"]
            if len(t) < 20_000:
                assert [ids_score(vocabulary, x) for x in r["nbest_ids"]] == pytest.approx(r["nbest_scores"])
            by_crc.setdefault(r["doc_id"], set()).add(t)
        assert by_crc == {i: {u or "" for j, u in rows_of(table) if j == i} for i, _ in rows_of(table)}
    assert pieces.encode_pieces(none).count() == 0


def test_licenses(spark, docs, none, small):
    for table in (docs, small):
        expected = []
        for i, t in rows_of(table):
            w, at, labels = brute.ALNUM.findall((t or "").translate(brute.AZ)), [], set()
            for phrase, label in license_scan.PHRASES.items():
                p = phrase.split()
                places = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
                at += places
                labels |= {label} if places else set()
            expected.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
        index = license_scan.corpus_index(table)
        counts, total = license_scan.document_counts(table, index)
        assert total == len(expected) and all(counts[i] == sum(w.decode() in set(brute.ALNUM.findall((t or "").translate(brute.AZ))) for _, t in rows_of(table)) for w, i in list(index.vocab.items())[::20])
        found = license_scan.scan_licenses(table, index)
        same(found.drop("labels", "score").collect(), expected)
        plain = [(i, *plain_licenses(index, t)) for i, t in rows_of(table)]
        same([(r["doc_id"], r["labels"], round(r["score"], 9)) for r in found.collect()], plain)
        assert table is docs or any(score for _, _, score in plain)
    assert license_scan.scan_licenses(none).count() == 0


def plain_licenses(index, text):
    """Labels and score of a text by trying every start of every template."""
    words = [index.vocab.get(w.encode(), 0) for w in brute.ALNUM.findall((text or "").translate(brute.AZ))]
    where, labels, score = {}, set(), 0.0
    for k, w in enumerate(words):
        if w:
            where.setdefault(w, []).append(k)
    has = lambda here, p: any(here[k : k + len(p)] == p.tolist() for k in range(len(here) - len(p) + 1))
    for p, label in index.phrases:
        labels |= {label} if has(words, p) else set()
    for k, t in enumerate(index.words):
        anchors = sorted(p for p, x in zip(index.place.tolist(), index.template.tolist()) if x == k)
        starts = sorted(at - p for p in anchors for at in where.get(int(t[p]), ()))
        for start in dict.fromkeys(starts):
            held = sum(any(start <= at - p <= start + index.slack for at in where.get(int(t[p]), ())) for p in anchors)
            here = words[max(0, start - index.slack) : max(0, start + len(t) + 2 * index.slack)]
            if held >= math.ceil(index.share * len(anchors)) and all(has(here, p) for p in index.required[k]) and not any(has(here, p) for p in index.absent[k]):
                labels.add(index.templates[k].label)
                score = max(score, held / len(anchors))
    return ",".join(sorted(labels)), round(score, 9)


def test_license_texts(spark):
    by_label = {t.label: t.text for t in license_scan.TEMPLATES}
    named = by_label["bsd-3-clause"].replace("the copyright holder nor", "Example Corporation of Somewhere nor").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS")
    cases = [
        (by_label["mit-text"], {"mit-text", "mit-grant"}), ("Copyright 2020\n" + by_label["bsd-2-clause"], {"bsd-2-clause", "bsd"}), ("/* " + named.replace("\n", "\n * ") + " */", {"bsd-3-clause", "bsd"}),
        (by_label["isc"], {"isc", "isc-grant"}), (by_label["0bsd"], {"0bsd", "isc-grant"}), (by_label["gpl-2.0"], {"gpl-2.0", "gpl"}), (by_label["gpl-3.0"].replace("software;", "software:"), {"gpl-3.0", "gpl"}),
        (by_label["lgpl-2.1"], {"lgpl-2.1"}), (by_label["agpl-3.0"], {"agpl-3.0"}), (by_label["apache-2.0"], {"apache-2.0", "apache-2.0-notice", "apache"}), ("x y z " * 50 + by_label["zlib"], {"zlib"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc"}), ("source and use of forms", set()), ("permission granted free copy software restriction charge", set()), (by_label["mpl-2.0"] + " own text " * 40 + by_label["unlicense"], {"mpl-2.0", "unlicense"}),
    ]
    noise = [" ".join(rng.choice(["the", "of", "software", "own%d" % k]) for k in range(60)) for _ in range(40)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate([t for t, _ in cases] + noise)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(table).collect()}
    for k, (_, labels) in enumerate(cases):
        assert found[k]["labels"] == ",".join(sorted(labels)), k
    assert found[0]["score"] == 1.0 and 0.6 <= found[2]["score"] <= 1.0 and all(found[k]["labels"] == "" for k in range(len(cases), len(found)))


def test_language_model(docs, none, small):
    for table in (docs, small):
        tokens = [(i, [*brute.WORD.findall((t or "").translate(brute.AZ)), " "]) for i, t in rows_of(table)]
        counts = Counter(x for i, w in tokens if not brute.held_out(i) for x in w)
        n, v = sum(counts.values()), len(counts)
        expected = sorted(((i is not None, i or 0, brute.held_out(i), len(w), sum(counts[x] > 0 for x in w), n), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens)
        # A low limit sends most words through the join.
        for frequent in (log_bilinear.FREQUENT, 50):
            found = log_bilinear.score_texts(table, frequent=frequent, rounds=1).collect()
            got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), r["base_score"]) for r in found)
            assert [k for k, _ in got] == [k for k, _ in expected]
            assert [s for _, s in got] == pytest.approx([s for _, s in expected])
            assert all(r["score"] < 0 for r in found)
    one = {r["doc_id"]: r for r in log_bilinear.score_texts(small).collect()}
    held = [r for r in one.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # Neither partitions nor their order change the result.
    again = {r["doc_id"]: r["score"] for r in log_bilinear.score_texts(small.repartition(7)).collect()}
    assert {i: r["score"] for i, r in one.items()} == pytest.approx(again, rel=1e-5)
    assert log_bilinear.score_texts(none).count() == 0


def plain_score(text, words, counts, model):
    """The score of a text, token by token, with every class's probability worked out."""
    context, target, one, two, bias = model.parts(model.flat.astype(np.float64))
    before = before2 = 0
    total = 0.0
    places = dict(zip(words.hashes.tolist(), range(len(words.hashes))))
    for w in [x.encode() for x in brute.WORD.findall((text or "").translate(brute.AZ))] + [b" "]:
        place = places.get(log_bilinear.xxhash.xxh3_64_intdigest(w), 10**9)
        k = place + 1 if place < words.singles else 1 + words.singles + log_bilinear.ending(w) % words.endings
        logits = (target @ (context[before] * one + context[before2] * two) + bias)[1:]
        total += (logits[k - 1] - np.log(np.exp(logits).sum())) / math.log(10)
        if place >= words.singles:
            same = [x for x in counts if places.get(log_bilinear.xxhash.xxh3_64_intdigest(x), 10**9) >= words.singles and log_bilinear.ending(x) % words.endings == log_bilinear.ending(w) % words.endings]
            total += math.log10((counts[w] + 1) / (sum(counts[x] + 1 for x in same) + 1))
        before, before2 = k, before
    return total


def test_scores_token_by_token(spark, docs):
    texts = [(i, t) for i, t in rows_of(docs) if t != LONG]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    counts = Counter(x.encode() for i, t in texts if not brute.held_out(i) for x in [*brute.WORD.findall((t or "").translate(brute.AZ)), " "])
    for frequent, classes in ((log_bilinear.FREQUENT, 32), (10, 16)):
        trained = log_bilinear.train(table, frequent=frequent, rounds=1, classes=classes, shard=100)
        found = log_bilinear.scores(*trained).select("doc_id", "score").collect()
        expected = sorted(((i is not None, i or 0), plain_score(t, trained[1], counts, trained[2])) for i, t in texts)
        got = sorted(((r[0] is not None, r[0] or 0), r[1]) for r in found)
        assert [k for k, _ in got] == [k for k, _ in expected] and [s for _, s in got] == pytest.approx([s for _, s in expected], rel=1e-4)


def test_model_is_normalised():
    model = log_bilinear.Model(np.array([0.0, 5.0, 3.0, 2.0, 1.0]), 4)
    w = np.random.default_rng(0).integers(1, 5, (3, 5000))
    model.train(w[0], w[1], w[2], 0.05, np.zeros_like(model.flat), np.random.default_rng(0))
    context, target, one, two, bias = model.parts(model.flat)
    for a in range(5):
        norm = model.log_normalisers(a)
        scores = ((context[a] * one + context * two) @ target.T + bias)[:, 1:]
        assert np.exp(scores - norm[:, None]).sum(axis=1) == pytest.approx(np.ones(5), abs=1e-4)


def test_fixity(spark, tmp_path):
    schema = "page_id long, url string, html string, node int, hash int"
    rows = [(k, f"u{k}", "x" * k, 0, 0) for k in range(40)] + [(None, "u", "h", 0, 0), (None, None, None, 0, 0), (7, "u7", "again", 0, 0), (7, "u7", "again", 0, 0), (5000, "f\r\nar", "é\r\n\r\nWARC/1.0\r\n", 0, 0), (-3, "below", "n", 0, 0)]
    one, numbers = spark.createDataFrame(rows, schema), iter(range(99))

    def written(pages):
        path = str(tmp_path / f"warc{next(numbers)}")
        warc_fixity.write_warc(pages, path)
        return warc_fixity.read_warc(spark, path)

    a = written(one.repartition(5))
    body = warc_fixity.read_warc(spark, str(tmp_path / "warc0"), bodies=True)
    assert sorted((r["page_id"] or 0, r["url"], r["body"]) for r in body.collect()) == sorted((i or 0, (u or "").replace("\r\n", " "), h or "") for i, u, h, _, _ in rows)
    assert warc_fixity.audit(a, written(one)).count() == 0
    none = written(one.filter("false"))
    assert warc_fixity.audit(none, none).count() == 0
    other = one.filter("page_id <> 9 OR page_id IS NULL").withColumn("html", F.when(F.col("page_id") == 5000, "e").otherwise(F.col("html"))).unionByName(spark.createDataFrame([(4000, "new", "n", 0, 0), (7, "u7", "again", 0, 0)], schema))
    found = {r["record"]: r for r in warc_fixity.audit(a, written(other)).collect()}
    assert {k: r["status"] for k, r in found.items()} == {9: "missing", 5000: "changed", 4000: "extra", 7: "changed"}
    assert found[9]["start_b"] is None and found[4000]["start_a"] is None and found[4000]["start_b"] >= 0
    assert found[9]["start_a"] == sum(r["bytes"] for r in a.filter("place < 9").collect())
    assert warc_fixity.audit(a, none).count() == a.select("place").distinct().count()


def test_damaged_warc_bytes(spark, tmp_path):
    import gzip

    def record(k, body):
        return f"WARC/1.0\r\nWARC-Type: resource\r\nPage-ID: {k}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()

    parts = [record(1, "one"), record(2, "two"), record(3, "three")]
    broken = [parts[0], parts[1].replace(b"Length: 3", b"Length: 9"), parts[2]]
    for name, members in (("a", parts), ("b", broken)):
        (tmp_path / name / "archive=0").mkdir(parents=True)
        (tmp_path / name / "archive=0" / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    a, b = (warc_fixity.read_warc(spark, str(tmp_path / name)) for name in "ab")
    assert [r["page_id"] for r in a.orderBy("start").collect()] == [1, 2, 3] and [r["page_id"] for r in b.orderBy("start").collect()] == [1, None, 3]
    found = warc_fixity.audit(a, b).collect()
    assert [(r["record"], r["status"], r["start_a"]) for r in found] == [(2, "changed", len(parts[0]))]


def test_foreign_archives(spark, tmp_path):
    """Records without a page id, in many members whose borders are not those of records."""
    import gzip

    def record(k, body):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: u{k}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()

    dice = random.Random(2)
    bodies = [f"body {k} " + "x" * dice.randrange(300) + "\r\n\r\nWARC/1.0\r\n" * (k % 5 == 0) for k in range(80)]
    for replica in "ab":
        (tmp_path / replica).mkdir()
        for name in ("one.warc.gz", "two.warc.gz"):
            parts = [record(k, "altered" if replica == "b" and name[0] == "t" and k == 33 else body) for k, body in enumerate(bodies)]
            whole, cuts = b"".join(parts), sorted(dice.sample(range(1, 9000), 20))
            pieces_ = [whole[p:q] for p, q in zip([0, *cuts], [*cuts, len(whole)])] if replica == "b" else parts
            (tmp_path / replica / name).write_bytes(b"".join(map(gzip.compress, pieces_)))
    a, b = (warc_fixity.read_warc(spark, str(tmp_path / x), bodies=True) for x in "ab")
    assert sorted(r["body"] for r in a.filter("place % 4294967296 < 80").collect()) == sorted(bodies * 2)
    starts = [0]
    for k, body in enumerate(bodies):
        starts.append(starts[-1] + len(record(k, body)))
    found = warc_fixity.audit(a.drop("body"), b.drop("body")).collect()
    assert [(r["status"], r["start_a"], r["record"]) for r in found] == [("changed", starts[33], warc_fixity.foreign_place("x/two.warc.gz", 33))]


def test_pipeline_stages(spark, docs, none, sf_dir):
    for table in (none, docs.withColumn("text", F.coalesce("text", F.lit(None)))):
        kept = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = kept.columns
            kept = stored(stage(spark, kept, sf_dir), name)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert kept.columns == before


def test_pipeline_against_plain_forms(spark, small, sf_dir):
    """Every stage's rows, texts included, on the whole small table."""
    items = [(r["item_id"], r["text"]) for r in read_table(spark, sf_dir, "benchmark").collect()]
    small = stored(small.withColumn("source", F.lit("one host")), "one-host")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in small.collect()]
    assert above_limit(rows)

    def quality(rows):
        above, out = above_limit(rows), []
        for i, t, s in rows:
            n = brute.quality(t)
            left = [x for x in (t or "").split("\n") if (s or "", x.strip(brute.WHITE).translate(brute.AZ)) not in above]
            words = sum(len(brute.WORD.findall(x)) for x in left)
            if n[0] >= 50 and 100 * n[4] <= 50 * n[0] and words >= 50 and 100 * words >= 20 * n[0]:
                out.append((i, "\n".join(left), s))
        return out

    def lines(rows):
        common = {k for k, n in Counter(k for _, t, _ in rows for k in {x.strip(brute.WHITE).translate(brute.AZ) for x in t.split("\n")}).items() if k and n >= 10}
        return [(i, "\n".join(x for x in t.split("\n") if x.strip(brute.WHITE).translate(brute.AZ) not in common), s) for i, t, s in rows]

    def first(rows):
        rows, sets, out = sorted(rows), [], []
        for i, t, s in rows:
            own = grams(t.translate(brute.AZ))
            if not any(100 * len(own & x) >= 80 * len(own | x) for x in sets):
                out.append((i, t, s))
            sets.append(own)
        return out

    stages = [quality, lines, first, lambda rows: [(i, brute.without_hits(t, items), s) for i, t, s in rows]]
    kept, sizes = small, []
    for (name, stage), plain in zip(corpus_pipeline.STAGES, stages):
        kept, rows = stored(stage(spark, kept, sf_dir), name), plain(rows)
        same([(r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in kept.collect()], [(i, t, s, len(t)) for i, t, s in rows])
        sizes.append(len(rows))
    assert len(small.collect()) > sizes[0] > sizes[2] > 0
    encoded = corpus_pipeline.encode(spark, kept, sf_dir)
    same([(r["doc_id"], r["text"]) for r in pieces.decode_pieces(encoded).collect()], [(i, t) for i, t, _ in rows])


def test_every_query_runs(spark, sf_dir):
    assert {n.split("_")[0] for n in queries.QUERIES if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert corpus_pipeline.run(spark, sf_dir).filter("NOT round_trip").count() == 0
