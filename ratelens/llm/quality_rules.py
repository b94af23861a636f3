"""Quality rules with DataFrame functions only: per-text counts, and the frequency of lines across documents.

Lines are normalised (stripped, A-Z lower-cased) and hashed, and the distinct documents of each (host, line)
are counted; the host is the document's source. A line is above the limit if more than ``max_percent`` of its
host's documents hold it, and more than ``floor`` documents: it is removed from every document of that host.
A document is depleted, and rejected, if fewer than ``min_words`` of its words are left, or less than
``min_left`` percent of them. Nothing collects a host or a line's documents: counts are combined before the
shuffle, and the joins on hosts and lines are salted.

Defined results: null text has no words and fails the base rules; a null source is a host of its own; rows
with the same doc_id count as one document; a document without lines above the limit keeps its text to the
byte, null included; an empty table gives an empty result; other columns are carried, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import LOWER_AZ, SPACES, UPPER_AZ, row_key

_WORDS = r"[^\x20\x09-\x0D]+"
SALTS = 16


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    Windows are sorted as one long each: hash bits above, position below. Equal windows are then neighbours;
    their words are compared, so a shared hash prefix alone counts for nothing.
    """

    def same(w: Column, a: Column, b: Column, mask: Column) -> Column:
        p, q = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
        equal = (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))
        return F.when(a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(mask)) == 0, equal).otherwise(F.lit(False))

    def windows(w: Column, mask: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.size(w) - 2)
        return F.array_sort(F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

    def repeats(w: Column, s: Column, mask: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce((i > 0) & same(w, F.get(s, i - 1), x, mask), F.lit(False)) | F.coalesce(same(w, x, F.get(s, i + 1), mask), F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x.bitwiseAND(mask)))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.size(words) + F.lit(2))).cast("int")) - 1
    many = let(mask, lambda m: let(windows(words, m), lambda s: let(repeats(words, s, m), covered)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(many)


def text_counts() -> Column:
    """A struct of ``text``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed.

    One expression in which words and lines are bound once, so that no rewrite of a plan can repeat them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def failed(c: Column) -> Column:
        return c.withField("base_failed", (c["n_words"] < 50) | (c["n_repeat_words"] * 100 > c["n_words"] * 50))

    return let(let(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)), counts), failed)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER_AZ, LOWER_AZ)


def _rid() -> Column:
    """Tells rows apart that differ in doc_id, text or host."""
    return F.xxhash64(row_key(), F.coalesce(F.col("source").cast("string"), F.lit("")))


def _line_rows(docs: DataFrame) -> DataFrame:
    """A row for each place of a line with a word in each document: host, hash, words, and the place."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.filter(F.transform(F.split(text, "\n", -1), _key), lambda x: x != "")
    # The row key is bound once a document; outside the array it would be hashed again for every line.
    rows = let(_rid(), lambda k: F.transform(key, lambda x, i: F.struct(k.alias("rid"), i.alias("place"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(_WORDS)).cast("long").alias("words"))))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.explode(rows).alias("line"))
    return lines.select("doc_id", "host", "line.*", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"))


def lines_above(docs: DataFrame, max_percent: int = 2, floor: int = 3) -> DataFrame:
    """host, h: the hashes of the lines above the limit of their host."""
    counts = _line_rows(docs).groupBy("host", "h").agg(F.count_distinct("doc").alias("n")).filter(F.col("n") > floor)
    host, doc = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    sizes = docs.select(host.alias("host"), doc.alias("doc")).groupBy("host").agg(F.count_distinct("doc").alias("size"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = counts.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(sizes, ["host", "salt"])
    return both.filter(F.col("n") * 100 > F.col("size") * max_percent).select("host", "h")


def line_losses(docs: DataFrame, max_percent: int = 2, floor: int = 3) -> DataFrame:
    """doc_id, rid, lost_words, lost_lines: for documents that lose lines, the words in these and their hashes."""
    above = lines_above(docs, max_percent, floor).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = _line_rows(docs).withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(above, ["host", "h", "salt"])
    # Equal rows send the same places, so a set has each of them once.
    places = hit.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("place", "h", "words")).alias("x"))
    lost_words = F.aggregate("x", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    return places.select("doc_id", "rid", lost_words.alias("lost_words"), F.array_distinct(F.transform("x", lambda p: p["h"])).alias("lost_lines"))


def depleted(n_words: Column, lost_words: Column, min_words: int, min_left: int) -> Column:
    left = n_words - lost_words
    return (left < min_words) | (left * 100 < n_words * min_left)


def judge(docs: DataFrame, max_percent: int = 2, floor: int = 3, min_words: int = 50, min_left: int = 20) -> DataFrame:
    """doc_id, the counts of ``text_counts``, lost_words and kept of every row."""
    base = docs.select("doc_id", _rid().alias("rid"), text_counts().alias("c")).select("doc_id", "rid", "c.*")
    lost = line_losses(docs, max_percent, floor).select(F.col("doc_id").alias("lost_id"), F.col("rid").alias("lost_rid"), "lost_words")
    both = base.join(lost, base["doc_id"].cast("long").eqNullSafe(lost["lost_id"]) & (base["rid"] == lost["lost_rid"]), "left").drop("lost_id", "lost_rid", "rid")
    judged = both.withColumn("lost_words", F.coalesce("lost_words", F.lit(0).cast("long")))
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted(F.col("n_words"), F.col("lost_words"), min_words, min_left))


def keep_good(docs: DataFrame, max_percent: int = 2, floor: int = 3, min_words: int = 50, min_left: int = 20) -> DataFrame:
    """The rows of ``docs`` that pass, without their lines above the limit."""
    # The rows that pass are generated, not filtered: a filter would be pushed down and count all texts again.
    passed = F.explode(F.filter(F.array(text_counts()), lambda c: ~c["base_failed"]))
    counted = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), _rid().alias("rid"), passed.alias("c")).select("row", "id", "rid", "c.n_words")
    lost = line_losses(docs, max_percent, floor).withColumnsRenamed({"doc_id": "lost_id", "rid": "lost_rid"})
    joined = counted.join(lost, counted["id"].eqNullSafe(lost["lost_id"]) & (counted["rid"] == lost["lost_rid"]), "left")
    kept = joined.filter(F.coalesce(~depleted(F.col("n_words"), F.col("lost_words"), min_words, min_left), F.lit(True)))
    lines = F.split(F.col("row")["text"].cast("string"), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x: ~F.array_contains("lost_lines", F.xxhash64(_key(x))) | (_key(x) == "")), "\n")
    text = F.when(F.col("lost_lines").isNull(), F.col("row")["text"].cast("string")).otherwise(left)
    return kept.select(*[text.cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
