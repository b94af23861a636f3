"""One query for each operator, over its whole table; ``SQL`` has the DuckDB form where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm import decontaminate, hard_negatives, license_scan, line_dedup, log_bilinear, pieces, quality_rules, set_join, simhash, spelling, substring_dedup, token_files, warc_fixity
from ratelens.llm.common import read_table, shared_dir
from ratelens.llm.oracles import SQL  # noqa: F401


def op1_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_digest(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op3_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score_texts(read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents")))


def op5_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(read_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read_table(spark, sf_dir, "documents")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op7_license_scan`` that SQL can express."""
    return op7_license_scan(spark, sf_dir).drop("labels", "score")


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}" for _ in range(2))
    warc_fixity.write_warc(read_table(spark, sf_dir, "pages"), one)
    warc_fixity.damaged_copy(spark, one, two)
    return warc_fixity.audit(warc_fixity.read_warc(spark, one), warc_fixity.read_warc(spark, two))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_hits(docs, read_table(spark, sf_dir, "benchmark")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.drop_common_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(read_table(spark, sf_dir, "embeddings").withColumn("label", moved))
    return hard_negatives.mine(rows, rows.filter("vec_id % 50 = 0"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(read_table(spark, sf_dir, "documents"), damage=31))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join_components(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simple8b_token_files, op2_quality_rules, op3_log_bilinear, op4_substring_dedup, op5_sentencepiece_nbest, op6_simhash, op7_license_scan, op8_warc_fixity, op9_decontaminate, op10_line_dedup, op11_hard_negatives, op12_spelling_variants, op13_jaccard_join, license_phrases)}
