"""Whole searches: from files to results, and from a plan to results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.operators import search, toc
from ratelens.schemas import RESULT_COLUMNS
from ratelens.sources import blocks, matching, mrf, sinks
from ratelens.sources.files import input_union


#: A file of more stored bytes is cut on all cores; a smaller one is a task of its own.
LARGE = 512 << 20


def search_files(files: DataFrame, npis: search.Targets, single_pass: bool = False, large: int = LARGE, block: int = blocks.BLOCK) -> DataFrame:
    """All prices of the targets in the files of a table (file_seq, source_file, maybe length).

    Every file is scanned once, in a task of its own that lets through only elements that can match (a file whose
    rates come before its references is read twice); these few are staged, and the search joins what is staged.
    Files whose ``length`` is above ``large`` are inflated into blocks, which all cores cut and filter. A table of
    more than ``matching.MOST_TARGETS`` numbers is joined after the scan. ``single_pass`` limits the result to
    ``search.single_pass_files``; then all references are staged, as it counts them."""
    listed = matching.few_enough(npis)
    few = listed is not None and len(listed) <= search.LISTED
    parts, small = [], files
    if "length" in files.columns:
        small, huge = files.filter(F.coalesce(F.col("length") <= large, F.lit(True))), files.filter(F.col("length") > large)
        if not huge.isEmpty():
            raw = blocks.read_split(huge, size=block)
            parts.append(search.prefilter_raw(raw, listed) if few and not single_pass else raw)
    if not parts or not small.isEmpty():
        parts.append(sinks.stage(mrf.read_elements(small) if listed is None else matching.read_matching(small, listed, all_references=single_pass)))
    raw = reduce(DataFrame.unionByName, parts)
    only = search.single_pass_files(raw, npis) if single_pass else None
    wanted = listed if few else npis if isinstance(npis, DataFrame) else listed
    inline = search.read_in_network(search.holding(raw, listed)) if few else None
    return search.search_rates(search.read_provider_references(raw), search.read_in_network(raw), wanted, only, inline)


def plan_files(tables_of_contents: DataFrame, plan_id: str) -> DataFrame:
    """file_seq, source_file: the files of a plan, in the order in which tables of contents (file_seq, source_file) list them."""
    urls = toc.resolve_toc(mrf.read_elements(tables_of_contents, ("reporting_structure",)), plan_id)
    # A plan's files are as many as one table of contents names for it; they are numbered in their order.
    place = F.row_number().over(Window.orderBy("toc_seq", "structure_pos", "file_pos")) - 1
    return urls.select(place.cast("int").alias("file_seq"), F.col("url").alias("source_file"))


def plans_files(tables_of_contents: DataFrame, plans: DataFrame) -> DataFrame:
    """plan_id, file_seq, source_file: the files of every plan of a table (plan_id), numbered for each plan by itself."""
    urls = toc.resolve_plans(toc.plan_index(mrf.read_elements(tables_of_contents, ("reporting_structure",))), plans)
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("toc_seq", "structure_pos", "file_pos")) - 1
    return urls.select("plan_id", place.cast("int").alias("file_seq"), F.col("url").alias("source_file"))


def search_plans(tables_of_contents: DataFrame, plans: DataFrame, npis: search.Targets) -> DataFrame:
    """plan_id and all prices of the targets in each plan's files. A file of several plans is read once."""
    spark, path = tables_of_contents.sparkSession, sinks.work_path(tables_of_contents.sparkSession, "plans-files")
    plans_files(tables_of_contents, plans).write.parquet(path)
    listed = spark.read.parquet(path)
    files = listed.select("source_file").distinct().select(F.xxhash64("source_file").alias("pos"), F.col("source_file").alias("url"))
    found = search_files(input_union(files).withColumn("file_seq", F.col("file_seq").cast("int")), npis)
    return found.drop("file_seq").join(listed, "source_file").select("plan_id", "file_seq", *RESULT_COLUMNS)


def search_plan(tables_of_contents: DataFrame, plan_id: str, npis: search.Targets) -> DataFrame:
    """All prices of the targets in the files of a plan. The plan's file list is staged, so it is resolved once."""
    spark, path = tables_of_contents.sparkSession, sinks.work_path(tables_of_contents.sparkSession, "plan-files")
    plan_files(tables_of_contents, plan_id).write.parquet(path)
    return search_files(spark.read.parquet(path), npis)
