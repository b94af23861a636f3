"""Summaries of a search, and the merging of saved searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ratelens.schemas import ITEM, REFERENCE
from ratelens.sources.mrf import parsed


def search_summary(results: DataFrame, files: DataFrame, npis: list[int], seconds: float = 0.0) -> DataFrame:
    """One row: the numbers as given, files searched, files with a result, rates, and the caller's duration."""
    found = results.agg(F.count_distinct("file_seq").alias("matched_files"), F.count("*").alias("rates"))
    searched = files.agg(F.count("*").alias("searched_files"))
    given = F.array(*[F.lit(int(n)).cast("long") for n in npis]) if npis else F.array().cast("array<bigint>")
    return searched.crossJoin(found).select(given.alias("npis"), "searched_files", "matched_files", "rates", F.lit(float(seconds)).alias("duration_seconds"))


def file_counters(raw: DataFrame) -> DataFrame:
    """file_seq, section, elements, malformed: what each file holds, and how much of it does not decode. A section
    that is empty counts zero."""
    # Each element is parsed once: the struct is bound before both tests.
    fits = lambda schema: F.transform(F.array(parsed(schema)), lambda x: x.isNotNull() & x["_bad"].isNull())[0]
    good = F.when(F.col("section") == "in_network", fits(ITEM)).otherwise(fits(REFERENCE))
    there = F.col("pos") >= 0
    return raw.groupBy("file_seq", "section").agg(F.count_if(there).alias("elements"), F.count_if(there & ~good).alias("malformed"))


def observed(raw: DataFrame, name: str = "elements") -> tuple[DataFrame, Observation]:
    """``raw`` with running totals of its sections, which can be read once an action over it has ended."""
    seen = Observation(name)
    count = lambda s: F.count_if((F.col("section") == s) & (F.col("pos") >= 0))
    return raw.observe(seen, count("provider_references").alias("refs_scanned"), count("in_network").alias("codes_scanned")), seen


def rates_found(results: DataFrame) -> DataFrame:
    """Rates of each file with any."""
    return results.groupBy("file_seq").agg(F.count("*").alias("rates"))


def npi_matches(providers: DataFrame) -> DataFrame:
    """Distinct matched groups of each file."""
    return providers.groupBy("file_seq").agg(F.count_distinct("provider_group_id").alias("groups"))


def merge_outputs(params: DataFrame) -> DataFrame:
    """One row of search parameters from those of several runs (run, npis, searched_files, matched_files, duration_seconds).

    Files add up, the longest duration counts, and the numbers are those of the first run that has any. The
    results themselves are a union."""
    numbers = F.min(F.when(F.size("npis") > 0, F.struct("run", "npis")))
    return params.agg(numbers["npis"].alias("npis"), F.sum("searched_files").alias("searched_files"), F.sum("matched_files").alias("matched_files"), F.max("duration_seconds").alias("duration_seconds"))
