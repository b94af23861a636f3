"""Landed rates by the group that they refer to, in buckets: searches for large tables of numbers join them where they are.

A rate is a row for each of its references, bucketed and sorted by file and group, and so are members. A search joins
numbers to members, which is the smaller side, and deals what matches by file and group; rates are not dealt again.
Inline listings go the way of the postings. Bucketed tables are known to the session's catalog by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.operators import search
from ratelens.sources import sinks

KEYS = ["file_seq", "group_key"]


def group_key(group: Column) -> Column:
    """A whole number for a group id: buckets by floating point numbers are not used in joins. Both zeros are one."""
    return F.xxhash64(group + F.lit(0.0))


def bucket_landed(spark: SparkSession, path: str, name: str, buckets: int = 512) -> None:
    """The tables ``name_members`` and ``name_rates`` of what ``sinks.land`` wrote to ``path``; they stand in ``path`` too."""
    members, items, _ = sinks.landed(spark, path)
    named = members.filter(F.col("provider_group_id").isNotNull()).withColumn("group_key", group_key(F.col("provider_group_id")))
    rates = search.rates(items.filter(F.size("negotiated_rates") > 0))
    asked = rates.select(*rates.columns, F.explode("rate.provider_references").alias("provider_group_id"))
    asked = asked.withColumn("rate", F.struct("rate.negotiated_prices")).withColumn("group_key", group_key(F.col("provider_group_id")))
    for table, rows in (("members", named), ("rates", asked)):
        # Dealt as the buckets are, so that each bucket is one file.
        rows.repartition(buckets, *KEYS).write.mode("overwrite").bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", f"{path}/bucketed_{table}").saveAsTable(f"{name}_{table}")


def search_bucketed(spark: SparkSession, path: str, name: str, npis: search.Targets) -> DataFrame:
    """The search of landed tables on their buckets."""
    members, rates = spark.table(f"{name}_members"), spark.table(f"{name}_rates")
    providers = search.only_targets(members, npis).select(*KEYS, F.col("provider_group_id").alias("matched"), "npi", "tin")
    # Equal hashes are nearly always equal ids; the ids decide. As two comparisons this is no further key of the join.
    same = (F.col("provider_group_id") <= F.col("matched")) & (F.col("provider_group_id") >= F.col("matched"))
    joined = rates.join(providers, KEYS).filter(same).drop("provider_group_id", "matched", "group_key")
    _, items, postings = sinks.landed(spark, path)
    inline = search.by_inline_group(search.rates(sinks.listed_items(items, postings, npis)), npis).withColumn("rate", F.struct("rate.negotiated_prices"))
    return search.project_results(joined.unionByName(inline.select(*joined.columns)))
