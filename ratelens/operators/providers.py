"""Provider registry: enrichment, missing numbers, and search by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions.text import provider_profile


def profiles(registry: DataFrame) -> DataFrame:
    return registry.select(*provider_profile({c: F.col(c) for c in ("number", "enumeration_type", "basic", "addresses", "taxonomies")}))


def lookup_providers(npis: DataFrame, registry: DataFrame) -> DataFrame:
    """The profile of every asked number (pos, npi), with nulls where the registry has none."""
    return npis.select("pos", "npi").join(profiles(registry), "npi", "left")


def missing_providers(npis: DataFrame, registry: DataFrame) -> DataFrame:
    return npis.select("pos", "npi").join(registry.select(F.col("number").try_cast("long").alias("npi")), "npi", "left_anti")


def search_by_name(registry: DataFrame, first: str, last: str, state: str = "", limit: int = 20) -> DataFrame:
    """Up to ``limit`` individuals of that name, by number; ``state`` looks at all their addresses."""
    same = lambda c, v: F.lower(F.trim(c)) == v.strip().lower()
    found = registry.filter((F.col("enumeration_type") == "NPI-1") & same("basic.last_name", last) & same("basic.first_name", first))
    if state:
        found = found.filter(F.exists("addresses", lambda a: F.coalesce(F.upper(a["state"]) == state.upper(), F.lit(False))))
    return profiles(found).orderBy("npi").limit(limit)
