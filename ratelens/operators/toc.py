"""Tables of contents: from a plan to the files that hold its rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.schemas import STRUCTURE
from ratelens.sources.mrf import decode


def may_hold_plan(plan_id: str) -> Column:
    """A cheap test on the raw element, before decoding."""
    return F.lower("raw").contains(plan_id.lower())


def has_plan(plan_id: str) -> Column:
    return F.coalesce(F.exists("reporting_plans", lambda p: F.coalesce(F.lower(p["plan_id"]) == plan_id.lower(), F.lit(False))), F.lit(False))


def matched_structures(raw: DataFrame, plan_id: str) -> DataFrame:
    """Decoded structures of the plan, from raw elements of section ``reporting_structure``."""
    structures = raw.filter((F.col("section") == "reporting_structure") & may_hold_plan(plan_id))
    return decode(structures, STRUCTURE, "file_seq", "pos").filter(has_plan(plan_id))


def resolve_toc(raw: DataFrame, plan_id: str) -> DataFrame:
    """url, url_pos: the plan's distinct locations in the order in which they first stand."""
    files = matched_structures(raw, plan_id).select("file_seq", "pos", F.posexplode("in_network_files").alias("file_pos", "f"))
    located = files.select(F.col("f.location").alias("url"), F.struct("file_seq", "pos", "file_pos").alias("at")).filter(F.coalesce("url", F.lit("")) != "")
    first = located.groupBy("url").agg(F.min("at").alias("at"))
    return first.select("url", F.col("at.file_seq").alias("toc_seq"), F.col("at.pos").alias("structure_pos"), F.col("at.file_pos").alias("file_pos"))


def plan_index(raw: DataFrame) -> DataFrame:
    """plan_id (lower case), url, toc_seq, structure_pos, file_pos: the files of every plan, each where it first stands.

    A structure's plans and files are both lists, so its pairs are made only after each list's repeats are gone."""
    structures = decode(raw.filter("section = 'reporting_structure'"), STRUCTURE, "file_seq", "pos")
    plans = F.array_distinct(F.transform("reporting_plans", lambda p: F.lower(p["plan_id"])))
    listed = structures.select("file_seq", "pos", F.explode(F.filter(plans, lambda p: p.isNotNull())).alias("plan_id"), "in_network_files")
    located = listed.select("plan_id", "file_seq", "pos", F.posexplode("in_network_files").alias("file_pos", "f")).filter(F.coalesce("f.location", F.lit("")) != "")
    first = located.groupBy("plan_id", F.col("f.location").alias("url")).agg(F.min(F.struct("file_seq", "pos", "file_pos")).alias("at"))
    return first.select("plan_id", "url", F.col("at.file_seq").alias("toc_seq"), F.col("at.pos").alias("structure_pos"), F.col("at.file_pos").alias("file_pos"))


def resolve_plans(index: DataFrame, plans: DataFrame) -> DataFrame:
    """plan_id as given, url and its place, for every plan of a table (plan_id); plans that repeat, but for case, count once each."""
    asked = plans.select("plan_id").distinct().select(F.col("plan_id").alias("asked"), F.lower("plan_id").alias("plan_id"))
    return asked.join(index, "plan_id").select(F.col("asked").alias("plan_id"), "url", "toc_seq", "structure_pos", "file_pos")


def entity_name(raw: DataFrame) -> DataFrame:
    """One row: the reporting entity of the last file that names one, the last name in it."""
    name = F.from_json(F.concat(F.lit('{"v":'), "raw", F.lit("}")), "v STRING")["v"]
    named = raw.filter("section = 'reporting_entity_name'").select(F.struct("file_seq", "pos").alias("at"), F.coalesce(name, F.lit("")).alias("name"))
    return named.agg(F.coalesce(F.max_by("name", "at"), F.lit("")).alias("entity_name"))


def toc_stats(raw: DataFrame, plan_id: str) -> DataFrame:
    """One row: structures seen, those of the plan, and the entity's name."""
    seen = raw.filter("section = 'reporting_structure' AND pos >= 0").agg(F.count("*").alias("structures"))
    return seen.crossJoin(matched_structures(raw, plan_id).agg(F.count("*").alias("matched_structures"))).crossJoin(entity_name(raw))
