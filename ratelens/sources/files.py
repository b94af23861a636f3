"""Other sources: lists of files, sizes, sections as lines, and the registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.schemas import REGISTRY


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, url: the lines of a text file, trimmed; blank ones and comments are skipped, repeats stay."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return lines.select("pos", F.regexp_replace("line", r"^\s+|\s+$", "").alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


#: Positions of a list that are numbered together.
BLOCK = 1 << 16


def input_union(*lists: DataFrame) -> DataFrame:
    """file_seq, source_file: lists (pos, url) one after the other, numbered from 0; nothing is deduplicated.

    Rows are counted by blocks of positions first, so that each block can be numbered by itself; only the
    blocks' counts, one row for 65,536 positions, are summed in one place."""
    tagged = reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("list"), F.col("pos").cast("long").alias("pos"), "url") for k, x in enumerate(lists)])
    tagged = tagged.withColumn("block", F.floor(F.col("pos") / BLOCK))
    before = Window.orderBy("list", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = tagged.groupBy("list", "block").agg(F.count("*").alias("n")).select("list", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("list", "block").orderBy("pos", "url"))
    return tagged.withColumn("place", place).join(blocks, ["list", "block"]).select((F.col("base") + F.col("place") - 1).alias("file_seq"), F.col("url").alias("source_file"))


def file_catalog(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length of all files there; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Raw elements of a folder that ``split_sections`` wrote."""
    rows = spark.read.schema("file_seq INT, source_file STRING, section_ord INT, pos BIGINT, raw STRING, section STRING").json(path)
    return rows.select("file_seq", "source_file", "section", "section_ord", "pos", "raw")


def read_lines(spark: SparkSession, paths: list[str], section: str, file_seq: int = 0, source_file: str | None = None) -> DataFrame:
    """Elements of plain line files, one to a line, as raw elements of one file: they share group ids, whatever
    number of line files they were split into."""
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    return lines.select(
        F.lit(file_seq).alias("file_seq"), F.lit(source_file or paths[0]).alias("source_file"), F.lit(section).alias("section"), F.lit(0).alias("section_ord"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("raw")
    )


def read_line_folders(spark: SparkSession, path: str) -> DataFrame:
    """Raw elements of what ``write_lines`` wrote: line files in folders by file and section, with their files' names."""
    lines = spark.read.schema("value STRING, file_seq INT, section STRING").text(f"{path}/lines").filter(F.trim("value") != "")
    lines = lines.select("file_seq", "section", F.lit(0).alias("section_ord"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("raw"))
    names = spark.read.schema("file_seq INT, source_file STRING").json(f"{path}/names")
    return lines.join(names, "file_seq", "left").select("file_seq", "source_file", "section", "section_ord", "pos", "raw")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).json(path)
