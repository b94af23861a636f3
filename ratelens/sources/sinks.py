"""Sinks: sections as lines, landed tables, and saved results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.operators import search
from ratelens.schemas import PARAMS, RAW, RESULT, RESULT_COLUMNS


_OWN: list[str] = []


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share, ``spark.checkpoint.dir``; in local mode, where all is one
    machine, a temporary folder if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base and not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="ratelens-shared-"))
    return f"{(base or _OWN[0]).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def split_sections(raw: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """Raw elements as JSON lines, gzipped, a folder for each section."""
    raw.write.option("maxRecordsPerFile", max_records).option("compression", "gzip").option("ignoreNullFields", "false").partitionBy("section").json(path)


def write_lines(raw: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """Elements as gzipped line files, one to a line and nothing else, in folders by file and section. The names of the
    files stand in ``names`` beside the folders. Rows of a folder are brought together first, so that it gets few files."""
    # A line break inside an element can only stand between its tokens.
    rows = raw.filter(F.col("raw").isNotNull()).select("file_seq", "section", F.regexp_replace("raw", r"[\r\n]+", " ").alias("value"))
    rows = rows.repartition("file_seq", "section", F.pmod(F.xxhash64("value"), F.lit(16)))
    rows.write.option("maxRecordsPerFile", max_records).option("compression", "gzip").partitionBy("file_seq", "section").text(f"{path}/lines")
    raw.groupBy("file_seq").agg(F.min("source_file").alias("source_file")).write.json(f"{path}/names")


def stage(raw: DataFrame) -> DataFrame:
    """The elements, written once to the shared folder by section: files are read once however often these are."""
    path = work_path(raw.sparkSession, "elements")
    raw.write.partitionBy("section").parquet(path)
    return raw.sparkSession.read.schema(RAW).parquet(path).select(*raw.columns)


#: Folders of landed rates: one a file up to so many files, then several files share one.
FILE_PARTS = 10_000


def land(raw: DataFrame, path: str, partitions: int | None = None, landing: str | None = None) -> None:
    """Normalised tables in Parquet: members by number with a bloom filter on it, items in folders by file, and postings,
    which say for each number where items list it themselves.

    A search then prunes members and postings by number, and items by the files that either of them names. Elements
    are dealt once, before decoding, by file; adaptive execution puts small files' elements together in a task, each
    file's folder getting one file, and splits those of a large file over as many tasks as their bytes need. With ``landing``, the tables stand in a folder of that name
    within each table of ``path``, which has one for each landing."""
    spark = raw.sparkSession
    folder = lambda table: f"{path}/{table}" + (f"/landing={landing}" if landing else "")
    members = search.read_provider_references(raw).select("file_seq", "provider_group_id", F.explode("provider_groups").alias("g"))
    members = members.select("file_seq", "provider_group_id", F.explode("g.npi").alias("npi"), F.col("g.tin").alias("tin"))
    _by_number(members, folder("members"))
    file_part = F.pmod("file_seq", F.lit(FILE_PARTS)).cast("int")
    dealt = raw.filter("section = 'in_network'").withColumn("file_part", file_part)
    dealt = dealt.hint("rebalance", *([partitions] if partitions else []), "file_part")
    items = search.read_in_network(dealt).select("*", file_part.alias("file_part")).sortWithinPartitions("file_part", "file_seq", "pos")
    items.write.partitionBy("file_part").parquet(folder("items"))
    # Only the numbers are read of what was written.
    items = spark.read.schema(items.schema).parquet(folder("items"))
    # A rate without groups gives null in these arrays.
    lists = F.flatten(F.transform("negotiated_rates", lambda r: F.coalesce(r["provider_groups"]["npi"], F.array().cast("array<array<bigint>>"))))
    numbers = F.array_distinct(F.flatten(F.transform(F.coalesce(lists, F.array().cast("array<array<bigint>>")), lambda n: F.coalesce(n, F.array().cast("array<bigint>")))))
    _by_number(items.select("file_part", "file_seq", "pos", F.explode(numbers).alias("npi")), folder("postings"))


def _by_number(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("npi").sortWithinPartitions("npi").write.option("parquet.bloom.filter.enabled#npi", "true").parquet(path)


def landed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (file_seq, provider_group_id, npi, tin), items and postings (npi, file_part, file_seq, pos) of landed tables."""
    members, items, postings = (spark.read.parquet(f"{path}/{t}") for t in ("members", "items", "postings"))
    return members, items, postings


def search_landed(spark: SparkSession, path: str, npis: search.Targets) -> DataFrame:
    """The search on landed tables. The filter on numbers reaches the scans of members and postings and their bloom
    filters; of items only the folders of files with a match are read, and of those only items with a posting are
    looked through for inline listings."""
    return search_tables(*landed(spark, path), npis)


def search_tables(members: DataFrame, items: DataFrame, postings: DataFrame, npis: search.Targets) -> DataFrame:
    """The search on members, items and postings of the same files."""
    providers = search.only_targets(members.filter(F.col("provider_group_id").isNotNull()), npis).select("file_seq", "provider_group_id", "npi", "tin")
    # At most FILE_PARTS small rows, whatever the input.
    by_reference = F.broadcast(providers.select(F.pmod("file_seq", F.lit(FILE_PARTS)).cast("int").alias("file_part")).distinct())
    return search.search_matched(providers, listed_items(items, postings, npis), npis, items.join(by_reference, "file_part", "left_semi"))


def listed_items(items: DataFrame, postings: DataFrame, npis: search.Targets) -> DataFrame:
    """The items that list a target themselves, by the postings; folders of other files are not read."""
    places = search.only_targets(postings, npis).select("file_part", "file_seq", "pos").distinct()
    parts = F.broadcast(places.select("file_part").distinct())  # at most FILE_PARTS
    return items.join(parts, "file_part", "left_semi").join(places, ["file_part", "file_seq", "pos"], "left_semi")


def kept(results: DataFrame) -> DataFrame:
    """The results, written once to the shared folder: what is made of them several times is searched for once."""
    path = work_path(results.sparkSession, "found")
    results.write.parquet(path)
    return results.sparkSession.read.schema(results.schema).parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines in the output order; null arrays stay, empty ones too."""
    results.select(*RESULT_COLUMNS).write.option("ignoreNullFields", "false").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).json(path)


def write_output(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Results of any size with their parameters: one line of JSON in ``search_params``, lines in ``results``. A search
    that the summary is made of too should be ``kept`` first, or it runs for each of them."""
    params = summary.select(_params(summary).alias("p")).select("p.*")
    params.write.option("ignoreNullFields", "false").json(f"{path}/search_params")
    write_results(results, f"{path}/results")


def read_output(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parameters (one row) and results of ``write_output``."""
    params = spark.read.schema(PARAMS.removeprefix("STRUCT<").removesuffix(">").replace(": ", " ")).json(f"{path}/search_params")
    return params, read_results(spark, f"{path}/results")


def _params(summary: DataFrame) -> Column:
    return F.struct("npis", "searched_files", "matched_files", "duration_seconds").cast(PARAMS.replace(": ", ":"))


def envelope(results: DataFrame, summary: DataFrame) -> DataFrame:
    """One row of JSON with parameters and results, for a result that fits a row (a file for one reader); others go
    to ``write_output``."""
    listed = results.agg(F.coalesce(F.collect_list(F.struct(*RESULT_COLUMNS)), F.array()).alias("results"))
    return summary.crossJoin(listed).select(F.to_json(F.struct(_params(summary).alias("search_params"), "results"), {"ignoreNullFields": "false"}).alias("json"))
