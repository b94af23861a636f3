"""Landing files again and again: a manifest says which landed rows are in force.

Each version of the manifest has a row for every file: its digest, its size, the order and the size of its sections,
and the landing that holds its rows. A file whose digest is known is not read again; a changed one is landed anew, and
the rows of its former landing are in force in former versions only. A version counts once all its rows are there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.operators import search
from ratelens.sources import mrf, sinks

MANIFEST = "file_seq INT, source_file STRING, digest STRING, length BIGINT, refs_at INT, rates_at INT, n_references BIGINT, n_items BIGINT, landing STRING, files BIGINT, version INT"


def digests(files: DataFrame) -> DataFrame:
    """file_seq, source_file, digest, length of the files as they are stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for path in batch.column("source_file").to_pylist():
                h, n = hashlib.sha256(), 0
                with mrf.opened(path) as stream:
                    while data := stream.read(1 << 20):
                        h.update(data)
                        n += len(data)
                found.append(h.hexdigest())
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("file_seq"), batch.column("source_file"), pa.array(found, pa.string()), pa.array(sizes, pa.int64())], ["file_seq", "source_file", "digest", "length"])

    return mrf.dealt(files).mapInArrow(run, "file_seq int, source_file string, digest string, length long")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last whole one if none is named; no rows where nothing was landed."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    whole = rows.groupBy("version").agg(F.count("*").alias("n"), F.max("files").alias("files")).filter("n = files")
    if version is None:
        version = whole.agg(F.max("version")).first()[0]
    return rows.filter(F.col("version") == F.lit(version)).join(whole.select("version"), "version", "left_semi").select(*[c.split()[0] for c in MANIFEST.split(", ")])


def land_files(files: DataFrame, path: str, partitions: int | None = None) -> int:
    """Land the files of a table (file_seq, source_file) as the next version, and return its number. Only files whose
    place, name or bytes are new are read; files that are not listed are not in the new version."""
    spark = files.sparkSession
    known = manifest(spark, path)
    at = sinks.work_path(spark, "digests")
    digests(files).write.parquet(at)
    found = spark.read.parquet(at)
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    keys = ["file_seq", "source_file", "digest", "length"]
    same = known.drop("files", "version").join(found, keys, "left_semi")
    new = found.join(known, keys, "left_anti")
    landing = f"l{uuid.uuid4().hex}"
    raw = sinks.stage(mrf.read_elements(new.select("file_seq", "source_file", "length")))
    sinks.land(raw, path, partitions, landing=landing)
    of = lambda s: F.col("section") == s
    told = raw.groupBy("file_seq").agg(
        F.min(F.when(of("provider_references"), F.col("section_ord"))).alias("refs_at"), F.min(F.when(of("in_network"), F.col("section_ord"))).alias("rates_at"),
        F.count_if(of("provider_references") & (F.col("pos") >= 0)).alias("n_references"), F.count_if(of("in_network") & (F.col("pos") >= 0)).alias("n_items"),
    )
    none = {"n_references": 0, "n_items": 0}
    rows = same.unionByName(new.join(told, "file_seq", "left").fillna(none).withColumn("landing", F.lit(landing)))
    rows.withColumn("files", F.lit(found.count())).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/manifest")
    return version


def search_files(spark: SparkSession, path: str, npis: search.Targets, version: int | None = None) -> DataFrame:
    """The search on the files of a version."""
    rows = manifest(spark, path, version)
    if rows.isEmpty():
        raise ValueError(f"nothing is landed in {path}")
    # Folders of other landings are not read, and of a landing only the files that are in force.
    in_force = rows.select("file_seq", "landing")
    names = F.broadcast(in_force.select("landing").distinct())  # a row for each time that files were landed
    tables = [t.join(names, "landing", "left_semi").join(in_force, ["file_seq", "landing"], "left_semi") for t in sinks.landed(spark, path)]
    return sinks.search_tables(*tables, npis)
