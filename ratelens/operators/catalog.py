"""Profiles of file lists: vendors, regions, sizes, shards, and the state of the files themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.operators import summary
from ratelens.sources import sinks
from ratelens.sources.mrf import SECTIONS, Counted, dealt, elements, inflated, opened, read_elements


def label_distribution(labels: DataFrame, label: str) -> DataFrame:
    """One row: the labels in alphabetical order, with counts unless one label covers all; blank ones count for the total only."""
    counted = labels.groupBy(F.coalesce(label, F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    entry = F.when(F.col("n") == F.col("total"), F.col("label")).otherwise(F.concat("label", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    totals = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return counted.crossJoin(totals).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("label") != "", entry))), ", ").alias("distribution"))


def size_stats(files: DataFrame, size: str = "length") -> DataFrame:
    """One row over known sizes (above zero): total, whole average, smallest, largest, and how many of how many are known."""
    known = F.when(F.col(size) > 0, F.col(size))
    return files.agg(
        F.coalesce(F.sum(known), F.lit(0)).alias("total_bytes"),
        F.expr(f"sum(if({size} > 0, {size}, null)) div count(if({size} > 0, {size}, null))").alias("average_bytes"),
        F.min(known).alias("min_bytes"), F.max(known).alias("max_bytes"), F.count(known).alias("known"), F.count("*").alias("files"),
    )


def assign_shards(files: DataFrame, n: int) -> DataFrame:
    """File i goes to shard i mod n, which no plan change can move; empty shards do not exist."""
    return files.withColumn("shard", F.pmod("file_seq", F.lit(n)).cast("int"))


def known_size(size: Column) -> Column:
    return F.coalesce(size, F.lit(0)) > 0


def validate_files(files: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """file_seq, source_file, ok, reason, elements, bytes: whether each file is a whole JSON object.

    A file is read to its end: gzip members with their checksums, brackets, and that nothing but white space
    follows. ``bytes`` is what was read of the file as it is stored; where ``files`` has a ``length`` above zero, both
    must agree."""

    def check(path: str, length: int | None) -> tuple[bool, str, int, int]:
        n, counted = 0, None
        try:
            with opened(path) as stream:
                counted = Counted(stream)
                for row in elements(inflated(counted), sections):
                    n += row[2] >= 0
            if length and counted.n != length:
                return False, f"read {counted.n} of {length} bytes", n, counted.n
        except Exception as e:  # what is wrong with the file is the answer
            return False, str(e) or type(e).__name__, n, counted.n if counted else 0
        return True, "", n, counted.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [check(*x) for x in zip(batch.column("source_file").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            kinds = {"ok": pa.bool_(), "reason": pa.string(), "elements": pa.int64(), "bytes": pa.int64()}
            yield pa.RecordBatch.from_arrays([batch.column("file_seq"), batch.column("source_file"), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds.values()))], ["file_seq", "source_file", *kinds])

    return dealt(files).mapInArrow(run, "file_seq int, source_file string, ok boolean, reason string, elements long, bytes long")


def audit_files(files: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """file_seq, section, elements, malformed of every whole file, and a row with section null and the reason for every
    other. An element is malformed if it does not fit its schema."""
    checked = validate_files(files, sections)
    path = sinks.work_path(files.sparkSession, "checked")
    checked.write.parquet(path)
    checked = files.sparkSession.read.schema(checked.schema).parquet(path)
    whole = files.join(checked.filter("ok").select("file_seq"), "file_seq", "left_semi")
    counted = summary.file_counters(read_elements(whole, sections)).withColumn("reason", F.lit(""))
    broken = checked.filter("not ok").select("file_seq", F.lit(None).cast("string").alias("section"), "elements", F.lit(None).cast("long").alias("malformed"), "reason")
    return counted.select("file_seq", "section", "elements", "malformed", "reason").unionByName(broken)
