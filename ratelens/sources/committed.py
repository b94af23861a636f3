"""A sink for results that is whole or not there: tasks write parts, the commit writes the manifest that names them.

``results.write.format("rate_results").option("search_params", "{...}").mode("append").save(path)``. A part that no manifest
names (of a task that was run twice, or of a job that failed and could not clear up) is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ratelens.schemas import RESULT

MANIFEST = "manifest.json"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class _Part(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, params: str):
        self.path, self.params, self.job = path.rstrip("/"), json.loads(params), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        system, folder = _system(self.path)
        name, rows = f"part-{self.job}-{uuid.uuid4().hex}.json", 0
        system.create_dir(folder, recursive=True)
        try:
            with system.open_output_stream(f"{folder}/{name}") as out:
                for batch in iterator:
                    out.write("".join(json.dumps(row, ensure_ascii=False) + "\n" for row in batch.to_pylist()).encode())
                    rows += batch.num_rows
        except BaseException:
            system.delete_file(f"{folder}/{name}")
            raise
        return _Part(name, rows)

    def commit(self, messages: list[_Part | None]) -> None:
        system, folder = _system(self.path)
        parts = [m for m in messages if m is not None]
        told = {"search_params": self.params, "rows": sum(m.rows for m in parts), "parts": sorted(m.name for m in parts)}
        with system.open_output_stream(f"{folder}/_{self.job}.json") as out:
            out.write(json.dumps(told).encode())
        # One step: the manifest is the old one or the new one.
        system.move(f"{folder}/_{self.job}.json", f"{folder}/{MANIFEST}")

    def abort(self, messages: list[_Part | None]) -> None:
        system, folder = _system(self.path)
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if self.job in info.base_name:
                system.delete_file(info.path)


class ResultsSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rate_results"

    def schema(self) -> str:
        return RESULT

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("search_params", "{}"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResultsSink)


def read(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The search parameters and results of the last commit."""
    told = json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])
    if not told["parts"]:
        return told["search_params"], spark.createDataFrame([], RESULT)
    return told["search_params"], spark.read.schema(RESULT).json([f"{path}/{p}" for p in told["parts"]])
