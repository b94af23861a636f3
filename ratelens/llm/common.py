"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte unchanged.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: ASCII that is neither digit nor letter becomes a space; A-Z becomes a-z; bytes over 0x7F stay.
ALNUM = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SPACES = " \t\n\x0b\x0c\r"
UPPER_AZ = "".join(map(chr, range(65, 91)))
LOWER_AZ = UPPER_AZ.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; in local mode, where all is one
    machine, a new folder if it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="ratelens-shared-"))
    return _OWN[0]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    Later stages may read it at any time, so it is left there, for the folder's owner to delete with the job."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores in front as keep them apart from ``columns`` (and from each other)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key() -> Column:
    """Tells rows apart that share a doc_id but not their text; rows equal in both are the same document."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("text").cast("string"))


def bounded_batches(spark: SparkSession) -> None:
    """Rows reach Python in batches of at most 4 MB (or one row), unless the session sets a limit of its own.

    Spark reads this setting when a plan starts, which may be after an operator returns; so it stays as it is set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub("[^0-9]", "", spark.conf.get(key)) or 0) >= 64 << 20:  # the default
        spark.conf.set(key, "4m")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``rid`` of a document table, whatever other columns it has."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", row_key())


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of text, so that memory in a task stays bounded; a longer text is a piece of its own."""
    for batch in batches:
        sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(batch.column(text)).to_pylist()], dtype=np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
