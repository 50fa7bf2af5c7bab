"""What several operators of this folder need: shared storage and salted joins."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.sources.storage import forget, shared_dir, stored

__all__ = ["bounded", "documents", "file_system", "forget", "fresh_dir", "in_arrow", "salted_join", "shared_dir", "slices", "stored", "unused"]

#: Bytes of a batch that Spark sends to a Python worker (a longer row is a batch of its own), where the session doesn't set them.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` over batches that are bounded by bytes as well as by rows. A worker, which lives on, gives back what a task's batches took."""
    key, most = ARROW_BYTES
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, most)

    def then_released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(then_released, schema)


def release() -> None:
    """Give memory that nothing uses any more back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has been counted to hold at most so many rows; else as it is, for a join that shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, rows: int = 256, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of at most so many rows and about ``limit`` bytes of texts and lists, so that what is unpacked at once stays small."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            sizes += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            sizes += 8 * pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        stop = min(at + rows, max(at + 1, full))
        yield batch.slice(at, stop - at)
        at = stop


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def salted_join(big: DataFrame, small: DataFrame, key: str, salt_by: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """Equi-join in which the rows of a hot key of ``big`` go to ``salts`` tasks.

    ``small`` has one row a key; it is repeated once for each salt.
    """
    big = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(small, [key, "_salt"], how).drop("_salt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def file_system(uri: str):
    """A file system for a URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)
