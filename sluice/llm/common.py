"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

SLICE_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts the lineage, survives lost executors."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_hint(df: DataFrame) -> int:
    """Catalyst's estimate of the input's bytes; used for partition counts only, never for results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def release() -> None:
    """Hand freed memory of this worker back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def crc(column: str) -> Column:
    """crc32 of the column's text form; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    run = np.cumsum(sizes.astype(np.int64)) // limit
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(sizes)], strict=True):
        yield batch.slice(int(a), int(b - a))


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of A-Z lower-cased texts.

    Returns one code per word, the words' offsets per text (one more than texts), and the
    distinct words that the codes point to. Null is the empty text.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    ends = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.r_[0, np.cumsum(full)]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), before[ends - ends[0]], coded.dictionary
