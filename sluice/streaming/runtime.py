"""Reading the event table as a stream and draining a query to a shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENTS
from ..session import shared_dir
from ..sources.adapters import events_to_transfers, table

# rows of a slice that are worth a file of their own
FILE_ROWS = 50_000


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def sliced_events(spark: SparkSession, folder: str, work: str, slices: int = 4) -> DataFrame:
    """The event table cut by id into slices that arrive one after another, a batch each.

    A slice is written by several tasks, one file for each remainder of the id, and a batch
    takes as many files. If a remainder is missing somewhere, all slices are one file each.
    """
    events = table(spark, folder, "events")
    low, high, n = events.agg(F.coalesce(F.min("event_id"), F.lit(0)), F.coalesce(F.max("event_id"), F.lit(0)), F.count(F.lit(1))).first()
    bounds = [low + (high - low + 1) * i // slices for i in range(slices + 1)]
    files = max(1, min(spark.sparkContext.defaultParallelism, n // (slices * FILE_ROWS)))
    if files > 1:
        at = sum((F.when(F.col("event_id") >= b, 1).otherwise(0) for b in bounds[1:-1]), F.lit(0))
        found = events.where("event_id IS NOT NULL").select(at.alias("i"), F.pmod("event_id", F.lit(files)).alias("r")).distinct().count()
        files = files if found == files * slices else 1
    for i in range(slices):
        part = events.where(F.col("event_id").between(bounds[i], bounds[i + 1] - 1))
        part = part.coalesce(1) if files == 1 else part.repartitionById(files, F.pmod("event_id", F.lit(files)).cast("int"))
        part.write.mode("append").parquet(f"{work}/events")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(f"{work}/events")


def sliced_transfers(spark: SparkSession, folder: str, work: str, slices: int = 4) -> DataFrame:
    return events_to_transfers(sliced_events(spark, folder, work, slices), F.lit(population(spark, folder)))


def population(spark: SparkSession, folder: str) -> int:
    """One number, known before the stream starts."""
    return table(spark, folder, "events").agg(F.max("user_id") + 1).first()[0]


def transfer_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    return events_to_transfers(event_stream(spark, folder, files_per_trigger), F.lit(population(spark, folder)))


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process everything available once; offsets and state live under ``folder``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if each is None:
        query = writer.format("parquet").option("path", f"{folder}/data").start()
    else:
        query = writer.foreachBatch(each).start()
    query.awaitTermination()


def batch_writer(folder: str, name: str = "data", prepare: Callable[[DataFrame, int], DataFrame] | None = None):
    """foreachBatch sink that rewrites its own batch folder, so a retried batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        rows = df if prepare is None else prepare(df, batch)
        rows.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/{name}/b={batch}")

    return write


def latest_per_key(spark: SparkSession, folder: str, keys: list[str], name: str = "data") -> DataFrame:
    """Last state of every key in an update-mode table."""
    rows = spark.read.parquet(f"{folder}/{name}").drop("b")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[f"r.{c}" for c in rest if c != "batch"])
