"""How five quality filters interact, from a sparse document-term matrix.

1. Each run of texts becomes one shard of the matrix in compressed row form (row offsets,
   column numbers, counts) over a dictionary of its own; what the other filters need
   (capitals, marks, code points, digest) is measured on the way.
2. All words of the table get ids (one shuffle of the shards' dictionaries, in which a
   word stands at most once a shard), and each shard is told those of its words: its
   columns become global.
3. Row sums are a text's words, stored entries its distinct words. They decide A and B.
4. E: texts meet by SHA-256. The smallest doc_id per digest is found with map-side
   partial results; a row finds out by (digest, doc_id) whether it is that one, so no
   task depends on how often a text stands there.
5. Rows are counted by (part, failed filters): 32 cells a part, from which every order of
   the filters follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shards
from .common import release

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
MARKS = np.zeros(256, bool)
MARKS[list(b"#$%&*|")] = True
CAPITALS = np.zeros(256, bool)
CAPITALS[ord("A"):ord("Z") + 1] = True

ROW = "doc_id array<bigint>, part array<string>, marks array<int>, sha array<binary>, starts array<bigint>, entries bigint, cells binary"
LOCAL = f"shard bigint, cell bigint, n bigint, names binary, data binary, {ROW}"
ROWS = "doc_id bigint, part string, failed int, sha binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def _bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def _counted(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Bytes of each text that belong to a class."""
    return np.diff(np.searchsorted(np.flatnonzero(which[flat]), offsets))


class Shard:
    """Rows of the matrix over local columns, grown run by run."""

    def __init__(self):
        self.words, self.runs, self.bytes = shards.Dictionary(), [], 0

    def add(self, run: pa.RecordBatch) -> None:
        text = pc.fill_null(run.column("text").cast(pa.string()), "")
        n = len(text)
        codes, offsets, words = shards.coded(text)
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
        cells, times = np.unique((row << 32) | codes, return_counts=True)
        del row, codes
        flat, ends = _bytes_of(text)
        chars = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        marks = 4 * (100 * _counted(flat, ends, CAPITALS) > MAX_CAPITALS * chars) + 8 * (_counted(flat, ends, MARKS) > 0)
        view = memoryview(flat)
        sha = [hashlib.sha256(view[a:b]).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        first = self.words.add(words)
        self.bytes += len(flat)
        self.runs.append((
            run.column("doc_id").cast(pa.int64()), pc.fill_null(run.column("part").cast(pa.string()), ""), pa.array(marks, pa.int32()), pa.array(sha, pa.binary()),
            np.diff(np.searchsorted(cells >> 32, np.arange(n + 1))), ((cells & 0xFFFFFFFF) + first).astype(np.uint32), times.astype(np.uint32)))

    def batches(self, shard: int, parts: int) -> Iterator[pa.RecordBatch]:
        words, place = self.words.unify()
        ids, part, marks, sha, sizes, codes, times = zip(*self.runs, strict=True)
        codes, starts = np.concatenate(codes), np.r_[0, np.cumsum(np.concatenate(sizes))]
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        cells, times = _ordered(row, place[codes].astype(np.int64), np.concatenate(times))
        one = {
            "shard": pa.array([shard], pa.int64()), "cell": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "names": pa.nulls(1, pa.binary()), "data": pa.nulls(1, pa.binary()),
            **{name: shards.lists(pa.concat_arrays(x)) for name, x in zip(NAMES, (ids, part, marks, sha), strict=False)},
            "starts": shards.lists(pa.array(starts, pa.int64())), "entries": pa.array([len(cells)], pa.int64()), "cells": pa.array([shards.pack(shards.delta(cells.astype(np.uint32)), times)], pa.binary())}
        yield pa.RecordBatch.from_pydict(one)
        rows = list(shards.sliced(words, parts))
        if rows:
            cell, n, names, data = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(np.full(len(rows), shard)), "cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64()), "names": pa.array(names, pa.binary()), "data": pa.array(data, pa.binary()),
                **{name: pa.nulls(len(rows), one[name].type) for name in NAMES}})


def _ordered(row: np.ndarray, columns: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries with ascending columns in each row."""
    order = np.lexsort((columns, row))
    return columns[order], times[order]


def _local(parts: int):
    """Rows of (doc_id, part, text) -> shards of the matrix over local columns, and slices of their dictionaries."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for run in shards.runs(batches):
            shard.add(run)
            if shard.bytes >= shards.SHARD_BYTES:
                yield from shard.batches(number, parts)
                number, shard = number + 1, Shard()
                release()
        if shard.runs:
            yield from shard.batches(number, parts)
        release()

    return local


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local columns of each shard become ids of the table's words, ascending in each row."""
    for batch in batches:
        for i in range(batch.num_rows):
            shard = batch.slice(i, 1)
            local, times = shards.unpack(shard.column("cells")[0].as_buffer(), shard.column("entries")[0].as_py(), np.uint32, np.uint32)
            ids = shards.by_code(*shards.heard(shard, np.int64))
            starts = shard.column("starts").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            columns, times = _ordered(row, ids[shards.undelta(local)], times)
            cells = pa.array([shards.pack(shards.delta(columns), times)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[shard.column(c) for c in NAMES[:-1]], cells], names=NAMES)
        release()


def matrix(docs: DataFrame, part: Column) -> DataFrame:
    """The document-term matrix in shards of compressed rows, with each row's other measures."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.cast("string").alias("part"), F.col("text").cast("string").alias("text"))
    parts = shards.cells(docs)
    local = shards.settled(rows.mapInArrow(_local(parts), LOCAL), "audit-shards")
    told = shards.mapping(shards.numbered(local.where("cell IS NOT NULL"), parts))
    wide = local.where("cell IS NULL").select("shard", *NAMES).join(told, "shard", "left")
    return wide.drop("shard").mapInArrow(_encoded, ROW)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards -> rows with the filters they fail, but for E."""
    for batch in batches:
        for i in range(batch.num_rows):
            shard = batch.slice(i, 1)
            _, times = shards.unpack(shard.column("cells")[0].as_buffer(), shard.column("entries")[0].as_py(), np.int64, np.uint32)
            starts = shard.column("starts").flatten().to_numpy(zero_copy_only=False)
            sums = np.r_[0, np.cumsum(times, dtype=np.int64)]
            n_words, distinct = np.diff(sums[starts]), np.diff(starts)
            failed = shard.column("marks").flatten().to_numpy(zero_copy_only=False) + (n_words < MIN_WORDS) + 2 * (100 * distinct < MIN_DISTINCT * n_words)
            yield pa.RecordBatch.from_arrays([shard.column("doc_id").flatten(), shard.column("part").flatten(), pa.array(failed, pa.int32()), shard.column("sha").flatten()], names=["doc_id", "part", "failed", "sha"])


def failures(docs: DataFrame, part: Column) -> DataFrame:
    """doc_id, part, failed (bits 1, 2, 4, 8, 16 for A to E) of every row.

    Null text is the empty text, which fails A only; null parts are the empty string. E
    compares doc_ids: rows with the smallest id of a text pass it, all of them where the id
    is repeated; a null id passes it and makes no other row fail. No rows give no rows.
    """
    rows = shards.settled(matrix(docs, part).mapInArrow(_judged, ROWS), "audit-rows")
    first = rows.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["sha", "doc_id"], "left").select("doc_id", "part", (F.col("failed") + F.when(later, 16).otherwise(0)).alias("failed"))


def orders(counts: DataFrame) -> DataFrame:
    """What each filter removes in each order, from (part, failed, n, good, toxic) counts."""
    cell = F.struct("failed", "n", "good", "toxic")
    parts = counts.groupBy("part").agg(F.collect_list(cell).alias("cells"))
    steps = parts.select("part", "cells", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order"))
    steps = steps.select("part", "cells", "filter_order", F.explode(F.array(*[F.lit(i) for i in range(1, len(FILTERS) + 1)])).alias("step"))

    def bits(text: Column) -> Column:
        return sum((F.when(F.contains(text, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))

    steps = steps.withColumn("own", bits(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("past", bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))

    def total(where, value) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(where(c["failed"]), value(c)).otherwise(F.lit(0)).cast("long"))

    own, past = F.col("own"), F.col("past")

    def removed(m):
        return (m.bitwiseAND(own) != 0) & (m.bitwiseAND(past) == 0)

    # by symmetry a row that fails k filters is removed by each in 120 / k of the orders
    def share(c):
        return c["n"] * F.lit(120) / F.bit_count(c["failed"])

    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(lambda m: m.bitwiseAND(own.bitwiseOR(past)) == 0, lambda c: c["n"]).alias("kept"),
        total(removed, lambda c: c["n"]).alias("removed"),
        total(lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(past) != 0), lambda c: c["n"]).alias("redundant"),
        total(lambda m: m == own, lambda c: c["n"]).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda m: m.bitwiseAND(own) != 0, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: Column | None = None) -> DataFrame:
    """One row per part, order of the five filters and step; ``part`` is the source unless given.

    ``docs`` has doc_id, text (and source), ``labels`` doc_id, quality, toxic. A row is good
    (toxic) if any label of its id says so; ids without a label, and null ids, are neither.
    Other columns are ignored, repeated rows count as often as they stand. No rows, no parts.
    """
    rows = failures(docs, part if part is not None else F.col("source"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left")
    counts = rows.groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return orders(counts)
