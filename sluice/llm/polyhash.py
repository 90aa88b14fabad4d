"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of bytes b0, b1, ... is the sum of (b_i + 1) * B^i modulo a prime, for two
primes, together with the length. Fingerprints of pieces combine: fp(xy) = fp(x) +
B^len(x) * fp(y), so the pieces of a huge text are hashed by different tasks and summed.
Texts with equal fingerprints are then compared chunk by chunk with one text of their
group; a text that differs (a collision) forms a group of its own with its likes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved

CHUNK = 1 << 16
#: texts of more bytes are cut into pieces of this size, which are hashed apart
SPLIT = 16 << 20
COMPARE = 1 << 20
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 741103597)
FINGERPRINT = "doc_id bigint, n_bytes bigint, h1 bigint, h2 bigint, text_sha256 string"
KEY = ["n_bytes", "h1", "h2"]


class Polynomial:
    """Hash of bytes modulo one prime, chunk by chunk."""

    def __init__(self, base: int, prime: int, chunk: int = CHUNK):
        self.base, self.prime, self.chunk = base, prime, chunk
        powers = np.ones(1, np.uint64)
        while len(powers) < chunk:  # doubling: B^(n+i) = B^n * B^i
            powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), prime)) % np.uint64(prime)])
        self.powers = powers[:chunk]
        self.step = pow(base, chunk, prime)

    def shift(self, value: int, by: int) -> int:
        """``value`` moved behind ``by`` bytes."""
        return value * pow(self.base, by, self.prime) % self.prime

    def combine(self, left: int, left_bytes: int, right: int) -> int:
        return (left + self.shift(right, left_bytes)) % self.prime

    def of(self, data: np.ndarray) -> int:
        """``data``: one more than each byte, as uint64; a chunk's sum stays under 2^56."""
        total, move = 0, 1
        for at in range(0, len(data), self.chunk):
            piece = data[at:at + self.chunk]
            total = (total + int(np.dot(piece, self.powers[:len(piece)])) % self.prime * move) % self.prime
            move = move * self.step % self.prime
        return total


def _hashers() -> list[Polynomial]:
    return [Polynomial(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


def _widened(raw: pa.Buffer | bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    polys = _hashers()
    for batch in batches:
        ids, sizes, hashes, digests = batch.column(0), [], ([], []), []
        for value in batch.column(1):
            raw = value.as_buffer()
            data = _widened(raw) if len(raw) else np.zeros(0, np.uint64)
            sizes.append(len(raw))
            for out, poly in zip(hashes, polys, strict=True):
                out.append(poly.of(data))
            digests.append(hashlib.sha256(raw).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(hashes[0], pa.int64()), pa.array(hashes[1], pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_bytes", "h1", "h2", "text_sha256"],
        )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    polys = _hashers()
    for batch in batches:
        at = batch.column(3).to_pylist()
        shifted = ([], [])
        for start, value in zip(at, batch.column(4), strict=True):
            data = _widened(value.as_buffer())
            for out, poly in zip(shifted, polys, strict=True):
                out.append(poly.shift(poly.of(data), start))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(4)], pa.array(shifted[0], pa.int64()), pa.array(shifted[1], pa.int64())],
            names=["doc_id", "text_sha256", "n_bytes", "at", "h1", "h2"],
        )


def fingerprints(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, h1, h2, text_sha256 of every row; null is the empty text."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    small = raw.where(F.octet_length("raw") <= split).mapInArrow(_whole, FINGERPRINT)
    huge = raw.where(F.octet_length("raw") > split).select(
        "doc_id", F.sha2("raw", 256).alias("text_sha256"), F.octet_length("raw").cast("long").alias("n_bytes"),
        F.explode(F.expr(f"sequence(0L, octet_length(raw) - 1L, {split}L)")).alias("at"), "raw",
    ).select("doc_id", "text_sha256", "n_bytes", "at", F.expr(f"substring(raw, cast(at + 1 as int), {split})").alias("piece"))
    parts = huge.repartition("text_sha256", "at").mapInArrow(_pieces, "doc_id bigint, text_sha256 string, n_bytes bigint, at bigint, h1 bigint, h2 bigint")
    # repeated rows add up to a multiple of one row's sum
    sums = parts.groupBy("doc_id", "text_sha256", "n_bytes").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"), F.sum((F.col("at") == 0).cast("long")).alias("k"))
    joined = sums.select(
        "doc_id", "n_bytes", F.expr(f"(s1 div k) % {PRIMES[0]}L").alias("h1"), F.expr(f"(s2 div k) % {PRIMES[1]}L").alias("h2"), "text_sha256",
        F.explode(F.expr("sequence(1L, k)")).alias("__copy"),
    ).drop("__copy")
    return small.unionByName(joined)


def shared_chunks(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Texts whose fingerprint occurs more than once, cut into chunks; ``__first`` marks one text of each group."""
    tops = saved(prints.groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n"), F.max(F.struct("doc_id", "text_sha256")).alias("__top")).where("__n > 1"), "dedup-tops")
    shared = prints.join(tops, KEY).select("doc_id", "text_sha256", *KEY, (F.struct("doc_id", "text_sha256").eqNullSafe(F.col("__top"))).alias("__first")).distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce("text", F.lit("")).cast("binary").alias("__raw"))
    text = text.withColumn("__sha", F.sha2("__raw", 256))
    members = text.join(shared, (F.col("__sha") == F.col("text_sha256")) & F.col("__id").eqNullSafe(F.col("doc_id")))
    starts = F.explode(F.expr(f"sequence(0L, greatest(octet_length(__raw) - 1L, 0L), {COMPARE}L)")).alias("__at")
    chunks = members.select("doc_id", "text_sha256", *KEY, "__first", "__raw", starts).select(
        "doc_id", "text_sha256", *KEY, "__first", "__at", F.expr(f"substring(__raw, cast(__at + 1 as int), {COMPARE})").alias("__chunk"))
    return chunks


def _differing(chunks: DataFrame) -> DataFrame:
    """Texts of which a chunk differs from the same chunk of their group's first text."""
    firsts = chunks.where("__first").groupBy(*KEY, "__at").agg(F.first("__chunk").alias("__want"))
    met = chunks.where("NOT __first").join(firsts, [*KEY, "__at"])
    return met.where("__chunk <> __want").select(F.col("doc_id").alias("__d"), F.col("text_sha256").alias("__t"), F.lit(True).alias("__odd")).distinct()


def classes(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Of equal texts the row with the largest doc_id is kept; null ids come last and are
    kept only where a group has no other, keep_id is then null. Of rows that repeat that
    doc_id and text one is kept. Null and empty texts are one group.
    """
    prints = saved(fingerprints(docs, split).withColumn("__uid", F.monotonically_increasing_id()), "dedup-prints")
    odd = saved(_differing(shared_chunks(docs, prints)), "dedup-collisions")
    rows = prints.join(odd, (F.col("text_sha256") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left")
    rows = rows.withColumn("__own", F.when(F.col("__odd"), F.col("text_sha256")).otherwise(F.lit(""))).drop("__d", "__t", "__odd")
    # written, so that the join has a plain exchange on either side and a hot group's rows are split
    groups = saved(rows.groupBy(*KEY, "__own").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "__uid")).alias("__top")), "dedup-groups")
    return rows.join(groups, [*KEY, "__own"]).select(
        "doc_id", F.col("__top.doc_id").alias("keep_id"), "group_size", (F.col("__uid") == F.col("__top.__uid")).alias("kept"), "text_sha256", "n_bytes",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs``, columns unchanged; rows that repeat id and text leave the first by their other columns."""
    # one key for the join and the window, so that texts are shuffled once for both
    key = lambda sha: F.concat_ws("/", sha, F.col("doc_id").cast("long").cast("string")).alias("__key")
    keep = classes(docs).where("kept").select(key(F.col("text_sha256")))
    rows = docs.select("*", key(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))).join(keep, "__key", "left_semi")
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind] or [F.lit(0)]
    place = F.row_number().over(W.partitionBy("__key").orderBy(*others))
    return rows.withColumn("__place", place).where("__place = 1").select(*docs.columns)
