"""SimHash near-duplicates, with pivot distance tables.

Equal fingerprints are one node from the start. Two fingerprints that differ in at most
``RADIUS`` bits agree wholly in two of five blocks of bits, so they meet under one of ten
keys. Within a key the rows are in order of their distance to a first pivot, and only
rows whose distances to it differ by at most the radius are looked at; of these, pairs
whose distance vectors to all pivots differ by more in any coordinate can't be within
the radius (triangle inequality) and are discarded; the rest are verified bit by bit.
A key emits edges of a spanning forest only, never all pairs of a group.

`similar` looks for texts whose sets of shingles are alike (Jaccard) rather than for close
fingerprints, see `wide`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved
from .graphs import components

SHINGLE = 3
SEED = 42
RADIUS = 3
PIVOTS = 16
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RUN = 1 << 15


def fingerprint(raw: bytes, width: int = SHINGLE) -> bytes:
    """Eight bytes: a bit is set if it is set in over half of the shingles' hashes; no words give zero."""
    text = b" ".join(raw.lower().split())
    if not text:
        return bytes(8)
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts, ends = np.r_[0, spaces + 1], np.r_[spaces, len(text)]
    width = min(width, len(starts))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), RUN):
        hashes = [digest(text[a:b], SEED) for a, b in zip(starts[at:at + RUN].tolist(), ends[at:at + RUN].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(starts)).tobytes()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = b"".join(fingerprint(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; null is the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw")).mapInArrow(_prints, "doc_id bigint, fp bigint")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode()) for i in range(count)], np.uint64)


def distance_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference."""
    return np.bitwise_count(prints[:, None] ^ refs[None, :]).astype(np.int8)


def _links(key: np.ndarray, prints: np.ndarray, refs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges among rows of equal ``key``; rows come ordered by key."""
    table = distance_table(prints, refs)
    order = np.lexsort((table[:, 0], key))
    key, prints, table = key[order], prints[order], table[order]
    parent = np.arange(len(key))
    at, step, found = np.arange(len(key)), 1, []
    while len(at):
        at = at[at + step < len(key)]
        at = at[(key[at] == key[at + step]) & (table[at + step, 0] - table[at, 0] <= radius)]
        # pairs that are already connected need no edge
        near = at[parent[at] != parent[at + step]]
        near = near[np.abs(table[near] - table[near + step]).max(axis=1, initial=0) <= radius]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= radius]
        if len(near):
            for i in near.tolist():
                a, b = i, i + step
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((i, i + step))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
        step += 1
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return prints[pairs[:, 0]], prints[pairs[:, 1]]


def _linker(refs: np.ndarray, radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.r_[held_key, batch.column(0).to_numpy()]
            prints = np.r_[held, batch.column(1).to_numpy().view(np.uint64)]
            done = np.searchsorted(key, key[-1]) if len(key) else 0  # the last key may go on in the next batch
            held_key, held = key[done:], prints[done:]
            if done:
                yield _edges(*_links(key[:done], prints[:done], refs, radius))
        if len(held):
            yield _edges(*_links(held_key, held, refs, radius))

    return link


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def links(prints: DataFrame, radius: int = RADIUS, refs: np.ndarray | None = None) -> DataFrame:
    """Edges (u, v) that connect the distinct values of ``fp`` within ``radius`` (at most 3) bits; enough for components."""
    if not 0 <= radius <= 3:
        raise ValueError("the blocks are laid out for a radius of up to 3 bits")
    keys = []
    for n, (a, b) in enumerate(combinations(BLOCKS, 2)):
        part = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in (a, b)]
        keys.append(F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(part[0], 13) + part[1])
    rows = prints.select("fp").distinct().select(F.explode(F.array(*keys)).alias("key"), "fp")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(pivots() if refs is None else refs, radius), "u bigint, v bigint")


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row of ``docs``.

    Texts without words have fingerprint 0 and link like any other. Null ids take part in
    a component but don't name it; a component of null ids has a null component_id.
    Repeated rows give repeated rows. ``root`` is the component's smallest fingerprint.
    """
    prints = saved(fingerprints(docs), "simhash-prints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("__first"))
    roots = saved(components(links(first, radius)), "simhash-roots")
    rooted = first.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    names = rooted.groupBy("root").agg(F.min("__first").alias("component_id"))
    # written, so that the join has a plain exchange on either side and a hot fingerprint's rows are split
    named = saved(rooted.join(names, "root").select(F.col("fp").alias("__fp"), "root", "component_id"), "simhash-names")
    return prints.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id", "root")


def _first_rows(docs: DataFrame, found: DataFrame, prints) -> DataFrame:
    """Of each ``root`` in ``found`` (doc_id, fp, root) the row with the smallest doc_id (null last, then by print and the other columns)."""
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("k"))
    keep = least.select(F.col("k.doc_id").alias("__k_id"), F.col("k.fp").alias("__k_fp"))
    counts = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows"))
    keep = keep.join(counts.withColumnRenamed("doc_id", "__c_id"), F.col("__k_id").eqNullSafe(F.col("__c_id"))).drop("__c_id")
    rows = docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__k_id")))
    single = rows.where("__rows = 1").select(*docs.columns)
    # ids that stand on several rows: the print tells the row, the first of equals stays
    others = [c for c, kind in docs.dtypes if c != "doc_id" and "map<" not in kind and "variant" not in kind]
    again = rows.where("__rows > 1")
    again = again.mapInArrow(_same_print(again.columns, prints), again.schema)
    place = F.row_number().over(W.partitionBy("__k_id", "__k_fp").orderBy(*others))
    return single.unionByName(again.withColumn("__place", place).where("__place = 1").select(*docs.columns))


def _same_print(columns: list[str], prints):
    text, want = columns.index("text"), columns.index("__k_fp")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(prints(batch.column(text).cast(pa.string())) == batch.column(want).to_numpy()))

    return keep


def _narrow(texts: pa.Array) -> np.ndarray:
    raw = b"".join(fingerprint(v.as_py().encode() if v.is_valid else b"") for v in texts)
    return np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64)


def unique(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (null last, then by the other columns); columns unchanged."""
    return _first_rows(docs, groups(docs, radius), _narrow)


def distinct(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of each group of texts that are alike over five-word shingles, by wide fingerprints (`wide`); columns unchanged."""
    from . import wide

    return wide.unique(docs, similarity)
