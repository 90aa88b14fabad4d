"""Near-duplicates by the similarity of their shingle sets, found by wide SimHashes.

A fingerprint of 256 bits over the distinct five-word shingles of a text estimates the
angle between two sets well: at a Jaccard similarity of 0.8 some 39 bits differ, with a
spread of 6; unrelated texts differ in 128. Fingerprints meet under ``TABLES`` keys of
``KEY_BITS`` bits each; of those that meet, rows are ordered by the distance to a pivot,
pairs whose pivot distances tell them apart are discarded, and the rest compared, the
closest first: a key gives edges of a spanning forest, never all pairs of a group. The
exact similarity of each edge's sets decides. A second round looks under all keys for
links between the components of the first.

Two texts of similarity 0.8 share a key with probability 0.91, of 0.85 with 0.98, of 0.9
with 0.998.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards
from .common import release, saved
from .graphs import components
from .simhash import _first_rows

SHINGLE, SIMILARITY = 5, 0.8
WORDS = 4
TABLES, KEY_BITS, FIRST_TABLES = 32, 16, 4
#: bits that may differ, closest pairs first; the last bound is 2.3 spreads above the mean at 0.8
LEVELS = (16, 28, 40, 52)
#: how far apart in pivot order pairs of the closer levels may stand; the last level looks at all
NEAR = 64
PIVOTS = 8
CHUNK = 1 << 15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and 64-bit hash of each distinct shingle of texts, ascending; A-Z are lower-cased.

    A text of fewer words has its whole sequence as the only shingle, one without words none.
    """
    codes, offsets, words = shards.coded(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = np.array([xxhash.xxh64_intdigest(w, 7) for w in words.cast(pa.binary()).to_pylist()], np.uint64)
    tokens, sizes = hashes[codes], np.diff(offsets)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = offsets[1:][owner] - np.arange(len(tokens))
    value = np.full(len(tokens), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(width):
        within = left > i
        ahead = np.zeros(len(tokens), np.uint64)
        ahead[: max(len(tokens) - i, 0)] = tokens[i:]
        value = np.where(within, _mixed(value * np.uint64(31) + ahead), value)
    start = (left >= width) | ((sizes[owner] < width) & (np.arange(len(tokens)) == offsets[:-1][owner]))
    owner, value = owner[start], value[start]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    first = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])] if len(owner) else np.zeros(0, bool)
    return owner[first], value[first]


def prints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (texts x 4 words) and the number of distinct shingles."""
    owner, value = shingles(texts)
    n = len(texts)
    ones = np.zeros((n, 64 * WORDS), np.int64)
    seeds = _mixed(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    for at in range(0, len(owner), CHUNK):
        who = owner[at:at + CHUNK]
        bits = np.unpackbits(_mixed(value[at:at + CHUNK, None] ^ seeds).view(np.uint8).reshape(len(who), -1), axis=1)
        heads = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        ones[who[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    sizes = np.bincount(owner, minlength=n)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(np.uint64).reshape(n, WORDS), sizes


def nodes(texts: pa.Array) -> np.ndarray:
    """One long per text: a digest of its fingerprint and size."""
    fp, sizes = prints(texts)
    raw = np.column_stack([fp, sizes.astype(np.uint64)])
    return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in raw], np.uint64).view(np.int64)


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in shards.runs(batches):
        fp, sizes = prints(run.column("text").cast(pa.string()))
        raw = np.column_stack([fp, sizes.astype(np.uint64)])
        node = np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in raw], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array(node), pa.array([r.tobytes() for r in fp], pa.binary())], names=["doc_id", "fp", "print"])
        release()


def _positions() -> np.ndarray:
    pick = np.random.default_rng(20)
    return np.array([pick.choice(64 * WORDS, KEY_BITS, replace=False) for _ in range(TABLES)])


def _keys(first: int, last: int):
    """Rows (fp, print, root) under the keys of some of the tables."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _positions()[first:last]
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
            for t, at in enumerate(places, first):
                key = bits[:, at].astype(np.int64) @ (1 << np.arange(KEY_BITS)) + (t << KEY_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(key), *[batch.column(c) for c in ("fp", "print", "root")]], names=["key", "fp", "print", "root"])

    return keys


def forest(key: np.ndarray, fp: np.ndarray, root: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Pairs of rows that connect what is close under equal keys, the closest first; rows of one root are connected already."""
    table = np.bitwise_count(fp[:, None, :] ^ refs[None]).sum(axis=2, dtype=np.int16)
    order = np.lexsort((table[:, 0], key))
    key, fp, table = key[order], fp[order], table[order]
    _, label = np.unique(root[order], return_inverse=True)
    ends = np.searchsorted(key, key, side="right")
    # within a key only: labels of other keys must not connect rows here
    _, label = np.unique(key * (len(label) + 1) + label, return_inverse=True)
    parent, found = np.arange(label.max(initial=-1) + 1), []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for radius in LEVELS:
        at, step = np.arange(len(key)), 1
        while len(at) and (step <= NEAR or radius == LEVELS[-1]):
            at = at[at + step < ends[at]]
            at = at[table[at + step, 0] - table[at, 0] <= radius]
            near = at[label[at] != label[at + step]]
            near = near[(np.abs(table[near] - table[near + step]) <= radius).all(axis=1)]
            near = near[np.bitwise_count(fp[near] ^ fp[near + step]).sum(axis=1) <= radius]
            for i in near.tolist():
                a, b = top(int(label[i])), top(int(label[i + step]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((order[i], order[i + step]))
            if len(near):
                while not (parent[parent] == parent).all():
                    parent = parent[parent]
                label = parent[label]
            if not step & (step - 1):
                # rows with nothing but their own component behind them are done
                other = np.flatnonzero(np.r_[(label[1:] != label[:-1]) | (key[1:] != key[:-1]), True])
                at = at[other[np.searchsorted(other, at)] + 1 < ends[at]]
            step += 1
    return np.array(found, np.int64).reshape(-1, 2)


def _linker(refs: np.ndarray):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in [*_blocks(batches), None]:
            if batch is not None:
                held = batch if held is None else pa.concat_tables([held, batch])
            if held is None:
                continue
            key = held.column("key").to_numpy()
            # the last key may go on in the next block
            done = len(key) if batch is None else int(np.searchsorted(key, key[-1])) if len(key) else 0
            if not done:
                continue
            part, held = held.slice(0, done), held.slice(done)
            fp = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint64).reshape(done, WORDS)
            node = part.column("fp").to_numpy()
            pairs = forest(key[:done], fp, part.column("root").to_numpy(), refs)
            yield pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["u", "v"])

    return link


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) -> node and sorted shingle hashes."""
    for run in shards.runs(batches):
        text = run.column("text").cast(pa.string())
        owner, value = shingles(text)
        ends = np.searchsorted(owner, np.arange(len(text) + 1))
        yield pa.RecordBatch.from_arrays([pa.array(nodes(text)), pa.array([value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["node", "hashes"])


def _alike(similarity: float):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(batch.column("one"), batch.column("two"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.filter(pa.array(kept, pa.bool_())).select(["u", "v"])

    return alike


def _verified(docs: DataFrame, found: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """Edges whose shingle sets are alike; sets are built for one row of each node on an edge."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    ids = found.join(ends, "fp").groupBy("fp").agg(F.min("doc_id").alias("__id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(ids.select("__id").distinct(), F.col("doc_id").eqNullSafe(F.col("__id"))).select("text")
    sets = saved(texts.mapInArrow(_sets, "node bigint, hashes binary").dropDuplicates(["node"]), "wide-sets")
    both = edges.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("one")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("two")), "v")
    return both.select("u", "v", "one", "two").mapInArrow(_alike(similarity), "u bigint, v bigint")


def similar(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, fp (node) and root of every row: rows linked by a similarity of ``similarity`` and more share a root.

    Texts without words are alike. Null ids take part. Repeated rows are one node.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = saved(rows.mapInArrow(_print_rows, "doc_id bigint, fp bigint, print binary"), "wide-prints")
    prints_ = saved(found.select("fp", "print").dropDuplicates(["fp"]).withColumn("root", F.col("fp")), "wide-nodes")
    refs = _mixed(np.arange(1, PIVOTS * WORDS + 1, dtype=np.uint64)).reshape(PIVOTS, WORDS)
    roots, links = prints_, None
    for first, last in ((0, FIRST_TABLES), (0, TABLES)):
        keyed = roots.mapInArrow(_keys(first, last), "key bigint, fp bigint, print binary, root bigint")
        edges = saved(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(refs), "u bigint, v bigint").distinct(), "wide-edges")
        edges = _verified(docs, found.select("doc_id", "fp"), edges, similarity)
        links = saved(edges if links is None else links.unionByName(edges), "wide-links")
        named = components(links)
        roots = saved(prints_.drop("root").join(named, F.col("fp") == F.col("node"), "left").select("fp", "print", F.coalesce("root", "fp").alias("root")), "wide-roots")
    return found.select("doc_id", F.col("fp").alias("__fp")).join(roots.select("fp", "root"), F.col("__fp") == F.col("fp")).select("doc_id", "fp", "root")


def unique(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group: the one with the smallest doc_id (null last, then by the other columns); columns unchanged."""
    return _first_rows(docs, similar(docs, similarity), nodes)
