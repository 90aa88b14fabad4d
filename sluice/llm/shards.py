"""Runs of texts as word codes with a dictionary of their own, and ids for all words of a table.

A shard is a run of rows with up to ``SHARD_BYTES`` of text, read in smaller runs. Its
dictionary holds each of its words once, so no word is hot among the dictionaries, however
frequent it is in the texts. Dictionaries travel in slices, one per hash cell of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, size_hint

RUN_BYTES = 2 << 20
SHARD_BYTES = 6 << 20
RUN_ROWS = 1 << 14
PIECE_BYTES = 4 << 20
CELL_BYTES = 8 << 20
LEVEL = 3
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


#: while a table of shards is written: small Arrow batches, as a row is megabytes, and no
#: shuffle files beyond the job that needs them
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def settled(df: DataFrame, what: str) -> DataFrame:
    """Write the rows to the shared folder under ``SETTINGS`` and read them back; the session's own settings return."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        conf.set(key, value)
    try:
        return saved(df, what)
    finally:
        for key, value in before.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)


def delta(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, wrapping around; ascending runs become small numbers."""
    return np.diff(a, prepend=a.dtype.type(0))


def undelta(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed."""
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.compress(b"".join(planes), LEVEL)


def unpack(data, n: int, *kinds) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(data) if n else b"", [], 0
    for kind in map(np.dtype, kinds):
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def pack_words(words: pa.Array) -> bytes:
    """Words, none of which holds a line feed."""
    return zstandard.compress(pc.binary_join(lists(words.cast(pa.string())), "\n")[0].as_buffer(), LEVEL) if len(words) else b""


def unpack_words(data, n: int) -> pa.Array:
    if not n:
        return pa.array([], pa.string())
    return pc.split_pattern(pa.array([zstandard.decompress(data)], pa.binary()).cast(pa.string()), "\n").flatten()


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in runs of about ``limit`` bytes of text; a longer text is a run of its own."""
    limit = limit or RUN_BYTES
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            past = int(ends[at - 1]) if at else 0
            room = int(np.searchsorted(ends, past + limit - size, side="right"))
            upto = min(room, at + RUN_ROWS - sum(b.num_rows for b in held))
            if upto <= at and not held:
                upto = at + 1
            if upto > at:
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1]) - past
                at = upto
            if at < len(sizes) or size >= limit:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def cut(text: str | bytes, limit: int) -> list[bytes]:
    """A long text in pieces that end before white space, so that every word stays whole."""
    data = text.encode() if isinstance(text, str) else text
    if len(data) <= limit:
        return [data]
    marks = np.flatnonzero(SPACE[np.frombuffer(data, np.uint8)])
    out, at = [], 0
    while len(data) - at > limit:
        i = int(np.searchsorted(marks, at + limit, side="right"))
        # the last white space inside the limit, or the first one beyond it
        end = int(marks[i - 1]) if i and marks[i - 1] > at else int(marks[i]) if i < len(marks) else len(data)
        out.append(data[at:end])
        at = end
    if at < len(data):
        out.append(data[at:])
    return out


def coded(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts without nulls, as they are.

    Returns one code per word, the words' offsets per text (one more than texts) and the
    distinct words. Long texts are cut before they are split.
    """
    pieces = cut(text[0].as_buffer().to_pybytes(), PIECE_BYTES) if len(text) == 1 and pc.binary_length(text)[0].as_py() > PIECE_BYTES else []
    if len(pieces) > 1:
        parts = [coded(pa.array([p.decode()], pa.string())) for p in pieces]
        whole = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(c, pa.int32()), d) for c, _, d in parts]).unify_dictionaries()
        codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in whole.chunks])
        return codes, np.array([0, len(codes)]), whole.chunks[-1].dictionary
    split = pc.ascii_split_whitespace(text)
    ends = split.offsets.to_numpy().astype(np.int64)
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.r_[0, np.cumsum(full)]
    found = flat.filter(pa.array(full)).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), before[ends - ends[0]], found.dictionary


def lists(values: pa.Array) -> pa.Array:
    """All values as the one list of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def cells(df: DataFrame) -> int:
    return max(8, -(-size_hint(df) // CELL_BYTES))


class Dictionary:
    """The words of one shard, grown run by run."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, words: pa.Array) -> int:
        """The words of a run; returns the number that their codes start from."""
        self.parts.append(words.cast(pa.string()))
        self.size += len(words)
        return self.size - len(words)

    def unify(self) -> tuple[pa.Array, np.ndarray]:
        """Distinct words, and for each added word its place among them."""
        whole = pa.chunked_array(self.parts, pa.string()).combine_chunks() if self.parts else pa.array([], pa.string())
        found = (whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole).dictionary_encode()
        return found.dictionary, found.indices.to_numpy(zero_copy_only=False)


def dealt(words: pa.Array, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the words of each hash cell."""
    cell = np.array([crc32(w) for w in words.cast(pa.binary()).to_pylist()], np.int64) % parts
    order = np.argsort(cell, kind="stable")
    some, heads = np.unique(cell[order], return_index=True)
    for c, a, b in zip(some.tolist(), heads.tolist(), [*heads[1:].tolist(), len(order)][: len(heads)], strict=True):
        yield c, order[a:b]


def sliced(words: pa.Array, parts: int, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(cell, n, words, codes and further arrays) of each hash cell; ``unslice`` reads the last."""
    for cell, at in dealt(words, parts):
        yield cell, len(at), pack_words(words.take(pa.array(at))), pack(delta(at.astype(np.int32)), *[a[at] for a in arrays])


def gathered(group: pa.Table, *kinds) -> tuple[np.ndarray, np.ndarray, pa.Array, list[np.ndarray]]:
    """Slices of one cell in the order of their shards, so that a repeated task gives the same ids.

    Returns the shards, the slices' sizes, all words, and codes and further arrays end to end.
    """
    group = group.take(pa.array(np.argsort(group.column("shard").to_numpy(), kind="stable")))
    sizes = group.column("n").to_numpy()
    words = pa.concat_arrays([unpack_words(d, n) for d, n in zip(group.column("names").to_pylist(), sizes.tolist(), strict=True)])
    parts = [unpack(d, n, np.int32, *kinds) for d, n in zip(group.column("data").to_pylist(), sizes.tolist(), strict=True)]
    arrays = [np.concatenate(column) for column in zip(*parts, strict=True)]
    ends = np.cumsum(sizes) - sizes
    codes = arrays[0].astype(np.int64)
    total = np.cumsum(codes)
    arrays[0] = total - np.repeat(total[ends] - codes[ends], sizes)
    return group.column("shard").to_numpy(), sizes, words, arrays


TOLD = "shard bigint, n bigint, data binary"


def told_rows(names: np.ndarray, sizes: np.ndarray, codes: np.ndarray, *values: np.ndarray) -> pa.Table:
    """What shards hear about their words: codes and values, a row per slice."""
    ends = np.cumsum(sizes)
    blobs = [pack(delta(codes[e - n:e].astype(np.int32)), *[v[e - n:e] for v in values]) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return pa.Table.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "n", "data"])


def _numbers(parts: int):
    def number(key, group):
        names, sizes, words, (codes,) = gathered(group)
        ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) * parts + key[0].as_py()
        return told_rows(names, sizes, codes, ids)

    return number


SLICE = ("shard", "cell", "n", "names", "data")


def numbered(words: DataFrame, parts: int) -> DataFrame:
    """Slices of shard dictionaries -> what each shard hears: the ids of its words, equal for equal words.

    One shuffle by hash cell; a cell numbers its distinct words.
    """
    return words.select(*SLICE).groupBy("cell").applyInArrow(_numbers(parts), TOLD)


def mapping(told: DataFrame) -> DataFrame:
    """All a shard hears in one row (``told``): as long as its dictionary."""
    return told.groupBy("shard").agg(F.collect_list(F.struct("n", "data")).alias("told"))


def heard(row: pa.RecordBatch, *kinds) -> list[np.ndarray]:
    """Codes and values of the row's ``told``; none where the shard heard nothing."""
    slices_ = row.column("told")[0].as_py() or []
    parts = []
    for s in slices_:
        codes, *values = unpack(s["data"], s["n"], np.int32, *kinds)
        parts.append([undelta(codes), *values])
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in (np.int32, *kinds)]


def by_code(codes: np.ndarray, values: np.ndarray, size: int | None = None) -> np.ndarray:
    out = np.zeros(len(codes) if size is None else size, values.dtype)
    out[codes] = values
    return out
