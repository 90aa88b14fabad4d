"""Exact top-k by inner product with MaxScore over shards.

A vector's components are terms, each shard keeps them as postings (one array of weights
per term). A term's contribution to a query lies between a floor and a ceiling that hold
for the whole shard; above the floor it is never negative, so ceilings bound what a set
of terms can still add. Terms are ordered by that bound. Those whose joint bound can't
lift a row over the k-th best score so far are non-essential: only the essential
postings are traversed, and the others are probed for rows that are still competitive.
A task carries what it has found from shard to shard, its k rows a query are merged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved

SHARD_ROWS = 8192
QUERY_BYTES = 32 << 20
BLOCK = 2048
PROBE = 8

#: scores, whether the id is null, ids
Best = tuple[np.ndarray, np.ndarray, np.ndarray]


def quantised(vectors: DataFrame, column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id and v (longs, floor(scale * component)); vectors that are null or hold null or non-finite components are left out."""
    x = F.col(column)
    broken = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where(x.isNotNull() & ~F.coalesce(broken, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Terms x rows; a missing component is 0."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lists)), lengths), at] = flat
    return np.ascontiguousarray(out.T)


class Shard:
    """Postings of one shard's rows."""

    def __init__(self, weights: np.ndarray, own: np.ndarray, exact):
        self.weights, self.own, self.exact = weights.astype(exact), own, exact
        self.low, self.high = self.weights.min(axis=1), self.weights.max(axis=1)

    def search(self, query: np.ndarray, own: int, k: int, ids: np.ndarray, none: np.ndarray, best: Best) -> Best:
        """The k best of ``best`` and of this shard's rows other than ``own``; ties go to smaller ids, null ids last."""
        q = query.astype(self.exact)
        a, b = q * self.low, q * self.high
        floor, bound = np.minimum(a, b), np.abs(b - a)
        terms = np.argsort(-bound.astype(float), kind="stable")
        rest = np.array([*np.cumsum(bound[terms][::-1])[::-1], 0], self.exact)
        base = floor.sum()
        scores, missing, found = best
        scores = scores.astype(self.exact)
        least = scores.min() if len(scores) == k else None
        for start in range(0, self.weights.shape[1], BLOCK):
            alive = np.arange(start, min(start + BLOCK, self.weights.shape[1]))
            # the essential terms: the least number such that the others alone stay below; all, if even none at all don't
            done = len(terms) if least is None else min(int(np.searchsorted(-(rest + base).astype(float), -float(least), side="right")), len(terms))
            first = terms[:done]
            part = base + (q[first] @ self.weights[first, start:start + BLOCK] - floor[first].sum() if done else np.zeros(len(alive), self.exact))
            while True:
                if least is not None:
                    on = part + rest[done] >= least
                    alive, part = alive[on], part[on]
                if done >= len(terms) or not len(alive):
                    break
                more = terms[done:done + PROBE]
                part = part + (q[more] @ self.weights[np.ix_(more, alive)] - floor[more].sum())
                done += len(more)
            other = self.own[alive] != own
            alive, part = alive[other], part[other]
            scores, missing, found = np.r_[scores, part], np.r_[missing, none[alive]], np.r_[found, ids[alive]]
            if len(scores) > k:
                order = np.lexsort((found, missing, -scores))[:k]
                scores, missing, found = scores[order], missing[order], found[order]
            if len(scores) == k:
                least = scores.min()
        return scores, missing, found


def _searcher(shared, k: int, shard_rows: int):
    """Rows of a partition, a shard at a time, against all queries of the round; what was found bounds later shards."""

    def search(batches):
        asked = shared.value
        best: list[Best] = [(np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64))] * len(asked.uid)
        for docs in _shards(batches, shard_rows):
            lists = docs.column("v").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            width = max(asked.matrix.shape[0], int(np.diff(lists.offsets.to_numpy()).max(initial=0)))
            weights = _matrix(lists, width)
            queries = np.zeros((width, len(asked.uid)), np.int64)
            queries[: asked.matrix.shape[0]] = asked.matrix
            top = float(np.abs(weights.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * width
            shard = Shard(weights, docs.column("uid").to_numpy(), np.float64 if top < 2.0**51 else object)
            ids = docs.column("vec_id").combine_chunks()
            none, ids = pc.is_null(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            for n, own in enumerate(asked.uid.tolist()):
                best[n] = shard.search(queries[:, n], own, k, ids, none, best[n])
        sizes = [len(b[0]) for b in best]
        if sum(sizes):
            missing = np.concatenate([b[1] for b in best])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(asked.uid, sizes)), pa.array(np.repeat(asked.vec_id, sizes)), pa.array(np.concatenate([b[2] for b in best]), pa.int64(), mask=missing),
                pa.array([int(s) for b in best for s in b[0]], pa.int64())], names=["query_uid", "query_id", "vec_id", "score"])

    return search


def _shards(batches, rows: int):
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, rows - size))
            size += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if size == rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


@dataclass
class Queries:
    """The queries of a round: at most ``QUERY_BYTES`` of components."""

    uid: np.ndarray
    vec_id: np.ndarray
    matrix: np.ndarray


def top_k(vectors: DataFrame, is_query, k: int = 5, shard_rows: int = SHARD_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds the k best other rows.

    ``vectors`` has vec_id and v (array of longs). Ties go to the smaller vec_id, null ids
    last. A vector shorter than another counts as 0 there. Rows that repeat a vec_id are
    candidates of their own, and queries of their own. No rows or no queries give no rows.
    A score beyond a long is an error.

    Rows are not shuffled: the queries go to them, in rounds of ``query_bytes``; a task
    carries the k-th best score of each query from shard to shard, and gives k rows a query.
    """
    spark = vectors.sparkSession
    rows = saved(vectors.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asked")).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    asked, width = rows.where("asked").agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    rounds = max(1, -(-asked * max(width, 1) * 8 // query_bytes))
    parts = []
    for turn in range(rounds):
        some = rows.where("asked").where(F.pmod(F.xxhash64("uid"), F.lit(rounds)) == turn).select("uid", "vec_id", "v").toArrow().combine_chunks()
        lists = some.column("v").chunk(0) if some.num_rows else pa.array([], pa.list_(pa.int64()))
        queries = Queries(some.column("uid").to_numpy(), some.column("vec_id").to_numpy(), _matrix(lists, max(width, 1)))
        found = rows.select("uid", "vec_id", "v").mapInArrow(_searcher(spark.sparkContext.broadcast(queries), k, shard_rows), "query_uid bigint, query_id bigint, vec_id bigint, score bigint")
        parts.append(saved(found, "top-rows") if rounds > 1 else found)
    best = W.partitionBy("query_uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    merged = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
