"""Connected components by alternating stars, to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _nearest(edges: DataFrame) -> DataFrame:
    """Per node its smallest neighbour or itself; ``edges`` hold both directions."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v longs): root is the smallest node reachable.

    Large stars move each node's larger neighbours to its smallest one, small stars the
    smaller ones; edges only ever shrink towards the root, and the rounds end when nothing
    changes. Each round is written to the shared folder. Loops and repeated edges are
    harmless; no edges give no rows.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    pairs = saved(pairs, "edges")
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star on the result: u > v already holds
        large = large.where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = saved(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = _mark(pairs)
        if now == mark:
            break
        mark = now
    nodes = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots.join(nodes.select("node"), "node", "left_anti"))
