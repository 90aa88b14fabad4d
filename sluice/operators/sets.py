"""Set operations on rows and on recipient sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# ids in one range of recipients
SPAN = 1024


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct accounts at either end; each side is made distinct before the union."""
    return edges.select(F.col("src").alias("account")).distinct().union(edges.select("dst").distinct()).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def two_way(edges: DataFrame) -> DataFrame:
    """Pairs that pay each other."""
    out = edges.select(F.col("src").alias("account"), F.col("dst").alias("peer"))
    return out.intersect(edges.select(F.col("dst").alias("account"), F.col("src").alias("peer")))


def overlap(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Jaccard of the recipient sets of listed pairs.

    Recipients are kept as lists per range of ``SPAN`` ids, so no account's whole set is
    gathered into one row and a pair is sent once per range. Lists meet only where both
    accounts have recipients in a range; unions follow from the degrees.
    """
    lists = cut(edges.groupBy("src", F.floor(F.col("dst") / SPAN).alias("range")).agg(F.collect_set("dst").alias("dsts")))
    # a list is empty only for an unknown recipient, which counts as one
    degree = lists.groupBy("src").agg(F.sum(F.greatest(F.size("dsts"), F.lit(1))).alias("n"))
    deg = lambda c, n: degree.select(F.col("src").alias(c), F.col("n").alias(n))
    side = lambda c, name: lists.select(F.col("src").alias(c), "range", F.col("dsts").alias(name))
    meet = pairs.join(side("account", "mine").drop("mine"), "account").join(side("peer", "theirs"), ["peer", "range"]).join(side("account", "mine"), ["account", "range"])
    common = meet.groupBy("account", "peer").agg(F.sum(F.size(F.array_intersect("mine", "theirs"))).alias("common"))
    both = pairs.join(deg("account", "na"), "account").join(deg("peer", "nb"), "peer").join(common, ["account", "peer"], "left").fillna(0, ["common"])
    return both.select("account", "peer", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))
