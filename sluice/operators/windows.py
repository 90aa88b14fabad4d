"""Ordered computations that other modules do not already own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import DAY, ordinal, running_sum
from .ranking import top_ranked


def inflow_between(transfers: DataFrame, intervals: DataFrame) -> DataFrame:
    """Money received inside closed intervals, from prefix sums and no range join.

    ``intervals``: ask, account, start, end. Each end becomes a mark on the
    account's timeline; the sum is the difference of two prefix sums, so cost does
    not grow with interval length.
    """
    money = transfers.select(F.col("dst").alias("account"), F.col("epoch").alias("t"), "amount", F.lit(None).cast("bigint").alias("ask"), F.lit(0).alias("sign"))
    zero = F.lit(0.0)
    left = intervals.select("account", (F.col("start") - 1).alias("t"), zero.alias("amount"), "ask", F.lit(-1).alias("sign"))
    right = intervals.select("account", F.col("end").alias("t"), zero.alias("amount"), "ask", F.lit(1).alias("sign"))
    line = money.unionByName(left).unionByName(right)
    run = running_sum(line, ["account"], F.floor(F.col("t") / DAY), ["t"], F.col("amount"), "upto")
    return run.where("ask IS NOT NULL").groupBy("ask", "account").agg(F.round(F.sum(F.col("upto") * F.col("sign")), 2).alias("inflow"))


def issue_minute(rank: Column, complaint: Column, parallel: int = 4, latency: float = 1.5) -> Column:
    """Minute the 0-based rank takes effect when instructions leave in batches."""
    return complaint + F.ceil((F.floor(rank / parallel) + 1) * latency)


def round_robin(incidents: DataFrame, buckets: Sequence[str], count: int) -> DataFrame:
    """Take the largest of every bucket, then the next of every bucket, up to ``count``."""
    ranked = top_ranked(incidents, buckets, [F.desc("amount"), F.col("incident")], count, "depth")
    return ranked.orderBy("depth", *buckets).limit(count)


def benchmark_sample(incidents: DataFrame, rounds: int, seed: int = 7) -> DataFrame:
    """Round 0 keeps the natural delay; later rounds draw log-normal(3.9, 1) in [4, 330].

    The normal comes from two hashed uniforms, so a row draws the same delay under
    any partitioning.
    """
    u = lambda tag: (F.pmod(F.xxhash64("incident", "round", F.lit(tag), F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * 3.141592653589793 * u("b"))
    drawn = F.least(F.greatest(F.exp(3.9 + normal), F.lit(4.0)), F.lit(330.0)).cast("bigint")
    rows = incidents.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return rows.select("incident", "round", F.when(F.col("round") == 0, F.col("delay")).otherwise(drawn).alias("delay"))


def number_communities(members: DataFrame, least: int = 4) -> DataFrame:
    """C01, C02... by size desc, then smallest member; numbered before the size filter."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("account").alias("first"))
    # many communities share a size: a cell is a size and a range of first members
    cell = F.struct((-F.col("size")).alias("size"), F.floor(F.col("first") / 4096).alias("range"))
    ranked = ordinal(sizes, [], cell, [F.desc("size"), F.col("first")], "pos")
    return ranked.where(F.col("size") >= least).select(
        "community", F.concat(F.lit("C"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("ring_id"), "size"
    )


def score_history(points: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Trajectory points in time order, optionally of chosen accounts only."""
    rows = points if accounts is None else points.join(accounts, "account", "left_semi")
    return rows.orderBy("account", "created", "alert_id")


def latest_per_account(points: DataFrame) -> DataFrame:
    return points.groupBy("account").agg(F.max(F.struct("created", "alert_id", "score", "severity")).alias("m")).select(
        "account", F.col("m.created").alias("created"), F.col("m.score").alias("score"), F.col("m.severity").alias("severity")
    )


def percentile_thresholds(scored: DataFrame, percents: Sequence[int]) -> DataFrame:
    """F1 when cutting at each percentile of the scores; best row first by ``f1``."""
    from ..core import exact_quantiles

    q = exact_quantiles(scored, [], "score", {f"p{p}": p / 100.0 for p in percents})
    pairs = ", ".join(f"{p}, p{p}" for p in percents)
    cuts = q.selectExpr(f"stack({len(percents)}, {pairs}) AS (percent, threshold)")
    # one small row per distinct score meets the few cuts
    blocks = scored.groupBy("score").agg(F.count_if("positive").alias("p"), F.count(F.lit(1)).alias("k"))
    total = scored.agg(F.count_if("positive").alias("pos")).scalar()
    hit = F.col("score") >= F.col("threshold")
    rows = blocks.join(F.broadcast(cuts)).groupBy("percent", "threshold").agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("k")).otherwise(0)).alias("k")
    )
    return rows.select("percent", "threshold", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("k") + total), F.lit(0.0)).alias("f1"))
