"""Building blocks that keep one hot key from landing in one task.

A plain window over a hot key sorts all of its rows in one task. The helpers here
split a key by a monotone bucket (a day, an hour, a value range): totals per
(key, bucket) are pre-aggregated map-side, a small window over the bucket totals
gives what each bucket inherits, and the exact answer inside a bucket is taken
from a window over (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DAY = 86_400
HOUR = 3_600


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str | Column],
    value: Column,
    out: str,
    peers: bool = True,
) -> DataFrame:
    """Cumulative sum per key in ``order``; ``peers`` includes rows tied in order."""
    keys = list(keys)
    df = df.withColumn("__b", bucket).withColumn("__v", value)
    totals = df.groupBy(*keys, "__b").agg(F.sum("__v").alias("__t"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*keys, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__c"))
    local = W.partitionBy(*keys, "__b").orderBy(*order)
    local = (
        local.rangeBetween(W.unboundedPreceding, 0)
        if peers
        else local.rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        df.join(carry, [*keys, "__b"])
        .withColumn(out, F.col("__c") + F.sum("__v").over(local))
        .drop("__b", "__v", "__c")
    )


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str | Column],
    out: str = "ordinal",
) -> DataFrame:
    """1-based row number per key over a total order, without a one-task sort.

    ``bucket`` must be monotone in the first ordering column (ascending sense of
    the order given).
    """
    keys = list(keys)
    df = df.withColumn("__b", bucket)
    totals = df.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__t"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*keys, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__c"))
    local = W.partitionBy(*keys, "__b").orderBy(*order)
    return (
        df.join(carry, [*keys, "__b"])
        .withColumn(out, F.col("__c") + F.row_number().over(local))
        .drop("__b", "__c")
    )


def latest_before(
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    mark: Column,
    out: str,
    width: int = DAY,
    tie: Column | None = None,
) -> DataFrame:
    """As-of value: the last non-null ``mark`` of the key at or before each row.

    ``tie`` orders rows of one instant (credits before debits).
    """
    keys = list(keys)
    df = events.withColumn("__b", F.floor(F.col(at) / width)).withColumn("__m", mark)
    tops = df.groupBy(*keys, "__b").agg(F.max("__m").alias("__t"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carry = tops.select(*keys, "__b", F.max("__t").over(before).alias("__c"))
    order = [F.col(at)] + ([tie] if tie is not None else [])
    local = W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        df.join(carry, [*keys, "__b"])
        .withColumn(out, F.coalesce(F.last("__m", ignorenulls=True).over(local), F.col("__c")))
        .drop("__b", "__m", "__c")
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    cells: int = 1024,
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles per key when a key may hold most rows.

    A histogram of ``cells`` equal-width cells per key finds the cell of each
    wanted rank; only the rows of those cells are ranked, ties collapsed first.
    ``method`` is ``linear`` (interpolated) or ``nearest`` (rank rounded half up).
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    span = rows.groupBy(*keys).agg(
        F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n")
    )
    attach = (lambda d: d.join(span, keys)) if keys else (lambda d: d.join(span))
    width = F.col("__hi") - F.col("__lo")
    cell = F.when(width > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / width * cells), F.lit(cells - 1))).otherwise(0)
    counted = (
        attach(rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__k")))
        .withColumn("__cell", cell)
    )
    hist = counted.groupBy(*keys, "__cell").agg(F.sum("__k").alias("__t"))
    wk = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    hist = hist.withColumn("__c", F.coalesce(F.sum("__t").over(wk), F.lit(0)))
    names = list(probs)
    wanted = span.select(
        *keys,
        F.explode(
            F.array(*[
                F.struct(F.lit(nm).alias("nm"), ((F.col("__n") - 1) * F.lit(float(probs[nm]))).alias("pos"))
                for nm in names
            ])
        ).alias("w"),
    ).select(*keys, "w.*")
    if method == "nearest":
        wanted = wanted.withColumn("pos", F.floor(F.col("pos") + 0.5).cast("double"))
    wanted = wanted.withColumn("lo", F.floor("pos")).withColumn("hi", F.ceil("pos"))
    pick = (F.col("hi") >= F.col("__c")) & (F.col("lo") < F.col("__c") + F.col("__t"))
    targets = (wanted.join(hist, keys) if keys else wanted.join(hist)).where(pick)
    ranked = counted.select(*keys, "__cell", "__v", "__k").join(
        targets.select(*keys, "__cell", "nm", "pos", "lo", "hi", "__c"), [*keys, "__cell"]
    )
    local = W.partitionBy(*keys, "__cell", "nm").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumn("__from", F.col("__c") + F.coalesce(F.sum("__k").over(local), F.lit(0)))
    inside = lambda r: (F.col(r) >= F.col("__from")) & (F.col(r) < F.col("__from") + F.col("__k"))
    aggs = []
    for nm in names:
        low = F.max(F.when((F.col("nm") == nm) & inside("lo"), F.col("__v")))
        high = F.max(F.when((F.col("nm") == nm) & inside("hi"), F.col("__v")))
        frac = F.max(F.when(F.col("nm") == nm, F.col("pos") - F.col("lo")))
        aggs.append((low + (high - low) * frac).alias(nm))
    return ranked.groupBy(*keys).agg(*aggs)


def interval_join(asks: DataFrame, rows: DataFrame, on: Sequence[str], at: str, lo: str, hi: str, width: int = HOUR) -> DataFrame:
    """Rows of the same key with ``lo <= at <= hi``, as an equi-join on time cells.

    Intervals must be short against ``width`` times a small number: each ask is
    repeated once per cell it touches, and a hot key splits by cell.
    """
    cells = F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))).alias("__cell")
    left = asks.where(F.col(hi) >= F.col(lo)).select("*", cells)
    right = rows.withColumn("__cell", F.floor(F.col(at) / width))
    return left.join(right, [*on, "__cell"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("__cell")


def share(num: Column, den: Column) -> Column:
    """num/den, 0 where the denominator is 0 or null."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)
