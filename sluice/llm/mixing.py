"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / source size.
Along a fixed order within the source the expected copies are summed up, one random
offset is added, and the document is taken once for each whole number that its step
crosses. The order is by size, so that documents of every length are taken in turn and
the words taken stay within about one largest document of the target.

The order is total and never sorted whole: a source is cut by size, a size by 4,096
hash cells of the id, and only a cell is ranked. Counts of the cells combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``, without an array of the words; null has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(marks, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target words of each row of ``totals`` (source, source_size; one row per source).

    Sources by code point, null last, weigh ``weights`` in turn. Targets are in
    proportion to the weights, but at most ``most`` times the source's size; what exceeds
    that goes to the others. Closed form of the repeated sharing: with sources in the
    order of (limit / weight), the first j that are full leave a level for the rest, and
    the right j is the first whose next source isn't full at that level. These windows
    see one row per source. No words at all: all targets are 0.
    """
    one = W.partitionBy(F.lit(0))
    place = F.row_number().over(one.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    order = one.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), "source")
    left = F.sum(F.col("source_size")).over(one) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("__w").over(order.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("__turn", F.row_number().over(order)).withColumn("__level", level)
    free = F.when(F.col("__level") <= F.col("__cap") / F.col("__w"), F.struct(F.col("__turn"), F.col("__level").alias("__at")))
    ranked = ranked.withColumn("__at", F.min(free).over(one)["__at"])
    return ranked.select("source", "source_size", F.least("__cap", F.coalesce(F.col("__at") * F.col("__w"), F.col("__cap"))).alias("target"))


def offset(seed: str = SEED) -> Column:
    """One number in [0, 1) per source, from the source's name."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of ``docs``.

    Copies are the rate rounded down or up, so no document exceeds ``most`` times its
    size when ``most`` is whole. A source without words has rate 0. Rows that repeat a
    doc_id and size are taken in any order, which gives the same rows. Null ids come
    first in their cell, a null source is a source. An empty table gives no rows.
    """
    sized = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    cell = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 3)
    sized = sized.withColumn("__cell", cell)
    cells = sized.groupBy("source", "size", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    sizes = cells.groupBy("source", "size").agg(F.sum("__n").alias("__n"))
    up_to = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("source", "size", F.coalesce(F.sum("__n").over(up_to), F.lit(0)).alias("__lower"))
    within = W.partitionBy("source", "size").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0))).drop("__n")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)

    def same(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
        b = b.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
        return a.join(b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]).drop(*[f"__r_{k}" for k in keys])

    starts = same(same(cells, sizes, "source", "size"), goals, "source")
    ranked = sized.withColumn("__k", F.row_number().over(W.partitionBy("source", "size", "__cell").orderBy("doc_id")))
    ranked = same(ranked, starts, "source", "size", "__cell")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("__lower") + F.col("__before") + F.col("__k")
    crossed = F.floor(rate * rank + offset(seed)) - F.floor(rate * (rank - 1) + offset(seed))
    return ranked.select(
        "doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"), (crossed * F.col("size")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as in ``docs``.

    Rows alike in doc_id, source and size share the copies of their ranks: all get the
    smaller number, and as many as the total asks for, by order of their text, one more.
    """
    took = mix(docs, **how).groupBy(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__words")
    ).agg(F.count(F.lit(1)).alias("__rows"), F.min("copies").alias("__least"), F.sum("copies").alias("__all")).where("__all > 0")
    rows = docs.withColumn("__size", word_count(F.col("text")))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__words"))
    joined = rows.join(took, on)
    place = F.row_number().over(W.partitionBy("__id", "__source", "__words").orderBy("text"))
    extra = F.col("__all") - F.col("__rows") * F.col("__least")
    one = joined.where("__rows = 1").withColumn("__copies", F.col("__all"))
    more = joined.where("__rows > 1").withColumn("__copies", F.col("__least") + (place <= extra).cast("long"))
    both = one.unionByName(more).where("__copies > 0")
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
