"""Verification of hash-chained ledgers and Merkle-rooted blocks.

Checking a stored chain is parallel: every row carries the previous hash it was
sealed with, so its digest needs no other row, and the link needs one neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.digests import hmac_sha256


def _json_text(c: Column) -> Column:
    wrapped = F.to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def audit_payload(prev: Column) -> Column:
    """Compact JSON with sorted keys; ``detail`` is already canonical JSON text."""
    return F.concat(
        F.lit('{"action":'), _json_text(F.col("action")), F.lit(',"actor":'), _json_text(F.col("actor")),
        F.lit(',"at":'), _json_text(F.col("logged_at")), F.lit(',"detail":'), F.col("detail"),
        F.lit(',"prev":'), _json_text(prev), F.lit(',"seq":'), F.col("seq").cast("string"),
        F.lit(',"target":'), _json_text(F.col("target")), F.lit("}"),
    )


def audit_digest(prev: Column, key: bytes) -> Column:
    return hmac_sha256(audit_payload(prev), key)


def previous_value(df: DataFrame, keys: Sequence[str], at: str, value: str, out: str, width: int = 1_000_000) -> DataFrame:
    """``lag(value)`` by ``at``, split into ranges of ``at`` so no task sorts a whole ledger."""
    keys = list(keys)
    df = df.withColumn("__b", F.floor(F.col(at) / width))
    tops = df.groupBy(*keys, "__b").agg(F.max_by(value, at).alias("__t"))
    order = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__b")
    carry = tops.select(*keys, "__b", F.lag("__t").over(order).alias("__c"))
    local = W.partitionBy(*keys, "__b").orderBy(at)
    return df.join(carry, [*keys, "__b"]).withColumn(out, F.coalesce(F.lag(value).over(local), F.col("__c"))).drop("__b", "__c")


def verify_chain(entries: DataFrame, keys: Sequence[str], key: bytes) -> DataFrame:
    """Per ledger: rows, the first broken sequence number, and whether it is intact."""
    linked = previous_value(entries, keys, "seq", "entry_hash", "__prev")
    bad = (F.col("prev_hash") != F.coalesce("__prev", F.lit(""))) | (
        F.col("entry_hash") != audit_digest(F.col("prev_hash"), key)
    )
    return linked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"),
        F.min(F.when(bad, F.col("seq"))).alias("broken_at"),
        (F.count_if(bad) == 0).alias("intact"),
    )


def merkle_roots(leaves: DataFrame, block: str = "block") -> DataFrame:
    """Root per block. ``leaves``: block, pos (0-based), serialized.

    One aggregation per tree level; an odd node pairs with itself, a block of one
    leaf keeps the leaf hash, a block that lists no leaf (null) hashes 'genesis'.
    """
    sized = leaves.groupBy(block).agg(F.count("serialized").alias("n"))
    level = leaves.where("serialized IS NOT NULL").join(sized, block).select(
        block, F.col("pos").cast("bigint").alias("pos"), "n", F.sha2("serialized", 256).alias("h")
    )
    largest = sized.agg(F.max("n")).first()[0] or 0
    for _ in range(max(0, math.ceil(math.log2(max(largest, 1))))):
        left = F.max(F.when(F.col("pos") % 2 == 0, F.col("h")))
        right = F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("h"))), left)
        level = level.groupBy(block, F.floor(F.col("pos") / 2).alias("up"), "n").agg(
            F.when(F.col("n") > 1, F.sha2(F.concat(left, right), 256)).otherwise(left).alias("h")
        ).select(block, F.col("up").alias("pos"), F.ceil(F.col("n") / 2).alias("n"), "h")
    empty = sized.where("n = 0").select(block, F.sha2(F.lit("genesis"), 256).alias("root"))
    return level.select(block, F.col("h").alias("root")).unionByName(empty)


def block_hash(prev: Column) -> Column:
    return F.sha2(
        F.concat(F.col("block").cast("string"), prev, F.col("root"), F.col("timestamp").cast("string"), F.col("nonce").cast("string")), 256
    )


def verify_blocks(blocks: DataFrame, leaves: DataFrame, keys: Sequence[str], difficulty: int = 4) -> DataFrame:
    """Per block: its root, its own hash, the work prefix and the link to the block before.

    ``blocks``: keys, block, root, prev_hash, hash, timestamp, nonce.
    """
    fresh = merkle_roots(leaves).withColumnRenamed("root", "fresh_root")
    linked = previous_value(blocks, keys, "block", "hash", "__prev").join(fresh, "block", "left")
    return linked.select(
        *keys, "block",
        F.coalesce(F.col("root") == F.col("fresh_root"), F.lit(False)).alias("root_ok"),
        (F.col("hash") == block_hash(F.col("prev_hash"))).alias("hash_ok"),
        F.col("hash").startswith("0" * difficulty).alias("work_ok"),
        (F.col("__prev").isNull() | (F.col("prev_hash") == F.col("__prev"))).alias("link_ok"),
    )
