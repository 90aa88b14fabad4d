"""Node features of a card-transaction table, one row per composite card key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import clamp

# Domain lists and risk encodings.
RISKY_DOMAINS = (
    "anonymous.com", "protonmail.com", "guerrillamail.com", "mailinator.com", "throwam.com", "yopmail.com",
    "sharklasers.com", "guerrillamailblock.com", "trashmail.com", "dispostable.com", "tempmail.com", "10minutemail.com",
)
FREE_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "live.com")
CARD_RISK = {"visa": 0.3, "mastercard": 0.3, "american express": 0.2, "discover": 0.4}
PRODUCT_RISK = {"W": 0.1, "H": 0.3, "C": 0.5, "S": 0.6, "R": 0.7}
OTHER_CARD, OTHER_PRODUCT, INTERNATIONAL_FLOOR = 0.5, 0.4, 150
WEEK = 604_800


def _encode(key: Column, table: dict[str, float], default: float) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def email_risk(cards: DataFrame) -> DataFrame:
    domain = F.trim(F.lower(F.element_at(F.split(F.coalesce("email", F.lit("unknown")), "@"), -1)))
    risky, free = F.avg(domain.isin(*RISKY_DOMAINS).cast("double")), F.avg(domain.isin(*FREE_DOMAINS).cast("double"))
    return cards.groupBy("card").agg(clamp(risky * 0.6 + free * 0.3 + (1 - risky - free) * 0.1, 0, 1).alias("risky_email"))


def _bits(counts: DataFrame) -> Column:
    """Entropy in bits from per-value counts in ``k`` with group total ``n``."""
    p = F.col("k") / F.col("n")
    return F.sum(-p * F.log2(p))


def categorical_entropy(cards: DataFrame, column: str, out: str) -> DataFrame:
    value = F.coalesce(F.col(column), F.lit(-1))
    counts = cards.groupBy("card", value.alias("v")).agg(F.count(F.lit(1)).alias("k"))
    totals = cards.groupBy("card").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(totals, "card").groupBy("card").agg(_bits(counts).alias(out))


def amount_entropy(cards: DataFrame, largest: int = 20) -> DataFrame:
    """Entropy over equal-width bins closed on the right; constant or single -> 0."""
    span = cards.groupBy("card").agg(
        F.min("amt").alias("lo"), F.max("amt").alias("hi"), F.count(F.lit(1)).alias("n"), F.countDistinct("amt").alias("u")
    )
    bins = F.least(F.lit(largest), F.col("u"))
    bucket = F.greatest(F.lit(0), F.ceil((F.col("amt") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) - 1)
    rows = cards.select("card", "amt").join(span.where("n >= 2 AND hi > lo"), "card").withColumn("bucket", bucket)
    counts = rows.groupBy("card", "bucket", "n").agg(F.count(F.lit(1)).alias("k"))
    bits = counts.groupBy("card").agg(_bits(counts).alias("amount_entropy"))
    return span.select("card").join(bits, "card", "left").fillna(0.0, ["amount_entropy"])


def velocity_7d(cards: DataFrame) -> DataFrame:
    """Rows inside the week before the card's own last transaction."""
    top = cards.groupBy("card").agg(F.max("dt").alias("top"))
    return cards.join(top, "card").groupBy("card").agg(F.count_if(F.col("dt") > F.col("top") - WEEK).alias("tx_velocity_7d"))


def second_hop_fraud(cards: DataFrame) -> DataFrame:
    """Mean over a card's rows of whether any transaction at that address was fraud."""
    addr = cards.where("addr1 IS NOT NULL").groupBy("addr1").agg(F.max("is_fraud").alias("addr_fraud"))
    own = cards.groupBy("card", "addr1").agg(F.count(F.lit(1)).alias("k"))
    return own.join(addr, "addr1", "left").groupBy("card").agg(
        F.coalesce(F.sum(F.col("addr_fraud") * F.col("k")) / F.sum(F.when(F.col("addr_fraud").isNotNull(), F.col("k"))), F.lit(0.0)).alias("second_hop_fraud_rate")
    )


def node_features(cards: DataFrame) -> DataFrame:
    """Fifteen features, the fraud mark and the second-hop rate per card."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    lower = F.lower("device_type")
    wide = cards.groupBy("card").agg(
        F.avg(zero("d1")).alias("account_age_days"),
        F.avg("amt").alias("balance_mean"),
        F.coalesce(F.stddev_samp("amt"), F.lit(0.0)).alias("balance_std"),
        F.count("transaction_id").alias("tx_count"),
        F.max("is_fraud").alias("is_fraud"),
        clamp(F.countDistinct("addr1") / (F.count("transaction_id") + 1), 0, 1).alias("fan_out_ratio"),
        F.avg(F.coalesce((lower == "mobile").cast("double"), F.lit(0.0))).alias("device_mobile"),
        clamp(1 - F.countDistinct("device_type") / F.count(F.lit(1)), 0, 1).alias("device_consistency"),
        F.avg((zero("d1") + zero("d2") + zero("d3") + zero("d4") + zero("d5")) / 5.0).alias("d_gap_mean"),
        F.avg(_encode(F.trim(F.lower(F.coalesce("card4", F.lit("")))), CARD_RISK, OTHER_CARD)).alias("card_network_risk"),
        F.avg(_encode(F.coalesce("product", F.lit("")), PRODUCT_RISK, OTHER_PRODUCT)).alias("product_code_risk"),
        F.avg((zero("card3") > INTERNATIONAL_FLOOR).cast("double")).alias("international_flag"),
    )
    for part in (velocity_7d(cards), amount_entropy(cards), email_risk(cards), categorical_entropy(cards, "addr1", "addr_entropy"), second_hop_fraud(cards)):
        wide = wide.join(part, "card", "left")
    return wide.fillna(0)
