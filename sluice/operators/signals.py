"""Six-signal account scoring as of an explicit moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import clamp, share

# Signal weights, segment expectations, segment codes, thresholds.
WEIGHTS = {"S1": 20.0, "S2": 30.0, "S3": 14.0, "S4": 14.0, "S5": 12.0, "S6": 10.0}
SEGMENT_EXPECTED = {"salary": 150_000.0, "retail": 80_000.0, "student": 30_000.0, "business": 1_500_000.0, "senior": 60_000.0}
SEGMENT_CODES = {"salary": 0.0, "retail": 1.0, "student": 2.0, "business": 3.0, "senior": 4.0}
OTHER_EXPECTED, OTHER_CODE = 80_000.0, 1.0
SUB_LOW, SUB_HIGH = 25_000.0, 50_000.0
BANDS = (("IMMINENT", 95.0), ("CRITICAL", 85.0), ("HOT", 70.0), ("WARMING", 55.0))
TIERS = {"IMMINENT": 6, "CRITICAL": 5, "HOT": 3, "WARMING": 2, "CLEAN": 0}
STATUSES = {"IMMINENT": "FROZEN", "CRITICAL": "RESTRICTED", "HOT": "KYC_HOLD", "WARMING": "WATCH", "CLEAN": "ACTIVE"}
SLA_MINUTES = {"IMMINENT": 30, "CRITICAL": 120, "HOT": 1440, "WARMING": 2880, "CLEAN": 2880}
HELD = ("FROZEN", "RESTRICTED", "KYC_HOLD")
COLUMNS = ("s1_velocity", "s2_round_trip", "s3_structuring", "s4_dormant_device", "s5_profile_mismatch", "s6_sim_swap")


def choose(key: Column, table: dict, default) -> Column:
    """A literal lookup as one CASE expression."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def band_for(score: Column) -> Column:
    out = None
    for name, floor in BANDS:
        out = F.when(score >= floor, name) if out is None else out.when(score >= floor, name)
    return out.otherwise("CLEAN")


def response_tier(band: Column) -> Column:
    return choose(band, TIERS, 0)


def recommended_status(band: Column) -> Column:
    return choose(band, STATUSES, "ACTIVE")


def sla_deadline(band: Column, at: Column, existing: Column | None = None) -> Column:
    due = at + choose(band, SLA_MINUTES, 2880) * 60
    return due if existing is None else F.least(due, existing)


def account_legs(transfers: DataFrame) -> DataFrame:
    """Both sides of every transfer: account, direction, counterparty, amount, epoch."""
    legs = F.explode(
        F.array(
            F.struct(F.col("src").alias("account"), F.lit("OUT").alias("direction"), F.col("dst").alias("peer")),
            F.struct(F.col("dst").alias("account"), F.lit("IN").alias("direction"), F.col("src").alias("peer")),
        )
    ).alias("leg")
    return transfers.select(legs, "amount", "epoch").select("leg.*", "amount", "epoch")


def signal_features(profiles: DataFrame, legs: DataFrame, as_of: Column, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """The 23 features per account from legs at or before ``as_of``.

    ``profiles``: keys, segment, last_active, opened_at (seconds), n_devices,
    sim_swaps_72h, new_device (boolean). Aggregation is partial before the shuffle.
    """
    out, inn = F.col("direction") == "OUT", F.col("direction") == "IN"
    amount = F.col("amount")
    sums = (
        legs.where(F.col("epoch") <= as_of)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("tx_count"),
            F.count_if(out).alias("sent_count"),
            F.count_if(inn).alias("recv_count"),
            F.sum(F.when(out, amount)).alias("sent_sum"),
            F.sum(F.when(inn, amount)).alias("recv_sum"),
            F.max(F.when(out, amount)).alias("sent_max"),
            F.max(F.when(inn, amount)).alias("recv_max"),
            F.count_if((amount >= SUB_LOW) & (amount < SUB_HIGH)).alias("sub_threshold_count"),
            F.count_if(F.col("epoch") > as_of - 48 * 3600).alias("n48"),
        )
    )
    counted = ["tx_count", "sent_count", "recv_count", "sent_sum", "recv_sum", "sent_max", "recv_max", "sub_threshold_count", "n48"]
    rows = profiles.join(sums, list(keys), "left").fillna(0, counted)
    ratio = F.least(F.lit(1.0), share(F.col("sent_sum"), F.col("recv_sum")))
    dormant = F.greatest(F.lit(0.0), (as_of - F.col("last_active")) / 86400.0)
    load = (F.col("sent_sum") + F.col("recv_sum")) / choose(F.col("segment"), SEGMENT_EXPECTED, OTHER_EXPECTED)
    return rows.select(
        *keys,
        clamp((F.col("n48") - 3) / 12.0, 0, 1).alias("s1_velocity"),
        F.when(F.col("recv_sum") <= 0, 0.0).when(ratio > 0.5, (ratio - 0.5) / 0.5).otherwise(0.0).alias("s2_round_trip"),
        clamp((F.col("sub_threshold_count") - 2) / 6.0, 0, 1).alias("s3_structuring"),
        F.when(F.col("new_device") & (dormant > 90), F.least(F.lit(1.0), dormant / 180 + 0.3)).otherwise(0.0).alias("s4_dormant_device"),
        clamp((load - 1.5) / 4.5, 0, 1).alias("s5_profile_mismatch"),
        F.when(F.col("sim_swaps_72h") >= 2, F.least(F.lit(1.0), F.col("sim_swaps_72h") * 0.35)).otherwise(0.0).alias("s6_sim_swap"),
        "tx_count", "sent_count", "recv_count", "sent_sum", "recv_sum",
        share(F.col("sent_sum"), F.col("sent_count")).alias("sent_mean"),
        share(F.col("recv_sum"), F.col("recv_count")).alias("recv_mean"),
        "sent_max", "recv_max",
        share(F.col("sent_sum"), F.col("recv_sum")).alias("round_trip_ratio"),
        (F.col("recv_sum") - F.col("sent_sum")).alias("net_flow"),
        "sub_threshold_count", "n_devices", "sim_swaps_72h",
        dormant.alias("dormant_days"),
        F.greatest(F.lit(0.0), (as_of - F.col("opened_at")) / 86400.0).alias("account_age_days"),
        choose(F.col("segment"), SEGMENT_CODES, OTHER_CODE).alias("segment_code"),
    )


def weighted_score(features: DataFrame, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """Score, fired signals in code order, and contributions largest first."""
    parts = list(zip(WEIGHTS.items(), COLUMNS))
    total = sum((F.col(c) * w for (_, w), c in parts), F.lit(0.0))
    fired = F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(code)) for (code, _), c in parts]), lambda x: x.isNotNull())
    contributions = F.filter(
        F.array(*[
            F.when(F.col(c) > 0, F.struct((-F.round(F.col(c) * w, 2)).alias("neg"), F.lit(code).alias("code")))
            for (code, w), c in parts
        ]),
        lambda x: x.isNotNull(),
    )
    return features.select(
        *keys,
        F.round(F.least(F.lit(100.0), total), 2).alias("score"),
        F.array_join(fired, ",").alias("fired"),
        F.array_join(F.transform(F.array_sort(contributions), lambda x: x["code"]), ",").alias("ranked"),
    )


def fold_taint(scores: DataFrame, taint: DataFrame, status: DataFrame) -> DataFrame:
    """Score plus network taint, then band, tier and status unless already held."""
    total = F.round(F.least(F.lit(100.0), F.col("score") + F.coalesce("taint", F.lit(0.0))), 2)
    rows = scores.join(taint, "account", "left").join(status, "account", "left").withColumn("final_score", total)
    band = band_for(F.col("final_score"))
    return rows.select(
        "account", "final_score",
        (F.coalesce("taint", F.lit(0.0)) > 0).alias("net_fired"),
        band.alias("severity"),
        response_tier(band).alias("tier"),
        F.when(F.col("status").isin(*HELD), F.col("status")).otherwise(recommended_status(band)).alias("status"),
    )
