"""Scoring rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import clamp

# Action table, thresholds, floors and blend weights.
ACTIONS = ("full_freeze", "outbound_hold", "step_up_verification")
HARM = {"full_freeze": 1.0, "outbound_hold": 0.45, "step_up_verification": 0.15}
EFFECT = {"full_freeze": 0.98, "outbound_hold": 0.88, "step_up_verification": 0.55}
ALLOW = (("full_freeze", 0.80), ("outbound_hold", 0.55), ("step_up_verification", 0.35))
CEILING, LEAST_ACTIVITY = 0.97, 0.05
AMOUNT_STEPS = ((100.0, 0.40), (500.0, 0.55), (2_000.0, 0.75), (10_000.0, 0.90), (100_000.0, 1.00), (1_000_000.0, 1.10))
AMOUNT_TOP, AMOUNT_NONE, KEEP = 1.20, 0.30, 0.35
AMOUNT_FLOORS = ((10_000_000.0, 0.72), (1_000_000.0, 0.60), (100_000.0, 0.45))
NEW_ACCOUNT_CAP, NEW_ACCOUNT_BASE = 0.75, 0.25
BLOCK, REVIEW = 0.75, 0.45
RISK_RULES = (
    ("fan_out_ratio", 0.7, "High fan-out: distributing funds to many accounts"),
    ("tx_velocity_7d", 10.0, "Burst activity: unusually high recent transaction volume"),
    ("reciprocity_score", 0.3, "Circular flows detected: money bouncing back"),
    ("ring_membership", 1.0, "Node participates in a known laundering ring"),
    ("community_fraud_rate", 0.3, "Embedded in a high-risk fraud community"),
    ("second_hop_fraud_rate", 0.4, "Two-hop neighbourhood has elevated fraud density"),
    ("risky_email", 0.5, "Associated with high-risk or anonymous email domain"),
    ("international_flag", 0.6, "High cross-border transaction ratio"),
    ("pagerank", 0.8, "High centrality: hub in transaction network"),
    ("in_out_ratio", 5.0, "Abnormal inflow vs outflow ratio"),
)
SMURFING = "Low amount diversity: possible smurfing pattern"
UNEXPLAINED = "Anomalous transaction graph pattern detected"
SIGNAL_TAGS = {
    "device_reuse_count": "DEVICE_REUSE_ACROSS_ACCOUNTS",
    "suspicious_neighbor_count": "SUSPICIOUS_NETWORK_CONNECTION",
    "ja3_reuse_count": "TLS_FINGERPRINT_REUSE",
    "velocity_score": "HIGH_TRANSACTION_VELOCITY",
    "burst_score": "BURST_TRANSACTION_PATTERN",
}
CHANNELS = ("UPI", "IMPS", "NEFT", "CARD", "ATM_WITHDRAWAL")


def pick(key: Column, table: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def innocence_cost(p: Column, weight: Column, action: Column) -> Column:
    """Cost of being wrong: confidence is capped and activity has a floor."""
    return (1 - F.least(p, F.lit(CEILING))) * F.greatest(weight, F.lit(LEAST_ACTIVITY)) * pick(action, HARM)


def allowed_actions(p: Column) -> Column:
    """Proportionate actions as an array, strongest first."""
    return F.filter(F.array(*[F.when(p >= floor, F.lit(a)) for a, floor in ALLOW]), lambda x: x.isNotNull())


def needs_second_approval(p: Column, cost: Column) -> Column:
    return (p < 0.90) | (cost > 0.05)


def amount_adjusted(risk: Column, amount: Column) -> Column:
    """Damp small amounts, lift large ones, keep a share of the base, apply floors."""
    amt = F.greatest(F.lit(0.0), amount)
    weight = F.when(amt <= 0, AMOUNT_NONE)
    for top, w in AMOUNT_STEPS:
        weight = weight.when(amt < top, w)
    blended = F.greatest(risk * KEEP, risk * weight.otherwise(AMOUNT_TOP))
    floor = None
    for at, f in AMOUNT_FLOORS:
        floor = F.when(amt >= at, f) if floor is None else floor.when(amt >= at, f)
    return clamp(F.greatest(blended, floor.otherwise(0.0)), 0, 1)


def risk_level(score: Column, threshold: float, as_int: bool = False) -> Column:
    names = (2, 1, 0) if as_int else ("HIGH", "MEDIUM", "LOW")
    return F.when(score >= min(0.95, threshold + 0.15), names[0]).when(score >= threshold, names[1]).otherwise(names[2])


def risk_factors(risk: Column, extra: Column | None = None) -> Column:
    """Messages of the rules a node trips, without repeats, in rule order."""
    hits = [F.when(F.col(c) > t, F.lit(m)) for c, t, m in RISK_RULES]
    hits.append(F.when((F.col("amount_entropy") > 0) & (F.col("amount_entropy") < 0.15), F.lit(SMURFING)))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    found = F.when((F.size(found) == 0) & (risk > 0.5), F.array(F.lit(UNEXPLAINED))).otherwise(found)
    if extra is not None:
        found = F.concat(found, extra)
    return F.array_distinct(found)


def signal_tags(factors: Column) -> Column:
    """Tags of the keys present in an attribution map."""
    return F.filter(F.array(*[F.when(F.map_contains_key(factors, k), F.lit(t)) for k, t in SIGNAL_TAGS.items()]), lambda x: x.isNotNull())


def rule_reasons(dormancy: Column, max_credit: Column, fanout: Column) -> Column:
    first = F.when((dormancy > 90) & (max_credit > 100_000), F.lit("dormant_then_large_credit"))
    return F.filter(F.array(first, F.when(fanout >= 5, F.lit("wide_fanout_in_10min"))), lambda x: x.isNotNull())


def rule_score(dormancy: Column, max_credit: Column, fanout: Column) -> Column:
    return F.when(F.size(rule_reasons(dormancy, max_credit, fanout)) > 0, 1.0).otherwise(0.0)


def encode_edge(amount: Column, delay: Column, night: Column, channel: Column) -> list[Column]:
    """log amount, log delay, night, then one column per channel."""
    return [
        F.log1p(F.greatest(amount, F.lit(0.0))).alias("log_amount"),
        F.log1p(F.greatest(delay, F.lit(0.0))).alias("log_delay"),
        night.cast("double").alias("night"),
        *[(channel == c).cast("double").alias(f"is_{c.lower()}") for c in CHANNELS],
    ]


# Products of features.
INTERACTIONS = {
    "comm_ring": ("community_fraud_rate_feat", "ring_membership_feat"),
    "comm_burst": ("community_fraud_rate_feat", "burst_score"),
    "comm_velocity": ("community_fraud_rate_feat", "velocity_score"),
    "neighbor_comm": ("suspicious_neighbor_count", "community_fraud_rate_feat"),
    "ip_comm": ("ip_reuse_count", "community_fraud_rate_feat"),
    "velocity_burst": ("velocity_score", "burst_score"),
}


def interactions() -> list[Column]:
    return [(F.col(a) * F.col(b)).alias(n) for n, (a, b) in INTERACTIONS.items()]


def behaviour_features(n24: Column, out24: Column, n7: Column, out7: Column, amount: Column) -> dict[str, Column]:
    """Velocity, burst and amount deviation, each in [0, 1], two decimals."""
    daily = F.when(n7 > 0, out7 / 7.0).otherwise(0.0)
    typical = F.when(n24 > 0, out24 / n24).otherwise(0.0)
    one = F.lit(1.0)
    return {
        "velocity": F.round(F.least(n24 / 10.0, one), 2),
        "burst": F.round(F.when(daily == 0, 0.0).otherwise(F.least(out24 / daily / 3.0, one)), 2),
        "deviation": F.round(F.when(typical == 0, 0.0).otherwise(F.least(F.abs(amount - typical) / typical, one)), 2),
    }


def fuse(gnn: Column, eif: Column, ja3: Column, velocity: Column, burst: Column, deviation: Column, connectivity: Column, two_hop: Column) -> dict[str, Column]:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    one = F.lit(1.0)
    behaviour = F.least(velocity * 0.3 + burst * 0.5 + deviation * 0.2, one)
    graph = F.least(connectivity * 0.6 + two_hop * 0.4, one)
    return {
        "behaviour_score": behaviour, "graph_score": graph,
        "risk": F.least(z(gnn) * 0.40 + z(eif) * 0.20 + behaviour * 0.25 + graph * 0.10 + z(ja3) * 0.05, one),
    }


def decision(risk: Column) -> Column:
    return F.when(risk >= BLOCK, "BLOCK").when(risk >= REVIEW, "REVIEW").otherwise("APPROVE")


def ensemble_risk(gnn: Column, eif: Column) -> Column:
    """Agreement of two models; a score within 0.01 of 0.89 is stale and ignored."""
    g, e = F.coalesce(gnn, F.lit(0.0)), F.coalesce(eif, F.lit(0.0))
    stale = gnn.isNull() | (F.abs(g - 0.89) < 0.01)
    risk = (
        F.when(stale, e).when((g >= 0.95) | (e >= 0.90), F.greatest(g, e))
        .when((g >= 0.75) & (e >= 0.40), F.lit(0.85)).when((g < 0.30) & (e < 0.30), F.least(g, e))
        .otherwise(g * 0.7 + e * 0.3)
    )
    return clamp(risk, 0, 1)


def blend_endpoints(src: Column, dst: Column) -> Column:
    return F.least(F.greatest(src * 0.80 + dst * 0.20, src, dst * 0.50), F.lit(1.0))


def blend_context(raw: Column, two_hop: Column, suspicious: Column, connectivity: Column, velocity: Column, burst: Column, device: Column, ip: Column) -> Column:
    """Model score mixed with context, only where any context is present."""
    unit = lambda c: clamp(c, 0, 1)
    tenth = lambda c: F.least(F.lit(1.0), c / 10.0)
    mixed = (
        raw * 0.68 + unit(two_hop) * 0.16 + tenth(suspicious) * 0.08 + unit(velocity) * 0.04 + unit(burst) * 0.02
        + tenth(device) * 0.01 + tenth(ip) * 0.01
    )
    has = (suspicious > 0) | (two_hop > 0) | (connectivity > 0) | (velocity > 0) | (burst > 0) | (device > 0) | (ip > 0)
    return F.when(has, clamp(mixed, 0, 1)).otherwise(raw)


def new_account_score(mean: Column, top: Column) -> Column:
    """Prior for an unseen account pulled toward its scored neighbours, capped."""
    near = clamp(mean * 0.20 + top * 0.10 + 0.70 * NEW_ACCOUNT_BASE, 0, 1)
    return F.least(F.when(mean.isNull(), F.lit(NEW_ACCOUNT_BASE)).otherwise(near), F.lit(NEW_ACCOUNT_CAP))


def quotient(num: Column, den: Column) -> Column:
    """Division of doubles as IEEE 754 has it: by zero it gives an infinity, or NaN for 0 / 0."""
    n, d = num.cast("double"), den.cast("double")
    return F.when(d != 0, F.try_divide(n, d)).when(d == 0, n * float("inf"))


def anomaly_features() -> list[Column]:
    """Eight features of the anomaly model from a node table.

    The burst of an account whose mean balance is -1 divides by zero: it is infinite, or NaN.
    """
    age = F.greatest(F.col("account_age_days"), F.lit(1))
    return [
        (F.col("tx_velocity_7d") / (age + 1)).alias("velocity_score"),
        quotient(F.col("balance_std"), F.col("balance_mean") + 1).alias("burst_score"),
        clamp(F.col("fan_out_ratio") * F.col("tx_count"), 0, 20).alias("suspicious_neighbor_count"),
        clamp(F.col("addr_entropy") * 3, 0, 10).alias("ip_reuse_count"),
        clamp(F.col("risky_email") * 5 + (1 - F.col("device_consistency")) * 3, 0, 10).alias("ja3_reuse_count"),
        clamp(F.col("community_fraud_rate"), 0, 1).alias("community_fraud_rate_feat"),
        clamp(F.col("ring_membership").cast("double"), 0, 1).alias("ring_membership_feat"),
        (F.col("pagerank") * 10000 + F.col("community_fraud_rate") * 5 + F.col("ring_membership") * 3).alias("network_risk_score"),
    ]


def additive_parts(devices: Column, velocity: Column, centrality: Column) -> dict[str, Column]:
    return {"device_part": devices * 10.0, "velocity_part": velocity * 100.0, "centrality_part": centrality * 200.0}
