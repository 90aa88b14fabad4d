"""Parsing and sentence building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOCK = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{0,9})?)?"
ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def flexible_timestamp(text: Column) -> Column:
    """Instant, offset or zone-less text (read as UTC), space or T; null when none fits."""
    trimmed = F.trim(text)
    zoned = F.when(trimmed.rlike(ZONE), trimmed).otherwise(F.concat(F.rtrim(trimmed, F.lit(".")), F.lit("Z")))
    return F.when(trimmed.rlike(CLOCK + "(Z|[+-]\\d{2}:?\\d{2})?$"), zoned.try_cast("timestamp"))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "1.0", "true"), F.lit(False))


def identity_keys(ja3: Column, device: Column, country: Column) -> list[Column]:
    return [
        F.lower(F.trim(ja3)).alias("ja3"),
        F.sha2(F.coalesce(device, F.lit("unknown")), 256).alias("device_hash"),
        F.upper(country).alias("country"),
    ]


def resolve_prefix(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exact node id, else the first id that starts with the asked id and an underscore.

    ``asked``: id. The prefix candidates are reduced to one per prefix before the join.
    """
    head = F.split("node", "_")[0]
    first = nodes.where(F.col("node").contains("_")).groupBy(head.alias("id")).agg(F.min("node").alias("by_prefix"))
    exact = nodes.select(F.col("node").alias("id"), F.col("node").alias("exact"))
    return asked.join(exact, "id", "left").join(first, "id", "left").select("id", F.coalesce("exact", "by_prefix").alias("node"))


# unit -> (format, factor)
UNITS = {
    "number": ("%.0f", 1.0), "share": ("%.0f%%", 100.0), "ratio": ("%.2f", 1.0), "rank": ("%.4f", 1.0),
    "days": ("%.0f d", 1.0), "years": ("%.1f y", 1 / 365), "hours": ("%.1f h", 1.0), "minutes": ("%.0f min", 1.0),
}
# feature -> (what it measures, unit)
MEASURES = {
    "account_age_days": ("age of the account", "years"),
    "activity_span_hours": ("time from first to last transfer", "hours"),
    "amount_cv": ("variation of outgoing amounts", "ratio"),
    "atm_value_share": ("outgoing value taken as cash", "share"),
    "betweenness": ("shortest paths through it", "share"),
    "burstiness": ("burstiness", "ratio"),
    "device_cluster_size": ("accounts on the device", "number"),
    "device_peers_in_incident": ("accounts on the device within the incident", "number"),
    "dormancy_days": ("idle time before the incident", "days"),
    "fanout_ratio": ("payees per payer", "ratio"),
    "hops_from_victim": ("distance to the victim", "number"),
    "hops_to_exit": ("distance to an exit", "number"),
    "in_degree": ("payers", "number"),
    "in_out_ratio_1h": ("outflow over inflow, 1 h", "ratio"),
    "in_out_ratio_6h": ("outflow over inflow, 6 h", "ratio"),
    "in_out_ratio_24h": ("outflow over inflow, 24 h", "ratio"),
    "ip_cluster_size": ("accounts on the network prefix", "number"),
    "max_fanout_10min": ("payees in its busiest ten minutes", "number"),
    "median_residence_minutes": ("median time money stays", "minutes"),
    "night_activity_share": ("transfers at night", "share"),
    "out_degree": ("payees", "number"),
    "outflow_within_10min_share": ("outgoing transfers within ten minutes of a credit", "share"),
    "pagerank": ("pagerank", "rank"),
    "recipient_jaccard_max": ("overlap of payees with its nearest account", "share"),
    "reciprocity": ("partners that pay and are paid", "share"),
    "round_amount_share": ("round amounts", "share"),
    "same_window_openings": ("partners opened at about the same time", "number"),
    "structuring_band_share": ("transfers just under the reporting limit", "share"),
    "turnover_ratio": ("outflow over inflow", "share"),
    "txn_count": ("transfers", "number"),
}
# features that are logarithms of an amount, and marks that hold or don't
LOGARITHMS = {"log_max_credit": "largest credit", "log_total_out": "total outflow"}
MARKS = {
    "crossborder_flag": "payments abroad", "exchange_flag": "payments to an exchange", "exit_adjacent": "payments straight to an exit",
    "kyc_small_flag": "reduced identity check", "kyc_video_flag": "identity check by video",
}


def phrase(feature: Column, value: Column) -> Column:
    """One attribution as "measure: value unit"; a mark is yes or no.

    An unknown feature is named by its column, underscores as spaces, with two digits.
    """
    out = F.when(F.lit(False), F.lit(""))
    for name, (label, unit) in MEASURES.items():
        form, factor = UNITS[unit]
        out = out.when(feature == name, F.concat(F.lit(f"{label}: "), F.format_string(form, value * factor)))
    for name, label in LOGARITHMS.items():
        out = out.when(feature == name, F.concat(F.lit(f"{label}: "), F.format_string("%.0f", F.expm1(value))))
    for name, label in MARKS.items():
        out = out.when(feature == name, F.concat(F.lit(f"{label}: "), F.when(value > 0, "yes").otherwise("no")))
    return out.otherwise(F.concat(F.translate(feature, "_", " "), F.lit(": "), F.format_string("%.2f", value)))


def reason_codes(attributions: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Sentences of the k strongest raising attributions of each account."""
    from ..operators.ranking import top_ranked

    return _spoken(top_ranked(attributions, keys, [F.desc(F.abs("contribution")), F.col("feature")], k), keys)


def reason_codes_of(rows: DataFrame, keys: list[str], parts: Column, k: int = 3) -> DataFrame:
    """The same where a row holds all attributions of its account. ``parts``: array of feature, value, contribution."""
    from ..operators.ranking import strongest

    return _spoken(strongest(rows, keys, parts, k), keys)


def _spoken(top: DataFrame, keys: list[str]) -> DataFrame:
    return top.where("contribution > 0").select(*keys, "rank", phrase(F.col("feature"), F.col("value")).alias("reason"))
