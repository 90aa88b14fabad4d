"""The 37-column account matrix of every incident, as of its complaint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import flows as W
from . import graph as R
from .filters import visible_edges

# Column order of the matrix.
FEATURES = (
    "median_residence_minutes", "in_out_ratio_1h", "in_out_ratio_6h", "in_out_ratio_24h", "turnover_ratio",
    "outflow_within_10min_share", "max_fanout_10min", "in_degree", "out_degree", "fanout_ratio", "pagerank",
    "betweenness", "hops_from_victim", "hops_to_exit", "reciprocity", "dormancy_days", "account_age_days",
    "burstiness", "night_activity_share", "activity_span_hours", "structuring_band_share", "amount_cv",
    "round_amount_share", "log_max_credit", "log_total_out", "txn_count", "device_cluster_size", "ip_cluster_size",
    "recipient_jaccard_max", "same_window_openings", "device_peers_in_incident", "atm_value_share", "exchange_flag",
    "crossborder_flag", "exit_adjacent", "kyc_video_flag", "kyc_small_flag",
)
KEYS = ["incident", "account"]
ON = ["incident"]


def build_matrix(incidents: DataFrame, pool: DataFrame, transfers: DataFrame, accounts: DataFrame, exits: DataFrame, graph: bool = True) -> DataFrame:
    """One row per (incident, candidate), finite everywhere.

    ``pool``: incident, account. Nothing after the complaint is read. ``graph=False``
    leaves out the iterative columns (PageRank, betweenness, hops).
    """
    until = incidents.select("incident", F.col("complaint").alias("until"))
    edges = cut(visible_edges(transfers, pool, until).join(until, "incident"))
    plain = edges.drop("until")
    flows = W.ratios(W.flow_aggregate(plain, ON)).select(
        *KEYS, "in_degree", "out_degree", "fanout_ratio", "turnover_ratio", "activity_span_hours", "log_max_credit", "log_total_out", "txn_count"
    )
    member = pool.select(*KEYS)
    inside = plain.join(member.withColumnRenamed("account", "src"), ["incident", "src"], "left_semi").join(
        member.withColumnRenamed("account", "dst"), ["incident", "dst"], "left_semi"
    )
    days = F.floor(F.col("until") / 86400)
    mine = plain.join(member.withColumnRenamed("account", "src"), ["incident", "src"], "left_semi")
    parts = [
        flows,
        W.window_ratios(edges, F.col("until"), ON),
        W.residence_summary(plain, ON),
        W.peak_fanout(mine, ON),
        W.amount_features(plain, exits, ON),
        W.account_attributes(pool.join(until, "incident"), accounts, days, ON),
        R.reciprocity(inside, ON).select(*KEYS, "reciprocity"),
        R.recipient_jaccard(mine, ON),
        R.same_window_openings(inside, accounts, ON),
        W.device_peers(pool, accounts),
    ]
    if graph:
        links = cut(inside.select("incident", F.col("src").alias("account"), F.col("dst").alias("peer")).distinct())
        payers = mine.join(exits.select(F.col("account").alias("dst")), "dst", "left_semi").select("incident", F.col("src").alias("account")).distinct()
        parts += [
            R.pagerank(member, R.pair_weights(inside, ON), ON),
            R.betweenness(member, links, ON),
            R.hops_from(member, links, incidents.select("incident", F.col("victim").alias("account")), ON),
            R.hops_to_exit(member, links, payers, ON),
        ]
    rows = member
    for part in parts:
        rows = rows.join(part, KEYS, "left")
    rows = rows.join(W.cluster_sizes(accounts), "account", "left").fillna(1, ["device_cluster_size", "ip_cluster_size"])
    names = [f for f in FEATURES if f in rows.columns]
    finite = lambda c: F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return rows.select(*KEYS, *[finite(c).alias(c) for c in names])
