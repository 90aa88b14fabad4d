"""Registered queries over joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows as W
from ..operators import joins as J
from ..sources import adapters as A
from ..sources.datasets import account_facts
from .registry import query

RESIDENCE = """
SELECT d.txn_id, d.src AS account, d.epoch, max(c.epoch) AS credit_epoch, d.epoch - max(c.epoch) AS gap
FROM c_transfers d JOIN c_transfers c ON c.dst = d.src AND c.epoch <= d.epoch GROUP BY d.txn_id, d.src, d.epoch"""


@query("left_join_defaults", "2.3.1", """
SELECT a.account, a.bank, coalesce(l.is_mule, false) AS is_mule, coalesce(l.layer_index, -1) AS layer_index, coalesce(l.is_cashout_node, false) AS is_cashout_node
FROM c_accounts a LEFT JOIN c_labels l ON l.account = a.account""")
def left_join_defaults(spark, sf):
    return account_facts(A.accounts(spark, sf), A.labels(spark, sf)).select("account", "bank", "is_mule", "layer_index", "is_cashout_node")


@query("residence_asof", "2.3.2", RESIDENCE)
def residence_asof(spark, sf):
    return J.residence(A.transfers(spark, sf))


@query("forwarding_delay", "2.3.3", f"""
WITH r AS ({RESIDENCE}), s AS (SELECT account, list_sort(list(gap / 60.0::DOUBLE)) AS g, count(*) AS n FROM r GROUP BY account)
SELECT account, round((g[1 + CAST(floor((n - 1) * 0.5) AS BIGINT)] + g[1 + CAST(ceil((n - 1) * 0.5) AS BIGINT)]) / 2, 6) AS median_delay,
   round(g[1 + CAST(floor((n - 1) * 0.25 + 0.5) AS BIGINT)], 6) AS q25, round(g[1 + CAST(floor((n - 1) * 0.75 + 0.5) AS BIGINT)], 6) AS q75 FROM s""")
def forwarding_delay(spark, sf):
    d = J.forwarding_delay(A.transfers(spark, sf))
    return d.select("account", *[F.round(c, 6).alias(c) for c in ("median_delay", "q25", "q75")])


@query("foreign_account_features", "2.3.4", """
WITH o AS (SELECT src AS account, count(*) AS out_count, sum(amount) AS out_sum, avg(amount) AS out_mean, count(DISTINCT dst) AS out_degree, min(epoch) AS first_out, max(epoch) AS last_out FROM c_transfers GROUP BY src),
i AS (SELECT dst AS account, count(*) AS in_count, sum(amount) AS in_sum, count(DISTINCT src) AS in_degree, min(epoch) AS first_in, max(CASE WHEN txn_id % 9 = 0 THEN 1 ELSE 0 END) AS positive FROM c_transfers GROUP BY dst)
SELECT coalesce(o.account, i.account) AS account, coalesce(out_count, 0) AS out_count, coalesce(in_count, 0) AS in_count,
  round(coalesce(out_sum, 0), 2) AS out_sum, round(coalesce(in_sum, 0), 2) AS in_sum, round(coalesce(out_mean, 0), 4) AS out_mean,
  coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree,
  round(coalesce(out_sum, 0) / (coalesce(in_sum, 0) + 1), 6) AS forward_ratio,
  round((coalesce(first_out, 0) - coalesce(first_in, 0)) / 60.0::DOUBLE, 4) AS residence, coalesce(positive, 0) AS positive
FROM o FULL OUTER JOIN i ON o.account = i.account""")
def foreign_account_features(spark, sf):
    t = A.transfers(spark, sf).withColumn("is_sar", F.col("txn_id") % 9 == 0)
    f = W.foreign_features(t)
    return f.select("account", "out_count", "in_count", F.round("out_sum", 2).alias("out_sum"), F.round("in_sum", 2).alias("in_sum"),
                    F.round("out_mean", 4).alias("out_mean"), "out_degree", "in_degree", F.round("forward_ratio", 6).alias("forward_ratio"),
                    F.round("residence", 4).alias("residence"), "positive")


@query("semi_join_edges", "2.3.5", """
SELECT t.txn_id, t.src, t.dst, t.amount FROM c_transfers t WHERE t.src IN (SELECT account FROM c_labels WHERE is_mule) AND t.dst IN (SELECT account FROM c_cand)""")
def semi_join_edges(spark, sf):
    mules = A.labels(spark, sf).where("is_mule").select(F.col("account").alias("src"))
    cand = A.candidates(spark, sf).select(F.col("account").alias("dst"))
    return A.transfers(spark, sf).select("txn_id", "src", "dst", "amount").join(mules, "src", "left_semi").join(cand, "dst", "left_semi")


@query("anti_join_exits", "2.3.6", """
SELECT DISTINCT incident, dst AS account FROM c_case k WHERE dst NOT IN (SELECT account FROM c_accounts WHERE exit_kind <> '')
 AND NOT EXISTS (SELECT 1 FROM c_case s WHERE s.incident = k.incident AND s.src = k.dst)""")
def anti_join_exits(spark, sf):
    k = A.case_transfers(spark, sf)
    core = k.select("incident", F.col("src").alias("account"))
    return (k.select("incident", F.col("dst").alias("account")).distinct()
            .join(A.exits(spark, sf).select("account"), "account", "left_anti").join(core, ["incident", "account"], "left_anti"))


@query("endpoint_lookup", "2.3.7", """
SELECT count(*) AS pairs, count(*) FILTER (s.node IS NULL OR d.node IS NULL) AS skipped, CAST(sum(CASE WHEN s.is_fraud = 1 OR d.is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS actual_fraud
FROM c_transfers t LEFT JOIN (SELECT * FROM c_nodes WHERE node % 10 <> 9) s ON s.node = t.src LEFT JOIN (SELECT * FROM c_nodes WHERE node % 10 <> 9) d ON d.node = t.dst""")
def endpoint_lookup(spark, sf):
    j = J.endpoint_lookup(A.transfers(spark, sf).select("src", "dst"), A.nodes(spark, sf).where("node % 10 <> 9"), "is_fraud")
    s, d = F.col("src_is_fraud"), F.col("dst_is_fraud")
    return j.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(s.isNull() | d.isNull()).alias("skipped"), F.count_if((s == 1) | (d == 1)).alias("actual_fraud"))


@query("shared_infrastructure", "2.3.8", """
WITH v AS (SELECT account, 'd' || device AS v FROM c_accounts UNION ALL SELECT account, 'i' || ip FROM c_accounts),
g AS (SELECT v FROM v GROUP BY v HAVING count(*) BETWEEN 2 AND 25)
SELECT x.account AS a, y.account AS b, sum(2.5::DOUBLE) AS weight FROM v x JOIN v y ON x.v = y.v AND x.account < y.account WHERE x.v IN (SELECT v FROM g) GROUP BY ALL""")
def shared_infrastructure(spark, sf):
    return J.shared_infrastructure(A.accounts(spark, sf), ["device", "ip"], largest=25)


@query("cooccurrence_edges", "2.3.9", """
WITH v AS (SELECT 'a' || addr1 AS v, card, amt FROM c_cards WHERE addr1 IS NOT NULL UNION ALL SELECT 'c' || card1, card, amt FROM c_cards
  UNION ALL SELECT 'd' || device_info, card, amt FROM c_cards WHERE device_info IS NOT NULL AND lower(device_info) NOT IN ('windows', 'ios device', 'macos')),
f AS (SELECT v, card, sum(amt) AS flow FROM v GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY flow DESC, card) AS r FROM f),
m AS (SELECT v, avg(flow) AS amount FROM k WHERE r <= 20 GROUP BY v HAVING count(*) >= 2)
SELECT x.card AS source, y.card AS target, round(max(m.amount), 4) AS amount FROM k x JOIN k y ON x.v = y.v AND x.card <> y.card JOIN m ON m.v = x.v
WHERE x.r <= 20 AND y.r <= 20 GROUP BY ALL""")
def cooccurrence_edges(spark, sf):
    e = J.cooccurrence_edges(A.cards(spark, sf), ["addr1", "card1", "device_info"], largest=20, generic=("windows", "ios device", "macos"))
    return e.select("source", "target", F.round("amount", 4).alias("amount"))


@query("usable_edges", "2.3.10", """
SELECT DISTINCT i.incident, t.txn_id, t.src, t.dst, t.amount, t.epoch, t.channel FROM c_incidents i JOIN c_transfers t ON t.src = i.victim AND t.epoch BETWEEN i.t0 AND i.horizon""")
def usable_edges(spark, sf):
    start = A.incidents(spark, sf).select("incident", F.col("victim").alias("account"), F.col("t0").alias("arrival"), "horizon")
    return J.usable_edges(start, A.transfers(spark, sf), "horizon")


@query("intercepted_parcels", "2.3.11", """
WITH p AS (SELECT incident, txn_id AS parcel, src AS account, offset_sec // 60 AS departs FROM c_case),
f AS (SELECT incident, account, 5 + pos AS at_minute FROM c_decisions WHERE model = 2 AND pos <= 25)
SELECT p.incident, p.parcel, p.account, p.departs, f.at_minute FROM p JOIN f ON f.incident = p.incident AND f.account = p.account WHERE p.departs >= f.at_minute""")
def intercepted_parcels(spark, sf):
    from ..operators.ranking import top_k_policy
    parcels = A.case_transfers(spark, sf).select("incident", F.col("txn_id").alias("parcel"), F.col("src").alias("account"), F.floor(F.col("offset_sec") / 60).alias("departs"))
    freezes = top_k_policy(A.model_scores(spark, sf).where("model = 2")).select("incident", "account", (F.col("rank") + 5).alias("at_minute"))
    return J.intercepted(parcels, freezes).select("incident", "parcel", "account", "departs", "at_minute")


@query("shared_recipients", "2.3.12", """
WITH p AS (SELECT DISTINCT src, dst FROM c_transfers)
SELECT x.src AS a, y.src AS b, count(*) AS common FROM p x JOIN p y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL""")
def shared_recipients(spark, sf):
    return J.common_payees(A.transfers(spark, sf))


@query("truth_join", "2.3.13", """
SELECT d.incident, d.model, d.account, d.pos, coalesce(l.is_mule, false) AS is_mule, coalesce(l.layer_index, -1) AS layer_index
FROM c_decisions d LEFT JOIN c_labels l ON l.account = d.account WHERE d.pos <= 25""")
def truth_join(spark, sf):
    from ..operators.ranking import top_ranked
    d = top_ranked(A.model_scores(spark, sf), ["incident", "model"], [F.desc("score"), F.col("account")], 25, "pos")
    return J.truth_join(d, A.labels(spark, sf)).select("incident", "model", "account", "pos", "is_mule", "layer_index")


@query("watchlist_exposure", "2.3.14", """
WITH b AS (SELECT DISTINCT * FROM (SELECT src AS account, dst AS peer FROM c_transfers UNION ALL SELECT dst, src FROM c_transfers)),
w AS (SELECT account FROM c_labels WHERE is_mule AND ring_id <> 'RING-01')
SELECT account, count(*) AS neighbours, count(*) FILTER (peer IN (SELECT account FROM w)) AS known_neighbours,
  round(count(*) FILTER (peer IN (SELECT account FROM w)) / count(*)::DOUBLE, 6) AS known_share FROM b GROUP BY account""")
def watchlist_exposure(spark, sf):
    watch = A.labels(spark, sf).where("is_mule AND ring_id <> 'RING-01'").select("account")
    return J.watchlist_exposure(A.transfers(spark, sf), watch).withColumn("known_share", F.round("known_share", 6))


@query("node_profiles", "2.3.15", """
SELECT n.node, CASE WHEN node % 3 <> 0 THEN round(pagerank * 0.5, 6) END AS score,
  CASE WHEN node % 4 <> 0 THEN 'burst=' || printf('%.3f', fan_out_ratio) || ',velocity=' || printf('%.3f', risky_email) ELSE '' END AS attributions,
  CASE WHEN node % 5 <> 0 THEN 'risk ' || community ELSE '' END AS explanation FROM c_nodes n""")
def node_profiles(spark, sf):
    n = A.nodes(spark, sf)
    scores = n.where("node % 3 <> 0").select("node", F.round(F.col("pagerank") * 0.5, 6).alias("score"))
    att = n.where("node % 4 <> 0").selectExpr("node", "stack(2, 'burst', fan_out_ratio, 'velocity', risky_email) AS (feature, contribution)")
    why = n.where("node % 5 <> 0").select("node", F.concat(F.lit("risk "), F.col("community").cast("string")).alias("explanation"))
    return J.node_profiles(n, scores, att, why)


@query("graph_export", "2.3.16", """
SELECT src AS source, dst AS target, CASE WHEN txn_id % 8 = 0 THEN 0.0 ELSE amount END AS amount FROM c_transfers WHERE src % 10 <> 9 AND dst % 10 <> 9""")
def graph_export(spark, sf):
    links = A.transfers(spark, sf).select(F.col("src").alias("source"), F.col("dst").alias("target"),
                                          F.when(F.col("txn_id") % 8 == 0, "??").otherwise(F.col("amount").cast("string")).alias("amount"))
    return J.known_links(A.nodes(spark, sf).where("node % 10 <> 9"), links)
