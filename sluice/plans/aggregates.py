"""Registered queries over aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cards as C
from ..operators import cases as K
from ..operators import evaluation as E
from ..operators import flows as W
from ..operators.signals import account_legs
from ..sources import adapters as A
from .joining import RESIDENCE
from .registry import query
from .views import AS_OF, AS_OF_DAY


def rounded(df, digits, *names):
    names = set(names)
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


FLOWS = """
SELECT coalesce(o.account, i.account) AS account, coalesce(out_value, 0) AS out_value, coalesce(out_count, 0) AS out_count, coalesce(out_degree, 0) AS out_degree,
  first_out, last_out, coalesce(in_value, 0) AS in_value, coalesce(max_credit, 0) AS max_credit, coalesce(in_count, 0) AS in_count, coalesce(in_degree, 0) AS in_degree, first_in
FROM (SELECT src AS account, sum(amount) AS out_value, count(*) AS out_count, count(DISTINCT dst) AS out_degree, min(epoch) AS first_out, max(epoch) AS last_out FROM c_transfers GROUP BY src) o
FULL OUTER JOIN (SELECT dst AS account, sum(amount) AS in_value, max(amount) AS max_credit, count(*) AS in_count, count(DISTINCT src) AS in_degree, min(epoch) AS first_in FROM c_transfers GROUP BY dst) i ON i.account = o.account"""


@query("flow_aggregate", "2.4.1", f"""
SELECT account, round(out_value, 2) AS out_value, out_count, out_degree, first_out, last_out, round(in_value, 2) AS in_value, max_credit, in_count, in_degree, first_in,
  round(ln(1 + out_value), 6) AS log_total_out, round(ln(1 + max_credit), 6) AS log_max_credit, round(coalesce((last_out - first_out) / 3600.0::DOUBLE, 0), 6) AS activity_span_hours, out_count + in_count AS txn_count
FROM ({FLOWS})""")
def flow_aggregate(spark, sf):
    f = W.flow_aggregate(A.transfers(spark, sf))
    return rounded(rounded(f, 2, "out_value", "in_value"), 6, "log_total_out", "log_max_credit", "activity_span_hours")


@query("turnover_ratios", "2.4.2", f"""
SELECT account, round(out_value / greatest(in_value, 1), 6) AS turnover_ratio, round(out_degree / greatest(in_degree, 1)::DOUBLE, 6) AS fanout_ratio FROM ({FLOWS})""")
def turnover_ratios(spark, sf):
    return rounded(W.ratios(W.flow_aggregate(A.transfers(spark, sf))), 6, "turnover_ratio", "fanout_ratio").select("account", "turnover_ratio", "fanout_ratio")


END = AS_OF - 86400 * 5


@query("window_ratios", "2.4.3", f"""
WITH l AS (SELECT * FROM c_legs WHERE epoch >= {END} - 86400 AND epoch <= {END})
SELECT account, {', '.join(f"round(coalesce(sum(amount) FILTER (direction = 'OUT' AND epoch >= {END} - {h * 3600}), 0) / greatest(coalesce(sum(amount) FILTER (direction = 'IN' AND epoch >= {END} - {h * 3600}), 0), 1), 6) AS in_out_ratio_{h}h" for h in (1, 6, 24))}
FROM l GROUP BY account""")
def window_ratios(spark, sf):
    t = A.transfers(spark, sf).where(F.col("epoch") <= END)
    return rounded(W.window_ratios(t, F.lit(END)), 6, "in_out_ratio_1h", "in_out_ratio_6h", "in_out_ratio_24h")


@query("residence_summary", "2.4.4", f"""
WITH r AS ({RESIDENCE})
SELECT account, round(median(gap / 60.0::DOUBLE), 6) AS median_residence_minutes, round(avg(CASE WHEN gap <= 600 THEN 1.0 ELSE 0.0 END), 6) AS outflow_within_10min_share,
  round(coalesce(CASE WHEN avg(gap) > 0 THEN var_samp(gap / 60.0::DOUBLE) / avg(gap / 60.0::DOUBLE) END, 0), 4) AS burstiness FROM r GROUP BY account""")
def residence_summary(spark, sf):
    r = W.residence_summary(A.transfers(spark, sf))
    return rounded(rounded(r, 6, "median_residence_minutes", "outflow_within_10min_share"), 4, "burstiness")


@query("amount_features", "2.4.5", """
SELECT src AS account, round(avg(CASE WHEN amount BETWEEN 45000 AND 49900 THEN 1.0 ELSE 0.0 END), 6) AS structuring_band_share,
  round(avg(CASE WHEN amount % 1000 = 0 THEN 1.0 ELSE 0.0 END), 6) AS round_amount_share,
  round(avg(CASE WHEN (epoch % 86400) // 3600 >= 23 OR (epoch % 86400) // 3600 < 5 THEN 1.0 ELSE 0.0 END), 6) AS night_activity_share,
  round(coalesce(sum(amount) FILTER (channel = 'ATM_WITHDRAWAL'), 0) / sum(amount), 6) AS atm_value_share,
  round(coalesce(stddev_samp(amount) / avg(amount), 0), 6) AS amount_cv,
  max(CASE WHEN dst % 25 = 7 THEN 1.0 ELSE 0.0 END) AS exit_adjacent, max(CASE WHEN dst % 25 = 7 AND dst % 3 = 1 THEN 1.0 ELSE 0.0 END) AS exchange_flag,
  max(CASE WHEN dst % 25 = 7 AND dst % 3 = 2 THEN 1.0 ELSE 0.0 END) AS crossborder_flag FROM c_transfers GROUP BY src""")
def amount_features(spark, sf):
    f = W.amount_features(A.transfers(spark, sf), A.exits(spark, sf))
    return rounded(f, 6, "structuring_band_share", "round_amount_share", "night_activity_share", "atm_value_share", "amount_cv")


@query("account_attributes", "2.4.6", f"""
SELECT account, CAST({AS_OF_DAY} - open_day AS DOUBLE) AS account_age_days, CAST({AS_OF_DAY} - prior_day AS DOUBLE) AS dormancy_days,
  CASE WHEN kyc_tier = 'video' THEN 1.0 ELSE 0.0 END AS kyc_video_flag, CASE WHEN kyc_tier = 'small' THEN 1.0 ELSE 0.0 END AS kyc_small_flag FROM c_accounts""")
def account_attributes(spark, sf):
    a = A.accounts(spark, sf)
    return W.account_attributes(a.select("account"), a, F.lit(AS_OF_DAY))


@query("cluster_sizes", "2.4.7", """
SELECT account, count(*) OVER (PARTITION BY device) AS device_cluster_size, count(*) OVER (PARTITION BY ip) AS ip_cluster_size FROM c_accounts""")
def cluster_sizes(spark, sf):
    return W.cluster_sizes(A.accounts(spark, sf))


@query("device_peers", "2.4.8", """
SELECT c.incident, c.account, count(*) OVER (PARTITION BY c.incident, a.device) - 1 AS device_peers_in_incident FROM c_cand c JOIN c_accounts a ON a.account = c.account""")
def device_peers(spark, sf):
    return W.device_peers(A.candidates(spark, sf), A.accounts(spark, sf))


@query("activity_weight", "2.4.9", f"""
WITH m AS (SELECT c.incident, c.account, CAST({AS_OF_DAY} - a.open_day AS DOUBLE) AS age, CAST(f.in_degree AS DOUBLE) AS ind, ln(1 + f.out_value) AS lo
  FROM c_cand c JOIN c_accounts a ON a.account = c.account JOIN ({FLOWS}) f ON f.account = c.account),
q AS (SELECT incident, quantile_cont(age, 0.95) AS qa, quantile_cont(ind, 0.95) AS qi, quantile_cont(lo, 0.95) AS ql FROM m GROUP BY incident)
SELECT m.incident, account, round(0.25 + 0.75 * (0.4 * greatest(0, least(1, age / greatest(qa, 1e-6))) + 0.35 * greatest(0, least(1, ind / greatest(qi, 1e-6))) + 0.25 * greatest(0, least(1, lo / greatest(ql, 1e-6)))), 6) AS activity_weight
FROM m JOIN q ON q.incident = m.incident""")
def activity_weight(spark, sf):
    a = A.accounts(spark, sf)
    m = (A.candidates(spark, sf).join(W.flow_aggregate(A.transfers(spark, sf)).select("account", "in_degree", "log_total_out"), "account")
         .join(W.account_attributes(a.select("account"), a, F.lit(AS_OF_DAY)).select("account", "account_age_days"), "account"))
    return rounded(W.activity_weight(m, ["incident"]), 6, "activity_weight")


@query("population_deviation", "2.4.10", f"""
WITH l AS (UNPIVOT (SELECT account, CAST(out_value AS DOUBLE) AS out_value, CAST(in_degree AS DOUBLE) AS in_degree, CAST(out_count AS DOUBLE) AS out_count, CAST(max_credit AS DOUBLE) AS max_credit FROM ({FLOWS})) ON out_value, in_degree, out_count, max_credit INTO NAME feature VALUE value),
m AS (SELECT feature, median(value) AS mid FROM l GROUP BY feature),
d AS (SELECT l.feature, median(abs(value - mid)) AS mad FROM l JOIN m ON m.feature = l.feature GROUP BY l.feature)
SELECT account, l.feature, round(greatest(-6, least(6, (value - mid) / greatest(1.4826 * mad, 1e-6))), 6) AS deviation FROM l JOIN m ON m.feature = l.feature JOIN d ON d.feature = l.feature""")
def population_deviation(spark, sf):
    f = W.flow_aggregate(A.transfers(spark, sf))
    return rounded(W.deviations(f, [], ["out_value", "in_degree", "out_count", "max_credit"]), 6, "deviation")


@query("dataset_summary", "2.4.11", """
SELECT 'totals' AS section, unnest(['transactions', 'total_amount', 'first_epoch', 'last_epoch']) AS item, unnest([count(*)::DOUBLE, round(sum(amount), 2), min(epoch)::DOUBLE, max(epoch)::DOUBLE]) AS value FROM c_transfers
UNION ALL SELECT 'totals', unnest(['accounts', 'banks', 'exits']), unnest([count(*)::DOUBLE, count(DISTINCT bank)::DOUBLE, (count(*) FILTER (exit_kind <> ''))::DOUBLE]) FROM c_accounts
UNION ALL SELECT 'totals', unnest(['mules', 'rings']), unnest([(count(*) FILTER (is_mule))::DOUBLE, (count(DISTINCT ring_id) FILTER (is_mule))::DOUBLE]) FROM c_labels
UNION ALL SELECT 'archetype', archetype, count(*)::DOUBLE FROM c_accounts GROUP BY archetype
UNION ALL SELECT 'channel', channel, count(*)::DOUBLE FROM c_transfers GROUP BY channel
UNION ALL SELECT 'hour', CAST((epoch % 86400) // 3600 AS VARCHAR), count(*)::DOUBLE FROM c_transfers GROUP BY 2""")
def dataset_summary(spark, sf):
    return W.dataset_summary(A.transfers(spark, sf), A.accounts(spark, sf), A.labels(spark, sf))


RING_SQL = """
WITH m AS (SELECT l.ring_id, l.account, l.layer_index, l.is_cashout_node, l.typology, a.bank, a.district, a.device, a.open_day - a.prior_day AS dormancy
           FROM {labels} l JOIN {accounts} a ON a.account = l.account WHERE l.is_mule),
f AS (SELECT m.ring_id, sum(t.amount) AS flow, count(*) AS moves FROM {transfers} t JOIN m ON t.src = m.account GROUP BY m.ring_id)
SELECT m.ring_id, max(m.typology) AS typology, count(*) AS mules, count(DISTINCT m.bank) AS banks, count(DISTINCT m.district) AS districts,
       count(DISTINCT m.device) AS devices, max(m.layer_index) AS depth, count(*) FILTER (WHERE m.is_cashout_node) AS cashout_nodes,
       CAST(median(m.dormancy) AS DOUBLE) AS median_dormancy, round(coalesce(max(f.flow), 0), 2) AS flow, coalesce(max(f.moves), 0) AS moves, {banks} AS bank_list
FROM m LEFT JOIN f ON f.ring_id = m.ring_id GROUP BY m.ring_id"""


@query("ring_summary", "2.4.12", RING_SQL.format(labels="c_labels", accounts="c_accounts", transfers="c_transfers",
       banks="(SELECT string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) FROM (SELECT DISTINCT x.bank AS b FROM m x WHERE x.ring_id = m.ring_id))"))
def ring_summary(spark, sf):
    for name, df in (("mule_labels", A.labels(spark, sf)), ("accounts", A.accounts(spark, sf)), ("transfers", A.transfers(spark, sf))):
        df.createOrReplaceTempView(name)
    return spark.sql(RING_SQL.format(labels="mule_labels", accounts="accounts", transfers="transfers",
                                     banks="array_join(transform(sort_array(collect_set(m.bank)), b -> CAST(b AS string)), ',')"))


@query("own_balances", "2.4.13", """
SELECT a.account, round(greatest(500, least(2000000, coalesce(sum(CASE direction WHEN 'IN' THEN l.amount ELSE -l.amount END), 0))), 2) AS own_balance
FROM c_accounts a LEFT JOIN c_legs l ON l.account = a.account GROUP BY a.account""")
def own_balances(spark, sf):
    return W.own_balances(A.transfers(spark, sf), A.accounts(spark, sf))


BEHAVIOUR_SQL = f"""
WITH r AS ({RESIDENCE}), s AS (SELECT account, list_sort(list(gap / 60.0::DOUBLE)) AS g, count(*) AS n FROM r GROUP BY account),
d AS (SELECT account, (g[1 + CAST(floor((n - 1) * 0.5) AS BIGINT)] + g[1 + CAST(ceil((n - 1) * 0.5) AS BIGINT)]) / 2 AS mid, g[1 + CAST(floor((n - 1) * 0.25 + 0.5) AS BIGINT)] AS q25, g[1 + CAST(floor((n - 1) * 0.75 + 0.5) AS BIGINT)] AS q75 FROM s),
o AS (SELECT src AS account, count(*) AS oc, sum(amount) AS ov, coalesce(sum(amount) FILTER (dst % 25 = 7), 0) AS ev FROM c_transfers GROUP BY src),
i AS (SELECT dst AS account, count(*) AS ic FROM c_transfers GROUP BY dst)
SELECT o.account, round(greatest(0.05, least(0.97, oc / greatest(coalesce(ic, 1), 1)::DOUBLE)), 6) AS forward_prob, round(greatest(0.5, least(720, coalesce(mid, 60))), 6) AS delay_minutes,
  round(greatest(0.5, least(360, coalesce(abs(q75 - q25) / 2, 30))), 6) AS delay_spread, CAST(greatest(1, least(16, round_even(oc / greatest(coalesce(ic, 1), 1)::DOUBLE, 0))) AS INTEGER) AS split_count, round(ev / ov, 6) AS exit_share
FROM o LEFT JOIN i ON i.account = o.account LEFT JOIN d ON d.account = o.account"""


@query("behaviour_fit", "2.4.14", BEHAVIOUR_SQL)
def behaviour_fit(spark, sf):
    return rounded(W.behaviour(A.transfers(spark, sf), A.exits(spark, sf)), 6, "forward_prob", "delay_minutes", "delay_spread", "exit_share")


@query("recipient_weights", "2.4.14", """
SELECT src AS account, dst, round(sum(amount), 2) AS weight FROM c_transfers WHERE dst % 25 <> 7 GROUP BY ALL""")
def recipient_weights(spark, sf):
    return rounded(W.recipient_weights(A.transfers(spark, sf), A.exits(spark, sf)), 2, "weight")


@query("display_features", "2.4.15", f"""
WITH f AS ({FLOWS}), r AS ({RESIDENCE}), rs AS (SELECT account, median(gap / 60.0::DOUBLE) AS med FROM r GROUP BY account),
b AS (SELECT src AS account, avg(CASE WHEN amount BETWEEN 45000 AND 49900 THEN 1.0 ELSE 0.0 END) AS band FROM c_transfers GROUP BY src),
p AS (SELECT incident, dst AS account, arg_min(src, offset_sec * 1000000 + txn_id) AS parent, min(epoch) AS credit_epoch FROM c_case GROUP BY incident, dst),
e AS (SELECT src, dst, min(epoch) AS first_epoch FROM c_transfers GROUP BY ALL),
ds AS (SELECT account, count(*) OVER (PARTITION BY device) AS dn, count(*) OVER (PARTITION BY ip) AS ipn FROM c_accounts)
SELECT c.incident, c.account, round(greatest(0, least(1, f.out_value / greatest(f.in_value, 1))), 4) AS pass_through_ratio, round(coalesce(rs.med, 0) * 60, 1) AS median_hold_seconds,
 round(CAST({AS_OF_DAY} - a.prior_day AS DOUBLE), 1) AS dormancy_days_before, f.in_degree AS inbound_fanin, f.out_degree AS outbound_fanout, ds.dn AS device_shared_count, ds.ipn AS ip_shared_count,
 round(greatest(0, least(1, coalesce(b.band, 0))), 4) AS structuring_score, CASE WHEN p.parent IS NOT NULL AND p.parent % 8 <> c.account % 8 THEN 1 ELSE 0 END AS cross_bank_hops,
 round(CAST({AS_OF_DAY} - a.open_day AS DOUBLE), 1) AS account_age_days, a.kyc_tier IN ('small', 'none') AS kyc_mismatch,
 round(least(525600, coalesce(greatest(0, (p.credit_epoch - e.first_epoch) / 60.0::DOUBLE), 0)), 1) AS beneficiary_added_minutes_before
FROM c_cand c JOIN c_accounts a ON a.account = c.account JOIN f ON f.account = c.account LEFT JOIN rs ON rs.account = c.account LEFT JOIN b ON b.account = c.account
LEFT JOIN p ON p.incident = c.incident AND p.account = c.account LEFT JOIN e ON e.src = p.parent AND e.dst = c.account JOIN ds ON ds.account = c.account""")
def display_features(spark, sf):
    t, a = A.transfers(spark, sf), A.accounts(spark, sf)
    m = (A.candidates(spark, sf).join(W.ratios(W.flow_aggregate(t)), "account").join(W.residence_summary(t), "account", "left")
         .join(W.amount_features(t, A.exits(spark, sf)).select("account", "structuring_band_share"), "account", "left")
         .join(W.cluster_sizes(a), "account").join(W.account_attributes(a.select("account"), a, F.lit(AS_OF_DAY)), "account")
         .fillna(0.0, ["median_residence_minutes", "structuring_band_share"]))
    rows = A.case_transfers(spark, sf)
    first = K.first_arrival(rows).join(A.incidents(spark, sf).select("incident", "t0"), "incident")
    path = first.select("incident", "account", (F.col("parent") % 8 != F.col("account") % 8).cast("int").alias("crossings"),
                        F.col("parent").alias("from_account"), (F.col("t0") + F.col("arrival")).alias("credit_epoch"))
    return W.display_features(m, path, t, a)


RISKY = "('" + "','".join(C.RISKY_DOMAINS) + "')"
FREE = "('" + "','".join(C.FREE_DOMAINS) + "')"
EMAIL_SQL = f"""
SELECT card, avg(CASE WHEN dom IN {RISKY} THEN 1.0 ELSE 0.0 END) AS r, avg(CASE WHEN dom IN {FREE} THEN 1.0 ELSE 0.0 END) AS f
FROM (SELECT card, trim(lower(list_last(string_split(coalesce(email, 'unknown'), '@')))) AS dom FROM c_cards) GROUP BY card"""
AMOUNT_ENTROPY_SQL = """
SELECT s.card, coalesce(b.bits, 0) AS amount_entropy FROM (SELECT card, min(amt) AS lo, max(amt) AS hi, count(*) AS n, least(20, count(DISTINCT amt)) AS bins FROM c_cards GROUP BY card) s
LEFT JOIN (SELECT card, sum(-(k / n::DOUBLE) * log2(k / n::DOUBLE)) AS bits FROM (
   SELECT c.card, greatest(0, ceil((c.amt - lo) / ((hi - lo) / bins)) - 1) AS bucket, max(n) AS n, count(*) AS k
   FROM c_cards c JOIN (SELECT card, min(amt) AS lo, max(amt) AS hi, count(*) AS n, least(20, count(DISTINCT amt)) AS bins FROM c_cards GROUP BY card) q ON q.card = c.card
   WHERE n >= 2 AND hi > lo GROUP BY 1, 2) GROUP BY card) b ON b.card = s.card"""
ADDR_ENTROPY_SQL = """
SELECT card, sum(-(k / n::DOUBLE) * log2(k / n::DOUBLE)) AS addr_entropy FROM (SELECT card, coalesce(addr1, -1) AS v, count(*) AS k, sum(count(*)) OVER (PARTITION BY card) AS n FROM c_cards GROUP BY card, coalesce(addr1, -1)) GROUP BY card"""
SECOND_HOP_SQL = """
SELECT c.card, coalesce(avg(a.f), 0) AS second_hop_fraud_rate FROM c_cards c LEFT JOIN (SELECT addr1, max(is_fraud) AS f FROM c_cards WHERE addr1 IS NOT NULL GROUP BY addr1) a ON a.addr1 = c.addr1 GROUP BY c.card"""
VELOCITY_SQL = """
SELECT card, count(*) FILTER (dt > top - 604800) AS tx_velocity_7d FROM (SELECT card, dt, max(dt) OVER (PARTITION BY card) AS top FROM c_cards) GROUP BY card"""


@query("card_node_features", "2.4.16", f"""
WITH w AS (SELECT card, avg(coalesce(d1, 0)) AS account_age_days, avg(amt) AS balance_mean, coalesce(stddev_samp(amt), 0) AS balance_std, count(*) AS tx_count, max(is_fraud) AS is_fraud,
  least(1, count(DISTINCT addr1) / (count(*) + 1)::DOUBLE) AS fan_out_ratio, avg(CASE WHEN lower(device_type) = 'mobile' THEN 1.0 ELSE 0.0 END) AS device_mobile,
  greatest(0, least(1, 1 - count(DISTINCT device_type) / count(*)::DOUBLE)) AS device_consistency, avg((coalesce(d1,0) + coalesce(d2,0) + d3 + d4 + coalesce(d5,0)) / 5.0::DOUBLE) AS d_gap_mean,
  avg(CASE card4 WHEN 'visa' THEN 0.3 WHEN 'mastercard' THEN 0.3 WHEN 'american express' THEN 0.2 WHEN 'discover' THEN 0.4 ELSE 0.5 END) AS card_network_risk,
  avg(CASE product WHEN 'W' THEN 0.1 WHEN 'H' THEN 0.3 WHEN 'C' THEN 0.5 WHEN 'S' THEN 0.6 WHEN 'R' THEN 0.7 ELSE 0.4 END) AS product_code_risk,
  avg(CASE WHEN card3 > 150 THEN 1.0 ELSE 0.0 END) AS international_flag FROM c_cards GROUP BY card)
SELECT w.card, round(account_age_days, 4) AS account_age_days, round(balance_mean, 4) AS balance_mean, round(balance_std, 4) AS balance_std, tx_count, is_fraud, round(fan_out_ratio, 6) AS fan_out_ratio,
  round(device_mobile, 6) AS device_mobile, round(device_consistency, 6) AS device_consistency, round(d_gap_mean, 4) AS d_gap_mean, round(card_network_risk, 6) AS card_network_risk,
  round(product_code_risk, 6) AS product_code_risk, round(international_flag, 6) AS international_flag, tx_velocity_7d, round(amount_entropy, 6) AS amount_entropy,
  round(greatest(0, least(1, r * 0.6 + f * 0.3 + (1 - r - f) * 0.1)), 6) AS risky_email, round(addr_entropy, 6) AS addr_entropy, round(second_hop_fraud_rate, 6) AS second_hop_fraud_rate
FROM w JOIN ({VELOCITY_SQL}) v ON v.card = w.card JOIN ({AMOUNT_ENTROPY_SQL}) ae ON ae.card = w.card JOIN ({EMAIL_SQL}) em ON em.card = w.card JOIN ({ADDR_ENTROPY_SQL}) ad ON ad.card = w.card JOIN ({SECOND_HOP_SQL}) sh ON sh.card = w.card""")
def card_node_features(spark, sf):
    f = C.node_features(A.cards(spark, sf))
    f = rounded(f, 4, "account_age_days", "balance_mean", "balance_std", "d_gap_mean")
    return rounded(f, 6, "fan_out_ratio", "device_mobile", "device_consistency", "card_network_risk", "product_code_risk", "international_flag",
                   "amount_entropy", "risky_email", "addr_entropy", "second_hop_fraud_rate")


@query("amount_entropy", "2.4.17", f"SELECT card, round(amount_entropy, 6) AS amount_entropy FROM ({AMOUNT_ENTROPY_SQL})")
def amount_entropy(spark, sf):
    return rounded(C.amount_entropy(A.cards(spark, sf)), 6, "amount_entropy")


@query("address_entropy", "2.4.18", f"SELECT card, round(addr_entropy, 6) AS addr_entropy FROM ({ADDR_ENTROPY_SQL})")
def address_entropy(spark, sf):
    return rounded(C.categorical_entropy(A.cards(spark, sf), "addr1", "addr_entropy"), 6, "addr_entropy")


@query("email_risk", "2.4.19", f"SELECT card, round(greatest(0, least(1, r * 0.6 + f * 0.3 + (1 - r - f) * 0.1)), 6) AS risky_email FROM ({EMAIL_SQL})")
def email_risk(spark, sf):
    return rounded(C.email_risk(A.cards(spark, sf)), 6, "risky_email")


@query("second_hop_fraud", "2.4.20", f"SELECT card, round(second_hop_fraud_rate, 6) AS second_hop_fraud_rate FROM ({SECOND_HOP_SQL})")
def second_hop_fraud(spark, sf):
    return rounded(C.second_hop_fraud(A.cards(spark, sf)), 6, "second_hop_fraud_rate")


@query("sender_features", "2.4.21", """
SELECT n.node AS account, n.account_age_days AS age_days, coalesce(c, 0) AS sent_count, round(coalesce(s, 0), 2) AS sent_sum, round(coalesce(m, 0), 4) AS sent_mean, round(coalesce(c, 0) / (n.account_age_days + 1)::DOUBLE, 6) AS velocity
FROM c_nodes n LEFT JOIN (SELECT src, count(*) AS c, sum(amount) AS s, avg(amount) AS m FROM c_transfers GROUP BY src) t ON t.src = n.node""")
def sender_features(spark, sf):
    n = A.nodes(spark, sf).select(F.col("node").alias("account"), F.col("account_age_days").alias("age_days"))
    return rounded(rounded(rounded(W.sender_features(n, A.transfers(spark, sf)), 2, "sent_sum"), 4, "sent_mean"), 6, "velocity")


@query("foreign_bulk_features", "2.4.22", """
SELECT coalesce(o.account, i.account) AS account, coalesce(oc, 0) AS out_count, coalesce(ic, 0) AS in_count, coalesce(od, 0) AS out_degree, coalesce(idg, 0) AS in_degree,
  round(coalesce(os, 0) / (coalesce(isum, 0) + 1), 6) AS forward_ratio, coalesce(positive, 0) AS positive
FROM (SELECT src AS account, count(*) AS oc, sum(amount) AS os, count(DISTINCT dst) AS od FROM c_bulk GROUP BY src) o
FULL OUTER JOIN (SELECT dst AS account, count(*) AS ic, sum(amount) AS isum, count(DISTINCT src) AS idg, max(CASE WHEN amount > 90000 THEN 1 ELSE 0 END) AS positive FROM c_bulk GROUP BY dst) i ON i.account = o.account""")
def foreign_bulk_features(spark, sf):
    f = W.foreign_features(A.bulk(spark, sf).withColumn("is_sar", F.col("amount") > 90000))
    return rounded(f, 6, "forward_ratio").select("account", "out_count", "in_count", "out_degree", "in_degree", "forward_ratio", "positive")


def reset_sql(tag, span):
    return f"""s{tag} AS (
  SELECT account, min(epoch) AS s FROM c_legs GROUP BY account
  UNION ALL SELECT a.account, (SELECT min(l.epoch) FROM c_legs l WHERE l.account = a.account AND l.epoch > a.s + {span}) FROM s{tag} a
  WHERE EXISTS (SELECT 1 FROM c_legs l WHERE l.account = a.account AND l.epoch > a.s + {span}))"""


@query("reset_aggregates", "2.4.23", f"""
WITH RECURSIVE {reset_sql('24h', 86400)}, {reset_sql('7d', 604800)},
d AS (SELECT account, max(s) AS s FROM s24h GROUP BY account), w AS (SELECT account, max(s) AS s FROM s7d GROUP BY account)
SELECT d.account, (SELECT round(coalesce(sum(amount) FILTER (direction = 'OUT'), 0), 2) FROM c_legs l WHERE l.account = d.account AND l.epoch >= d.s) AS total_out_24h,
 (SELECT round(coalesce(sum(amount) FILTER (direction = 'IN'), 0), 2) FROM c_legs l WHERE l.account = d.account AND l.epoch >= d.s) AS total_in_24h,
 (SELECT count(*) FROM c_legs l WHERE l.account = d.account AND l.epoch >= d.s) AS txn_count_24h,
 (SELECT round(coalesce(sum(amount) FILTER (direction = 'OUT'), 0), 2) FROM c_legs l WHERE l.account = d.account AND l.epoch >= w.s) AS total_out_7d,
 (SELECT round(coalesce(sum(amount) FILTER (direction = 'IN'), 0), 2) FROM c_legs l WHERE l.account = d.account AND l.epoch >= w.s) AS total_in_7d,
 (SELECT count(*) FROM c_legs l WHERE l.account = d.account AND l.epoch >= w.s) AS txn_count_7d,
 (SELECT count(DISTINCT peer) FROM c_legs l WHERE l.account = d.account AND l.epoch >= w.s) AS unique_counterparties_7d
FROM d JOIN w ON w.account = d.account""")
def reset_aggregates(spark, sf):
    return W.reset_aggregates(account_legs(A.transfers(spark, sf)))


@query("node_counters", "2.4.24", f"""
SELECT account, out_count AS out_degree, round(out_value, 2) AS total_out, in_count AS in_degree, round(in_value, 2) AS total_in,
  round(CASE WHEN in_value > 0 THEN out_value / in_value ELSE 1.0 END, 6) AS risk_ratio FROM ({FLOWS})""")
def node_counters(spark, sf):
    return rounded(rounded(W.node_counters(A.transfers(spark, sf)), 2, "total_out", "total_in"), 6, "risk_ratio")


@query("identity_reuse", "2.4.25", """
SELECT txn_id, CASE WHEN device IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY device ORDER BY epoch, txn_id) - 1 END AS device_reuse,
  row_number() OVER (PARTITION BY ip ORDER BY epoch, txn_id) - 1 AS ip_reuse,
  CASE WHEN ja3 IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY ja3 ORDER BY epoch, txn_id) - 1 END AS ja3_reuse FROM c_gateway""")
def identity_reuse(spark, sf):
    return W.reuse_counts(A.gateway(spark, sf), ["device", "ip", "ja3"])


@query("graph_context", "2.4.26", """
WITH e AS (SELECT src AS account, suspected FROM c_decided UNION ALL SELECT dst, suspected FROM c_decided),
o AS (SELECT account, count(*) AS edges, count(*) FILTER (suspected) AS suspicious, least(1.0, count(*) FILTER (suspected) / count(*)::DOUBLE) AS connectivity FROM e GROUP BY account),
l AS (SELECT DISTINCT * FROM (SELECT src AS account, dst AS peer FROM c_decided UNION ALL SELECT dst, src FROM c_decided))
SELECT o.account, o.edges, o.suspicious, round(o.connectivity, 6) AS connectivity, round(o.connectivity * o.connectivity, 6) AS two_hop_approx, round(t.s, 6) AS two_hop_share
FROM o JOIN (SELECT l.account, avg(p.connectivity) AS s FROM l JOIN o p ON p.account = l.peer GROUP BY l.account) t ON t.account = o.account""")
def graph_context(spark, sf):
    return rounded(W.graph_context(A.decided(spark, sf).select("src", "dst", "suspected")), 6, "connectivity", "two_hop_approx", "two_hop_share")


RECRUITERS = """
SELECT src AS account, count(DISTINCT dst) AS downstream, round(sum(amount), 2) AS total, count(*) AS payments,
  CASE WHEN count(DISTINCT dst) >= 50 THEN 'NATIONAL_SYNDICATE' WHEN count(DISTINCT dst) >= 20 THEN 'INDUSTRIAL_ORCHESTRATOR' WHEN count(DISTINCT dst) >= 10 THEN 'COORDINATOR' ELSE 'FACILITATOR' END AS class
FROM c_transfers WHERE amount <= 10000 GROUP BY src HAVING count(DISTINCT dst) >= 5"""


@query("recruiter_fanout", "2.4.27", RECRUITERS)
def recruiter_fanout(spark, sf):
    return rounded(W.recruiters(A.transfers(spark, sf)), 2, "total").orderBy(F.desc("downstream"), "account")


@query("recruiter_campaigns", "2.4.28", f"""
WITH r AS ({RECRUITERS}) SELECT t.src AS recruiter, t.dst AS account, count(*) AS payments, round(sum(amount), 2) AS total FROM c_transfers t JOIN r ON r.account = t.src WHERE amount <= 10000 GROUP BY ALL""")
def recruiter_campaigns(spark, sf):
    t = A.transfers(spark, sf)
    return rounded(W.campaign(t, W.recruiters(t)), 2, "total")


@query("enforcement_stats", "2.4.29", """
WITH s AS (SELECT count(*) AS total, count(*) FILTER (decision = 'BLOCK' OR suspected) AS blocked, count(*) FILTER (decision = 'REVIEW') AS review,
  count(*) FILTER ((decision = 'BLOCK' OR suspected) AND risk >= 0.85) AS police, count(*) FILTER ((decision = 'BLOCK' OR suspected) AND risk >= 0.7) AS soft,
  round(sum(amount) FILTER (decision = 'BLOCK' OR suspected), 2) AS blocked_value, count(DISTINCT ring) AS rings, count(DISTINCT cluster) AS clusters, count(DISTINCT device) AS devices, count(DISTINCT ip) AS ips,
  round(avg(gnn), 6) AS mean_score, round(count(*) FILTER (risk < 0.3 AND (decision = 'BLOCK' OR suspected)) / count(*) FILTER (risk < 0.3)::DOUBLE, 6) AS low_risk_false_rate,
  round(count(*) / ((max(epoch) - min(epoch)) / 3600.0::DOUBLE), 4) AS per_hour FROM c_decided),
r AS (SELECT *, least(CASE WHEN police > 0 THEN police ELSE soft END, blocked) AS ref FROM s)
SELECT total, blocked, review, police, soft, blocked_value, rings, clusters, devices, ips, mean_score, low_risk_false_rate, per_hour,
  round((blocked - ref) / (blocked + review)::DOUBLE * 100, 2) AS frozen_pct, round(review / (blocked + review)::DOUBLE * 100, 2) AS review_pct, round(ref / (blocked + review)::DOUBLE * 100, 2) AS referral_pct FROM r""")
def enforcement_stats(spark, sf):
    return W.enforcement_stats(A.decided(spark, sf))


@query("fairness", "2.4.30", """
SELECT coalesce(segment, 'overall') AS segment, count(*) AS accounts, count(*) FILTER (severity <> 'CLEAN') AS flagged,
  count(*) FILTER (account IN (SELECT account FROM c_alerts WHERE status = 'FALSE_POSITIVE')) AS false_positives,
  round(count(*) FILTER (account IN (SELECT account FROM c_alerts WHERE status = 'FALSE_POSITIVE')) / count(*)::DOUBLE, 6) AS fp_rate
FROM c_profiles GROUP BY ROLLUP (segment)""")
def fairness(spark, sf):
    return W.fairness(A.profiles(spark, sf), A.alerts(spark, sf).where("status = 'FALSE_POSITIVE'"))


@query("live_facts", "2.4.31", """
SELECT (SELECT count(*) FROM c_alerts WHERE status NOT IN ('RESOLVED', 'FALSE_POSITIVE')) AS open_alerts, count(*) FILTER (severity <> 'CLEAN') AS watched,
  (SELECT account FROM c_profiles ORDER BY score DESC, account LIMIT 1) AS highest_account, max(score) AS highest_score, round(avg(score), 4) AS average_score FROM c_profiles""")
def live_facts(spark, sf):
    return W.live_facts(A.alerts(spark, sf), A.profiles(spark, sf))


CONTRAST_SQL = f"""
SELECT feature, family, round(mule, 6) AS mule, round(hv, 6) AS legit_high_velocity, round(ol, 6) AS other_legitimate, round((mule + 1e-6) / (hv + 1e-6), 6) AS ratio FROM (
SELECT feature, CASE WHEN feature IN ('out_count', 'out_degree', 'out_value') THEN 'velocity' ELSE 'shared_infrastructure' END AS family,
  median(value) FILTER (g = 'mule') AS mule, median(value) FILTER (g = 'hv') AS hv, median(value) FILTER (g = 'ol') AS ol FROM (
 UNPIVOT (SELECT a.account, CASE WHEN coalesce(l.is_mule, false) THEN 'mule' WHEN a.archetype = 'legit_high_velocity' THEN 'hv' ELSE 'ol' END AS g,
   CAST(f.out_count AS DOUBLE) AS out_count, CAST(f.out_degree AS DOUBLE) AS out_degree, CAST(f.out_value AS DOUBLE) AS out_value,
   CAST(d.dn AS DOUBLE) AS device_cluster_size, CAST(d.ipn AS DOUBLE) AS ip_cluster_size
  FROM c_accounts a LEFT JOIN c_labels l ON l.account = a.account JOIN ({FLOWS}) f ON f.account = a.account
  JOIN (SELECT account, count(*) OVER (PARTITION BY device) AS dn, count(*) OVER (PARTITION BY ip) AS ipn FROM c_accounts) d ON d.account = a.account)
 ON out_count, out_degree, out_value, device_cluster_size, ip_cluster_size INTO NAME feature VALUE value) GROUP BY feature)"""


def _contrast(spark, sf):
    a = A.accounts(spark, sf)
    m = (a.select("account", "archetype").join(A.labels(spark, sf).select("account", "is_mule"), "account", "left").fillna(False, ["is_mule"])
         .join(W.flow_aggregate(A.transfers(spark, sf)), "account").join(W.cluster_sizes(a), "account"))
    return W.contrast_report(m, ("out_count", "out_degree", "out_value"), ("device_cluster_size", "ip_cluster_size"))


@query("contrast_report", "2.4.32", CONTRAST_SQL)
def contrast_report(spark, sf):
    return rounded(_contrast(spark, sf), 6, "mule", "legit_high_velocity", "other_legitimate", "ratio")


@query("contrast_separation", "2.4.32", f"SELECT family, round(median(ratio), 4) AS separation FROM ({CONTRAST_SQL}) GROUP BY family")
def contrast_separation(spark, sf):
    return rounded(W.separation(_contrast(spark, sf)), 4, "separation")


@query("policy_summary", "2.4.33", """
SELECT policy, count(*) AS incidents, round(avg(rate), 6) AS mean_recovery, round(sum(prevented), 2) AS total_prevented, round(sum(amount), 2) AS total_amount, CAST(sum(innocent) AS BIGINT) AS innocent_total,
 round(sum(innocent) / sum(frozen)::DOUBLE, 6) AS innocent_rate, round(sum(mules) / sum(frozen)::DOUBLE, 6) AS precision, round(median(rate), 6) AS median_recovery, round(quantile_cont(rate, 0.1), 6) AS p10, round(quantile_cont(rate, 0.9), 6) AS p90,
 round(median(first_freeze), 6) AS median_first_freeze, round(quantile_cont(solve_ms, 0.5), 6) AS p50_ms, round(quantile_cont(solve_ms, 0.95), 6) AS p95_ms FROM c_outcomes GROUP BY policy""")
def policy_summary(spark, sf):
    s = E.policy_summary(A.outcomes(spark, sf))
    return rounded(rounded(s, 2, "total_prevented", "total_amount"), 6, "mean_recovery", "innocent_rate", "precision", "median_recovery", "p10", "p90", "median_first_freeze", "p50_ms", "p95_ms")


@query("recovery_histogram", "2.4.33", "SELECT policy, CAST(least(9, greatest(0, floor(prevented / greatest(amount, 1) * 10))) AS INTEGER) AS bucket, count(*) AS n FROM c_outcomes GROUP BY ALL")
def recovery_histogram(spark, sf):
    return E.recovery_histogram(A.outcomes(spark, sf))


@query("delay_curve", "2.4.34", """
SELECT i.delay // 30 * 30 AS delay, round(avg(rate) FILTER (policy = 1), 6) AS "1", round(avg(rate) FILTER (policy = 2), 6) AS "2", round(avg(rate) FILTER (policy = 3), 6) AS "3"
FROM c_outcomes o JOIN c_incidents i ON i.incident = o.incident GROUP BY 1""")
def delay_curve(spark, sf):
    d = A.incidents(spark, sf).select("incident", (F.floor(F.col("delay") / 30) * 30).alias("delay"))
    return rounded(E.curve(A.outcomes(spark, sf).join(d, "incident"), "delay", [1, 2, 3]), 6, "1", "2", "3")


@query("gap_summary", "2.4.35", """
WITH g AS (SELECT greatest(0, (bound - achieved) / greatest(bound, 1e-9)) AS gap FROM (SELECT incident, max(prevented) FILTER (policy = 1) AS achieved, max(prevented) AS bound FROM c_outcomes GROUP BY incident))
SELECT count(*) AS n, round(avg(gap), 6) AS mean_gap, round(max(gap), 6) AS max_gap, round(median(gap), 6) AS median_gap FROM g""")
def gap_summary(spark, sf):
    r = A.outcomes(spark, sf).groupBy("incident").agg(F.max(F.when(F.col("policy") == 1, F.col("prevented"))).alias("achieved"), F.max("prevented").alias("bound"))
    return rounded(E.gap_summary(r), 6, "mean_gap", "max_gap", "median_gap")


@query("confusion_metrics", "2.4.36", """
WITH c AS (SELECT model, count(*) FILTER (score >= 0.6 AND positive) AS tp, count(*) FILTER (score >= 0.6 AND NOT positive) AS fp, count(*) FILTER (score < 0.6 AND positive) AS fn, count(*) FILTER (score < 0.6 AND NOT positive) AS tn FROM c_positive GROUP BY model)
SELECT model, tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1,
 round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(fp / (fp + tn)::DOUBLE, 6) AS fpr, round(fn / (fn + tp)::DOUBLE, 6) AS fnr FROM c""")
def confusion_metrics(spark, sf):
    s = A.labelled_scores(spark, sf).select("model", (F.col("score") >= 0.6).alias("predicted"), F.col("positive").alias("actual"))
    return rounded(E.confusion(s, ["model"]), 6, "precision", "recall", "f1", "accuracy", "fpr", "fnr")


OUTCOME_SQL = """
WITH q AS (SELECT d.incident, d.model, d.account, d.pos, d.pos <= 8 AND d.score >= 0.3 AS flag,
   i.complaint - i.t0 + CAST(CASE WHEN d.pos <= 8 AND d.score >= 0.3 THEN ceil(d.pos / 4.0) ELSE ceil(least(d.pos, 9) / 4.0) END AS BIGINT) * 90 AS t, i.amount AS stolen_amount
  FROM c_decisions d JOIN c_incidents i ON i.incident = d.incident),
delta AS (SELECT incident, victim AS account, -1 AS t, amount AS d FROM c_incidents UNION ALL SELECT incident, src, offset_sec, -amount FROM c_case UNION ALL SELECT incident, dst, offset_sec, amount FROM c_case WHERE NOT to_exit),
h AS (SELECT q.*, greatest(0, coalesce((SELECT sum(d) FROM delta x WHERE x.incident = q.incident AND x.account = q.account AND x.t <= q.t), 0)) AS held,
   coalesce(l.is_mule, false) AS mule, l.layer_index, a.own_balance FROM q LEFT JOIN c_labels l ON l.account = q.account LEFT JOIN c_accounts a ON a.account = q.account),
g AS (SELECT incident, model, max(stolen_amount) AS amt, sum(CASE WHEN flag AND mule THEN held ELSE 0 END) AS rec, sum(CASE WHEN flag AND NOT mule THEN own_balance + held ELSE 0 END) AS wf,
 count(*) FILTER (flag AND mule) AS tp, count(*) FILTER (flag AND NOT mule) AS fp, count(*) FILTER (NOT flag AND mule) AS fn, count(*) FILTER (NOT flag AND NOT mule) AS tn,
 median(t) FILTER (flag AND mule) AS median_latency, min(layer_index) FILTER (flag AND mule) AS first_hop FROM h GROUP BY incident, model)
SELECT incident, model, round(rec, 2) AS recovered, round(amt - rec, 2) AS lost, round(wf, 2) AS wrongly_frozen, round(rec - wf, 2) AS net_benefit, tp, fp, fn, tn, median_latency, first_hop FROM g"""


def case_outcome_rows(spark, sf):
    inc = A.incidents(spark, sf)
    told = inc.select("incident", (F.col("complaint") - F.col("t0")).alias("complaint_offset"))
    dec = E.decision_queue(A.model_scores(spark, sf), told, ["incident", "model"], 8, 0.3)
    return K.case_outcomes(dec, inc, A.case_transfers(spark, sf), A.accounts(spark, sf).select("account", "own_balance"), A.labels(spark, sf))


@query("case_outcomes", "2.4.37", OUTCOME_SQL)
def case_outcomes(spark, sf):
    return case_outcome_rows(spark, sf)


@query("net_benefit_curve", "2.4.38", f"""
WITH o AS ({OUTCOME_SQL}), t AS (SELECT model, sum(recovered) AS r, sum(wrongly_frozen) AS w FROM o GROUP BY model), l AS (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 1, 2, 4]) AS lam)
SELECT CAST(model AS VARCHAR) AS model, lam, round(r - lam * w, 2) AS net_benefit FROM t, l UNION ALL SELECT 'no_system', lam, 0.0 FROM l""")
def net_benefit_curve(spark, sf):
    return rounded(E.net_benefit_curve(case_outcome_rows(spark, sf), (0.0, 0.25, 0.5, 1.0, 2.0, 4.0)), 2, "net_benefit")


@query("seed_spread", "2.4.39", "SELECT policy, min(rate) AS low, max(rate) AS high, count(rate) AS n, round(median(rate), 6) AS median FROM c_outcomes GROUP BY policy")
def seed_spread(spark, sf):
    return rounded(E.spread(A.outcomes(spark, sf), ["policy"], "rate"), 6, "median")


@query("score_histogram", "2.4.40", "SELECT m.model, b.bin, (SELECT count(*) FROM c_scores s WHERE s.model = m.model AND least(9, floor(s.score * 10)) = b.bin) AS n FROM (SELECT unnest([1, 2, 3]) AS model) m, (SELECT unnest(range(0, 10)) AS bin) b")
def score_histogram(spark, sf):
    return E.score_histogram(A.model_scores(spark, sf), ["model"])


@query("account_profile", "2.4.4 2.9.25", f"""
WITH f AS ({FLOWS}), r AS ({RESIDENCE}), rs AS (SELECT account, median(gap / 60.0::DOUBLE) AS med, avg(CASE WHEN gap <= 600 THEN 1.0 ELSE 0.0 END) AS fast FROM r GROUP BY account)
SELECT f.account, round(out_value, 2) AS out_value, round(in_value, 2) AS in_value, out_degree, in_degree, round(out_value / greatest(in_value, 1), 6) AS turnover_ratio,
  round(coalesce(med, 0), 6) AS median_residence_minutes, round(coalesce(fast, 0), 6) AS outflow_within_10min_share FROM f LEFT JOIN rs ON rs.account = f.account""")
def account_profile(spark, sf):
    """Value in and out, turnover, and how fast money moves on, per account."""
    t = A.transfers(spark, sf)
    flows = W.ratios(W.flow_aggregate(t)).select("account", "out_value", "in_value", "out_degree", "in_degree", "turnover_ratio")
    rows = flows.join(W.residence_summary(t).drop("burstiness"), "account", "left").fillna(0.0, ["median_residence_minutes", "outflow_within_10min_share"])
    return rounded(rounded(rows, 2, "out_value", "in_value"), 6, "turnover_ratio", "median_residence_minutes", "outflow_within_10min_share")
