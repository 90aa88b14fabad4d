"""Registered queries over selections and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as P
from ..sources import adapters as A
from .registry import query
from .views import AUDIT_SQL, SIGNALS_SQL, audit_with_hashes, signal_rows

@query("visible_edges", "2.2.1", """
SELECT DISTINCT i.incident, t.txn_id, t.src, t.dst, t.amount, t.epoch, t.channel
FROM c_incidents i JOIN c_transfers t ON t.epoch <= i.complaint
WHERE EXISTS (SELECT 1 FROM c_case k WHERE k.incident = i.incident AND (k.src = t.src OR k.src = t.dst))""")
def visible_edges(spark, sf):
    keep = A.case_transfers(spark, sf).select("incident", F.col("src").alias("account")).distinct()
    until = A.incidents(spark, sf).select("incident", F.col("complaint").alias("until"))
    return P.visible_edges(A.transfers(spark, sf), keep, until)


@query("window_slice", "2.2.2", "SELECT * FROM c_transfers WHERE epoch BETWEEN 1704067207 AND 1705276800")
def window_slice(spark, sf):
    return P.window_slice(A.transfers(spark, sf), 1704067207, 1705276800)


@query("observed_accounts", "2.2.3", """
WITH s AS (SELECT incident, src, dst, offset_sec FROM c_case WHERE offset_sec <= 7200),
l AS (SELECT incident, account, max(offset_sec) AS last_seen FROM (SELECT incident, src AS account, offset_sec FROM s UNION ALL SELECT incident, dst, offset_sec FROM s) GROUP BY ALL)
SELECT c.incident, c.account, round(19745 - a.open_day + 7200 / 86400.0::DOUBLE, 6) AS age_days,
       round(CASE WHEN l.last_seen IS NOT NULL THEN (7200 - l.last_seen) / 86400.0::DOUBLE ELSE 19745 - a.prior_day + 7200 / 86400.0::DOUBLE END, 6) AS dormancy_days
FROM c_cand c JOIN c_accounts a ON a.account = c.account LEFT JOIN l ON l.incident = c.incident AND l.account = c.account""")
def observed_accounts(spark, sf):
    pool = A.candidates(spark, sf).join(A.accounts(spark, sf), "account").select(
        "incident", "account", (F.lit(19745) - F.col("open_day")).alias("age_days"), (F.lit(19745) - F.col("prior_day")).alias("dormancy_days"))
    out = P.observed_accounts(A.case_transfers(spark, sf), pool, F.lit(7200))
    return out.select("incident", "account", F.round("age_days", 6).alias("age_days"), F.round("dormancy_days", 6).alias("dormancy_days"))


END_SQL = """
SELECT i.incident, least(i.horizon - i.t0, greatest(i.complaint - i.t0, coalesce(max(k.offset_sec), 0)) + 900) AS end_sec
FROM c_incidents i LEFT JOIN c_case k ON k.incident = i.incident GROUP BY i.incident, i.horizon, i.t0, i.complaint"""


@query("tick_schedule", "2.2.4", f"""
WITH e AS ({END_SQL}),
m AS (SELECT incident, unnest(range(0, end_sec + 1, 30)) AS t FROM e UNION ALL SELECT incident, end_sec FROM e
  UNION ALL SELECT incident, offset_sec FROM c_case UNION ALL SELECT incident, offset_sec + 1 FROM c_case WHERE NOT to_exit
  UNION ALL SELECT incident, complaint - t0 FROM c_incidents)
SELECT DISTINCT m.incident, m.t FROM m JOIN e ON e.incident = m.incident WHERE m.t BETWEEN 0 AND e.end_sec""")
def tick_schedule(spark, sf):
    return P.tick_schedule(A.case_transfers(spark, sf), A.incidents(spark, sf))


@query("case_end", "2.2.5", END_SQL)
def case_end(spark, sf):
    return P.case_end(A.case_transfers(spark, sf), A.incidents(spark, sf))


@query("holdout_split", "2.2.6", """
SELECT incident, ring_id, ring_id IN ('RING-01', 'RING-03') AS held FROM c_incidents""")
def holdout_split(spark, sf):
    i = A.incidents(spark, sf).select("incident", "ring_id")
    rings = ("RING-01", "RING-03")
    return P.holdout(i, rings, True).withColumn("held", F.lit(True)).unionByName(
        P.holdout(i, rings, False).withColumn("held", F.lit(False)))


@query("complaints", "2.2.7", """
SELECT CAST(incident AS VARCHAR) || '@' || CAST(d AS VARCHAR) AS complaint_id, incident, d AS delay, t0 + d * 60 AS complaint, t0 + d * 60 + 21600 AS horizon_end
FROM c_incidents, (SELECT unnest([5, 10, 15, 30, 45, 60, 90, 120, 240, 360]) AS d)""")
def complaints(spark, sf):
    return P.materialise_complaints(A.incidents(spark, sf), (5, 10, 15, 30, 45, 60, 90, 120, 240, 360))


@query("intake", "2.2.8", """
WITH s AS (SELECT min(epoch) AS f, max(epoch) AS l FROM c_transfers),
c AS (SELECT alert_id AS complaint_id, account + CASE WHEN alert_id % 10 = 0 THEN 100000000 ELSE 0 END AS account,
        created + CASE WHEN alert_id % 7 = 0 THEN 90 * 86400 ELSE 0 END AS filed_at,
        CASE WHEN alert_id % 9 = 0 THEN -1.0 ELSE score END AS amount, alert_id * 13 % 1600 AS delay FROM c_alerts)
SELECT complaint_id, account, CASE WHEN account NOT IN (SELECT account FROM c_accounts) THEN 'unknown_account'
  WHEN filed_at < f OR filed_at > l + 86400 THEN 'outside_window' WHEN amount <= 0 OR amount > 1e8 THEN 'bad_amount'
  WHEN delay < 0 OR delay > 1440 THEN 'bad_delay' ELSE 'accepted' END AS reason FROM c, s""")
def intake(spark, sf):
    i = F.col("alert_id")
    filed = A.alerts(spark, sf).select(
        i.alias("complaint_id"), (F.col("account") + F.when(i % 10 == 0, 100000000).otherwise(0)).alias("account"),
        (F.col("created") + F.when(i % 7 == 0, 90 * 86400).otherwise(0)).alias("filed_at"),
        F.when(i % 9 == 0, -1.0).otherwise(F.col("score")).alias("amount"), (i * 13 % 1600).alias("delay"))
    span = A.transfers(spark, sf).agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"))
    return P.intake(filed, A.accounts(spark, sf), span)


@query("validate_transactions", "2.2.9", """
WITH b AS (SELECT txn_id, CASE WHEN txn_id % 17 = 0 THEN NULL ELSE src END AS src, dst, CASE WHEN txn_id % 19 = 0 THEN -amount ELSE amount END AS amount, epoch FROM c_transfers),
m AS (SELECT max(epoch) AS top FROM c_transfers)
SELECT txn_id, CASE WHEN src IS NULL THEN 'missing_field' WHEN amount <= 0 THEN 'bad_amount' WHEN epoch < top - 86400 * 20 - 86400 THEN 'stale'
  WHEN txn_id % 5 = 0 AND txn_id IN (SELECT txn_id FROM c_transfers) THEN 'duplicate' ELSE 'ok' END AS reason FROM b, m""")
def validate_transactions(spark, sf):
    t = A.transfers(spark, sf)
    batch = t.select("txn_id", F.when(F.col("txn_id") % 17 != 0, F.col("src")).alias("src"), "dst",
                     F.when(F.col("txn_id") % 19 == 0, -F.col("amount")).otherwise(F.col("amount")).alias("amount"), "epoch")
    as_of = t.agg((F.max("epoch") - 86400 * 20).alias("m")).scalar()
    return P.validate_transactions(batch, t.where("txn_id % 5 = 0").select("txn_id"), as_of)


@query("account_search", "2.2.10", """
SELECT account, holder, bank, segment, score, severity FROM c_profiles WHERE holder ILIKE '%CUSTOMER#0000000%' AND severity = 'IMMINENT'
ORDER BY score DESC, account LIMIT 21 OFFSET 2""")
def account_search(spark, sf):
    return P.search_accounts(A.profiles(spark, sf), "CUSTOMER#0000000", "IMMINENT", 2, 20)


@query("alert_queue", "2.2.11", "SELECT * FROM c_alerts WHERE status = 'NEW'")
def alert_queue(spark, sf):
    return P.alert_queue(A.alerts(spark, sf), status="NEW", sort="sla")


@query("audit_log", "2.2.12", f"""
WITH h AS ({AUDIT_SQL}) SELECT seq, logged_at, actor, action, target, right(entry_hash, 8) AS fingerprint FROM h WHERE actor = '1-URGENT' AND action = 'account.freeze'""")
def audit_log(spark, sf):
    return P.audit_log(audit_with_hashes(spark, sf), "1-URGENT", "account.freeze")


PATTERN = f"""
WITH sig AS ({SIGNALS_SQL}), j AS (SELECT p.account, p.score, p.severity, s.s2_round_trip AS s2, s.s3_structuring AS s3 FROM c_profiles p JOIN sig s ON s.account = p.account)
"""


@query("pattern_round_trip", "2.2.13", PATTERN + "SELECT account, score, severity FROM j WHERE severity <> 'CLEAN' AND s2 > 0.4 ORDER BY score DESC, account LIMIT 25")
def pattern_round_trip(spark, sf):
    return _pattern(spark, sf, "round_trip")


@query("pattern_structuring", "2.2.13", PATTERN + "SELECT account, score, severity FROM j WHERE severity <> 'CLEAN' AND s3 > 0.3 ORDER BY score DESC, account LIMIT 25")
def pattern_structuring(spark, sf):
    return _pattern(spark, sf, "structuring")


@query("pattern_velocity", "2.2.13", PATTERN + "SELECT account, score, severity FROM j WHERE severity <> 'CLEAN' AND score >= 55 ORDER BY score DESC, account LIMIT 25")
def pattern_velocity(spark, sf):
    return _pattern(spark, sf, "velocity")


def _pattern(spark, sf, kind):
    sig = signal_rows(spark, sf).select("account", F.col("s2_round_trip").alias("s2"), F.col("s3_structuring").alias("s3"))
    return P.pattern_hits(A.profiles(spark, sf).join(sig, "account"), kind).select("account", "score", "severity")


@query("structuring_band", "2.2.14", "SELECT src, count(*) AS n FROM c_transfers WHERE amount BETWEEN 45000 AND 49900 GROUP BY src")
def structuring_band(spark, sf):
    return A.transfers(spark, sf).where(P.in_structuring_band(F.col("amount"))).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("high_risk", "2.2.15", "SELECT account, score AS risk_score FROM c_profiles WHERE score > 50 ORDER BY score DESC, account LIMIT 20")
def high_risk(spark, sf):
    return P.high_risk(A.profiles(spark, sf).select("account", F.col("score").alias("risk_score")))


@query("case_selection", "2.2.16", """
SELECT i.incident, i.delay, count(*) AS core_size FROM c_incidents i JOIN c_cand c ON c.incident = i.incident
WHERE delay <= 130 GROUP BY ALL HAVING count(*) BETWEEN 8 AND 70""")
def case_selection(spark, sf):
    return P.select_cases(A.incidents(spark, sf), A.candidates(spark, sf))


@query("quality_report", "2.2.17", """
SELECT 'null_field' AS rule, count(*) FILTER (txn_id IS NULL OR src IS NULL OR dst IS NULL OR amount IS NULL OR epoch IS NULL OR channel IS NULL) AS violations FROM c_transfers
UNION ALL SELECT 'self_transfer', count(*) FILTER (src = dst) FROM c_transfers
UNION ALL SELECT 'bad_amount', count(*) FILTER (amount <= 0) FROM c_transfers
UNION ALL SELECT 'orphan_endpoint', (SELECT count(*) FROM c_transfers WHERE src NOT IN (SELECT account FROM c_accounts)) + (SELECT count(*) FROM c_transfers WHERE dst NOT IN (SELECT account FROM c_accounts))
UNION ALL SELECT 'duplicate_id', count(*) - count(DISTINCT txn_id) FROM c_transfers
UNION ALL SELECT 'orphan_label', count(*) FROM c_labels WHERE account NOT IN (SELECT account FROM c_accounts)
UNION ALL SELECT 'label_ring_mismatch', count(*) FILTER (is_mule <> (ring_id <> '')) FROM c_labels
UNION ALL SELECT 'label_layer_mismatch', count(*) FILTER (is_mule <> (layer_index >= 0)) FROM c_labels""")
def quality_report(spark, sf):
    return P.quality_report(A.transfers(spark, sf), A.accounts(spark, sf), A.labels(spark, sf))
