"""Derived inputs shared by several registered queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digests import pads
from ..operators import ledger as L
from ..operators import signals as G
from ..sources import adapters as A

AS_OF = 1706659200
AS_OF_DAY = 19753
AUDIT_KEY = b"audit-ledger-key"
IPAD, OPAD = pads(AUDIT_KEY)


def hmac_sql(text: str) -> str:
    return f"sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode({text}))))"


def payload_sql(prev: str, r: str = "") -> str:
    return (
        f"""'{{"action":"' || {r}action || '","actor":"' || {r}actor || '","at":"' || {r}logged_at || '","detail":' || {r}detail || ',"prev":"' || {prev} || '","seq":' || CAST({r}seq AS VARCHAR) || ',"target":"' || {r}target || '"}}'"""
    )


# Ledgers of three entries; some rows are altered after sealing.
AUDIT_SQL = f"""
SELECT ledger, seq, logged_at, CASE WHEN seq % 50 = 7 THEN 'intruder' ELSE actor END AS actor, action, target, detail,
       CASE WHEN seq % 70 = 11 THEN 'x' ELSE prev_hash END AS prev_hash, entry_hash FROM (
  SELECT seq // 3 AS ledger, *, '' AS prev_hash, {hmac_sql(payload_sql("''"))} AS entry_hash FROM c_audit WHERE seq % 3 = 0
  UNION ALL
  SELECT b.seq // 3, b.*, a.h, {hmac_sql(payload_sql("a.h", "b."))} FROM c_audit b
    JOIN (SELECT seq // 3 AS l, {hmac_sql(payload_sql("''"))} AS h FROM c_audit WHERE seq % 3 = 0) a ON a.l = b.seq // 3 WHERE b.seq % 3 = 1
  UNION ALL
  SELECT c.seq // 3, c.*, b.h, {hmac_sql(payload_sql("b.h", "c."))} FROM c_audit c
    JOIN (SELECT r.seq // 3 AS l, {hmac_sql(payload_sql("a.h", "r."))} AS h FROM c_audit r
          JOIN (SELECT seq // 3 AS l, {hmac_sql(payload_sql("''"))} AS h FROM c_audit WHERE seq % 3 = 0) a ON a.l = r.seq // 3 WHERE r.seq % 3 = 1) b
    ON b.l = c.seq // 3 WHERE c.seq % 3 = 2)
"""


def audit_with_hashes(spark, sf):
    rows = A.audit(spark, sf).withColumn("ledger", F.floor(F.col("seq") / 3))
    seal = lambda prev: L.audit_digest(prev, AUDIT_KEY)
    first = rows.where("seq % 3 = 0").withColumn("prev_hash", F.lit("")).withColumn("entry_hash", seal(F.lit("")))
    parts = [first]
    for pos in (1, 2):
        link = parts[-1].select("ledger", F.col("entry_hash").alias("prev_hash"))
        nxt = rows.where(f"seq % 3 = {pos}").join(link, "ledger")
        parts.append(nxt.withColumn("entry_hash", seal(F.col("prev_hash"))))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("actor", F.when(F.col("seq") % 50 == 7, "intruder").otherwise(F.col("actor"))).withColumn(
        "prev_hash", F.when(F.col("seq") % 70 == 11, "x").otherwise(F.col("prev_hash"))
    )


def signal_profiles(spark, sf):
    a = F.col("account")
    return A.accounts(spark, sf).select(
        "account", "segment", (F.col("prior_day") * 86400).alias("last_active"), (F.col("open_day") * 86400).alias("opened_at"),
        (a % 3 + 1).alias("n_devices"), (a % 4).alias("sim_swaps_72h"), (a % 5 == 2).alias("new_device"),
    )


def signal_rows(spark, sf):
    return G.signal_features(signal_profiles(spark, sf), G.account_legs(A.transfers(spark, sf)), F.lit(AS_OF))


SIGNALS_SQL = f"""
SELECT account,
  greatest(0.0, least(1.0, (n48 - 3) / 12.0::DOUBLE)) AS s1_velocity,
  CASE WHEN recv_sum <= 0 THEN 0.0 WHEN least(1.0, sent_sum / recv_sum) > 0.5 THEN (least(1.0, sent_sum / recv_sum) - 0.5::DOUBLE) / 0.5::DOUBLE ELSE 0.0 END AS s2_round_trip,
  greatest(0.0, least(1.0, (sub_threshold_count - 2) / 6.0::DOUBLE)) AS s3_structuring,
  CASE WHEN account % 5 = 2 AND dormant_days > 90 THEN least(1.0, dormant_days / 180 + 0.3) ELSE 0.0 END AS s4_dormant_device,
  greatest(0.0, least(1.0, ((sent_sum + recv_sum) / (CASE segment WHEN 'salary' THEN 150000.0 WHEN 'retail' THEN 80000.0 WHEN 'student' THEN 30000.0 WHEN 'business' THEN 1500000.0 ELSE 60000.0 END) - 1.5) / 4.5)) AS s5_profile_mismatch,
  CASE WHEN account % 4 >= 2 THEN least(1.0, (account % 4) * 0.35::DOUBLE) ELSE 0.0 END AS s6_sim_swap,
  tx_count, sent_count, recv_count, sent_sum, recv_sum,
  CASE WHEN sent_count > 0 THEN sent_sum / sent_count ELSE 0 END AS sent_mean, CASE WHEN recv_count > 0 THEN recv_sum / recv_count ELSE 0 END AS recv_mean,
  sent_max, recv_max, CASE WHEN recv_sum > 0 THEN sent_sum / recv_sum ELSE 0 END AS round_trip_ratio, recv_sum - sent_sum AS net_flow,
  sub_threshold_count, account % 3 + 1 AS n_devices, account % 4 AS sim_swaps_72h, dormant_days, account_age_days,
  CASE segment WHEN 'salary' THEN 0.0 WHEN 'retail' THEN 1.0 WHEN 'student' THEN 2.0 WHEN 'business' THEN 3.0 ELSE 4.0 END AS segment_code
FROM (SELECT a.account, a.segment, count(t.amount) AS tx_count, count(*) FILTER (t.d = 'OUT') AS sent_count, count(*) FILTER (t.d = 'IN') AS recv_count,
   coalesce(sum(t.amount) FILTER (t.d = 'OUT'), 0) AS sent_sum, coalesce(sum(t.amount) FILTER (t.d = 'IN'), 0) AS recv_sum,
   coalesce(max(t.amount) FILTER (t.d = 'OUT'), 0) AS sent_max, coalesce(max(t.amount) FILTER (t.d = 'IN'), 0) AS recv_max,
   count(*) FILTER (t.amount >= 25000 AND t.amount < 50000) AS sub_threshold_count, count(*) FILTER (t.epoch > {AS_OF} - 172800) AS n48,
   greatest(0.0, ({AS_OF} - a.prior_day * 86400) / 86400.0::DOUBLE) AS dormant_days, greatest(0.0, ({AS_OF} - a.open_day * 86400) / 86400.0::DOUBLE) AS account_age_days
  FROM c_accounts a LEFT JOIN (SELECT src AS account, 'OUT' AS d, amount, epoch FROM c_transfers UNION ALL SELECT dst, 'IN', amount, epoch FROM c_transfers) t
    ON t.account = a.account AND t.epoch <= {AS_OF}
  GROUP BY a.account, a.segment, a.prior_day, a.open_day)
"""
