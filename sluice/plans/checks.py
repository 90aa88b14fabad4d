"""DuckDB twins of the canonical tables, used only by the SQL checks."""

from __future__ import annotations

import re

VIEWS: dict[str, tuple[list[str], str]] = {}

# DuckDB reads 0.5 as a decimal; the library computes in doubles.
LITERAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")


def doubles(sql: str) -> str:
    return LITERAL.sub(r"CAST(\1 AS DOUBLE)", sql)


def view(name: str, sql: str) -> None:
    VIEWS[name] = ([], doubles(sql))


def _deps(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def with_views(sql: str) -> str:
    """Prefix the statement with the canonical views it mentions, in order."""
    needed: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for dep in _deps(text):
            if dep != own and dep not in needed:
                visit(VIEWS[dep][1], dep)
                needed.append(dep)

    sql = doubles(sql)
    visit(sql)
    body = sql.strip().rstrip(";")
    if not needed:
        return body
    heads = ",\n".join(f"{v} AS (\n{VIEWS[v][1].strip()}\n)" for v in needed)
    low = body.lower()
    if low.startswith("with recursive"):
        return f"WITH RECURSIVE {heads},\n{body[len('with recursive'):].lstrip()}"
    if low.startswith("with"):
        return f"WITH {heads},\n{body[4:].lstrip()}"
    return f"WITH {heads}\n{body}"


# --- canonical tables -------------------------------------------------------

view("c_n", "SELECT max(user_id) + 1 AS n FROM events")

view("c_transfers", """
SELECT event_id AS txn_id, user_id AS src,
       (user_id * 31 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1) % n AS dst,
       round(value * 1000, 2) AS amount,
       CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch,
       CASE event_type WHEN 'click' THEN 'UPI' WHEN 'purchase' THEN 'IMPS' WHEN 'view' THEN 'NEFT'
            WHEN 'signup' THEN 'CARD' ELSE 'ATM_WITHDRAWAL' END AS channel,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM events, c_n
WHERE user_id <> (user_id * 31 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1) % n
""")

view("c_bulk", """
SELECT o_custkey AS src, l_suppkey AS dst, round(l_extendedprice, 2) AS amount,
       CAST(epoch(l_shipdate) AS BIGINT) AS epoch
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_custkey <> l_suppkey
""")

view("c_accounts", """
SELECT c_custkey AS account, c_custkey % 8 AS bank,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'salary' WHEN 'AUTOMOBILE' THEN 'retail'
            WHEN 'MACHINERY' THEN 'student' WHEN 'HOUSEHOLD' THEN 'business' ELSE 'senior' END AS segment,
       c_name AS holder, c_acctbal AS own_balance,
       18262 + c_custkey * 37 % 1400 AS open_day,
       19509 + c_custkey * 13 % 200 AS prior_day,
       CASE c_custkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'video' ELSE 'small' END AS kyc_tier,
       CASE WHEN c_custkey % 25 = 7 THEN 'exit_point' WHEN c_custkey % 9 = 4 THEN 'legit_high_velocity'
            ELSE 'retail' END AS archetype,
       c_custkey % (n // 4 + 1) AS device, c_custkey % (n // 3 + 1) AS ip, c_custkey % 20 AS district,
       CASE WHEN c_custkey % 25 <> 7 THEN '' WHEN c_custkey % 3 = 0 THEN 'atm'
            WHEN c_custkey % 3 = 1 THEN 'exchange' ELSE 'crossborder' END AS exit_kind
FROM customer, c_n WHERE c_custkey < n
""")

view("c_labels", """
SELECT account, account % 17 = 3 AS is_mule,
       CASE WHEN account % 17 = 3 THEN 'RING-0' || CAST(account % 4 AS VARCHAR) ELSE '' END AS ring_id,
       CASE WHEN account % 17 = 3 THEN account % 5 ELSE -1 END AS layer_index,
       account % 34 = 3 AS is_cashout_node,
       CASE WHEN account % 17 = 3 THEN (CASE account % 3 WHEN 0 THEN 'fanout' WHEN 1 THEN 'structuring' ELSE 'crypto_exit' END) ELSE '' END AS typology
FROM c_accounts WHERE account % 2 = 1
""")

view("c_incidents", """
SELECT txn_id AS incident, src AS victim, amount, epoch AS t0,
       10 + txn_id % 120 AS delay, epoch + (10 + txn_id % 120) * 60 AS complaint,
       epoch + 21600 AS horizon,
       CASE txn_id % 4 WHEN 0 THEN 'fanout' WHEN 1 THEN 'structuring' WHEN 2 THEN 'chain_burst' ELSE 'crypto_exit' END AS typology,
       'RING-0' || CAST(src % 4 AS VARCHAR) AS ring_id
FROM c_transfers WHERE amount >= 250000 AND src % 25 <> 7
""")

view("c_gateway", """
SELECT txn_id, src, dst, amount, epoch, k,
       CASE WHEN txn_id % 11 = 0 THEN NULL ELSE (txn_id * 37 % 101) / 100.0::DOUBLE END AS gnn,
       CASE WHEN txn_id % 13 = 0 THEN NULL ELSE (txn_id * 53 % 101) / 100.0::DOUBLE END AS eif,
       CASE WHEN k % 25 = 24 THEN NULL ELSE k % 25 END AS ja3, k % 25 = 3 AS ja3_hit,
       src % 40 AS device, (src * 7 + k) % 60 AS ip,
       CASE WHEN txn_id % 19 = 0 THEN txn_id % 7 ELSE NULL END AS ring,
       CASE WHEN txn_id % 5 = 0 THEN src % 12 ELSE NULL END AS cluster
FROM c_transfers
""")

view("c_decided", """
SELECT *, CASE WHEN risk >= 0.75 THEN 'BLOCK' WHEN risk >= 0.45 THEN 'REVIEW' ELSE 'APPROVE' END AS decision,
       risk >= 0.75 AS suspected
FROM (SELECT *, least(1.0, coalesce(gnn, 0) * 0.6 + coalesce(eif, 0) * 0.4) AS risk FROM c_gateway)
""")

view("c_cards", """
SELECT o_orderkey AS transaction_id, CAST(epoch(o_orderdate) AS BIGINT) AS dt, o_totalprice AS amt,
       CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS is_fraud,
       CAST(o_custkey % 500 AS VARCHAR) || '_' ||
         (CASE o_custkey % 5 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' WHEN 2 THEN 'discover' WHEN 3 THEN 'american express' ELSE 'X' END)
         || '_' || (CASE o_custkey % 3 WHEN 0 THEN 'credit' WHEN 1 THEN 'debit' ELSE 'X' END) AS card,
       CASE o_custkey % 5 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' WHEN 2 THEN 'discover' WHEN 3 THEN 'american express' END AS card4,
       120 + o_orderkey % 50 AS card3,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey * 7 % 90 END AS addr1,
       o_custkey % 500 AS card1,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'W' WHEN '2' THEN 'H' WHEN '3' THEN 'C' WHEN '4' THEN 'S' ELSE 'Z' END AS product,
       CASE o_orderkey % 6 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'user@ProtonMail.com' WHEN 2 THEN 'corp.example'
            WHEN 3 THEN 'yahoo.com' WHEN 4 THEN NULL ELSE 'tempmail.com' END AS email,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'mobile' ELSE 'desktop' END AS device_type,
       CASE o_orderkey % 4 WHEN 0 THEN 'Windows' WHEN 1 THEN NULL ELSE 'handset-' || CAST(o_custkey % 300 AS VARCHAR) END AS device_info,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 400 END AS d1,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 30 END AS d2,
       o_orderkey % 11 AS d3, o_orderkey % 17 AS d4, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 60 END AS d5
FROM orders
""")

view("c_nodes", """
SELECT c_custkey AS node, c_custkey * 37 % 1400 AS account_age_days, c_acctbal AS balance_mean,
       round(abs(c_acctbal) * (c_custkey % 10) / 8, 4) AS balance_std, c_custkey * 11 % 90 AS tx_count,
       c_custkey * 7 % 25 AS tx_velocity_7d, (c_custkey * 13 % 100) / 100.0::DOUBLE AS fan_out_ratio,
       (c_custkey * 17 % 50) / 20.0::DOUBLE - 0.1::DOUBLE AS amount_entropy, (c_custkey * 19 % 100) / 100.0::DOUBLE AS risky_email,
       (c_custkey * 23 % 100) / 100.0::DOUBLE AS device_consistency, (c_custkey * 29 % 40) / 10.0::DOUBLE AS addr_entropy,
       (c_custkey * 31 % 100) / 100.0::DOUBLE AS international_flag, (c_custkey * 41 % 1000) / 1000.0::DOUBLE AS pagerank,
       (c_custkey * 43 % 800) / 100.0::DOUBLE AS in_out_ratio, (c_custkey * 47 % 60) / 100.0::DOUBLE AS reciprocity_score,
       (c_custkey * 53 % 110) / 100.0::DOUBLE AS community_fraud_rate, c_custkey * 59 % 3 AS ring_membership,
       (c_custkey * 61 % 100) / 100.0::DOUBLE AS second_hop_fraud_rate,
       CASE WHEN c_custkey % 17 = 3 THEN 1 ELSE 0 END AS is_fraud, c_custkey % 37 AS community
FROM customer
""")

view("c_alerts", """
SELECT event_id AS alert_id, user_id AS account, score, severity, status, created,
       created + (CASE severity WHEN 'IMMINENT' THEN 1800 WHEN 'CRITICAL' THEN 7200 WHEN 'HOT' THEN 86400 ELSE 172800 END) AS sla,
       tainted
FROM (
 SELECT event_id, user_id, round(least(100, value * 1.5), 3) AS score,
        CASE WHEN round(least(100, value * 1.5), 3) >= 95 THEN 'IMMINENT' WHEN round(least(100, value * 1.5), 3) >= 85 THEN 'CRITICAL'
             WHEN round(least(100, value * 1.5), 3) >= 70 THEN 'HOT' WHEN round(least(100, value * 1.5), 3) >= 55 THEN 'WARMING' ELSE 'CLEAN' END AS severity,
        CASE event_id % 6 WHEN 0 THEN 'NEW' WHEN 1 THEN 'ACK' WHEN 2 THEN 'ASSIGNED' WHEN 3 THEN 'ESCALATED' WHEN 4 THEN 'RESOLVED' ELSE 'FALSE_POSITIVE' END AS status,
        CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS created, event_id % 3 = 0 AS tainted
 FROM events WHERE event_type = 'error')
WHERE severity <> 'CLEAN'
""")

view("c_profiles", """
SELECT a.account, a.holder, a.bank, a.segment, coalesce(max(al.score), 0) AS score,
       CASE WHEN coalesce(max(al.score), 0) >= 95 THEN 'IMMINENT' WHEN coalesce(max(al.score), 0) >= 85 THEN 'CRITICAL'
            WHEN coalesce(max(al.score), 0) >= 70 THEN 'HOT' WHEN coalesce(max(al.score), 0) >= 55 THEN 'WARMING' ELSE 'CLEAN' END AS severity
FROM c_accounts a LEFT JOIN c_alerts al ON al.account = a.account
GROUP BY ALL
""")

view("c_audit", """
SELECT o_orderkey + 1 AS seq, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS logged_at, o_orderpriority AS actor,
       CASE o_orderstatus WHEN 'F' THEN 'account.freeze' WHEN 'O' THEN 'alert.open' ELSE 'case.update' END AS action,
       'AC' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS target,
       '{"amount":' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '}' AS detail
FROM orders
""")

view("c_cand", """
SELECT DISTINCT incident, account FROM (
  SELECT incident, victim AS account FROM c_incidents
  UNION ALL
  SELECT i.incident, t.dst FROM c_incidents i JOIN c_transfers t ON t.src = i.victim AND t.epoch <= i.complaint)
WHERE account % 25 <> 7
""")

view("c_scores", """
SELECT incident, m.model, account,
       ((account * 7919 + incident * 104729 + m.model * 1299709) % 499) / 498.0::DOUBLE AS score
FROM c_cand, (SELECT unnest([1, 2, 3]) AS model) m
""")

view("c_case", """
SELECT i.incident, i.victim, i.t0, i.complaint, i.horizon, i.amount AS stolen, t.txn_id, t.src, t.dst, t.amount,
       t.epoch, t.channel, t.epoch - i.t0 AS offset_sec, t.dst % 25 = 7 AS to_exit
FROM c_incidents i
JOIN (SELECT incident, victim AS account FROM c_incidents
      UNION
      SELECT j.incident, u.dst FROM c_incidents j JOIN c_transfers u ON u.src = j.victim AND u.epoch BETWEEN j.t0 AND j.horizon
      WHERE u.dst % 25 <> 7) c ON c.incident = i.incident
JOIN c_transfers t ON t.src = c.account AND t.epoch BETWEEN i.t0 AND i.horizon
""")

view("c_decisions", """
SELECT incident, model, account, score,
       row_number() OVER (PARTITION BY incident, model ORDER BY score DESC, account) AS pos
FROM c_scores
""")

view("c_outcomes", """
SELECT i.incident, m.model AS policy, i.amount, i.amount * ((i.incident * 31 + m.model * 17) % 101) / 100.0::DOUBLE AS prevented,
       ((i.incident * 31 + m.model * 17) % 101) / 100.0::DOUBLE AS rate,
       (i.incident + m.model) % 4 AS innocent, (i.incident * m.model) % 6 AS mules, (i.incident + m.model) % 4 + (i.incident * m.model) % 6 AS frozen,
       CASE WHEN i.incident % 7 <> 0 THEN 2 + i.incident % 9 END AS first_freeze, (i.incident * m.model * 13 % 1000) / 10.0::DOUBLE AS solve_ms
FROM c_incidents i, (SELECT unnest([1, 2, 3]) AS model) m
""")

view("c_legs", """
SELECT src AS account, 'OUT' AS direction, dst AS peer, amount, epoch FROM c_transfers
UNION ALL SELECT dst, 'IN', src, amount, epoch FROM c_transfers
""")

view("c_positive", """
SELECT s.model, s.incident, s.account, s.score, coalesce(l.is_mule, false) AS positive FROM c_scores s LEFT JOIN c_labels l ON l.account = s.account
""")
