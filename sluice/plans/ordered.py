"""Registered queries over windows and ordered computations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cards as C
from ..operators import cases as K
from ..operators import evaluation as E
from ..operators import flows as W
from ..operators import ledger as L
from ..operators import ranking as T
from ..operators import windows as O
from ..sources import adapters as A
from .aggregates import VELOCITY_SQL, rounded
from .registry import query
from .views import AUDIT_KEY, AUDIT_SQL, audit_with_hashes, hmac_sql, payload_sql


@query("peak_fanout", "2.5.1", """
SELECT src AS account, max(n) AS max_fanout_10min FROM (
 SELECT a.src, a.txn_id, count(DISTINCT b.dst) AS n FROM c_transfers a JOIN c_transfers b ON b.src = a.src AND b.epoch > a.epoch - 600 AND b.epoch <= a.epoch GROUP BY a.src, a.txn_id) GROUP BY src""")
def peak_fanout(spark, sf):
    return W.peak_fanout(A.transfers(spark, sf))


@query("inflow_between", "2.5.2", """
SELECT i.incident AS ask, i.victim AS account, round(coalesce(sum(t.amount), 0), 2) AS inflow
FROM (SELECT incident, victim, t0 - 86400 AS s, horizon AS e FROM c_incidents) i LEFT JOIN c_transfers t ON t.dst = i.victim AND t.epoch BETWEEN i.s AND i.e GROUP BY ALL""")
def inflow_between(spark, sf):
    asks = A.incidents(spark, sf).select(F.col("incident").alias("ask"), F.col("victim").alias("account"), (F.col("t0") - 86400).alias("start"), F.col("horizon").alias("end"))
    return O.inflow_between(A.transfers(spark, sf), asks)


@query("rank_normalise", "2.5.3", """
SELECT incident, model, account, score, round(CASE WHEN n = 1 THEN 1.0 ELSE (r - 1 + (k - 1) / 2.0 + 1) / n END, 6) AS normalised FROM (
 SELECT *, rank() OVER (PARTITION BY incident, model ORDER BY score) AS r, count(*) OVER (PARTITION BY incident, model, score) AS k, count(*) OVER (PARTITION BY incident, model) AS n FROM c_scores)""")
def rank_normalise(spark, sf):
    return E.rank_normalise(A.model_scores(spark, sf), ["incident", "model"])


@query("alert_budget", "2.5.4", "SELECT incident, model, account, score, pos AS rank FROM c_decisions WHERE pos <= 12 AND score >= 0.4")
def alert_budget(spark, sf):
    return E.apply_budget(A.model_scores(spark, sf), ["incident", "model"], 12, 0.4)


@query("decision_queue", "2.5.5", """
SELECT d.incident, d.model, d.account, d.score, d.pos AS rank, CASE WHEN pos <= 8 AND score >= 0.3 THEN 'flag' ELSE 'clear' END AS decision,
  i.complaint - i.t0 + CAST(ceil(CASE WHEN pos <= 8 AND score >= 0.3 THEN pos ELSE least(pos, 9) END / 4.0) AS BIGINT) * 90 AS t_decision_sec
FROM c_decisions d JOIN c_incidents i ON i.incident = d.incident""")
def decision_queue(spark, sf):
    told = A.incidents(spark, sf).select("incident", (F.col("complaint") - F.col("t0")).alias("complaint_offset"))
    return E.decision_queue(A.model_scores(spark, sf), told, ["incident", "model"], 8, 0.3)


@query("first_crossings", "2.5.6", """
WITH ticks AS (SELECT incident, model, t, account, (round(score * 498) * (7 + t // 600) % 499) / 498.0 AS score FROM c_scores, (SELECT unnest([0, 600, 1200, 2400]) AS t)),
r AS (SELECT *, row_number() OVER (PARTITION BY incident, model, t ORDER BY score DESC, account) AS rank FROM ticks WHERE score >= 0.7),
f AS (SELECT incident, model, account, min(t) AS t_flag_sec, arg_min(rank, t) AS rank FROM r WHERE rank <= 10 GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY incident, model ORDER BY t_flag_sec, rank, account) AS pos FROM f)
SELECT q.incident, model, account, t_flag_sec, rank, pos, greatest(t_flag_sec, i.complaint - i.t0 + CAST(ceil(pos / 4.0) AS BIGINT) * 90) AS t_decision_sec FROM q JOIN c_incidents i ON i.incident = q.incident""")
def first_crossings(spark, sf):
    t = F.explode(F.array(*[F.lit(x) for x in (0, 600, 1200, 2400)]))
    ticks = A.model_scores(spark, sf).withColumn("t", t).withColumn(
        "score", (F.round(F.col("score") * 498) * (F.lit(7) + F.floor(F.col("t") / 600)) % 499) / 498.0)
    told = A.incidents(spark, sf).select("incident", (F.col("complaint") - F.col("t0")).alias("complaint_offset"))
    return E.first_crossings(ticks, told, 0.7, 10)


@query("issue_minutes", "2.5.7", """
SELECT d.incident, account, pos AS rank, i.delay + CAST(ceil((floor((pos - 1) / 4.0) + 1) * 1.5) AS BIGINT) AS issue_at_minute FROM c_decisions d JOIN c_incidents i ON i.incident = d.incident WHERE model = 1 AND pos <= 25""")
def issue_minutes(spark, sf):
    top = T.top_k_policy(A.model_scores(spark, sf).where("model = 1")).join(A.incidents(spark, sf).select("incident", "delay"), "incident")
    return top.select("incident", "account", "rank", O.issue_minute(F.col("rank") - 1, F.col("delay")).alias("issue_at_minute"))


@query("first_arrival", "2.5.8", """
SELECT incident, dst AS account, offset_sec AS arrival, src AS parent, amount FROM (SELECT *, row_number() OVER (PARTITION BY incident, dst ORDER BY offset_sec, txn_id) AS r FROM c_case) WHERE r = 1""")
def first_arrival(spark, sf):
    return K.first_arrival(A.case_transfers(spark, sf))


@query("stolen_balance", "2.5.9", """
WITH delta AS (SELECT incident, victim AS account, -1 AS t, amount AS d FROM c_incidents UNION ALL SELECT incident, src, offset_sec, -amount FROM c_case UNION ALL SELECT incident, dst, offset_sec, amount FROM c_case WHERE NOT to_exit),
m AS (SELECT c.incident, c.account, unnest([0, 1800, 3600, 7200, 21600]) AS t FROM c_cand c)
SELECT m.incident, m.account, m.t, round(greatest(0, coalesce(sum(d.d), 0)), 2) AS stolen FROM m LEFT JOIN delta d ON d.incident = m.incident AND d.account = m.account AND d.t <= m.t GROUP BY ALL""")
def stolen_balance(spark, sf):
    m = A.candidates(spark, sf).withColumn("t", F.explode(F.array(*[F.lit(x) for x in (0, 1800, 3600, 7200, 21600)])))
    return rounded(K.stolen_at(A.case_transfers(spark, sf), A.incidents(spark, sf), m), 2, "stolen")


@query("unrecoverable_series", "2.5.10", """
WITH g AS (SELECT incident, 0 AS t, 0.0 AS a FROM c_incidents UNION ALL SELECT incident, offset_sec, amount FROM c_case WHERE to_exit)
SELECT DISTINCT incident, t, round(sum(a) OVER (PARTITION BY incident ORDER BY t), 2) AS unrecoverable FROM g""")
def unrecoverable_series(spark, sf):
    return K.unrecoverable_series(A.case_transfers(spark, sf), A.incidents(spark, sf))


@query("velocity_7d", "2.5.11", VELOCITY_SQL)
def velocity_7d(spark, sf):
    return C.velocity_7d(A.cards(spark, sf))


@query("minute_frames", "2.5.12", """
WITH s AS (SELECT incident, amount, unnest(range(0, 361)) AS minute FROM c_incidents),
m AS (SELECT incident, offset_sec // 60 AS minute, sum(CASE WHEN to_exit THEN least(amount, stolen) * 0.1 ELSE 0 END) AS l, sum(CASE WHEN to_exit THEN 0 ELSE least(amount, stolen) * 0.05 END) AS s FROM c_case GROUP BY ALL),
z AS (SELECT d.incident, i.delay + pos AS minute, count(*) AS n FROM c_decisions d JOIN c_incidents i ON i.incident = d.incident WHERE model = 1 AND pos <= 5 GROUP BY ALL),
r AS (SELECT s.incident, s.minute, s.amount, sum(coalesce(m.l, 0)) OVER w AS l, sum(coalesce(m.s, 0)) OVER w AS sec, sum(coalesce(z.n, 0)) OVER w AS n
  FROM s LEFT JOIN m ON m.incident = s.incident AND m.minute = s.minute LEFT JOIN z ON z.incident = s.incident AND z.minute = s.minute WINDOW w AS (PARTITION BY s.incident ORDER BY s.minute))
SELECT incident, minute, CAST(n AS BIGINT) AS frozen, round(l, 2) AS leaked, round(sec, 2) AS recovered, round(greatest(0, amount - l - sec), 2) AS at_risk FROM r""")
def minute_frames(spark, sf):
    k = A.case_transfers(spark, sf)
    part = F.least("amount", "stolen")
    money = k.select("incident", F.floor(F.col("offset_sec") / 60).cast("int").alias("minute"),
                     F.when(F.col("to_exit"), part * 0.1).otherwise(0.0).alias("leaked"), F.when(F.col("to_exit"), 0.0).otherwise(part * 0.05).alias("secured"))
    inc = A.incidents(spark, sf)
    top = T.top_ranked(A.model_scores(spark, sf).where("model = 1"), ["incident"], [F.desc("score"), F.col("account")], 5)
    freezes = top.join(inc.select("incident", "delay"), "incident").select("incident", (F.col("delay") + F.col("rank")).cast("int").alias("minute"), F.lit(1).alias("n"))
    return K.minute_frames(inc, money, freezes, 360)


@query("round_robin_cases", "2.5.13", """
SELECT incident, typology, ring_id, amount, depth FROM (SELECT *, row_number() OVER (PARTITION BY typology, ring_id ORDER BY amount DESC, incident) AS depth FROM c_incidents) ORDER BY depth, typology, ring_id LIMIT 24""")
def round_robin_cases(spark, sf):
    return O.round_robin(A.incidents(spark, sf), ["typology", "ring_id"], 24).select("incident", "typology", "ring_id", "amount", "depth")


@query("benchmark_sample", "2.5.14")
def benchmark_sample(spark, sf):
    return O.benchmark_sample(A.incidents(spark, sf), 4)


@query("context_rank", "2.5.15", """
WITH core AS (SELECT DISTINCT incident, src AS account FROM c_case),
e AS (SELECT DISTINCT c.incident, t.txn_id, t.src, t.dst, t.epoch FROM core c JOIN c_incidents i ON i.incident = c.incident JOIN c_transfers t ON (t.src = c.account OR t.dst = c.account) AND t.epoch BETWEEN i.t0 - 2592000 AND i.horizon),
b AS (SELECT incident, src AS near, dst AS far, epoch, txn_id FROM e UNION ALL SELECT incident, dst, src, epoch, txn_id FROM e),
r AS (SELECT b.* FROM b JOIN core c ON c.incident = b.incident AND c.account = b.near WHERE NOT EXISTS (SELECT 1 FROM core x WHERE x.incident = b.incident AND x.account = b.far) AND far % 25 <> 7),
g AS (SELECT incident, far AS account, count(*) AS n, arg_min(near, epoch * 1000000 + txn_id) AS attached_to FROM r GROUP BY ALL)
SELECT incident, account, n, row_number() OVER (PARTITION BY incident ORDER BY n DESC, account) - 1 AS context_rank, attached_to FROM g""")
def context_rank(spark, sf):
    from ..operators.filters import visible_edges
    core = A.case_transfers(spark, sf).select("incident", F.col("src").alias("account")).distinct()
    inc = A.incidents(spark, sf)
    edges = visible_edges(A.transfers(spark, sf), core, inc.select("incident", F.col("horizon").alias("until")))
    edges = edges.join(inc.select("incident", "t0"), "incident").where("epoch >= t0 - 2592000")
    return K.context_rank(edges, core, A.exits(spark, sf))


@query("community_numbers", "2.5.16", """
WITH s AS (SELECT district AS community, count(*) AS size, min(account) AS first FROM c_accounts GROUP BY district),
r AS (SELECT *, row_number() OVER (ORDER BY size DESC, first) AS pos FROM s)
SELECT community, 'C' || lpad(CAST(pos AS VARCHAR), 2, '0') AS ring_id, size FROM r WHERE size >= 6""")
def community_numbers(spark, sf):
    members = A.accounts(spark, sf).select("account", F.col("district").alias("community"))
    return O.number_communities(members, 6)


PR_SQL = """
b AS (SELECT model, score, count(*) FILTER (positive) AS p, count(*) AS k FROM c_positive GROUP BY ALL),
c AS (SELECT model, score, sum(p) OVER w AS tp, sum(k) OVER w AS taken, sum(p) OVER (PARTITION BY model) AS pos FROM b WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


@query("best_threshold", "2.5.17", f"""
WITH {PR_SQL}, f AS (SELECT model, score, round(2.0 * tp / (taken + pos), 12) AS f1 FROM c),
m AS (SELECT model, max(f1) AS best_f1 FROM f GROUP BY model)
SELECT m.model, round(m.best_f1, 9) AS best_f1, greatest(0.01, least(0.99, max(f.score))) AS threshold FROM m JOIN f ON f.model = m.model AND f.f1 = m.best_f1 GROUP BY ALL""")
def best_threshold(spark, sf):
    return rounded(E.best_threshold(A.labelled_scores(spark, sf), ["model"]), 9, "best_f1")


GRID = [round(0.2 + 0.025 * i, 3) for i in range(25)]


@query("grid_thresholds", "2.5.17", f"""
WITH g AS (SELECT unnest([{', '.join(repr(x) for x in GRID)}]) AS threshold)
SELECT model, g.threshold, count(*) FILTER (positive AND score >= g.threshold) AS tp, count(*) FILTER (score >= g.threshold) AS k,
 round(2.0 * count(*) FILTER (positive AND score >= g.threshold) / (count(*) FILTER (score >= g.threshold) + count(*) FILTER (positive)), 6) AS f1 FROM c_positive, g GROUP BY ALL""")
def grid_thresholds(spark, sf):
    return rounded(E.grid_thresholds(A.labelled_scores(spark, sf), ["model"], GRID), 6, "f1").drop("pos")


PERCENTS = ", ".join(str(p / 100) for p in range(80, 100))


@query("percentile_thresholds", "2.5.17", f"""
WITH s AS (SELECT * FROM c_positive WHERE model = 1), q AS (SELECT unnest(range(80, 100)) AS percent, unnest(quantile_cont(score, [{PERCENTS}])) AS threshold FROM s)
SELECT q.percent, round(q.threshold, 9) AS threshold, round(2.0 * count(*) FILTER (positive AND score >= q.threshold) / (count(*) FILTER (score >= q.threshold) + count(*) FILTER (positive)), 6) AS f1 FROM s, q GROUP BY ALL""")
def percentile_thresholds(spark, sf):
    rows = O.percentile_thresholds(A.labelled_scores(spark, sf).where("model = 1"), list(range(80, 100)))
    return rounded(rounded(rows, 9, "threshold"), 6, "f1")


@query("average_precision", "2.5.18", """
WITH r AS (SELECT *, row_number() OVER w AS rank, count(*) FILTER (positive) OVER w AS tp FROM c_positive WINDOW w AS (PARTITION BY incident, model ORDER BY score DESC, account ROWS UNBOUNDED PRECEDING))
SELECT incident, model, round(coalesce(avg(tp / rank::DOUBLE) FILTER (positive), 0), 6) AS average_precision FROM r GROUP BY ALL""")
def average_precision(spark, sf):
    return rounded(E.average_precision(A.labelled_scores(spark, sf), ["incident", "model"]), 6, "average_precision")


@query("auc", "2.5.18", """
WITH r AS (SELECT model, positive, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM c_positive)
SELECT model, round((sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)), 6) AS auc FROM r GROUP BY model""")
def auc(spark, sf):
    return rounded(E.auc(A.labelled_scores(spark, sf), ["model"]), 6, "auc")


@query("score_history", "2.5.19", "SELECT account, created, alert_id, score, severity FROM c_alerts WHERE account IN (SELECT account FROM c_labels WHERE is_mule)")
def score_history(spark, sf):
    pts = A.alerts(spark, sf).select("account", "created", "alert_id", "score", "severity")
    return O.score_history(pts, A.labels(spark, sf).where("is_mule").select("account"))


@query("latest_score", "2.5.19", "SELECT account, created, score, severity FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY created DESC, alert_id DESC) AS r FROM c_alerts) WHERE r = 1")
def latest_score(spark, sf):
    return O.latest_per_account(A.alerts(spark, sf))


@query("audit_verification", "2.5.20", f"""
WITH h AS ({AUDIT_SQL}), v AS (SELECT ledger, seq, prev_hash <> coalesce(lag(entry_hash) OVER (PARTITION BY ledger ORDER BY seq), '') OR entry_hash <> {hmac_sql(payload_sql('prev_hash'))} AS bad FROM h)
SELECT ledger, count(*) AS entries, min(seq) FILTER (bad) AS broken_at, count(*) FILTER (bad) = 0 AS intact FROM v GROUP BY ledger""")
def audit_verification(spark, sf):
    return L.verify_chain(audit_with_hashes(spark, sf), ["ledger"], AUDIT_KEY)


def fraud_leaves(spark, sf):
    """Gateway rows as log lines in blocks of 48 consecutive ids."""
    g = A.gateway(spark, sf)
    text = F.concat(F.col("txn_id").cast("string"), F.col("src").cast("string"), F.col("k").cast("string"), F.lit("BLOCK"), F.col("epoch").cast("string"))
    from ..core import ordinal
    rows = g.select("txn_id", F.floor(F.col("txn_id") / 48).alias("block"), text.alias("serialized"))
    return ordinal(rows, ["block"], F.lit(0), ["txn_id"], "o").select("block", (F.col("o") - 1).alias("pos"), "serialized")


def merkle_sql(rounds: int = 6) -> str:
    leaf = "sha256(CAST(txn_id AS VARCHAR) || CAST(src AS VARCHAR) || CAST(k AS VARCHAR) || 'BLOCK' || CAST(epoch AS VARCHAR))"
    sql = f"SELECT txn_id // 48 AS block, row_number() OVER (PARTITION BY txn_id // 48 ORDER BY txn_id) - 1 AS pos, count(*) OVER (PARTITION BY txn_id // 48) AS n, {leaf} AS h FROM c_gateway"
    for _ in range(rounds):
        sql = (f"SELECT block, pos // 2 AS pos, max((n + 1) // 2) AS n, CASE WHEN max(n) > 1 THEN sha256(max(h) FILTER (pos % 2 = 0) || coalesce(max(h) FILTER (pos % 2 = 1), max(h) FILTER (pos % 2 = 0))) ELSE max(h) END AS h "
               f"FROM ({sql}) GROUP BY block, pos // 2")
    return f"SELECT block, h AS root FROM ({sql})"


BLOCKS_SQL = f"""
WITH m AS ({merkle_sql()}), s AS (SELECT block, CASE WHEN block % 23 = 5 THEN sha256('other') ELSE root END AS root, 1700000000 + block AS timestamp, block * 31 AS nonce FROM m),
p AS (SELECT block // 2 AS chain, block, root, '' AS prev_hash, timestamp, nonce, sha256(CAST(block AS VARCHAR) || '' || root || CAST(timestamp AS VARCHAR) || CAST(nonce AS VARCHAR)) AS hash FROM s WHERE block % 2 = 0),
q AS (SELECT s.block // 2 AS chain, s.block, s.root, CASE WHEN s.block % 14 = 3 THEN 'x' ELSE p.hash END AS prev_hash, s.timestamp, s.nonce, sha256(CAST(s.block AS VARCHAR) || p.hash || s.root || CAST(s.timestamp AS VARCHAR) || CAST(s.nonce AS VARCHAR)) AS hash FROM s JOIN p ON p.chain = s.block // 2 WHERE s.block % 2 = 1),
u AS (SELECT * FROM p UNION ALL SELECT * FROM q)
SELECT u.chain, u.block, u.root = m.root AS root_ok, u.hash = sha256(CAST(u.block AS VARCHAR) || u.prev_hash || u.root || CAST(u.timestamp AS VARCHAR) || CAST(u.nonce AS VARCHAR)) AS hash_ok,
  left(u.hash, 1) = '0' AS work_ok, coalesce(u.prev_hash = lag(u.hash) OVER (PARTITION BY u.chain ORDER BY u.block), true) AS link_ok FROM u JOIN m ON m.block = u.block"""


@query("block_verification", "2.5.21", BLOCKS_SQL)
def block_verification(spark, sf):
    leaves = fraud_leaves(spark, sf)
    b = F.col("block")
    s = L.merkle_roots(leaves).select("block", F.when(b % 23 == 5, F.sha2(F.lit("other"), 256)).otherwise(F.col("root")).alias("root"),
                                      (b + 1700000000).alias("timestamp"), (b * 31).alias("nonce"), F.floor(b / 2).alias("chain"))
    first = s.where("block % 2 = 0").withColumn("prev_hash", F.lit("")).withColumn("hash", L.block_hash(F.lit("")))
    nxt = s.where("block % 2 = 1").join(first.select("chain", F.col("hash").alias("up")), "chain").withColumn("hash", L.block_hash(F.col("up")))
    nxt = nxt.withColumn("prev_hash", F.when(b % 14 == 3, "x").otherwise(F.col("up"))).drop("up")
    return L.verify_blocks(first.unionByName(nxt), leaves, ["chain"], 1)


@query("merkle_roots", "2.9.59", merkle_sql())
def merkle_roots(spark, sf):
    return L.merkle_roots(fraud_leaves(spark, sf))
