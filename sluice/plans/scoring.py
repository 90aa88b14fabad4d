"""Registered queries over scoring, detectors and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import detectors as D
from ..operators import evaluation as E
from ..operators import features as X
from ..operators import flows as W
from ..operators import forest as Z
from ..operators import graph as R
from ..operators import signals as G
from ..sources import adapters as A
from . import stages
from .aggregates import FLOWS, OUTCOME_SQL, case_outcome_rows, rounded
from .registry import query
from .scalars import AMOUNT_SQL, ANOMALY_SQL
from .views import AS_OF, AS_OF_DAY, AUDIT_KEY, SIGNALS_SQL, hmac_sql, payload_sql, signal_rows

SIGNAL_COLS = ("s1_velocity", "s2_round_trip", "s3_structuring", "s4_dormant_device", "s5_profile_mismatch", "s6_sim_swap")
WEIGHTED = "20 * s1_velocity + 30 * s2_round_trip + 14 * s3_structuring + 14 * s4_dormant_device + 12 * s5_profile_mismatch + 10 * s6_sim_swap"


@query("rules_detector", "2.9.26", f"""
WITH f AS (SELECT a.account, {AS_OF_DAY} - prior_day AS dorm, coalesce(m, 0) AS mc, coalesce(n, 0) AS fan FROM c_accounts a LEFT JOIN (SELECT dst, max(amount) AS m FROM c_transfers GROUP BY dst) i ON i.dst = a.account
 LEFT JOIN (SELECT src, max(n) AS n FROM (SELECT x.src, x.txn_id, count(DISTINCT y.dst) AS n FROM c_transfers x JOIN c_transfers y ON y.src = x.src AND y.epoch > x.epoch - 600 AND y.epoch <= x.epoch GROUP BY ALL) GROUP BY src) o ON o.src = a.account)
SELECT account, CASE WHEN (dorm > 90 AND mc > 100000) OR fan >= 5 THEN 1.0 ELSE 0.0 END AS score FROM f""")
def rules_detector(spark, sf):
    t = A.transfers(spark, sf)
    rows = A.accounts(spark, sf).select("account", "prior_day").join(W.flow_aggregate(t).select("account", "max_credit"), "account", "left").join(W.peak_fanout(t), "account", "left").fillna(0)
    return rows.select("account", S.rule_score(F.lit(AS_OF_DAY) - F.col("prior_day"), F.col("max_credit"), F.col("max_fanout_10min")).alias("score"))


SIGNAL_FLOATS = (*SIGNAL_COLS, "sent_sum", "recv_sum", "sent_mean", "recv_mean", "round_trip_ratio", "net_flow", "dormant_days", "account_age_days")


@query("six_signal_features", "2.9.27", "SELECT * REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in SIGNAL_FLOATS) + f") FROM ({SIGNALS_SQL})")
def six_signal_features(spark, sf):
    return rounded(signal_rows(spark, sf), 4, *SIGNAL_FLOATS)


FIRED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} > 0 THEN 'S{i + 1}' END" for i, c in enumerate(SIGNAL_COLS)) + "], lambda x: x IS NOT NULL), ',')"


@query("weighted_signal_score", "2.9.28", f"""
WITH s AS ({SIGNALS_SQL}), l AS (SELECT account, unnest(['S1','S2','S3','S4','S5','S6']) AS code, unnest([{', '.join(SIGNAL_COLS)}]) * unnest([20, 30, 14, 14, 12, 10]) AS c FROM s)
SELECT account, round(least(100, {WEIGHTED}), 2) AS score, {FIRED} AS fired, coalesce((SELECT string_agg(code, ',' ORDER BY round(c, 2) DESC, code) FROM l WHERE l.account = s.account AND c > 0), '') AS ranked FROM s""")
def weighted_signal_score(spark, sf):
    return G.weighted_score(signal_rows(spark, sf))


TAINTS = "CASE WHEN account % 6 = 1 THEN 55.0 WHEN account % 6 = 2 THEN 34.1 END"
FINAL = f"round(least(100, round(least(100, {WEIGHTED}), 2) + coalesce({TAINTS}, 0)), 2)"


@query("fold_taint", "2.9.29", f"""
WITH f AS (SELECT account, {FINAL} AS final_score, coalesce({TAINTS}, 0) > 0 AS net_fired, account % 10 = 4 AS held FROM ({SIGNALS_SQL})),
b AS (SELECT *, CASE WHEN final_score >= 95 THEN 'IMMINENT' WHEN final_score >= 85 THEN 'CRITICAL' WHEN final_score >= 70 THEN 'HOT' WHEN final_score >= 55 THEN 'WARMING' ELSE 'CLEAN' END AS severity FROM f)
SELECT account, final_score, net_fired, severity, CASE severity WHEN 'IMMINENT' THEN 6 WHEN 'CRITICAL' THEN 5 WHEN 'HOT' THEN 3 WHEN 'WARMING' THEN 2 ELSE 0 END AS tier,
  CASE WHEN held THEN 'FROZEN' ELSE CASE severity WHEN 'IMMINENT' THEN 'FROZEN' WHEN 'CRITICAL' THEN 'RESTRICTED' WHEN 'HOT' THEN 'KYC_HOLD' WHEN 'WARMING' THEN 'WATCH' ELSE 'ACTIVE' END END AS status FROM b""")
def fold_taint(spark, sf):
    a = F.col("account")
    acc = A.accounts(spark, sf)
    taint = acc.select("account", F.when(a % 6 == 1, 55.0).when(a % 6 == 2, 34.1).alias("taint")).where("taint IS NOT NULL")
    status = acc.where("account % 10 = 4").select("account", F.lit("FROZEN").alias("status"))
    return G.fold_taint(G.weighted_score(signal_rows(spark, sf)), taint, status)


CASE_SIGNALS = """
WITH l AS (SELECT c.incident, c.account, i.complaint, g.direction, g.amount, g.epoch FROM c_cand c JOIN c_incidents i ON i.incident = c.incident JOIN c_legs g ON g.account = c.account AND g.epoch <= i.complaint),
s AS (SELECT c.incident, c.account, a.prior_day, i.complaint, a.segment, count(*) OVER (PARTITION BY c.incident, a.device) AS peers FROM c_cand c JOIN c_incidents i ON i.incident = c.incident JOIN c_accounts a ON a.account = c.account),
g AS (SELECT incident, account, count(*) FILTER (epoch > complaint - 172800) AS n48, coalesce(sum(amount) FILTER (direction = 'OUT'), 0) AS o, coalesce(sum(amount) FILTER (direction = 'IN'), 0) AS i, count(*) FILTER (amount >= 25000 AND amount < 50000) AS near FROM l GROUP BY ALL)
SELECT s.incident, s.account, round(least(1, (20 * greatest(0, least(1, (coalesce(n48, 0) - 3) / 12.0)) + 30 * CASE WHEN coalesce(i, 0) <= 0 THEN 0 WHEN least(1, o / i) > 0.5 THEN (least(1, o / i) - 0.5) / 0.5 ELSE 0 END
  + 14 * greatest(0, least(1, (coalesce(near, 0) - 2) / 6.0)) + 14 * CASE WHEN peers > 1 AND (complaint - prior_day * 86400) / 86400.0 > 90 THEN least(1, (complaint - prior_day * 86400) / 86400.0 / 180 + 0.3) ELSE 0 END
  + 12 * greatest(0, least(1, ((coalesce(o, 0) + coalesce(i, 0)) / CASE segment WHEN 'salary' THEN 150000.0 WHEN 'retail' THEN 80000.0 WHEN 'student' THEN 30000.0 WHEN 'business' THEN 1500000.0 ELSE 60000.0 END - 1.5) / 4.5))) / 100), 4) AS score
FROM s LEFT JOIN g ON g.incident = s.incident AND g.account = s.account"""


@query("case_signal_score", "2.9.30", CASE_SIGNALS)
def case_signal_score(spark, sf):
    inc = A.incidents(spark, sf)
    pool, acc = A.candidates(spark, sf), A.accounts(spark, sf)
    legs = G.account_legs(A.transfers(spark, sf)).join(pool.join(inc.select("incident", "complaint"), "incident"), "account")
    peers = W.device_peers(pool, acc)
    prof = pool.join(acc, "account").join(peers, ["incident", "account"]).join(inc.select("incident", F.col("complaint").alias("at")), "incident").select(
        "incident", "account", "segment", (F.col("prior_day") * 86400).alias("last_active"), (F.col("open_day") * 86400).alias("opened_at"), F.lit(1).alias("n_devices"),
        F.lit(0).alias("sim_swaps_72h"), (F.col("device_peers_in_incident") > 0).alias("new_device"), F.col("at").alias("complaint"))
    feats = G.signal_features(prof, legs, F.col("complaint"), ("incident", "account"))
    total = sum((F.col(c) * w for c, w in zip(G.COLUMNS, G.WEIGHTS.values())), F.lit(0.0)) / 100
    return feats.select("incident", "account", F.round(F.least(F.lit(1.0), total), 4).alias("score"))


@query("behaviour_features", "2.9.31", f"""
WITH a AS (SELECT account, count(*) FILTER (epoch > {AS_OF} - 172800) AS n24, coalesce(sum(amount) FILTER (direction = 'OUT' AND epoch > {AS_OF} - 172800), 0) AS out24, count(*) FILTER (epoch > {AS_OF} - 691200) AS n7, coalesce(sum(amount) FILTER (direction = 'OUT' AND epoch > {AS_OF} - 691200), 0) AS out7 FROM c_legs GROUP BY account)
SELECT t.txn_id, round(least(n24 / 10.0, 1), 2) AS velocity, round(CASE WHEN n7 = 0 OR out7 = 0 THEN 0 ELSE least(out24 / (out7 / 7.0) / 3, 1) END, 2) AS burst,
  round(CASE WHEN n24 = 0 OR out24 = 0 THEN 0 ELSE least(abs(t.amount - out24 / n24) / (out24 / n24), 1) END, 2) AS deviation FROM c_transfers t JOIN a ON a.account = t.src""")
def behaviour_features(spark, sf):
    t = A.transfers(spark, sf)
    legs = G.account_legs(t)
    out = F.when(F.col("direction") == "OUT", F.col("amount")).otherwise(0.0)
    late, week = F.col("epoch") > AS_OF - 172800, F.col("epoch") > AS_OF - 691200
    agg = legs.groupBy("account").agg(F.count_if(late).alias("n24"), F.sum(F.when(late, out).otherwise(0.0)).alias("out24"), F.count_if(week).alias("n7"), F.sum(F.when(week, out).otherwise(0.0)).alias("out7"))
    f = S.behaviour_features(F.col("n24"), F.col("out24"), F.col("n7"), F.col("out7"), F.col("amount"))
    return t.join(agg, t["src"] == agg["account"]).select("txn_id", *[c.alias(n) for n, c in f.items()])


@query("risk_fusion", "2.9.32", """
WITH b AS (SELECT txn_id, gnn, eif, CASE WHEN ja3 IS NULL THEN 0.3 ELSE 0.2 + ja3 / 50.0 END AS ja3, (txn_id % 11) / 10.0 AS v, (txn_id % 7) / 6.0 AS bu, (txn_id % 5) / 4.0 AS dv, (src % 10) / 9.0 AS cn, (dst % 10) / 9.0 AS th FROM c_gateway),
s AS (SELECT *, least(v * 0.3 + bu * 0.5 + dv * 0.2, 1) AS bs, least(cn * 0.6 + th * 0.4, 1) AS gs FROM b), r AS (SELECT *, least(0.40 * coalesce(gnn, 0) + 0.20 * coalesce(eif, 0) + 0.25 * bs + 0.10 * gs + 0.05 * ja3, 1) AS risk FROM s)
SELECT txn_id, round(bs, 6) AS behaviour_score, round(gs, 6) AS graph_score, round(risk, 6) AS risk, CASE WHEN round(risk, 9) >= 0.75 THEN 'BLOCK' WHEN round(risk, 9) >= 0.45 THEN 'REVIEW' ELSE 'APPROVE' END AS decision FROM r""")
def risk_fusion(spark, sf):
    t, g = F.col("txn_id"), A.gateway(spark, sf)
    ja3 = F.when(F.col("ja3").isNull(), 0.3).otherwise(F.col("ja3") / 50.0 + 0.2)
    f = S.fuse(F.col("gnn"), F.col("eif"), ja3, (t % 11) / 10.0, (t % 7) / 6.0, (t % 5) / 4.0, (F.col("src") % 10) / 9.0, (F.col("dst") % 10) / 9.0)
    return g.select("txn_id", *[F.round(c, 6).alias(n) for n, c in f.items()], S.decision(F.round(f["risk"], 9)).alias("decision"))


ENSEMBLE = """
WITH e AS (SELECT t.txn_id, t.gnn, t.eif, t.gnn IS NULL OR abs(t.gnn - 0.89) < 0.01 AS stale, coalesce(t.gnn, 0) AS g, coalesce(t.eif, 0) AS e, s.is_fraud = 1 OR d.is_fraud = 1 AS actual FROM c_gateway t JOIN c_nodes s ON s.node = t.src JOIN c_nodes d ON d.node = t.dst),
r AS (SELECT *, greatest(0, least(1, CASE WHEN stale THEN e WHEN g >= 0.95 OR e >= 0.90 THEN greatest(g, e) WHEN g >= 0.75 AND e >= 0.40 THEN 0.85 WHEN g < 0.30 AND e < 0.30 THEN least(g, e) ELSE g * 0.7 + e * 0.3 END)) AS risk FROM e)"""


@query("ensemble_risk", "2.9.33", ENSEMBLE + " SELECT txn_id, round(risk, 6) AS risk, actual FROM r")
def ensemble_risk(spark, sf):
    return _ensemble(spark, sf).select("txn_id", F.round("risk", 6).alias("risk"), "actual")


def _ensemble(spark, sf):
    n = A.nodes(spark, sf)
    from ..operators.joins import endpoint_lookup
    rows = endpoint_lookup(A.gateway(spark, sf), n, "is_fraud").where("src_is_fraud IS NOT NULL AND dst_is_fraud IS NOT NULL")
    return rows.select("txn_id", "gnn", "eif", S.ensemble_risk(F.col("gnn"), F.col("eif")).alias("risk"), ((F.col("src_is_fraud") == 1) | (F.col("dst_is_fraud") == 1)).alias("actual"))


def cm_sql(cond, where="true"):
    return f"SELECT count(*) FILTER ({cond} AND actual) AS tp, count(*) FILTER ({cond} AND NOT actual) AS fp, count(*) FILTER (NOT ({cond}) AND actual) AS fn, count(*) FILTER (NOT ({cond}) AND NOT actual) AS tn FROM r WHERE {where}"


@query("ensemble_metrics", "2.9.33", ENSEMBLE + f""", m AS (SELECT 'combined' AS model, * FROM ({cm_sql('round(risk, 9) >= 0.65')}) UNION ALL SELECT 'gnn', * FROM ({cm_sql('gnn >= 0.86', 'NOT stale')}) UNION ALL SELECT 'eif', * FROM ({cm_sql('e >= 0.48 AND eif IS NOT NULL')}))
SELECT model, tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall FROM m""")
def ensemble_metrics(spark, sf):
    rows = _ensemble(spark, sf)
    stale = F.col("gnn").isNull() | (F.abs(F.coalesce("gnn", F.lit(0.0)) - 0.89) < 0.01)
    long = (rows.select(F.lit("combined").alias("model"), (F.round("risk", 9) >= 0.65).alias("predicted"), "actual")
            .unionByName(rows.where(~stale).select(F.lit("gnn").alias("model"), (F.col("gnn") >= 0.86).alias("predicted"), "actual"))
            .unionByName(rows.select(F.lit("eif").alias("model"), F.coalesce(F.col("eif") >= 0.48, F.lit(False)).alias("predicted"), "actual")))
    return rounded(E.confusion(long, ["model"]).select("model", "tp", "fp", "fn", "tn", "precision", "recall"), 6, "precision", "recall")


BLEND = """
WITH kn AS (SELECT node, pagerank AS risk FROM c_nodes WHERE node % 4 <> 1), nb AS (SELECT DISTINCT * FROM (SELECT src AS account, dst AS peer FROM c_transfers UNION ALL SELECT dst, src FROM c_transfers)),
ns AS (SELECT a.account, avg(k.risk) AS m, max(k.risk) AS x FROM c_accounts a LEFT JOIN nb ON nb.account = a.account LEFT JOIN kn k ON k.node = nb.peer WHERE a.account NOT IN (SELECT node FROM kn) GROUP BY a.account),
sc AS (SELECT a.account, coalesce(k.risk, least(0.75, CASE WHEN ns.m IS NULL THEN 0.25 ELSE greatest(0, least(1, 0.7 * 0.25 + 0.2 * ns.m + 0.1 * ns.x)) END)) AS risk FROM c_accounts a LEFT JOIN kn k ON k.node = a.account LEFT JOIN ns ON ns.account = a.account),
bl AS (SELECT g.*, least(1, greatest(0.8 * s.risk + 0.2 * d.risk, s.risk, d.risk * 0.5)) AS base FROM c_gateway g JOIN sc s ON s.account = g.src JOIN sc d ON d.account = g.dst)"""


def account_risks(spark, sf):
    """Known scores, and for unseen accounts the prior pulled toward their neighbours."""
    known = A.nodes(spark, sf).where("node % 4 <> 1").select(F.col("node").alias("account"), F.col("pagerank").alias("known"))
    t = A.transfers(spark, sf)
    near = R.undirected(t).join(known.withColumnRenamed("account", "peer"), "peer").groupBy("account").agg(F.avg("known").alias("m"), F.max("known").alias("x"))
    rows = A.accounts(spark, sf).select("account").join(known, "account", "left").join(near, "account", "left")
    return rows.select("account", F.coalesce("known", S.new_account_score(F.col("m"), F.col("x"))).alias("risk"))


def blended(spark, sf):
    risk = account_risks(spark, sf)
    side = lambda c, n: risk.select(F.col("account").alias(c), F.col("risk").alias(n))
    rows = A.gateway(spark, sf).join(side("src", "sr"), "src").join(side("dst", "dr"), "dst")
    return rows.withColumn("base", S.blend_endpoints(F.col("sr"), F.col("dr")))


@query("endpoint_blend", "2.9.34", BLEND + " SELECT txn_id, round(base, 6) AS risk FROM bl")
def endpoint_blend(spark, sf):
    return blended(spark, sf).select("txn_id", F.round("base", 6).alias("risk"))


@query("context_blend", "2.9.34", BLEND + """ SELECT txn_id, round(CASE WHEN k % 4 = 0 THEN base ELSE greatest(0, least(1, 0.68 * base + 0.16 * least(1, k / 100.0) + 0.08 * least(1, k % 13 / 10.0) + 0.04 * least(1, k % 5 / 4.0) + 0.02 * least(1, k % 7 / 6.0) + 0.01 * least(1, k % 17 / 10.0) + 0.01 * least(1, k % 19 / 10.0))) END, 6) AS risk FROM bl""")
def context_blend(spark, sf):
    k = F.col("k")
    on = lambda c: F.when(k % 4 == 0, 0.0).otherwise(c)
    mixed = S.blend_context(F.col("base"), on(k / 100.0), on((k % 13).cast("double")), on(F.lit(0.5)), on(k % 5 / 4.0), on(k % 7 / 6.0), on((k % 17).cast("double")), on((k % 19).cast("double")))
    return blended(spark, sf).select("txn_id", F.round(mixed, 6).alias("risk"))


@query("batch_scoring", "2.9.60", BLEND + f""", sd AS (SELECT txn_id, {AMOUNT_SQL} AS risk FROM (SELECT txn_id, base, amount AS amt FROM bl))
SELECT txn_id, round(risk, 6) AS risk, CASE WHEN round(risk, 9) >= 0.65 THEN 'HIGH' WHEN round(risk, 9) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level, round(risk, 9) >= 0.5 AS flagged FROM sd""")
def batch_scoring(spark, sf):
    risk = F.round(S.amount_adjusted(F.col("base"), F.col("amount")), 9)
    return blended(spark, sf).select("txn_id", F.round(risk, 6).alias("risk"), S.risk_level(risk, 0.5).alias("level"), (risk >= 0.5).alias("flagged"))


ANOMALY = ("velocity_score", "burst_score", "suspicious_neighbor_count", "ip_reuse_count", "ja3_reuse_count", "community_fraud_rate_feat", "ring_membership_feat", "network_risk_score")


@query("anomaly_features", "2.9.35", f"SELECT node, is_fraud, {', '.join(f'round({c}, 5) AS {c}' for c in ANOMALY)} FROM ({ANOMALY_SQL})")
def anomaly_features(spark, sf):
    return rounded(A.nodes(spark, sf).select("node", "is_fraud", *S.anomaly_features()), 5, *ANOMALY)


def forest_inputs(spark, sf):
    from ..operators.reports import standard_apply, standard_fit
    base = A.nodes(spark, sf).select("node", "is_fraud", *S.anomaly_features())
    wide = base.select("*", *S.interactions())
    names = [*ANOMALY, *S.INTERACTIONS]
    return standard_apply(wide, standard_fit(wide, names), names, ["node", "is_fraud"]), names


def forest_of(spark, sf):
    rows, names = forest_inputs(spark, sf)
    return stages.stage(spark, sf, "forest", lambda: Z.fit_forest(rows, "node", names)), rows, names


@query("isolation_forest", "2.9.36 2.11.2")
def isolation_forest(spark, sf):
    from ..core import exact_quantiles
    forest, rows, names = forest_of(spark, sf)
    scored = stages.stage(spark, sf, "forest-scores", lambda: Z.score_forest(rows, ["node", "is_fraud"], names, forest))
    cut = exact_quantiles(scored, [], "raw", {"t": 0.88}).scalar()
    return Z.calibrated(scored, cut).withColumn("flagged", F.col("raw") > cut)


@query("ablation_importance", "2.9.37")
def ablation_importance(spark, sf):
    forest, rows, names = forest_of(spark, sf)
    return Z.ablation_importance(rows, "node", names, forest)


@query("additive_risk", "2.9.38", f"""
WITH dc AS (SELECT account, count(*) OVER (PARTITION BY device) AS dn FROM c_accounts), o AS (SELECT src AS account, count(*) AS n FROM c_transfers GROUP BY src),
u AS (SELECT account, count(*) AS d FROM (SELECT src AS account, dst AS peer FROM c_transfers UNION SELECT dst, src FROM c_transfers) GROUP BY account),
p AS (SELECT c.incident, c.account, dn * 10.0 AS device_part, coalesce(n, 0) / ({AS_OF_DAY} - a.open_day + 1) * 100.0 AS velocity_part, coalesce(d, 0) / (SELECT count(*) - 1 FROM c_accounts) * 200.0 AS centrality_part
  FROM c_cand c JOIN c_accounts a ON a.account = c.account JOIN dc ON dc.account = c.account LEFT JOIN o ON o.account = c.account LEFT JOIN u ON u.account = c.account)
SELECT incident, account, round(device_part, 6) AS device_part, round(velocity_part, 6) AS velocity_part, round(centrality_part, 6) AS centrality_part, round((device_part + velocity_part + centrality_part) / max(device_part + velocity_part + centrality_part) OVER (PARTITION BY incident), 6) AS score FROM p""")
def additive_risk(spark, sf):
    a, t = A.accounts(spark, sf), A.transfers(spark, sf)
    age = F.lit(AS_OF_DAY) - F.col("open_day") + 1
    facts = (a.select("account", "open_day").join(W.cluster_sizes(a), "account").join(t.groupBy(F.col("src").alias("account")).agg(F.count(F.lit(1)).alias("n")), "account", "left")
             .join(R.degree_centrality(a, t), "account").fillna(0, ["n"]))
    parts = S.additive_parts(F.col("device_cluster_size"), F.col("n") / age, F.col("network_score"))
    rows = A.candidates(spark, sf).join(facts.select("account", *[c.alias(n) for n, c in parts.items()]), "account").withColumn("total", F.col("device_part") + F.col("velocity_part") + F.col("centrality_part"))
    top = rows.groupBy("incident").agg(F.max("total").alias("top"))
    return rows.join(top, "incident").select("incident", "account", *[F.round(n, 6).alias(n) for n in parts], F.round(F.col("total") / F.col("top"), 6).alias("score"))


@query("proxy_score", "2.9.39", """
WITH o AS (SELECT src AS account, sum(amount) AS os, count(DISTINCT dst) AS od, min(epoch) AS fo FROM c_transfers GROUP BY src), i AS (SELECT dst AS account, sum(amount) AS s, min(epoch) AS fi, max(CASE WHEN txn_id % 9 = 0 THEN 1 ELSE 0 END) AS positive FROM c_transfers GROUP BY dst)
SELECT coalesce(o.account, i.account) AS account, round(ln(1 + coalesce(od, 0)) + greatest(0, least(2, coalesce(os, 0) / (coalesce(s, 0) + 1))) - greatest(0, least(1440, (coalesce(fo, 0) - coalesce(fi, 0)) / 60.0)) / 1440, 6) AS score, coalesce(positive, 0) AS positive FROM o FULL OUTER JOIN i ON i.account = o.account""")
def proxy_score(spark, sf):
    f = W.foreign_features(A.transfers(spark, sf).withColumn("is_sar", F.col("txn_id") % 9 == 0))
    return rounded(W.proxy_score(f), 6, "score")


def training_rows(spark, sf):
    """Candidates of every incident with their features and truth."""
    def build():
        m = X.build_matrix(A.incidents(spark, sf), A.candidates(spark, sf), A.transfers(spark, sf), A.accounts(spark, sf), A.exits(spark, sf))
        truth = A.labels(spark, sf).select("account", F.col("is_mule").cast("double").alias("label"))
        return m.join(truth, "account", "left").fillna(0.0, ["label"])
    return stages.stage(spark, sf, "training", build)


def plain_features(rows):
    return [c for c in X.FEATURES if c in rows.columns]


@query("tree_detector", "2.9.40")
def tree_detector(spark, sf):
    rows = training_rows(spark, sf)
    score = D.train_trees(rows, plain_features(rows))
    return score(rows)


LINEAR = ("in_degree", "out_degree", "fanout_ratio", "turnover_ratio", "reciprocity", "recipient_jaccard_max", "txn_count", "device_cluster_size", "same_window_openings")


@query("linear_detector", "2.9.41")
def linear_detector(spark, sf):
    rows = training_rows(spark, sf)
    score, _ = D.train_linear(rows, LINEAR)
    return score(rows)


@query("stratified_split", "2.9.42", """
WITH r AS (SELECT node, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY md5(CAST(node AS VARCHAR) || '|7'), node) - 1 AS o, count(*) OVER (PARTITION BY is_fraud) AS n FROM c_nodes)
SELECT node, is_fraud, CASE WHEN o / n::DOUBLE < 0.7 THEN 'train' WHEN o / n::DOUBLE < 0.7 + 0.15 THEN 'valid' ELSE 'test' END AS part FROM r""")
def stratified_split(spark, sf):
    return D.stratified_split(A.nodes(spark, sf).select("node", "is_fraud"), "is_fraud", "node")


@query("tier_evaluation", "2.9.43", """
WITH r AS (SELECT *, row_number() OVER w AS rank, count(*) FILTER (positive) OVER w AS tp FROM (SELECT model, incident * 1000003 + account AS account, score, positive FROM c_positive) WINDOW w AS (PARTITION BY model ORDER BY score DESC, account ROWS UNBOUNDED PRECEDING))
SELECT model, round(avg(tp / rank::DOUBLE) FILTER (positive), 6) AS average_precision, round(avg(positive::INT) FILTER (rank <= 50), 6) AS p_at_50, round(avg(positive::INT) FILTER (rank <= 100), 6) AS p_at_100,
 round(count(*) FILTER (positive AND score >= 0.5) / count(*) FILTER (score >= 0.5)::DOUBLE, 6) AS precision, round(count(*) FILTER (positive AND score >= 0.5) / count(*) FILTER (positive)::DOUBLE, 6) AS recall, count(*) FILTER (score >= 0.5) AS flagged FROM r GROUP BY model""")
def tier_evaluation(spark, sf):
    s = A.labelled_scores(spark, sf).withColumn("account", F.col("incident") * 1000003 + F.col("account")).select("model", "account", "score", "positive")
    return rounded(E.evaluate_tier(s, ["model"]), 6, "average_precision", "precision", "recall")


@query("deviation_attributions", "2.9.44", f"""
WITH l AS (UNPIVOT (SELECT account, CAST(out_value AS DOUBLE) AS out_value, CAST(in_degree AS DOUBLE) AS in_degree, CAST(out_count AS DOUBLE) AS out_count, CAST(max_credit AS DOUBLE) AS max_credit FROM ({FLOWS})) ON out_value, in_degree, out_count, max_credit INTO NAME feature VALUE value),
m AS (SELECT feature, median(value) AS mid, stddev_pop(value) AS sd FROM l GROUP BY feature)
SELECT account, l.feature, round(value, 2) AS value, round(CASE WHEN sd > 0 THEN (value - mid) / sd ELSE 0 END, 6) AS contribution FROM l JOIN m ON m.feature = l.feature""")
def deviation_attributions(spark, sf):
    f = W.flow_aggregate(A.transfers(spark, sf))
    return rounded(rounded(D.deviation_attributions(f, [], ["out_value", "in_degree", "out_count", "max_credit"]), 6, "contribution"), 2, "value")


@query("operating_points", "2.9.46", """
WITH n AS (SELECT model, count(*) AS n, max(score) AS top FROM c_positive WHERE NOT positive GROUP BY model), k AS (SELECT model, n, top, CAST(round_even(n * 0.05, 0) AS BIGINT) AS allowed FROM n),
i AS (SELECT model, score, row_number() OVER (PARTITION BY model ORDER BY score DESC) AS r FROM c_positive WHERE NOT positive),
p AS (SELECT k.model, 'equal_fpr' AS mode, 1000000 AS budget, CASE WHEN allowed >= 1 THEN i.score ELSE top + 1e-9 END AS threshold FROM k LEFT JOIN i ON i.model = k.model AND i.r = k.allowed
 UNION ALL SELECT model, 'equal_alert_budget', 12, 1e-9 FROM k UNION ALL SELECT model, 'native', 1000000, 0.5 FROM k)
SELECT p.model, mode, budget, threshold, round(count(*) FILTER (NOT positive AND score >= threshold) / count(*) FILTER (NOT positive)::DOUBLE, 6) AS fpr, round(count(*) FILTER (positive AND score >= threshold) / count(*) FILTER (positive)::DOUBLE, 6) AS tpr
FROM p JOIN c_positive s ON s.model = p.model GROUP BY p.model, mode, budget, threshold""")
def operating_points(spark, sf):
    return rounded(E.operating_points(A.labelled_scores(spark, sf).select("model", "score", "positive"), ["model"], 12, 0.05, 0.5), 6, "fpr", "tpr")


@query("rule_fraction", "2.9.47", "SELECT account, round(((own_balance > 5000)::INT * 2 + (device % 3 = 0)::INT * 1.5 + (kyc_tier = 'video')::INT * 0.5) / 4.0, 6) AS rule_fraction FROM c_accounts")
def rule_fraction(spark, sf):
    fired = A.accounts(spark, sf).select("account", (F.col("own_balance") > 5000).alias("rich"), (F.col("device") % 3 == 0).alias("shared"), (F.col("kyc_tier") == "video").alias("video"))
    return rounded(E.rule_fraction(fired, {"rich": 2.0, "shared": 1.5, "video": 0.5}), 6, "rule_fraction")


def step_sql(x, factor):
    return f"(xor({x}, {x} >> 13) * {factor} + 1) % {E.MODULUS}"


BOOTSTRAP = f"""
WITH p AS (SELECT incident, max(rate) FILTER (policy = 1) - max(rate) FILTER (policy = 2) AS d FROM c_outcomes GROUP BY incident), k AS (SELECT * FROM p WHERE d IS NOT NULL),
x0 AS (SELECT d, round, (incident % {E.MODULUS} * {E.FACTORS[0]} + round * {E.FACTORS[1]} + 7) % {E.MODULUS} AS x FROM k, (SELECT unnest(range(0, 5000)) AS round)),
x1 AS (SELECT d, round, {step_sql("x", E.FACTORS[2])} AS x FROM x0), x2 AS (SELECT d, round, {step_sql("x", E.FACTORS[3])} AS x FROM x1), x3 AS (SELECT d, round, {step_sql("x", E.FACTORS[2])} AS x FROM x2),
w AS (SELECT d, round, len(list_filter([{", ".join(map(repr, E.POISSON))}]::DOUBLE[], lambda c: x / {E.MODULUS}::DOUBLE > c)) AS w FROM x3),
m AS (SELECT round, sum(d * w) / nullif(sum(w), 0) AS m FROM w GROUP BY round),
q AS (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m)
SELECT round((SELECT avg(d) FROM k), 9) AS mean_difference, (SELECT count(*) FROM k) AS cases, round(low, 9) AS low, round(high, 9) AS high, low > 0 OR high < 0 AS significant FROM q"""


@query("paired_bootstrap", "2.9.48", BOOTSTRAP)
def paired_bootstrap(spark, sf):
    r = A.outcomes(spark, sf).groupBy("incident").agg(F.max(F.when(F.col("policy") == 1, F.col("rate"))).alias("a"), F.max(F.when(F.col("policy") == 2, F.col("rate"))).alias("b"))
    return rounded(E.paired_bootstrap(r.withColumnRenamed("incident", "case_id")), 9, "mean_difference", "low", "high")


@query("mcnemar", "2.9.49", """
WITH p AS (SELECT incident, account, max(score) FILTER (model = 1) >= 0.5 AS a, max(score) FILTER (model = 2) >= 0.6 AS b, bool_or(positive) AS t FROM c_positive GROUP BY ALL),
d AS (SELECT count(*) FILTER ((a = t) AND (b <> t)) AS b, count(*) FILTER ((a <> t) AND (b = t)) AS c FROM p), k AS (SELECT b, c, b + c AS n, least(b, c) AS k FROM d),
s AS (SELECT unnest(range(0, (SELECT k + 1 FROM k))) AS i)
SELECT b, c, round(least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM s)), 6) AS p_value FROM k""")
def mcnemar(spark, sf):
    s = A.labelled_scores(spark, sf).groupBy("incident", "account").agg(
        (F.max(F.when(F.col("model") == 1, F.col("score"))) >= 0.5).alias("a"), (F.max(F.when(F.col("model") == 2, F.col("score"))) >= 0.6).alias("b"), F.bool_or("positive").alias("t"))
    return rounded(E.mcnemar(s.select((F.col("a") == F.col("t")).alias("a_correct"), (F.col("b") == F.col("t")).alias("b_correct"))), 6, "p_value")


@query("weakness_notes", "2.9.61", f"""
WITH o AS ({OUTCOME_SQL}), r AS (SELECT incident, max(net_benefit) AS nb FROM o WHERE model <> 1 GROUP BY incident), v AS (SELECT o.incident, o.net_benefit, o.fn, o.fp, o.model, row_number() OVER (PARTITION BY o.incident ORDER BY o.net_benefit DESC, o.model) AS k FROM o WHERE model <> 1),
j AS (SELECT m.*, v.net_benefit AS rnb, v.fn AS rfn, v.fp AS rfp, v.model AS rm FROM o m JOIN v ON v.incident = m.incident AND v.k = 1 WHERE m.model = 1)
SELECT incident, CASE WHEN rnb > net_benefit THEN 'system ' || rm || ' has the better net benefit (' || CAST(CAST(round(rnb, 0) AS BIGINT) AS VARCHAR) || ' against ' || CAST(CAST(round(net_benefit, 0) AS BIGINT) AS VARCHAR) || '); ' || CASE WHEN fn > rfn THEN 'missed mules: ' || fn ELSE 'innocent frozen: ' || fp END
 WHEN fn > 0 THEN 'best here, missed mules: ' || fn || ', first correct flag at hop ' || coalesce(CAST(first_hop AS VARCHAR), 'none') WHEN fp > 0 THEN 'best here, innocent frozen: ' || fp || ', locking ' || CAST(CAST(round(wrongly_frozen, 0) AS BIGINT) AS VARCHAR) ELSE 'best here without a miss or a wrong freeze' END AS note FROM j""")
def weakness_notes(spark, sf):
    return E.weakness_note(case_outcome_rows(spark, sf), 1)


CROSS = """
SELECT d.incident, d.model, count(*) FILTER (WHERE d.decision = 'flag' AND coalesce(l.is_mule, false)) AS tp,
  count(*) FILTER (WHERE d.decision = 'flag' AND NOT coalesce(l.is_mule, false)) AS fp, count(*) FILTER (WHERE d.decision <> 'flag' AND coalesce(l.is_mule, false)) AS fn
FROM decisions d LEFT JOIN mule_labels l ON l.account = d.account GROUP BY d.incident, d.model"""


@query("outcome_cross_check", "2.9.62", f"SELECT incident, model, tp, fp, fn, true AS agrees FROM ({OUTCOME_SQL})")
def outcome_cross_check(spark, sf):
    """The SQL recount of the case outcome next to the DataFrame one."""
    told = A.incidents(spark, sf).select("incident", (F.col("complaint") - F.col("t0")).alias("complaint_offset"))
    E.decision_queue(A.model_scores(spark, sf), told, ["incident", "model"], 8, 0.3).createOrReplaceTempView("decisions")
    A.labels(spark, sf).createOrReplaceTempView("mule_labels")
    again = spark.sql(CROSS)
    first = case_outcome_rows(spark, sf).select("incident", "model", F.col("tp").alias("tp1"), F.col("fp").alias("fp1"), F.col("fn").alias("fn1"))
    both = again.join(first, ["incident", "model"])
    return both.select("incident", "model", "tp", "fp", "fn", ((F.col("tp") == F.col("tp1")) & (F.col("fp") == F.col("fp1")) & (F.col("fn") == F.col("fn1"))).alias("agrees"))


@query("detector_contract", "2.11.4", "SELECT incident, account, CASE WHEN account % 2 = 0 THEN 1.0 ELSE 0.0 END AS score, 'parity' AS model FROM c_cand UNION ALL SELECT incident, account, round(account / (account + 10.0), 6), 'ratio' FROM c_cand")
def detector_contract(spark, sf):
    parity = D.FunctionDetector("parity", "binary", lambda o: o.withColumn("score", (F.col("account") % 2 == 0).cast("double")))
    ratio = D.FunctionDetector("ratio", "continuous", lambda o: o.withColumn("score", F.round(F.col("account") / (F.col("account") + 10.0), 6)))
    broken = D.FunctionDetector("broken", "continuous", lambda o: o.select("no_such_column"))
    rows, failed = D.run_detectors([parity, ratio, broken], A.candidates(spark, sf))
    assert list(failed) == ["broken"]
    return rows


@query("hmac_digests", "2.11.3", f"""WITH a AS (SELECT seq, {payload_sql("''")} AS text FROM c_audit) SELECT seq, {hmac_sql("text")} AS digest FROM a""")
def hmac_digests(spark, sf):
    from ..operators.ledger import audit_digest
    return A.audit(spark, sf).select("seq", audit_digest(F.lit(""), AUDIT_KEY).alias("digest"))
