"""Registered queries that drain a stream and are compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..sources import adapters as A
from ..streaming import accounts as U
from ..streaming import feed as Q
from ..streaming import identity as I
from ..streaming import runtime as T
from .aggregates import FLOWS, RECRUITERS, rounded
from .ordered import minute_frames
from .registry import RAW, query


@query("stream_live_scores", "2.10.1", """
WITH m AS (SELECT account, max(epoch) AS as_of FROM c_legs GROUP BY account),
g AS (SELECT l.account, max(m.as_of) AS as_of, count(*) FILTER (l.epoch // 3600 > m.as_of // 3600 - 48) AS n48, count(*) FILTER (amount >= 25000 AND amount < 50000) AS near,
  coalesce(sum(amount) FILTER (direction = 'OUT'), 0) AS o, coalesce(sum(amount) FILTER (direction = 'IN'), 0) AS i FROM c_legs l JOIN m ON m.account = l.account GROUP BY l.account),
s AS (SELECT g.account, as_of, round(least(100, 20 * greatest(0, least(1, (n48 - 3) / 12.0)) + 30 * CASE WHEN i <= 0 THEN 0 WHEN least(1, o / i) > 0.5 THEN (least(1, o / i) - 0.5) / 0.5 ELSE 0 END + 14 * greatest(0, least(1, (near - 2) / 6.0))
  + 12 * greatest(0, least(1, ((o + i) / CASE segment WHEN 'salary' THEN 150000.0 WHEN 'retail' THEN 80000.0 WHEN 'student' THEN 30000.0 WHEN 'business' THEN 1500000.0 ELSE 60000.0 END - 1.5) / 4.5))), 2) AS score FROM g JOIN c_accounts a ON a.account = g.account)
SELECT account, as_of, score, CASE WHEN score >= 95 THEN 'IMMINENT' WHEN score >= 85 THEN 'CRITICAL' WHEN score >= 70 THEN 'HOT' WHEN score >= 55 THEN 'WARMING' ELSE 'CLEAN' END AS severity FROM s""")
def stream_live_scores(spark, sf):
    folder = T.work_folder(spark, "scores")
    segments = A.accounts(spark, sf).select("account", "segment")
    T.drain(U.live_scores(U.live_totals(T.sliced_transfers(spark, sf, folder)), segments), folder, each=T.batch_writer(folder))
    return T.latest_per_key(spark, folder, ["account"])


def alert_events(events, score_of="value"):
    """Scores from 'error' rows and human actions from 'signup' rows of one stream."""
    i = F.col("event_id")
    score = F.round(F.least(F.lit(100.0), F.col(score_of) * 1.5), 3)
    kind = F.when(F.col("event_type") == "error", "score").when(i % 4 == 0, "ack").when(i % 4 == 1, "assign").when(i % 4 == 2, "escalate").otherwise("resolve")
    return events.where("event_type IN ('error', 'signup')").select(
        F.col("user_id").alias("account"), kind.alias("kind"), score.alias("score"), A.severity_of(score).alias("severity"), A.seconds(F.col("ts")).alias("at"), i.alias("pos"))


@query("stream_alerts", "2.10.2")
def stream_alerts(spark, sf):
    folder = T.work_folder(spark, "alerts")
    T.drain(U.alert_states(alert_events(T.event_stream(spark, sf))), folder)
    return spark.read.parquet(f"{folder}/data")


@query("stream_alert_changes", "2.10.2", """
WITH RECURSIVE ev AS (SELECT user_id AS account, CASE WHEN event_type = 'error' THEN 'score' WHEN event_id % 4 = 0 THEN 'ACK' WHEN event_id % 4 = 1 THEN 'ASSIGNED' WHEN event_id % 4 = 2 THEN 'ESCALATED' ELSE 'RESOLVED' END AS kind,
   round(least(100, value * 1.5), 3) AS score, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts), event_id) AS r FROM events WHERE event_type IN ('error', 'signup')),
st(account, r, number, status) AS (SELECT DISTINCT account, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'NONE' FROM ev
  UNION ALL SELECT e.account, e.r, CASE WHEN e.kind = 'score' AND e.score >= 55 AND s.status IN ('NONE', 'RESOLVED') THEN s.number + 1 ELSE s.number END,
   CASE WHEN e.kind = 'score' THEN CASE WHEN e.score >= 55 AND s.status IN ('NONE', 'RESOLVED') THEN 'NEW' ELSE s.status END WHEN s.status IN ('NONE', 'RESOLVED') THEN s.status ELSE e.kind END
  FROM st s JOIN ev e ON e.account = s.account AND e.r = s.r + 1)
SELECT account, max(number) AS alerts, arg_max(status, r) AS last_status FROM st GROUP BY account HAVING max(number) > 0""")
def stream_alert_changes(spark, sf):
    rows = stream_alerts(spark, sf)
    w = rows.groupBy("account").agg(F.max("alert_no").alias("alerts"))
    return w.join(_last_status(spark, sf, rows), "account")


def _last_status(spark, sf, rows):
    return rows.groupBy("account").agg(F.max_by("status", F.struct("at", "pos")).alias("last_status"))


@query("stream_reset_totals", "2.10.3", RAW["reset_aggregates"])
def stream_reset_totals(spark, sf):
    folder = T.work_folder(spark, "reset")
    T.drain(U.reset_totals(T.sliced_transfers(spark, sf, folder)), folder, "update", T.batch_writer(folder))
    return T.latest_per_key(spark, folder, ["account"])


@query("stream_sliding_totals", "2.10.3", """
SELECT h * 3600 AS start, src AS account, count(*) AS n, round(sum(amount), 2) AS total FROM (SELECT src, amount, unnest(range(epoch // 3600 - 23, epoch // 3600 + 1)) AS h FROM c_transfers) GROUP BY ALL""")
def stream_sliding_totals(spark, sf):
    folder = T.work_folder(spark, "sliding")
    T.drain(U.hour_totals(T.transfer_stream(spark, sf)), folder, "update", T.batch_writer(folder))
    return U.sliding_totals(T.latest_per_key(spark, folder, ["hour", "account"]))


def finger_stream(spark, sf):
    t = T.transfer_stream(spark, sf)
    ja3 = F.when(F.col("k") % 25 != 24, F.col("k") % 25)
    return t.select("txn_id", "epoch", F.col("src").alias("account"), ja3.alias("ja3"), F.timestamp_seconds(F.col("epoch")).alias("ts"))


@query("stream_fingerprints", "2.10.4", """
WITH RECURSIVE w(ja3, s) AS (SELECT ja3, min(epoch) FROM c_gateway WHERE ja3 IS NOT NULL GROUP BY ja3
  UNION ALL SELECT w.ja3, (SELECT min(epoch) FROM c_gateway g WHERE g.ja3 = w.ja3 AND g.epoch > w.s + 300) FROM w WHERE EXISTS (SELECT 1 FROM c_gateway g WHERE g.ja3 = w.ja3 AND g.epoch > w.s + 300)),
e AS (SELECT g.txn_id, g.ja3, g.src, g.epoch, w.s FROM c_gateway g ASOF JOIN w ON w.ja3 = g.ja3 AND w.s <= g.epoch),
c AS (SELECT a.txn_id, a.ja3, count(*) AS velocity, count(DISTINCT b.src) AS fanout FROM e a JOIN e b ON b.ja3 = a.ja3 AND b.s = a.s AND (b.epoch, b.txn_id) <= (a.epoch, a.txn_id) GROUP BY a.txn_id, a.ja3)
SELECT txn_id, ja3, velocity, fanout, 0.2 + CASE WHEN velocity > 50 THEN 0.3 ELSE 0 END + CASE WHEN fanout > 20 THEN 0.4 ELSE 0 END AS risk FROM c""")
def stream_fingerprints(spark, sf):
    folder = T.work_folder(spark, "finger")
    hits = I.fingerprint_hits(finger_stream(spark, sf))
    T.drain(hits.withColumn("risk", I.fingerprint_risk(F.col("velocity"), F.col("fanout"))), folder)
    return spark.read.parquet(f"{folder}/data")


@query("stream_fingerprint_windows", "2.10.4", """
SELECT epoch // 300 * 300 AS start, ja3, count(*) AS velocity, count(DISTINCT src) AS fanout FROM c_gateway GROUP BY ALL""")
def stream_fingerprint_windows(spark, sf):
    folder = T.work_folder(spark, "windows")
    T.drain(I.fingerprint_windows(finger_stream(spark, sf)), folder, "update", T.batch_writer(folder))
    return I.window_totals(T.latest_per_key(spark, folder, ["start", "ja3", "account"]))


@query("stream_identity", "2.10.5", """
WITH e AS (SELECT txn_id, epoch, src, CAST(ja3 AS VARCHAR) AS ja3, CAST(device AS VARCHAR) AS device, CAST(ip AS VARCHAR) AS ip, CASE WHEN k % 10 = 0 THEN 'xx' ELSE 'in' END AS geo, CASE WHEN ja3 IS NULL THEN 0.3 ELSE 0.2 + (k % 3) * 0.3 END AS jr FROM c_gateway),
f AS (SELECT *, row_number() OVER (PARTITION BY ja3, src ORDER BY epoch, txn_id) = 1 AS fj, row_number() OVER (PARTITION BY device, src ORDER BY epoch, txn_id) = 1 AS fd, row_number() OVER (PARTITION BY ip, src ORDER BY epoch, txn_id) = 1 AS fi FROM e),
c AS (SELECT *, CASE WHEN ja3 IS NULL THEN 0 ELSE count(*) FILTER (fj) OVER (PARTITION BY ja3 ORDER BY epoch, txn_id ROWS UNBOUNDED PRECEDING) END AS nj, count(*) FILTER (fd) OVER (PARTITION BY device ORDER BY epoch, txn_id ROWS UNBOUNDED PRECEDING) AS nd,
  count(*) FILTER (fi) OVER (PARTITION BY ip ORDER BY epoch, txn_id ROWS UNBOUNDED PRECEDING) AS ni FROM f)
SELECT txn_id, nj AS ja3_reuse, nd AS device_reuse, ni AS ip_reuse, ja3 IS NOT NULL AND fj AND nj = 1 AS new_ja3, fd AND nd = 1 AS new_device, geo = 'xx' AS geo_mismatch, round(jr * 0.4 + nj * 0.2 + nd * 0.2 + CASE WHEN geo = 'xx' THEN 0.2 ELSE 0 END, 6) AS risk,
  CASE WHEN round(jr * 0.4 + nj * 0.2 + nd * 0.2 + CASE WHEN geo = 'xx' THEN 0.2 ELSE 0 END, 9) > 0.7 THEN 'BLOCK' ELSE 'ALLOW' END AS decision, geo = 'xx' AND jr > 0.6 AS geo_blocked FROM c""")
def stream_identity(spark, sf):
    folder = T.work_folder(spark, "identity")
    k = F.col("k")
    ja3 = F.when(k % 25 != 24, k % 25)
    rows = T.transfer_stream(spark, sf).select(
        "txn_id", "epoch", F.col("src").alias("account"), ja3.alias("ja3"), (F.col("src") % 40).alias("device"), ((F.col("src") * 7 + k) % 60).alias("ip"),
        F.when(k % 10 == 0, "xx").otherwise("in").alias("geo"), F.lit("IN").alias("home"), F.when(ja3.isNull(), 0.3).otherwise((k % 3) * 0.3 + 0.2).alias("ja3_risk"))

    def profile(df, batch):
        from ..sources.datasets import missing_files
        seen = None if missing_files(spark, [f"{folder}/pairs"]) else spark.read.parquet(f"{folder}/pairs").where(F.col("b") < batch)
        scored, pairs = I.profile_batch(df, seen)
        T.batch_writer(folder, "pairs")(pairs, batch)
        T.batch_writer(folder, "scored")(scored, batch)

    T.drain(rows, folder, each=profile)
    return spark.read.parquet(f"{folder}/scored").drop("b", "batch")


@query("stream_gate", "2.10.6", "SELECT txn_id, src, dst, amount, epoch FROM c_transfers")
def stream_gate(spark, sf):
    folder = T.work_folder(spark, "gate")
    once = T.transfer_stream(spark, sf).select("txn_id", "src", "dst", "amount", "epoch", F.timestamp_seconds(F.col("epoch")).alias("ts"))
    again = T.transfer_stream(spark, sf).where("txn_id % 7 = 0").select("txn_id", "src", "dst", "amount", "epoch", F.timestamp_seconds(F.col("epoch")).alias("ts"))
    T.drain(I.gate(once.unionByName(again)), folder)
    return spark.read.parquet(f"{folder}/data").drop("ts")


@query("stream_feed", "2.10.7", """
SELECT feed_id, txn_id, src, amount, epoch FROM (SELECT *, row_number() OVER (ORDER BY epoch, txn_id) AS feed_id FROM c_transfers) WHERE feed_id > 50""")
def stream_feed(spark, sf):
    folder = T.work_folder(spark, "feed")
    T.drain(T.transfer_stream(spark, sf).select("txn_id", "src", "amount", "epoch"), folder, each=Q.feed_writer(folder))
    return Q.read_feed(spark, folder, 50)


@query("stream_pulse", "2.10.8", RAW["live_facts"])
def stream_pulse(spark, sf):
    """Alerts in slices; each batch adds what it changes, no table is read again."""
    folder = T.work_folder(spark, "pulse")
    alerts = A.events_to_alerts(T.sliced_events(spark, sf, folder)).withColumn("open", ~F.col("status").isin("RESOLVED", "FALSE_POSITIVE"))
    T.drain(Q.score_changes(alerts), folder, each=Q.pulse_writer(folder))
    n, first = A.accounts(spark, sf).agg(F.count(F.lit(1)), F.min("account")).first()
    return Q.read_pulse(spark, folder, n, first)


@query("stream_freeze_cascade", "2.10.9", """
WITH RECURSIVE u AS (SELECT src AS a, dst AS b FROM c_transfers UNION SELECT dst, src FROM c_transfers), sd AS (SELECT DISTINCT account FROM c_alerts WHERE severity = 'IMMINENT'),
r(seed, account, d) AS (SELECT account, account, 0 FROM sd UNION SELECT r.seed, u.b, r.d + 1 FROM r JOIN u ON u.a = r.account WHERE r.d < 4), m AS (SELECT seed, account, min(d) AS d FROM r WHERE seed <> account GROUP BY ALL)
SELECT account, round(max(55.0 * power(0.62, d - 1)), 2) AS taint FROM m GROUP BY account""")
def stream_freeze_cascade(spark, sf):
    folder = T.work_folder(spark, "freeze")
    hot = T.event_stream(spark, sf).where("event_type = 'error' AND round(least(100D, value * 1.5D), 3) >= 95").select(F.col("user_id").alias("account"))
    T.drain(hot, folder, each=Q.freeze_writer(folder, A.transfers(spark, sf)))
    return spark.read.parquet(f"{folder}/taint").groupBy("account").agg(F.max("taint").alias("taint"))


CASE_STATUS = ("OPEN", "INVESTIGATING", "ESCALATED", "CLOSED_CONFIRMED", "CLOSED_CLEARED", "UNKNOWN")


@query("case_transitions", "2.10.10", """
WITH u AS (SELECT account AS case_id, alert_id AS seq, CASE alert_id % 6 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'INVESTIGATING' WHEN 2 THEN 'ESCALATED' WHEN 3 THEN 'CLOSED_CONFIRMED' WHEN 4 THEN 'CLOSED_CLEARED' ELSE 'UNKNOWN' END AS status FROM c_alerts),
l AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY case_id ORDER BY seq), 'OPEN') AS from_status FROM u WHERE status <> 'UNKNOWN')
SELECT case_id, seq, from_status, status AS to_status FROM l WHERE from_status <> status""")
def case_transitions(spark, sf):
    status = F.element_at(F.array(*[F.lit(s) for s in CASE_STATUS]), (F.col("alert_id") % 6).cast("int") + 1)
    return Q.case_activity(A.alerts(spark, sf).select(F.col("account").alias("case_id"), F.col("alert_id").alias("seq"), status.alias("status")))


@query("stream_node_counters", "2.10.11", f"SELECT account, CAST(out_count AS BIGINT) AS out_degree, round(out_value, 2) AS total_out, CAST(in_count AS BIGINT) AS in_degree, round(in_value, 2) AS total_in FROM ({FLOWS})")
def stream_node_counters(spark, sf):
    folder = T.work_folder(spark, "nodes")
    T.drain(Q.node_counters(T.sliced_transfers(spark, sf, folder)), folder, "update", T.batch_writer(folder))
    return rounded(T.latest_per_key(spark, folder, ["account"]), 2, "total_out", "total_in")


@query("stream_replay_frames", "2.10.12", RAW["minute_frames"])
def stream_replay_frames(spark, sf):
    """A replay timeline written as a table and played back as a stream of frames."""
    folder = T.work_folder(spark, "frames")
    frames = minute_frames(spark, sf)
    frames.write.parquet(f"{folder}/timeline")
    T.drain(spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/timeline"), folder)
    return spark.read.parquet(f"{folder}/data")


@query("stream_scheduled_evaluation", "2.10.13", """
SELECT model, tp, fp, fn, tn FROM (SELECT 'eif' AS model, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM (SELECT txn_id * 53 % 101 >= 48 AS p, src % 17 = 3 OR dst % 17 = 3 AS a FROM c_transfers))""")
def stream_scheduled_evaluation(spark, sf):
    """The evaluation job: each run drains what is new and stores its counts."""
    folder = T.work_folder(spark, "evaluation")
    rows = T.transfer_stream(spark, sf).select((F.col("txn_id") * 53 % 101 >= 48).alias("predicted"), ((F.col("src") % 17 == 3) | (F.col("dst") % 17 == 3)).alias("actual"))
    T.drain(rows, folder, each=T.batch_writer(folder, "data", lambda df, b: E.confusion(df.withColumn("model", F.lit("eif")), ["model"]).select("model", "tp", "fp", "fn", "tn")))
    return spark.read.parquet(f"{folder}/data").groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


@query("stream_campaign_freeze", "2.10.14", f"""
WITH r AS (SELECT account FROM ({RECRUITERS}) WHERE account IN (SELECT user_id FROM events WHERE event_type = 'signup'))
SELECT DISTINCT t.src AS recruiter, t.dst AS account FROM c_transfers t JOIN r ON r.account = t.src WHERE amount <= 10000 UNION SELECT account, account FROM r""")
def stream_campaign_freeze(spark, sf):
    folder = T.work_folder(spark, "campaign")
    named = T.event_stream(spark, sf).where("event_type = 'signup'").select(F.col("user_id").alias("account"))
    T.drain(named, folder, each=Q.campaign_writer(folder, A.transfers(spark, sf)))
    return spark.read.parquet(f"{folder}/frozen").select("recruiter", "account").distinct()
