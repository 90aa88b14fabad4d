"""Registered queries over sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.digests import pads
from ..operators.ranking import top_ranked
from ..session import shared_dir
from ..sources import adapters as A
from ..sources import datasets as D
from ..sources import sinks as S
from .registry import query

SEAL_KEY = b"package-seal-key"


def fresh_path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_transfers", "2.1.1", "SELECT * FROM c_transfers")
def scan_transfers(spark, sf):
    return A.transfers(spark, sf)


@query("scan_accounts", "2.1.1", "SELECT * FROM c_accounts")
def scan_accounts(spark, sf):
    return A.accounts(spark, sf)


@query("scan_incidents", "2.1.1", "SELECT * FROM c_incidents")
def scan_incidents(spark, sf):
    return A.incidents(spark, sf)


@query("scan_case_transfers", "2.1.1", "SELECT * FROM c_case")
def scan_case_transfers(spark, sf):
    return A.case_transfers(spark, sf)


@query("scan_bulk_transfers", "2.1.1", """
SELECT src % 100 AS src_group, dst, count(*) AS n, round(sum(amount), 2) AS total FROM c_bulk GROUP BY ALL""")
def scan_bulk(spark, sf):
    return A.bulk(spark, sf).groupBy((F.col("src") % 100).alias("src_group"), "dst").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@query("warehouse_views", "2.1.2", """
SELECT a.account, a.archetype, coalesce(l.is_mule, false) AS is_mule, coalesce(l.ring_id, '') AS ring_id,
       coalesce(l.layer_index, -1) AS layer_index, coalesce(l.typology, '') AS typology
FROM c_accounts a LEFT JOIN c_labels l ON a.account = l.account WHERE a.archetype <> 'exit_point'""")
def warehouse_views(spark, sf):
    D.register_warehouse(A.accounts(spark, sf), A.transfers(spark, sf), A.labels(spark, sf))
    return spark.sql("""
      SELECT f.account, f.archetype, f.is_mule, f.ring_id, f.layer_index, f.typology
      FROM account_facts f JOIN retail_accounts r ON f.account = r.account""")


@query("sql_rollup", "2.1.3", """
SELECT channel, count(*) AS n, round(sum(amount), 2) AS total, round(max(amount), 2) AS largest
FROM c_transfers WHERE amount >= 20000 AND epoch < 1705363200 GROUP BY channel""")
def sql_rollup(spark, sf):
    A.transfers(spark, sf).createOrReplaceTempView("transfers")
    return D.rollup(spark, """
      SELECT channel, count(*) AS n, round(sum(amount), 2) AS total, round(max(amount), 2) AS largest
      FROM transfers WHERE amount >= ? AND epoch < ? GROUP BY channel""", [20000, 1705363200])


@query("foreign_csv_ingest", "2.1.4", """
SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, amount,
       epoch // 3600 * 3600 AS epoch, txn_id % 9 = 0 AS is_sar
FROM c_transfers WHERE txn_id % 23 <> 0""")
def foreign_csv_ingest(spark, sf):
    path = fresh_path(spark, "foreign")
    A.transfers(spark, sf).select(
        F.col("src").alias("nameOrig"), F.col("dst").alias("nameDest"),
        F.when(F.col("txn_id") % 23 != 0, F.col("amount")).alias("amt"),
        F.floor(F.col("epoch") / 3600).alias("step"),
        F.when(F.col("txn_id") % 9 == 0, "SAR").otherwise("NORMAL").alias("isFraud"),
    ).write.csv(path, header=True)
    return D.load_foreign_transfers(spark, path)


@query("edge_list_load", "2.1.5", """
SELECT CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS target,
       CASE WHEN max(txn_id) % 10 = 3 THEN 1.0 ELSE arg_max(amount, txn_id) END AS amount
FROM c_transfers GROUP BY src, dst""")
def edge_list_load(spark, sf):
    raw = A.transfers(spark, sf).select(
        F.col("src").alias("source"), F.col("dst").alias("target"),
        F.when(F.col("txn_id") % 10 == 3, "n/a").otherwise(F.col("amount").cast("string")).alias("amount"), "txn_id")
    return D.load_edge_list(raw, "txn_id")


@query("edge_list_nodes", "2.1.5", """
WITH e AS (SELECT DISTINCT src, dst FROM c_transfers)
SELECT CAST(a.account AS VARCHAR) AS node, (SELECT count(*) FROM e WHERE e.src = a.account) AS out_degree,
       (SELECT count(*) FROM e WHERE e.dst = a.account) AS in_degree FROM c_accounts a""")
def edge_list_nodes(spark, sf):
    return D.graph_nodes(A.accounts(spark, sf).select(F.col("account").alias("node")), edge_list_load(spark, sf))


@query("identity_merge", "2.1.6", """
SELECT transaction_id, amt, CASE WHEN transaction_id % 3 = 0 THEN device_type END AS device_type,
       CASE WHEN transaction_id % 3 = 0 THEN device_info END AS device_info FROM c_cards""")
def identity_merge(spark, sf):
    cards = A.cards(spark, sf)
    identity = cards.where("transaction_id % 3 = 0").select("transaction_id", "device_type", "device_info")
    return D.merge_identity(cards.select("transaction_id", "amt"), identity)


@query("finalised_transfers", "2.1.7", """
SELECT 'T' || lpad(CAST(row_number() OVER (ORDER BY epoch, src, dst, amount, channel) AS VARCHAR), 9, '0') AS txn_id,
       src, dst, amount, epoch, channel FROM c_transfers""")
def finalised_transfers(spark, sf):
    t = A.transfers(spark, sf).select("src", "dst", "amount", "epoch", "channel")
    path = fresh_path(spark, "finalised")
    S.write_transfers(S.finalise_transfers(t.where("channel = 'UPI'"), t.where("channel <> 'UPI'")), path)
    return spark.read.parquet(path)


def drawn_candidates(spark, sf, limit=190):
    """The draw list: best-scored candidates of every incident, at most ``limit``."""
    scores = A.model_scores(spark, sf).where("model = 1")
    return top_ranked(scores, ["incident"], [F.desc("score"), F.col("account")], limit).select("incident", "account")


@query("case_documents", "2.1.8")
def case_documents(spark, sf):
    docs = S.case_documents(A.incidents(spark, sf), drawn_candidates(spark, sf), A.accounts(spark, sf),
                            A.labels(spark, sf), A.case_transfers(spark, sf))
    return docs.select("case_id", F.to_json("victim").alias("victim"), F.to_json("accounts").alias("accounts"),
                       F.to_json("truth").alias("truth"), F.to_json("transfers").alias("transfers"),
                       F.to_json("cashout_events").alias("cashout_events"))


@query("case_document_sizes", "2.1.8", """
SELECT i.incident AS case_id, least(190, (SELECT count(*) FROM c_cand c WHERE c.incident = i.incident)) AS accounts,
       (SELECT count(*) FROM c_case k WHERE k.incident = i.incident AND NOT to_exit
          AND EXISTS (SELECT 1 FROM c_cand c WHERE c.incident = i.incident AND c.account = k.src)) AS transfers,
       (SELECT count(*) FROM c_case k WHERE k.incident = i.incident AND to_exit
          AND EXISTS (SELECT 1 FROM c_cand c WHERE c.incident = i.incident AND c.account = k.src)) AS cashouts
FROM c_incidents i""")
def case_document_sizes(spark, sf):
    docs = S.case_documents(A.incidents(spark, sf), drawn_candidates(spark, sf), A.accounts(spark, sf),
                            A.labels(spark, sf), A.case_transfers(spark, sf))
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("bigint")
    return docs.select("case_id", n("accounts").alias("accounts"), n("transfers").alias("transfers"), n("cashout_events").alias("cashouts"))


@query("report_sink", "2.1.9", """
SELECT model, count(*) AS accounts, round(avg(score), 6) AS mean_score FROM c_scores GROUP BY model""")
def report_sink(spark, sf):
    path = fresh_path(spark, "report")
    rows = A.model_scores(spark, sf).groupBy("model").agg(
        F.count(F.lit(1)).alias("accounts"), F.round(F.avg("score"), 6).alias("mean_score"))
    S.write_report(rows, path)
    return spark.read.schema("model int, accounts bigint, mean_score double").json(path)


IPAD, OPAD = pads(SEAL_KEY)


@query("sealed_packages", "2.1.10", f"""
WITH r AS (
 SELECT incident AS case_id, account, score, row_number() OVER (PARTITION BY incident ORDER BY score DESC, account) AS pos
 FROM c_scores WHERE model = 1),
t AS (SELECT case_id, pos, 'AC-****-' || right(lpad(CAST(account AS VARCHAR), 8, '0'), 4) AS ref,
   CAST(CAST(floor(score * 100) AS BIGINT) AS VARCHAR) AS score_text,
   CASE WHEN score >= 0.95 THEN 'IMMINENT' WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HOT' WHEN score >= 0.55 THEN 'WARMING' ELSE 'CLEAN' END AS band
   FROM r WHERE pos <= 25),
x AS (SELECT case_id,
   '<str case="' || CAST(case_id AS VARCHAR) || '">' || string_agg('<account ref="' || ref || '" score="' || score_text || '" band="' || band || '" status="WATCH"/>', '' ORDER BY pos) || '</str>' AS xml,
   '{{"case":' || CAST(case_id AS VARCHAR) || ',"accounts":[' || string_agg('{{"ref":"' || ref || '","score":"' || score_text || '","band":"' || band || '","status":"WATCH"}}', ',' ORDER BY pos) || ']}}' AS json
   FROM t GROUP BY case_id)
SELECT case_id, xml, json, right(sha256(xml), 8) AS fingerprint,
       sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode(xml)))) AS seal FROM x""")
def sealed_packages(spark, sf):
    s = F.col("score")
    ranked = top_ranked(A.model_scores(spark, sf).where("model = 1"), ["incident"], [F.desc("score"), F.col("account")], 25)
    rows = ranked.select(
        F.col("incident").alias("case_id"), F.col("rank").alias("pos"),
        F.concat(F.lit("AC-"), F.lpad(F.col("account").cast("string"), 8, "0")).alias("account_id"),
        F.floor(s * 100).cast("string").alias("score_text"),
        F.when(s >= 0.95, "IMMINENT").when(s >= 0.85, "CRITICAL").when(s >= 0.7, "HOT").when(s >= 0.55, "WARMING").otherwise("CLEAN").alias("band"),
        F.lit("WATCH").alias("status"))
    return S.sealed_packages(rows, SEAL_KEY)


@query("freeze_orders", "2.1.11", """
WITH p AS (SELECT incident, account, score, row_number() OVER (PARTITION BY incident ORDER BY score DESC, account) AS rank FROM c_scores WHERE model = 1),
q AS (SELECT p.*, a.bank, round(a.own_balance, 2) AS at_risk, round(a.own_balance * score, 6) AS expected, (1 - least(score, 0.97)) * 0.5 AS cost
      FROM p JOIN c_accounts a ON a.account = p.account WHERE rank <= 25)
SELECT incident, bank, min(rank) AS first_rank, count(*) AS instructions, round(sum(at_risk), 2) AS at_risk,
       round(sum(expected), 4) AS expected, count(*) FILTER (score < 0.90 OR cost > 0.05) AS second_approval,
       string_agg(CAST(account AS VARCHAR), ',' ORDER BY rank) AS accounts
FROM q GROUP BY incident, bank""")
def freeze_orders(spark, sf):
    acc = A.accounts(spark, sf)
    top = top_ranked(A.model_scores(spark, sf).where("model = 1"), ["incident"], [F.desc("score"), F.col("account")], 25)
    plan = top.join(acc.select("account", "own_balance"), "account").select(
        "incident", "rank", "account", F.round("own_balance", 2).alias("at_risk"),
        F.round(F.col("own_balance") * F.col("score"), 6).alias("expected"), F.col("score").alias("p_mule"),
        ((1 - F.least(F.col("score"), F.lit(0.97))) * 0.5).alias("cost"))
    return S.freeze_orders(plan, acc)


@query("latest_row", "2.1.12", """
SELECT txn_id, src, dst, amount, epoch FROM c_transfers ORDER BY epoch DESC, txn_id DESC LIMIT 1""")
def latest_row(spark, sf):
    t = A.transfers(spark, sf).withColumn("at", F.struct("epoch", "txn_id"))
    return D.latest_row(t, "at", "txn_id", "src", "dst", "amount", "epoch")
