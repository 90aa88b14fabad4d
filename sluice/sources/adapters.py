"""The star-schema tables read as the canonical money-flow tables.

Every adapter is a projection or an equi-join of the scan, so filters and column
pruning reach the parquet files. The account count is a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HORIZON = 6 * 3600
INCIDENT_FLOOR = 250_000.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Zone-free epoch seconds."""
    return F.unix_timestamp(F.date_trunc("second", ts).cast("timestamp"))


def _population(spark, folder) -> Column:
    return table(spark, folder, "events").agg((F.max("user_id") + 1).alias("n")).scalar()


def events_to_transfers(events: DataFrame, n: Column) -> DataFrame:
    """Also used on the streaming read of the same table, with ``n`` given."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    channel = (
        F.when(F.col("event_type") == "click", "UPI")
        .when(F.col("event_type") == "purchase", "IMPS")
        .when(F.col("event_type") == "view", "NEFT")
        .when(F.col("event_type") == "signup", "CARD")
        .otherwise("ATM_WITHDRAWAL")
    )
    return events.select(
        F.col("event_id").alias("txn_id"),
        F.col("user_id").alias("src"),
        ((F.col("user_id") * 31 + k + 1) % n).alias("dst"),
        F.round(F.col("value") * 1000, 2).alias("amount"),
        seconds(F.col("ts")).alias("epoch"),
        channel.alias("channel"),
        k.alias("k"),
    ).where("src <> dst")


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    return events_to_transfers(table(spark, folder, "events"), _population(spark, folder))


def bulk(spark, folder) -> DataFrame:
    """Orders x lineitems as day-level transfers from customers to suppliers."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    od = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return (
        li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("src"),
            F.col("l_suppkey").alias("dst"),
            F.round("l_extendedprice", 2).alias("amount"),
            seconds(F.col("l_shipdate")).alias("epoch"),
        )
        .where("src <> dst")
    )


def accounts(spark, folder) -> DataFrame:
    n = _population(spark, folder)
    i = F.col("c_custkey")
    segment = (
        F.when(F.col("c_mktsegment") == "BUILDING", "salary")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "retail")
        .when(F.col("c_mktsegment") == "MACHINERY", "student")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "business")
        .otherwise("senior")
    )
    return (
        table(spark, folder, "customer")
        .where(i < n)
        .select(
            i.alias("account"),
            (i % 8).alias("bank"),
            segment.alias("segment"),
            F.col("c_name").alias("holder"),
            F.col("c_acctbal").alias("own_balance"),
            (F.lit(18262) + i * 37 % 1400).alias("open_day"),
            (F.lit(19509) + i * 13 % 200).alias("prior_day"),
            F.when(i % 3 == 0, "full").when(i % 3 == 1, "video").otherwise("small").alias("kyc_tier"),
            F.when(i % 25 == 7, "exit_point").when(i % 9 == 4, "legit_high_velocity").otherwise("retail").alias("archetype"),
            (i % (F.floor(n / 4) + 1)).alias("device"),
            (i % (F.floor(n / 3) + 1)).alias("ip"),
            (i % 20).alias("district"),
            F.when(i % 25 != 7, "").when(i % 3 == 0, "atm").when(i % 3 == 1, "exchange").otherwise("crossborder").alias("exit_kind"),
        )
    )


def exits(spark, folder) -> DataFrame:
    return accounts(spark, folder).where("exit_kind <> ''").select("account", "exit_kind")


def labels(spark, folder) -> DataFrame:
    a = F.col("account")
    mule = a % 17 == 3
    kind = F.when(a % 3 == 0, "fanout").when(a % 3 == 1, "structuring").otherwise("crypto_exit")
    return accounts(spark, folder).where(a % 2 == 1).select(
        "account",
        mule.alias("is_mule"),
        F.when(mule, F.concat(F.lit("RING-0"), (a % 4).cast("string"))).otherwise("").alias("ring_id"),
        F.when(mule, a % 5).otherwise(F.lit(-1)).alias("layer_index"),
        (a % 34 == 3).alias("is_cashout_node"),
        F.when(mule, kind).otherwise("").alias("typology"),
    )


def incidents(spark, folder) -> DataFrame:
    """One reported loss per large transfer from an ordinary account."""
    kind = (
        F.when(F.col("txn_id") % 4 == 0, "fanout")
        .when(F.col("txn_id") % 4 == 1, "structuring")
        .when(F.col("txn_id") % 4 == 2, "chain_burst")
        .otherwise("crypto_exit")
    )
    delay = F.lit(10) + F.col("txn_id") % 120
    return (
        transfers(spark, folder)
        .where((F.col("amount") >= INCIDENT_FLOOR) & (F.col("src") % 25 != 7))
        .select(
            F.col("txn_id").alias("incident"),
            F.col("src").alias("victim"),
            "amount",
            F.col("epoch").alias("t0"),
            delay.alias("delay"),
            (F.col("epoch") + delay * 60).alias("complaint"),
            (F.col("epoch") + HORIZON).alias("horizon"),
            kind.alias("typology"),
            F.concat(F.lit("RING-0"), (F.col("src") % 4).cast("string")).alias("ring_id"),
        )
    )


def gateway(spark, folder) -> DataFrame:
    t = F.col("txn_id")
    return transfers(spark, folder).select(
        "txn_id", "src", "dst", "amount", "epoch", "k",
        F.when(t % 11 != 0, (t * 37 % 101) / 100.0).alias("gnn"),
        F.when(t % 13 != 0, (t * 53 % 101) / 100.0).alias("eif"),
        F.when(F.col("k") % 25 != 24, F.col("k") % 25).alias("ja3"),
        (F.col("k") % 25 == 3).alias("ja3_hit"),
        (F.col("src") % 40).alias("device"),
        ((F.col("src") * 7 + F.col("k")) % 60).alias("ip"),
        F.when(t % 19 == 0, t % 7).alias("ring"),
        F.when(t % 5 == 0, F.col("src") % 12).alias("cluster"),
    )


def decided(spark, folder) -> DataFrame:
    """Gateway rows carrying a stored risk and decision."""
    risk = F.least(F.lit(1.0), F.coalesce("gnn", F.lit(0.0)) * 0.6 + F.coalesce("eif", F.lit(0.0)) * 0.4)
    return (
        gateway(spark, folder)
        .withColumn("risk", risk)
        .withColumn("decision", F.when(F.col("risk") >= 0.75, "BLOCK").when(F.col("risk") >= 0.45, "REVIEW").otherwise("APPROVE"))
        .withColumn("suspected", F.col("risk") >= 0.75)
    )


def cards(spark, folder) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    net = F.when(c % 5 == 0, "visa").when(c % 5 == 1, "mastercard").when(c % 5 == 2, "discover").when(c % 5 == 3, "american express")
    p = F.substring("o_orderpriority", 1, 1)
    return table(spark, folder, "orders").select(
        o.alias("transaction_id"),
        seconds(F.col("o_orderdate")).alias("dt"),
        F.col("o_totalprice").alias("amt"),
        (o % 29 == 0).cast("int").alias("is_fraud"),
        F.concat_ws(
            "_", (c % 500).cast("string"), F.coalesce(net, F.lit("X")),
            F.when(c % 3 == 0, "credit").when(c % 3 == 1, "debit").otherwise("X"),
        ).alias("card"),
        net.alias("card4"),
        (F.lit(120) + o % 50).alias("card3"),
        F.when(o % 13 != 0, c * 7 % 90).alias("addr1"),
        (c % 500).alias("card1"),
        F.when(p == "1", "W").when(p == "2", "H").when(p == "3", "C").when(p == "4", "S").otherwise("Z").alias("product"),
        F.when(o % 6 == 0, "gmail.com").when(o % 6 == 1, "user@ProtonMail.com").when(o % 6 == 2, "corp.example")
        .when(o % 6 == 3, "yahoo.com").when(o % 6 == 5, "tempmail.com").alias("email"),
        F.when(o % 7 == 0, F.lit(None)).when(o % 3 == 0, "mobile").otherwise("desktop").alias("device_type"),
        F.when(o % 4 == 0, "Windows").when(o % 4 > 1, F.concat(F.lit("handset-"), (c % 300).cast("string"))).alias("device_info"),
        F.when(o % 9 != 0, o % 400).alias("d1"),
        F.when(o % 4 != 0, o % 30).alias("d2"),
        (o % 11).alias("d3"),
        (o % 17).alias("d4"),
        F.when(o % 5 != 0, o % 60).alias("d5"),
    )


def nodes(spark, folder) -> DataFrame:
    i = F.col("c_custkey")
    cent = lambda m, mod=100, div=100.0: (i * m % mod) / div
    return table(spark, folder, "customer").select(
        i.alias("node"),
        (i * 37 % 1400).alias("account_age_days"),
        F.col("c_acctbal").alias("balance_mean"),
        F.round(F.abs("c_acctbal") * (i % 10) / 8, 4).alias("balance_std"),
        (i * 11 % 90).alias("tx_count"),
        (i * 7 % 25).alias("tx_velocity_7d"),
        cent(13).alias("fan_out_ratio"),
        ((i * 17 % 50) / 20.0 - 0.1).alias("amount_entropy"),
        cent(19).alias("risky_email"),
        cent(23).alias("device_consistency"),
        cent(29, 40, 10.0).alias("addr_entropy"),
        cent(31).alias("international_flag"),
        cent(41, 1000, 1000.0).alias("pagerank"),
        cent(43, 800).alias("in_out_ratio"),
        cent(47, 60).alias("reciprocity_score"),
        cent(53, 110).alias("community_fraud_rate"),
        (i * 59 % 3).alias("ring_membership"),
        cent(61).alias("second_hop_fraud_rate"),
        (i % 17 == 3).cast("int").alias("is_fraud"),
        (i % 37).alias("community"),
    )


def severity_of(score: Column) -> Column:
    return (
        F.when(score >= 95, "IMMINENT").when(score >= 85, "CRITICAL").when(score >= 70, "HOT")
        .when(score >= 55, "WARMING").otherwise("CLEAN")
    )


def alerts(spark, folder) -> DataFrame:
    return events_to_alerts(table(spark, folder, "events"))


def events_to_alerts(events: DataFrame) -> DataFrame:
    """Also used on the streaming read of the same table."""
    i = F.col("event_id")
    score = F.round(F.least(F.lit(100.0), F.col("value") * 1.5), 3)
    status = (
        F.when(i % 6 == 0, "NEW").when(i % 6 == 1, "ACK").when(i % 6 == 2, "ASSIGNED")
        .when(i % 6 == 3, "ESCALATED").when(i % 6 == 4, "RESOLVED").otherwise("FALSE_POSITIVE")
    )
    rows = events.where("event_type = 'error'").select(
        i.alias("alert_id"), F.col("user_id").alias("account"), score.alias("score"),
        severity_of(score).alias("severity"), status.alias("status"),
        seconds(F.col("ts")).alias("created"), (i % 3 == 0).alias("tainted"),
    )
    window = (
        F.when(F.col("severity") == "IMMINENT", 1800).when(F.col("severity") == "CRITICAL", 7200)
        .when(F.col("severity") == "HOT", 86400).otherwise(172800)
    )
    return rows.where("severity <> 'CLEAN'").withColumn("sla", F.col("created") + window)


def profiles(spark, folder) -> DataFrame:
    best = alerts(spark, folder).groupBy("account").agg(F.max("score").alias("score"))
    return (
        accounts(spark, folder).select("account", "holder", "bank", "segment")
        .join(best, "account", "left").fillna(0.0, ["score"])
        .withColumn("severity", severity_of(F.col("score")))
    )


def audit(spark, folder) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        (F.col("o_orderkey") + 1).alias("seq"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("logged_at"),
        F.col("o_orderpriority").alias("actor"),
        F.when(status == "F", "account.freeze").when(status == "O", "alert.open").otherwise("case.update").alias("action"),
        F.concat(F.lit("AC"), F.lpad(F.col("o_custkey").cast("string"), 10, "0")).alias("target"),
        F.concat(F.lit('{"amount":'), F.floor("o_totalprice").cast("string"), F.lit("}")).alias("detail"),
    )


def candidates(spark, folder) -> DataFrame:
    """Per incident the victim and everyone it had paid by the complaint."""
    inc = incidents(spark, folder)
    paid = (
        transfers(spark, folder).select("src", "dst", "epoch")
        .join(inc.select("incident", F.col("victim").alias("src"), "complaint"), "src")
        .where("epoch <= complaint").select("incident", F.col("dst").alias("account"))
    )
    return (
        inc.select("incident", F.col("victim").alias("account")).unionByName(paid)
        .where("account % 25 <> 7").distinct()
    )


def model_scores(spark, folder) -> DataFrame:
    """Three stand-in scorers over the candidates of every incident."""
    m = F.explode(F.array(*[F.lit(x) for x in (1, 2, 3)]))
    mix = F.col("account") * 7919 + F.col("incident") * 104729 + F.col("model") * 1299709
    return candidates(spark, folder).withColumn("model", m).select(
        "incident", "model", "account", ((mix % 499) / 498.0).alias("score")
    )


def case_transfers(spark, folder) -> DataFrame:
    """Transfers sent inside the horizon by the victim or an account it paid there."""
    inc = incidents(spark, folder)
    tx = transfers(spark, folder)
    first = (
        tx.select(F.col("src").alias("victim"), "dst", "epoch")
        .join(inc.select("incident", "victim", "t0", "horizon"), "victim")
        .where("epoch BETWEEN t0 AND horizon AND dst % 25 <> 7")
        .select("incident", F.col("dst").alias("account"))
    )
    core = inc.select("incident", F.col("victim").alias("account")).unionByName(first).distinct()
    frame = inc.select("incident", "victim", "t0", "complaint", "horizon", F.col("amount").alias("stolen"))
    return (
        core.join(frame, "incident")
        .join(tx.select("txn_id", "src", "dst", "amount", "epoch", "channel"), F.col("account") == F.col("src"))
        .where("epoch BETWEEN t0 AND horizon")
        .select(
            "incident", "victim", "t0", "complaint", "horizon", "stolen", "txn_id", "src", "dst", "amount",
            "epoch", "channel", (F.col("epoch") - F.col("t0")).alias("offset_sec"), (F.col("dst") % 25 == 7).alias("to_exit"),
        )
    )


def outcomes(spark, folder) -> DataFrame:
    """Stand-in replay outcomes of three policies on every incident."""
    i, m = F.col("incident"), F.col("policy")
    pct = (i * 31 + m * 17) % 101
    return incidents(spark, folder).withColumn("policy", F.explode(F.array(*[F.lit(x) for x in (1, 2, 3)]))).select(
        "incident", "policy", "amount", (F.col("amount") * pct / 100.0).alias("prevented"), (pct / 100.0).alias("rate"),
        ((i + m) % 4).alias("innocent"), ((i * m) % 6).alias("mules"), ((i + m) % 4 + (i * m) % 6).alias("frozen"),
        F.when(i % 7 != 0, F.lit(2) + i % 9).alias("first_freeze"), ((i * m * 13 % 1000) / 10.0).alias("solve_ms"),
    )


def labelled_scores(spark, folder) -> DataFrame:
    """Model scores with the truth attached; unlabelled accounts are innocent."""
    truth = labels(spark, folder).select("account", F.col("is_mule").alias("positive"))
    return model_scores(spark, folder).join(truth, "account", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
