"""Balances, outcomes and shape of a case over time.

``case_rows``: incident, victim, stolen, src, dst, amount, offset_sec, to_exit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..core import HOUR, ordinal, running_sum


def balance_deltas(case_rows: DataFrame, incidents: DataFrame) -> DataFrame:
    """Signed stolen money per account and second; the victim starts with the sum stolen."""
    start = incidents.select("incident", F.col("victim").alias("account"), F.lit(-1).cast("bigint").alias("t"), F.col("amount").alias("delta"))
    out = case_rows.select("incident", F.col("src").alias("account"), F.col("offset_sec").alias("t"), (-F.col("amount")).alias("delta"))
    inn = case_rows.where(~F.col("to_exit")).select("incident", F.col("dst").alias("account"), F.col("offset_sec").alias("t"), F.col("amount").alias("delta"))
    return start.unionByName(out).unionByName(inn).groupBy("incident", "account", "t").agg(F.sum("delta").alias("delta"))


def stolen_at(case_rows: DataFrame, incidents: DataFrame, moments: DataFrame) -> DataFrame:
    """Stolen money in an account at each asked second, never below zero.

    ``moments``: incident, account, t. Both sides meet in one running sum per
    account split by hour; a moment at the second of a transfer sees it.
    """
    deltas = balance_deltas(case_rows, incidents).withColumn("ask", F.lit(0))
    asks = moments.select("incident", "account", F.col("t").cast("bigint").alias("t")).distinct().withColumn("delta", F.lit(0.0)).withColumn("ask", F.lit(1))
    both = deltas.unionByName(asks)
    run = running_sum(both, ["incident", "account"], F.floor(F.col("t") / HOUR), ["t"], F.col("delta"), "held")
    return run.where("ask = 1").select("incident", "account", "t", F.greatest(F.col("held"), F.lit(0.0)).alias("stolen"))


def unrecoverable_series(case_rows: DataFrame, incidents: DataFrame) -> DataFrame:
    """Money gone through exits as a step series starting at (0, 0)."""
    gone = case_rows.where("to_exit").groupBy("incident", F.col("offset_sec").alias("t")).agg(F.sum("amount").alias("a"))
    start = incidents.select("incident", F.lit(0).cast("bigint").alias("t"), F.lit(0.0).alias("a"))
    rows = gone.unionByName(start).groupBy("incident", "t").agg(F.sum("a").alias("a"))
    return running_sum(rows, ["incident"], F.floor(F.col("t") / HOUR), ["t"], F.col("a"), "gone").select("incident", "t", F.round("gone", 2).alias("unrecoverable"))


def unrecoverable_at(case_rows: DataFrame, t: Column) -> DataFrame:
    return case_rows.where(F.col("to_exit") & (F.col("offset_sec") <= t)).groupBy("incident").agg(F.round(F.sum("amount"), 2).alias("unrecoverable"))


def first_arrival(case_rows: DataFrame) -> DataFrame:
    """First transfer into each account in time order, with its sender."""
    return case_rows.groupBy("incident", F.col("dst").alias("account")).agg(F.min(F.struct("offset_sec", "txn_id", "src", "amount")).alias("f")).select(
        "incident", "account", F.col("f.offset_sec").alias("arrival"), F.col("f.src").alias("parent"), F.col("f.amount").alias("amount")
    )


def case_outcomes(decisions: DataFrame, incidents: DataFrame, case_rows: DataFrame, balances: DataFrame, labels: DataFrame, lam: float = 1.0) -> DataFrame:
    """Headline numbers per incident and model.

    ``decisions``: incident, model, account, decision, t_decision_sec. A flagged
    mule returns what it holds, a flagged innocent locks own money too.
    """
    flagged = decisions.where("decision = 'flag'").select("incident", "account", F.col("t_decision_sec").alias("t"))
    stolen = stolen_at(case_rows, incidents, flagged)
    truth = labels.select("account", "is_mule", "layer_index")
    rows = (
        decisions.withColumn("t", F.col("t_decision_sec")).join(stolen, ["incident", "account", "t"], "left")
        .join(truth, "account", "left").join(balances, "account", "left")
        .join(incidents.select("incident", F.col("amount").alias("lossable")), "incident")
    )
    mule, flag = F.coalesce("is_mule", F.lit(False)), F.col("decision") == "flag"
    held = F.coalesce("stolen", F.lit(0.0))
    agg = rows.groupBy("incident", "model", "lossable").agg(
        F.sum(F.when(flag & mule, held).otherwise(0.0)).alias("recovered"),
        F.sum(F.when(flag & ~mule, F.coalesce("own_balance", F.lit(0.0)) + held).otherwise(0.0)).alias("wrongly_frozen"),
        F.count_if(flag & mule).alias("tp"), F.count_if(flag & ~mule).alias("fp"),
        F.count_if(~flag & mule).alias("fn"), F.count_if(~flag & ~mule).alias("tn"),
        F.percentile(F.when(flag & mule, F.col("t")), 0.5).alias("median_latency"),
        F.min(F.when(flag & mule, F.col("layer_index"))).alias("first_hop"),
    )
    two = lambda c: F.round(c, 2)
    return agg.select(
        "incident", "model", two(F.col("recovered")).alias("recovered"),
        two(F.col("lossable") - F.col("recovered")).alias("lost"),
        two(F.col("wrongly_frozen")).alias("wrongly_frozen"), two(F.col("recovered") - lam * F.col("wrongly_frozen")).alias("net_benefit"),
        "tp", "fp", "fn", "tn", "median_latency", "first_hop",
    )


def minute_frames(incidents: DataFrame, money: DataFrame, freezes: DataFrame, minutes: int) -> DataFrame:
    """Running leaked, secured and at-risk money for every minute; they always add up.

    ``money``: incident, minute, leaked, secured. ``freezes``: incident, minute, n.
    """
    spine = incidents.select("incident", "amount", F.explode(F.sequence(F.lit(0), F.lit(minutes))).alias("minute"))
    m = money.groupBy("incident", "minute").agg(F.sum("leaked").alias("leaked"), F.sum("secured").alias("secured"))
    z = freezes.groupBy("incident", "minute").agg(F.sum("n").alias("n"))
    w = W.partitionBy("incident").orderBy("minute").rowsBetween(W.unboundedPreceding, 0)
    run = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(w)
    rows = spine.join(m, ["incident", "minute"], "left").join(z, ["incident", "minute"], "left")
    rows = rows.select("incident", "minute", "amount", run("leaked").alias("l"), run("secured").alias("s"), run("n").alias("frozen"))
    two = lambda c: F.round(c, 2)
    return rows.select(
        "incident", "minute", F.col("frozen").cast("bigint").alias("frozen"), two(F.col("l")).alias("leaked"), two(F.col("s")).alias("recovered"),
        two(F.greatest(F.lit(0.0), F.col("amount") - F.col("l") - F.col("s"))).alias("at_risk"),
    )


def context_rank(edges: DataFrame, core: DataFrame, exits: DataFrame) -> DataFrame:
    """Outside accounts by transfers with the core, and the core account seen first.

    ``edges``: incident, src, dst, epoch, txn_id. The rank splits by transfer
    count and range of accounts.
    """
    both = edges.select("incident", F.col("src").alias("near"), F.col("dst").alias("far"), "epoch", "txn_id").unionByName(
        edges.select("incident", F.col("dst").alias("near"), F.col("src").alias("far"), "epoch", "txn_id")
    )
    c = lambda n: core.select("incident", F.col("account").alias(n))
    rows = both.join(c("near"), ["incident", "near"], "left_semi").join(c("far"), ["incident", "far"], "left_anti").join(
        exits.select(F.col("account").alias("far")), "far", "left_anti"
    )
    agg = rows.groupBy("incident", F.col("far").alias("account")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("epoch", "txn_id", "near")).alias("f")
    )
    cell = F.struct((-F.col("n")).alias("n"), F.floor(F.col("account") / 4096).alias("range"))
    ranked = ordinal(agg, ["incident"], cell, [F.desc("n"), F.col("account")], "o")
    return ranked.select("incident", "account", "n", (F.col("o") - 1).alias("context_rank"), F.col("f.near").alias("attached_to"))


def classify(incidents: DataFrame, members: DataFrame, gone: DataFrame, depth: DataFrame) -> DataFrame:
    """Scenario name and difficulty of each case.

    ``members``: incident, ring_id, dormant_days of its mules. ``gone``: incident,
    escaped by the complaint. ``depth``: incident, depth.
    """
    per_ring = members.groupBy("incident", "ring_id").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("dormant_days") >= 90).alias("d"))
    shape = per_ring.groupBy("incident").agg(
        F.sum("k").alias("mules"), F.sum("d").alias("dormant"),
        F.sort_array(F.collect_list(F.when(F.col("ring_id") != "", F.col("k"))), asc=False).alias("rings"),
    )
    # Typology to scenario, cut points.
    base = (
        F.when(F.col("typology") == "fanout", "layering").when(F.col("typology") == "structuring", "smurfing")
        .when(F.col("typology") == "chain_burst", "rapid_cashout").when(F.col("typology") == "crypto_exit", "cross_bank_mixing").otherwise("layering")
    )
    rows = incidents.join(shape, "incident", "left").join(gone, "incident", "left").join(depth, "incident", "left")
    second = F.when(F.size("rings") >= 2, F.element_at("rings", 2))
    scenario = (
        F.when(second >= F.greatest(F.lit(2.0), F.col("mules") * 0.2), "mixed")
        .when(F.col("dormant") / F.col("mules") >= 0.8, "dormant_reactivation").otherwise(base)
    )
    pressure = (
        F.col("delay") / 60.0 + F.coalesce("depth", F.lit(1)) / 4.0
        + F.coalesce("escaped", F.lit(0.0)) * 3.0 / F.greatest("amount", F.lit(1.0))
    )
    return rows.select("incident", scenario.alias("scenario"), F.when(pressure < 1.2, "easy").when(pressure < 2.4, "medium").otherwise("hard").alias("difficulty"))


def title(typology: Column, hops: Column, banks: Column) -> Column:
    # Names of the four shapes.
    name = (
        F.when(typology == "fanout", "Fan-out layering").when(typology == "structuring", "Sub-threshold structuring")
        .when(typology == "chain_burst", "Narrow chain into a burst").when(typology == "crypto_exit", "Crypto exit")
        .otherwise(F.initcap(F.replace(typology, F.lit("_"), F.lit(" "))))
    )
    return F.concat(name, F.lit(", "), hops.cast("string"), F.lit(" hops, "), banks.cast("string"), F.lit(" banks"))
