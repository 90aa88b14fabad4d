"""Writing: finalised transfers, nested case documents, reports, sealed packages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import HOUR, ordinal
from ..functions.digests import hmac_sha256
from ..functions.masking import mask_ref


def finalise_transfers(*parts: DataFrame) -> DataFrame:
    """Union in one total order with a stable ordinal id per row.

    The ordinal is hour totals plus a row number inside the hour, so no task sorts
    the whole table.
    """
    rows = reduce(DataFrame.unionByName, parts)
    order = ["epoch", "src", "dst", "amount", "channel"]
    return ordinal(rows, [], F.floor(F.col("epoch") / HOUR), order, "pos").select(
        F.format_string("T%09d", F.col("pos")).alias("txn_id"),
        "src", "dst", "amount", "epoch", "channel",
    )


def write_transfers(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").option("compressionLevel", 3).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def case_documents(incidents: DataFrame, drawn: DataFrame, accounts: DataFrame, labels: DataFrame, case_rows: DataFrame) -> DataFrame:
    """One nested document per case over its drawn accounts.

    ``drawn`` is bounded per case by the draw list, which bounds every array.
    """
    facts = (
        drawn.select("incident", "account")
        .join(accounts.select("account", "bank", "kyc_tier"), "account")
        .join(labels.select("account", "is_mule"), "account", "left")
        .groupBy("incident")
        .agg(
            F.sort_array(F.collect_list(F.struct(F.col("account").alias("id"), "bank", "kyc_tier"))).alias("accounts"),
            F.map_from_entries(
                F.collect_list(F.struct("account", F.coalesce("is_mule", F.lit(False)).alias("m")))
            ).alias("truth"),
        )
    )
    inside = drawn.select("incident", F.col("account").alias("src"))
    rows = case_rows.join(inside, ["incident", "src"], "left_semi")
    amount = F.round("amount", 2).alias("amount_inr")
    at = F.col("offset_sec").alias("t_offset_sec")
    moves = (
        rows.groupBy("incident")
        .agg(
            F.sort_array(F.collect_list(F.when(~F.col("to_exit"), F.struct("src", "dst", amount, at)))).alias("transfers"),
            F.sort_array(
                F.collect_list(F.when(F.col("to_exit"), F.struct(F.col("src").alias("account_id"), amount, at)))
            ).alias("cashout_events"),
        )
    )
    return (
        incidents.select(
            F.col("incident"),
            F.struct(F.col("victim").alias("account_id"), F.col("amount").alias("amount_inr")).alias("victim"),
        )
        .join(facts, "incident", "left").join(moves, "incident", "left")
        .withColumnRenamed("incident", "case_id")
    )


def write_case_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").partitionBy("case_id").json(path)


def sealed_packages(rows: DataFrame, key: bytes) -> DataFrame:
    """Per case an XML body over its ranked accounts, its fingerprint and its seal.

    ``rows`` carries ``case_id, pos, account_id, score, band, status`` and is
    bounded per case by the plan size.
    """
    line = F.concat(
        F.lit('<account ref="'), mask_ref(F.col("account_id")), F.lit('" score="'), F.col("score_text"),
        F.lit('" band="'), F.col("band"), F.lit('" status="'), F.col("status"), F.lit('"/>'),
    )
    item = F.to_json(F.struct(mask_ref(F.col("account_id")).alias("ref"), F.col("score_text").alias("score"), "band", "status"))
    body = lambda c, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", c.alias("t")))), lambda x: x["t"]), sep)
    packed = rows.groupBy("case_id").agg(body(line, "").alias("lines"), body(item, ",").alias("items"))
    xml = F.concat(F.lit('<str case="'), F.col("case_id").cast("string"), F.lit('">'), F.col("lines"), F.lit("</str>"))
    doc = F.concat(F.lit('{"case":'), F.col("case_id").cast("string"), F.lit(',"accounts":['), F.col("items"), F.lit("]}"))
    return packed.select(
        "case_id", xml.alias("xml"), doc.alias("json"),
        F.right(F.sha2(xml, 256), F.lit(8)).alias("fingerprint"),
        hmac_sha256(xml, key).alias("seal"),
    )


def freeze_orders(plan: DataFrame, accounts: DataFrame) -> DataFrame:
    """Plan rows grouped by holding bank, banks ordered by their best rank.

    ``plan``: incident, rank, account, at_risk, expected, p_mule, cost.
    """
    second = (F.col("p_mule") < 0.90) | (F.col("cost") > 0.05)
    return (
        plan.join(accounts.select("account", "bank"), "account")
        .groupBy("incident", "bank")
        .agg(
            F.min("rank").alias("first_rank"),
            F.count(F.lit(1)).alias("instructions"),
            F.round(F.sum("at_risk"), 2).alias("at_risk"),
            F.round(F.sum("expected"), 4).alias("expected"),
            F.count_if(second).alias("second_approval"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("account").cast("string").alias("a")))), lambda x: x["a"]), ",").alias("accounts"),
        )
    )
