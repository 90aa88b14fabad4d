"""Feed with a resume cursor, metrics kept by their changes, and actions that fan out per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import HOUR, ordinal
from ..operators import graph as R
from ..operators.flows import campaign, recruiters
from ..sources.adapters import severity_of
from .runtime import batch_writer

STEP = 1 << 40
STATUSES = ("OPEN", "INVESTIGATING", "ESCALATED", "CLOSED_CONFIRMED", "CLOSED_CLEARED")


def feed_writer(folder: str):
    """Append events under an id that rises with the batch and the event time inside it."""

    def number(df: DataFrame, batch: int) -> DataFrame:
        rows = ordinal(df, [], F.floor(F.col("epoch") / HOUR), ["epoch", "txn_id"], "o")
        return rows.withColumn("feed_id", F.lit(batch * STEP) + F.col("o")).drop("o")

    return batch_writer(folder, "feed", number)


def read_feed(spark: SparkSession, folder: str, after: int = 0) -> DataFrame:
    """Events after the cursor, in order; no gap and no repeat."""
    return spark.read.parquet(f"{folder}/feed").where(F.col("feed_id") > after).drop("b", "batch").orderBy("feed_id")


CHANGE_OUT = "account bigint, was double, now double, opened bigint"


def score_changes(alerts: DataFrame) -> DataFrame:
    """Per account and batch its best score before and after, and the alerts it adds that are open.

    State is one number per account; an account's rows are only folded, never gathered.
    ``alerts``: account, score, open.
    """
    import pandas as pd

    def update(key, batches, state):
        was = state.get[0] if state.exists else 0.0
        now, opened = was, 0
        for pdf in batches:
            now, opened = max(now, float(pdf["score"].max())), opened + int(pdf["open"].sum())
        state.update((now,))
        yield pd.DataFrame([(key[0], was, now, opened)], columns=[c.split()[0] for c in CHANGE_OUT.split(", ")])

    return alerts.select("account", "score", "open").groupBy("account").applyInPandasWithState(update, CHANGE_OUT, "best double", "append", "NoTimeout")


def pulse_writer(folder: str):
    """What a batch of `score_changes` adds to the metrics: one row, from the batch alone."""

    def added(df: DataFrame, batch: int) -> DataFrame:
        watched = lambda c: (severity_of(F.col(c)) != "CLEAN").cast("long")
        return df.agg(
            F.coalesce(F.sum("opened"), F.lit(0)).alias("opened"), F.coalesce(F.sum(watched("now") - watched("was")), F.lit(0)).alias("watched"),
            F.coalesce(F.sum(F.col("now") - F.col("was")), F.lit(0.0)).alias("gained"), F.max(F.struct(F.col("now").alias("score"), (-F.col("account")).alias("neg"))).alias("best"))

    return batch_writer(folder, "pulse", added)


def read_pulse(spark: SparkSession, folder: str, accounts: int, first: int, upto: int | None = None) -> DataFrame:
    """The metrics after batch ``upto`` (the last by default): the sum of what the batches added.

    ``accounts`` is the number of accounts, ``first`` the smallest one: all scores begin at 0.
    """
    rows = spark.read.parquet(f"{folder}/pulse")
    if upto is not None:
        rows = rows.where(F.col("batch") <= upto)
    whole = rows.agg(F.sum("opened").alias("open_alerts"), F.sum("watched").alias("watched"), F.max("best").alias("best"), F.sum("gained").alias("gained"))
    start = F.struct(F.lit(0.0).alias("score"), F.lit(-first).cast("long").alias("neg"))
    best = F.greatest(F.coalesce("best", start), start)
    return whole.select(
        F.coalesce("open_alerts", F.lit(0)).alias("open_alerts"), F.coalesce("watched", F.lit(0)).alias("watched"), (-best["neg"]).alias("highest_account"), best["score"].alias("highest_score"),
        F.round(F.coalesce("gained", F.lit(0.0)) / accounts, 4).alias("average_score"))


def freeze_writer(folder: str, edges: DataFrame, max_hops: int = 4):
    """Freeze a batch of accounts: an audit row each, and taint around all of them."""

    def act(df: DataFrame, batch: int) -> None:
        seeds = df.select("account").distinct()
        batch_writer(folder, "events")(seeds.withColumn("action", F.lit("account.frozen")), batch)
        batch_writer(folder, "taint")(R.decay_taint(seeds, edges, max_hops), batch)

    return act


def campaign_writer(folder: str, transfers: DataFrame):
    """Freeze each named recruiter together with everyone it recruited."""

    def act(df: DataFrame, batch: int) -> None:
        named = recruiters(transfers).join(df.select("account").distinct(), "account", "left_semi")
        members = campaign(transfers, named)
        frozen = members.select("recruiter", "account").unionByName(named.select(F.col("account").alias("recruiter"), "account")).distinct()
        batch_writer(folder, "frozen")(frozen, batch)

    return act


def case_activity(updates: DataFrame) -> DataFrame:
    """One row per real status change; unknown statuses are rejected.

    ``updates``: case_id, seq, status. Uses the split lag, so a busy case is not a sort.
    """
    from ..operators.ledger import previous_value

    valid = updates.where(F.col("status").isin(*STATUSES))
    rows = previous_value(valid, ["case_id"], "seq", "status", "from_status", 100_000)
    return rows.where(F.coalesce(F.col("from_status"), F.lit("OPEN")) != F.col("status")).select(
        "case_id", "seq", F.coalesce("from_status", F.lit("OPEN")).alias("from_status"), F.col("status").alias("to_status")
    )


def node_counters(transfers: DataFrame) -> DataFrame:
    """Streaming counters per node (update mode); partial sums merge before the state."""
    leg = F.explode(F.array(
        F.struct(F.col("src").alias("account"), F.lit(1).alias("o"), F.col("amount").alias("out"), F.lit(0).alias("i"), F.lit(0.0).alias("inn")),
        F.struct(F.col("dst").alias("account"), F.lit(0).alias("o"), F.lit(0.0).alias("out"), F.lit(1).alias("i"), F.col("amount").alias("inn")),
    )).alias("leg")
    return transfers.select(leg).select("leg.*").groupBy("account").agg(
        F.sum("o").alias("out_degree"), F.sum("out").alias("total_out"), F.sum("i").alias("in_degree"), F.sum("inn").alias("total_in")
    )
