"""Visibility rules, selections and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIX_HOURS = 6 * 3600


def visible_edges(transfers: DataFrame, keep: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Per incident: transfers at or before its cutoff touching a kept account.

    The OR over both endpoints is two equi-joins: rows found by the receiver leave out
    those the sender already brought, so the wide result is never made distinct.
    ``keep``: incident, account. ``cutoffs``: incident, until.
    """
    wanted = keep.select("incident", "account").distinct().join(cutoffs, "incident").select("incident", "account", "until")

    def touching(side):
        rows = transfers.join(wanted.withColumnRenamed("account", side), side).where(F.col("epoch") <= F.col("until"))
        return rows.select("incident", "txn_id", "src", "dst", "amount", "epoch", "channel")

    sent = wanted.select("incident", F.col("account").alias("src"))
    return touching("src").unionByName(touching("dst").join(sent, ["incident", "src"], "left_anti"))


def window_slice(transfers: DataFrame, start: int, end: int) -> DataFrame:
    """Closed at both ends."""
    return transfers.where(F.col("epoch").between(start, end))


def observed_accounts(case_rows: DataFrame, pool: DataFrame, at: Column) -> DataFrame:
    """Account state as of ``at`` seconds after the theft.

    ``pool``: incident, account, age_days, dormancy_days. Dormancy restarts from
    the last event seen; an account never seen keeps ageing from its stored value.
    """
    seen = case_rows.where(F.col("offset_sec") <= at)
    ends = seen.select("incident", F.col("src").alias("account"), "offset_sec").unionByName(
        seen.select("incident", F.col("dst").alias("account"), "offset_sec")
    )
    last = ends.groupBy("incident", "account").agg(F.max("offset_sec").alias("last_seen"))
    day = 86400.0
    return pool.join(last, ["incident", "account"], "left").select(
        "incident", "account",
        (F.col("age_days") + at / day).alias("age_days"),
        F.when(F.col("last_seen").isNotNull(), (at - F.col("last_seen")) / day)
        .otherwise(F.col("dormancy_days") + at / day).alias("dormancy_days"),
    )


def case_end(case_rows: DataFrame, incidents: DataFrame) -> DataFrame:
    """Replay end: 15 minutes past the last event or complaint, at most the horizon."""
    last = case_rows.groupBy("incident").agg(F.max("offset_sec").alias("last_event"))
    return incidents.join(last, "incident", "left").select(
        "incident",
        F.least(
            F.col("horizon") - F.col("t0"),
            F.greatest(F.col("complaint") - F.col("t0"), F.coalesce("last_event", F.lit(0))) + 900,
        ).alias("end_sec"),
    )


def tick_schedule(case_rows: DataFrame, incidents: DataFrame, tick_sec: int = 30) -> DataFrame:
    """Distinct moments of a replay: grid, events and the second after, complaint."""
    ends = case_end(case_rows, incidents)
    grid = ends.select("incident", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("end_sec"), F.lit(tick_sec).cast("bigint"))).alias("t"))
    edge = ends.select("incident", F.col("end_sec").alias("t"))
    events = case_rows.where(~F.col("to_exit")).select(
        "incident", F.explode(F.array(F.col("offset_sec"), F.col("offset_sec") + 1)).alias("t")
    )
    cashouts = case_rows.where("to_exit").select("incident", F.col("offset_sec").alias("t"))
    told = incidents.select("incident", (F.col("complaint") - F.col("t0")).alias("t"))
    everything = grid.unionByName(edge).unionByName(events).unionByName(cashouts).unionByName(told)
    return everything.join(ends, "incident").where("t BETWEEN 0 AND end_sec").select("incident", "t").distinct()


def holdout(episodes: DataFrame, rings: Sequence[str], held: bool | None) -> DataFrame:
    if held is None:
        return episodes
    inside = F.col("ring_id").isin(*rings)
    return episodes.where(inside if held else ~inside)


def materialise_complaints(episodes: DataFrame, delays: Sequence[int]) -> DataFrame:
    """Every episode at every delay; the id names both."""
    return episodes.withColumn("delay", F.explode(F.array(*[F.lit(d) for d in delays]))).select(
        F.concat(F.col("incident").cast("string"), F.lit("@"), F.col("delay").cast("string")).alias("complaint_id"),
        "incident", "delay",
        (F.col("t0") + F.col("delay") * 60).alias("complaint"),
        (F.col("t0") + F.col("delay") * 60 + SIX_HOURS).alias("horizon_end"),
    )


def intake(complaints: DataFrame, accounts: DataFrame, span: DataFrame) -> DataFrame:
    """Reason per filed complaint, 'accepted' when every rule holds.

    ``complaints``: complaint_id, account, filed_at, amount, delay. ``span``: one row of
    first and last transfer second.
    """
    known = accounts.select("account", F.lit(True).alias("known"))
    first, last = span.select("first").scalar(), span.select("last").scalar()
    reason = (
        F.when(F.col("known").isNull(), "unknown_account")
        .when((F.col("filed_at") < first) | (F.col("filed_at") > last + 86400), "outside_window")
        .when((F.col("amount") <= 0) | (F.col("amount") > 1e8), "bad_amount")
        .when((F.col("delay") < 0) | (F.col("delay") > 1440), "bad_delay")
        .otherwise("accepted")
    )
    return complaints.join(known, "account", "left").select("complaint_id", "account", reason.alias("reason"))


def validate_transactions(batch: DataFrame, seen: DataFrame, as_of: Column) -> DataFrame:
    """Reason per gateway row: missing field, amount, stale, duplicate, or ok."""
    known = seen.select("txn_id").distinct().withColumn("dup", F.lit(True))
    reason = (
        F.when(F.col("src").isNull() | F.col("dst").isNull() | F.col("amount").isNull(), "missing_field")
        .when(F.col("amount") <= 0, "bad_amount")
        .when(F.col("epoch") < as_of - 86400, "stale")
        .when(F.col("dup"), "duplicate")
        .otherwise("ok")
    )
    return batch.join(known, "txn_id", "left").select("txn_id", reason.alias("reason"))


def search_accounts(profiles: DataFrame, text: str | None, severity: str | None, offset: int, limit: int) -> DataFrame:
    """One page plus one row, so a further page is visible to the caller."""
    rows = profiles
    if text:
        rows = rows.where(F.col("holder").ilike(f"%{text}%") | F.col("account").cast("string").ilike(f"%{text}%"))
    if severity:
        rows = rows.where(F.col("severity") == severity)
    return rows.orderBy(F.desc("score"), "account").offset(offset).limit(limit + 1)


ALERT_SORTS = {
    "score_desc": lambda: [F.desc("score")],
    "score_asc": lambda: [F.asc("score")],
    "newest": lambda: [F.desc("created")],
    "sla": lambda: [F.asc_nulls_first("sla")],
}


def alert_queue(alerts: DataFrame, status: str | None = None, severity: str | None = None, sort: str = "score_desc") -> DataFrame:
    rows = alerts
    if status:
        rows = rows.where(F.col("status") == status)
    if severity:
        rows = rows.where(F.col("severity") == severity)
    return rows.orderBy(*ALERT_SORTS[sort](), "alert_id")


def audit_log(entries: DataFrame, actor: str | None = None, action: str | None = None) -> DataFrame:
    rows = entries
    if actor:
        rows = rows.where(F.col("actor") == actor)
    if action:
        rows = rows.where(F.col("action") == action)
    return rows.select("seq", "logged_at", "actor", "action", "target", F.right("entry_hash", F.lit(8)).alias("fingerprint"))


def pattern_hits(scored: DataFrame, kind: str, limit: int = 25) -> DataFrame:
    """Watched accounts showing one pattern, best scores first.

    ``scored``: account, score, severity, s2, s3.
    """
    rules = {
        "round_trip": F.col("s2") > 0.4,
        "layering": F.col("s2") > 0.4,
        "structuring": F.col("s3") > 0.3,
    }
    watched = F.col("severity") != "CLEAN"
    return scored.where(watched & rules.get(kind, F.col("score") >= 55)).orderBy(F.desc("score"), "account").limit(limit)


def in_structuring_band(amount: Column, low: float = 45_000.0, high: float = 49_900.0) -> Column:
    return amount.between(low, high)


def high_risk(scored: DataFrame, floor: float = 50.0, limit: int = 20) -> DataFrame:
    return scored.where(F.col("risk_score") > floor).orderBy(F.desc("risk_score"), "account").limit(limit)


def select_cases(incidents: DataFrame, core: DataFrame, max_delay: int = 130, low: int = 8, high: int = 70) -> DataFrame:
    sizes = core.groupBy("incident").agg(F.count(F.lit(1)).alias("core_size"))
    return incidents.join(sizes, "incident").where(
        (F.col("delay") <= max_delay) & F.col("core_size").between(low, high)
    ).select("incident", "delay", "core_size")


def quality_report(transfers: DataFrame, accounts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per rule with its number of violations."""
    rows = transfers.agg(
        F.count_if(F.greatest(*[F.col(c).isNull() for c in ("txn_id", "src", "dst", "amount", "epoch", "channel")])).alias("null_field"),
        F.count_if(F.col("src") == F.col("dst")).alias("self_transfer"),
        F.count_if(F.col("amount") <= 0).alias("bad_amount"),
    )
    ids = accounts.select("account")
    ends = transfers.select(F.col("src").alias("account")).unionByName(transfers.select(F.col("dst").alias("account")))
    orphans = ends.join(ids, "account", "left_anti").agg(F.count(F.lit(1)).alias("orphan_endpoint"))
    dupes = transfers.groupBy("txn_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_id"))
    marks = labels.join(ids, "account", "left_anti").agg(F.count(F.lit(1)).alias("orphan_label"))
    incoherent = labels.agg(
        F.count_if(F.col("is_mule") != (F.col("ring_id") != "")).alias("label_ring_mismatch"),
        F.count_if(F.col("is_mule") != (F.col("layer_index") >= 0)).alias("label_layer_mismatch"),
    )
    parts = []
    for frame in (rows, orphans, dupes, marks, incoherent):
        pairs = ", ".join(f"'{c}', {c}" for c in frame.columns)
        parts.append(frame.selectExpr(f"stack({len(frame.columns)}, {pairs}) AS (rule, violations)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("rule", F.col("violations").cast("bigint").alias("violations"))
