"""Keyed state per account: live scores, reset-on-expiry totals, alerts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.signals import account_legs

HOURS = 48
DAY, WEEK = 86_400, 7 * 86_400
SPAN = 24

SCORE_OUT = "account bigint, as_of bigint, n48 bigint, near bigint, sent double, received double"
SCORE_STATE = "sent double, received double, near bigint, last bigint, hours array<bigint>, counts array<bigint>"


def live_totals(transfers: DataFrame) -> DataFrame:
    """Running score inputs of every account a batch touches (append history).

    The 48-hour count is kept per clock hour, so state is at most 48 numbers however
    busy the account is.
    """
    import numpy as np
    import pandas as pd

    def update(key, batches: Iterator[pd.DataFrame], state):
        sent, received, near, last, hours, counts = state.get if state.exists else (0.0, 0.0, 0, 0, [], [])
        tally = dict(zip(hours, counts))
        for pdf in batches:
            out = (pdf["direction"] == "OUT").to_numpy()
            amount, epoch = pdf["amount"].to_numpy(), pdf["epoch"].to_numpy()
            sent += float(amount[out].sum())
            received += float(amount[~out].sum())
            near += int(((amount >= 25_000) & (amount < 50_000)).sum())
            last = max(last, int(epoch.max()))
            for hour, n in zip(*np.unique(epoch // 3600, return_counts=True)):
                tally[int(hour)] = tally.get(int(hour), 0) + int(n)
        floor = last // 3600 - HOURS
        tally = {h: n for h, n in sorted(tally.items()) if h > floor}
        state.update((sent, received, near, last, list(tally), list(tally.values())))
        yield pd.DataFrame([(key[0], last, sum(tally.values()), near, sent, received)], columns=[c.split()[0] for c in SCORE_OUT.split(", ")])

    return account_legs(transfers).groupBy("account").applyInPandasWithState(update, SCORE_OUT, SCORE_STATE, "append", "NoTimeout")


def live_scores(totals: DataFrame, segments: DataFrame) -> DataFrame:
    """Score and band of the live totals; a stream-static join to the segments."""
    from ..core import clamp, share
    from ..operators.signals import OTHER_EXPECTED, SEGMENT_EXPECTED, WEIGHTS, band_for, choose

    ratio = F.least(F.lit(1.0), share(F.col("sent"), F.col("received")))
    s2 = F.when(F.col("received") <= 0, 0.0).when(ratio > 0.5, (ratio - 0.5) / 0.5).otherwise(0.0)
    load = (F.col("sent") + F.col("received")) / choose(F.col("segment"), SEGMENT_EXPECTED, OTHER_EXPECTED)
    total = (
        clamp((F.col("n48") - 3) / 12.0, 0, 1) * WEIGHTS["S1"] + s2 * WEIGHTS["S2"]
        + clamp((F.col("near") - 2) / 6.0, 0, 1) * WEIGHTS["S3"] + clamp((load - 1.5) / 4.5, 0, 1) * WEIGHTS["S5"]
    )
    score = F.round(F.least(F.lit(100.0), total), 2)
    return totals.join(segments, "account").select("account", "as_of", score.alias("score"), band_for(score).alias("severity"))


def hour_totals(transfers: DataFrame) -> DataFrame:
    """Count and sum sent per account and clock hour (update mode), the panes of `sliding_totals`.

    A pane takes late rows as long as the last sliding window over it would.
    """
    rows = transfers.withColumn("ts", F.timestamp_seconds("epoch")).withWatermark("ts", f"{SPAN} hours")
    panes = rows.groupBy(F.window("ts", "1 hour").alias("w"), F.col("src").alias("account")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    return panes.select(F.unix_timestamp("w.start").alias("hour"), "account", "n", "total")


def sliding_totals(panes: DataFrame) -> DataFrame:
    """Totals of every window of 24 hours, one hour apart, that holds a row.

    Only panes are shuffled, by account; an account has at most one per hour.
    """
    starts = F.explode(F.sequence(F.col("hour") - (SPAN - 1) * 3600, F.col("hour"), F.lit(3600))).alias("start")
    return panes.repartition("account").select(starts, "account", "n", "total").groupBy("start", "account").agg(
        F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


RESET_OUT = (
    "account bigint, total_out_24h double, total_in_24h double, txn_count_24h bigint, "
    "total_out_7d double, total_in_7d double, txn_count_7d bigint, unique_counterparties_7d bigint"
)
RESET_STATE = "d_start bigint, d_out double, d_in double, d_n bigint, w_start bigint, w_out double, w_in double, w_n bigint, peers array<bigint>"


def reset_totals(transfers: DataFrame) -> DataFrame:
    """Totals whose 24-hour and 7-day windows restart at the first event after expiry."""
    import numpy as np
    import pandas as pd

    def fold(start, span, epoch):
        """Index of the first event of the open window, and its start."""
        first = 0
        if start is None:
            start = int(epoch[0])
        while True:
            i = int(np.searchsorted(epoch, start + span, side="right"))
            if i >= len(epoch):
                return first, start
            first, start = i, int(epoch[i])

    def update(key, batches: Iterator[pd.DataFrame], state):
        old = state.get if state.exists else (None, 0.0, 0.0, 0, None, 0.0, 0.0, 0, [])
        rows = pd.concat(list(batches)).sort_values("epoch", kind="stable")
        epoch, amount = rows["epoch"].to_numpy(), rows["amount"].to_numpy()
        out, peer = (rows["direction"] == "OUT").to_numpy(), rows["peer"].to_numpy()
        parts = []
        for at, span in ((0, DAY), (4, WEEK)):
            first, start = fold(old[at], span, epoch)
            keep = start == old[at]
            base = old[at + 1 : at + 4] if keep else (0.0, 0.0, 0)
            a, o = amount[first:], out[first:]
            parts.append((start, base[0] + float(a[o].sum()), base[1] + float(a[~o].sum()), base[2] + len(a)))
            if span == WEEK:
                peers = sorted(set(old[8] if keep else []) | set(peer[first:].tolist()))
        (d, w) = parts
        state.update((*d, *w, peers))
        yield pd.DataFrame([(key[0], round(d[1], 2), round(d[2], 2), d[3], round(w[1], 2), round(w[2], 2), w[3], len(peers))], columns=[c.split()[0] for c in RESET_OUT.split(", ")])

    return account_legs(transfers).groupBy("account").applyInPandasWithState(update, RESET_OUT, RESET_STATE, "update", "NoTimeout")


ALERT_OUT = "account bigint, alert_no bigint, score double, severity string, status string, sla bigint, at bigint, pos bigint"
ALERT_STATE = "alert_no bigint, score double, severity string, status string, sla bigint"
# Minutes to act per band, and where each human action leads.
SLA = {"IMMINENT": 30, "CRITICAL": 120, "HOT": 1440, "WARMING": 2880, "CLEAN": 2880}
ACTIONS = {"ack": "ACK", "assign": "ASSIGNED", "escalate": "ESCALATED", "resolve": "RESOLVED", "false_positive": "FALSE_POSITIVE"}
CLOSED = ("RESOLVED", "FALSE_POSITIVE")


def step_alert(state, event):
    """One event on one account: (new state, changed). Scores raise or update, people act."""
    number, score, severity, status, sla = state
    kind, value, band, at = event
    live = number > 0 and status not in CLOSED
    if kind == "score":
        if band == "CLEAN":
            return state, False
        due = at + SLA[band] * 60
        if live:
            return (number, value, band, status, min(sla, due)), True
        return (number + 1, value, band, "NEW", due), True
    if not live:
        return state, False
    return (number, score, severity, ACTIONS[kind], sla), True


def alert_states(events: DataFrame) -> DataFrame:
    """Alert changes per account. ``events``: account, kind, score, severity, at, pos."""
    import pandas as pd

    def update(key, batches: Iterator[pd.DataFrame], state):
        now = state.get if state.exists else (0, 0.0, "CLEAN", "NONE", 0)
        rows = pd.concat(list(batches)).sort_values(["at", "pos"])
        out = []
        for kind, value, band, at, pos in zip(rows["kind"], rows["score"], rows["severity"], rows["at"], rows["pos"]):
            now, changed = step_alert(now, (kind, float(value), band, int(at)))
            if changed:
                out.append((key[0], *now, int(at), int(pos)))
        state.update(now)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERT_OUT.split(", ")])

    return events.groupBy("account").applyInPandasWithState(update, ALERT_OUT, ALERT_STATE, "append", "NoTimeout")
