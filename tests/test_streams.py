"""A stream in several batches ends where one batch over the same rows ends."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluice.sources import adapters as A
from sluice.streaming import accounts as U
from sluice.streaming import feed as Q
from sluice.streaming import identity as I
from sluice.streaming import runtime as T


@pytest.fixture(scope="module")
def sliced(spark, small, tmp_path_factory):
    """The event table as four files in time order, read one per trigger."""
    folder = str(tmp_path_factory.mktemp("events"))
    ev = A.table(spark, small, "events")
    lo, hi = ev.agg(F.min("event_id"), F.max("event_id")).first()
    for i in range(4):
        a, b = lo + (hi - lo + 1) * i // 4, lo + (hi - lo + 1) * (i + 1) // 4
        ev.where((F.col("event_id") >= a) & (F.col("event_id") < b)).coalesce(1).write.parquet(f"{folder}/part{i}")
    import shutil
    from pathlib import Path

    flat = tmp_path_factory.mktemp("flat")
    for i in range(4):
        src = next(Path(folder, f"part{i}").glob("*.parquet"))
        shutil.copy(src, flat / f"events-{i}.parquet")
        import os

        os.utime(flat / f"events-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(flat)


def stream(spark, small, sliced):
    return A.events_to_transfers(T.event_stream(spark, sliced, 1), F.lit(T.population(spark, small)))


def test_reset_totals(spark, small, sliced):
    from sluice.operators.flows import reset_aggregates
    from sluice.operators.signals import account_legs

    folder = T.work_folder(spark, "t-reset")
    T.drain(U.reset_totals(stream(spark, small, sliced)), folder, "update", T.batch_writer(folder))
    got = T.latest_per_key(spark, folder, ["account"])
    want = reset_aggregates(account_legs(A.transfers(spark, small)))
    rows = lambda d: sorted(tuple(round(v, 2) if isinstance(v, float) else v for v in r) for r in d.select(*want.columns).collect())
    assert spark.read.parquet(f"{folder}/data").select("b").distinct().count() == 4
    assert rows(got) == rows(want)


def test_node_counters_and_live_totals(spark, small, sliced):
    folder = T.work_folder(spark, "t-nodes")
    T.drain(Q.node_counters(stream(spark, small, sliced)), folder, "update", T.batch_writer(folder))
    got = T.latest_per_key(spark, folder, ["account"]).agg(F.sum("out_degree"), F.sum("in_degree")).first()
    n = A.transfers(spark, small).count()
    assert tuple(got) == (n, n)


def test_identity_profile_over_batches(spark, small, sliced):
    rows = lambda t: t.select("txn_id", "epoch", F.col("src").alias("account"), (F.col("k") % 5).alias("ja3"), (F.col("src") % 4).alias("device"),
                              (F.col("k") % 7).alias("ip"), F.lit("in").alias("geo"), F.lit("IN").alias("home"), F.lit(0.2).alias("ja3_risk"))
    folder = T.work_folder(spark, "t-id")

    def act(df, batch):
        seen = spark.read.parquet(f"{folder}/pairs") if batch else None
        scored, pairs = I.profile_batch(df, seen)
        scored, pairs = scored.persist(), pairs.persist()
        T.batch_writer(folder, "scored")(scored, batch)
        pairs.count()
        T.batch_writer(folder, "pairs")(pairs, batch)

    T.drain(rows(stream(spark, small, sliced)), folder, each=act)
    whole, _ = I.profile_batch(rows(A.transfers(spark, small)), None)
    got = spark.read.parquet(f"{folder}/scored").select(whole.columns)
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()


def test_fingerprints_over_batches(spark, small, sliced):
    t = stream(spark, small, sliced).select("txn_id", "epoch", F.col("src").alias("account"), (F.col("k") % 3).alias("ja3"))
    folder = T.work_folder(spark, "t-ja3")
    T.drain(I.fingerprint_hits(t), folder)
    got = {r.txn_id: (r.velocity, r.fanout) for r in spark.read.parquet(f"{folder}/data").collect()}
    start, hits, known = {}, {}, {}
    for r in A.transfers(spark, small).orderBy("epoch", "txn_id").collect():
        j = r.k % 3
        if j not in start or r.epoch - start[j] > 300:
            start[j], hits[j], known[j] = r.epoch, 0, set()
        hits[j] += 1
        known[j].add(r.src)
        assert got[r.txn_id] == (hits[j], len(known[j]))


def test_alert_state_machine():
    s = (0, 0.0, "CLEAN", "NONE", 0)
    s, c = U.step_alert(s, ("score", 60.0, "WARMING", 0))
    assert c and s == (1, 60.0, "WARMING", "NEW", 172_800)
    s, _ = U.step_alert(s, ("ack", 0.0, "", 5))
    s, _ = U.step_alert(s, ("score", 96.0, "IMMINENT", 100))
    assert s == (1, 96.0, "IMMINENT", "ACK", 1900)
    s, _ = U.step_alert(s, ("score", 56.0, "WARMING", 200))
    assert s[4] == 1900  # the tighter deadline stays
    s, _ = U.step_alert(s, ("resolve", 0.0, "", 300))
    assert U.step_alert(s, ("ack", 0.0, "", 301))[1] is False
    s, _ = U.step_alert(s, ("score", 70.0, "HOT", 400))
    assert s[0] == 2 and s[3] == "NEW"


def test_feed_resumes_without_gap_or_repeat(spark, small, sliced):
    folder = T.work_folder(spark, "t-feed")
    T.drain(stream(spark, small, sliced).select("txn_id", "epoch"), folder, each=Q.feed_writer(folder))
    ids = [r.feed_id for r in Q.read_feed(spark, folder).collect()]
    assert len(ids) == len(set(ids)) == A.transfers(spark, small).count() and ids == sorted(ids)
    assert [r.feed_id for r in Q.read_feed(spark, folder, ids[99]).collect()] == ids[100:]


def test_gate_drops_repeats(spark, small, sliced):
    t = stream(spark, small, sliced).withColumn("ts", F.timestamp_seconds("epoch"))
    folder = T.work_folder(spark, "t-gate")
    T.drain(I.gate(t.unionByName(stream(spark, small, sliced).withColumn("ts", F.timestamp_seconds("epoch")))), folder)
    rows = spark.read.parquet(f"{folder}/data")
    assert rows.count() == rows.select("txn_id").distinct().count()


def test_pulse_after_every_slice(spark, small, sliced):
    from sluice.operators.flows import live_facts

    folder = T.work_folder(spark, "t-pulse")
    marked = lambda d: d.withColumn("open", ~F.col("status").isin("RESOLVED", "FALSE_POSITIVE"))
    T.drain(Q.score_changes(marked(A.events_to_alerts(T.event_stream(spark, sliced, 1)))), folder, each=Q.pulse_writer(folder))
    accounts = A.accounts(spark, small)
    n, first = accounts.agg(F.count(F.lit(1)), F.min("account")).first()
    for upto in range(4):
        events = spark.read.parquet(*[f"{sliced}/events-{i}.parquet" for i in range(upto + 1)])
        alerts = A.events_to_alerts(events)
        best = alerts.groupBy("account").agg(F.max("score").alias("score"))
        profiles = accounts.select("account").join(best, "account", "left").fillna(0.0, ["score"]).withColumn("severity", A.severity_of(F.col("score")))
        want = live_facts(alerts, profiles).first()
        assert tuple(Q.read_pulse(spark, folder, n, first, upto).select(*want.asDict()).first()) == tuple(want)


def test_accounts_of_a_window_are_counted_exactly(spark, tmp_path):
    """Windows of up to 60 accounts over two batches; a sketch misses some of them."""
    for i in range(2):
        spark.range(24_000).where(F.col("id") % 2 == i).select(
            F.col("id").alias("txn_id"), F.timestamp_seconds(F.floor(F.col("id") / 60) * 300 + F.col("id") % 60).alias("ts"), (F.col("id") % 5).alias("ja3"),
            (F.xxhash64("id") % (F.floor(F.col("id") / 60) % 60 + 1)).alias("account")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    T.drain(I.fingerprint_windows(source, "10 days"), f"{tmp_path}/out", "update", T.batch_writer(f"{tmp_path}/out"))
    got = I.window_totals(T.latest_per_key(spark, f"{tmp_path}/out", ["start", "ja3", "account"]))
    want = rows.groupBy((F.floor(F.unix_timestamp("ts") / 300) * 300).alias("start"), "ja3").agg(F.count(F.lit(1)).alias("velocity"), F.countDistinct("account").alias("fanout"))
    assert got.count() == want.count() == 2000 and got.exceptAll(want).isEmpty()


def test_sliding_totals_keep_one_row_per_hour_and_expand_when_read(spark, small, monkeypatch):
    from sluice.plans import streams

    kept, read = [], T.latest_per_key
    monkeypatch.setattr(T, "latest_per_key", lambda s, folder, keys, name="data": (kept.append(s.read.parquet(f"{folder}/{name}").count()), read(s, folder, keys, name))[1])
    found = {(r["start"], r["account"]): (r["n"], r["total"]) for r in streams.stream_sliding_totals(spark, small).collect()}
    t = A.transfers(spark, small).select(F.floor(F.col("epoch") / 3600).alias("h"), F.col("src").alias("account"), "amount")
    assert kept == [t.select("h", "account").distinct().count()]
    want = t.select(F.explode(F.sequence(F.col("h") - 23, F.col("h"))).alias("h"), "account", "amount").groupBy("h", "account").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("t"))
    assert found == {(r["h"] * 3600, r["account"]): (r["n"], pytest.approx(r["t"])) for r in want.collect()}


def test_slices_are_written_by_several_tasks_and_arrive_one_a_batch(spark, small, tmp_path, monkeypatch):
    from pathlib import Path

    monkeypatch.setattr(T, "FILE_ROWS", 50, raising=False)
    rows = T.sliced_events(spark, small, str(tmp_path))
    n = len(list(Path(tmp_path, "events").glob("*.parquet")))
    assert n > 4 and n % 4 == 0
    T.drain(rows.select("event_id"), str(tmp_path), each=T.batch_writer(str(tmp_path)))
    got = spark.read.parquet(f"{tmp_path}/data").groupBy("batch").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.count("*").alias("n")).orderBy("batch").collect()
    assert len(got) == 4
    assert all(a["hi"] < b["lo"] for a, b in zip(got, got[1:]))
    assert sum(r["n"] for r in got) == A.table(spark, small, "events").count()
