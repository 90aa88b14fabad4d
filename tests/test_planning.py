from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluice.operators import detectors as D
from sluice.operators import features as X
from sluice.operators import filters, flows
from sluice.operators import rollouts as M
from sluice.plans import planning, scoring
from sluice.plans import stages as S
from sluice.sources import adapters as A


def test_registered_rollouts_are_the_whole_number():
    assert (planning.N_ROLLOUTS, planning.N_PARCELS) == (M.ROLLOUTS, M.PARCELS) == (200, 240)


def test_delay_sweep_replays_the_greedy_plan(spark, small, monkeypatch):
    monkeypatch.setattr(planning, "N_ROLLOUTS", 2)
    monkeypatch.setattr(planning, "N_PARCELS", 8)
    frozen = []
    moves = planning.Y.replay_moves
    monkeypatch.setattr(planning.Y, "replay_moves", lambda inc, held, t, ex, freezes, runs: frozen.append(freezes) or moves(inc, held, t, ex, freezes, runs))
    S.forget()
    rows = planning.delay_sweep(spark, small).collect()
    told = {r.incident: r.delay for r in planning.swept(spark, small)[0].select("incident", "delay").collect()}
    S.forget()
    assert {r.policy for r in rows} == {"named_account_only", "greedy_frontier"}
    by = {(r.policy, r.delay): r for r in rows}
    delays = {r.delay for r in rows}
    assert len(by) == len(rows) == 2 * len(delays)
    assert all(by[p, d].incidents == by["named_account_only", d].incidents for p, d in by)
    # plans of every delay are replayed
    done = {r.run.split("|")[1] for r in frozen[0].select("run").distinct().collect()}
    assert done == {"named_account_only", "greedy_frontier"}
    greedy = frozen[0].where("run LIKE '%greedy_frontier'").select("incident").distinct().collect()
    assert {told[r.incident] for r in greedy} == delays


def test_tree_detector_trains_default_trees_on_all_features(spark, small, monkeypatch):
    seen = {}

    def train(rows, names, trees=40, depth=5, seed=7):
        seen.update(names=list(names), trees=trees, depth=depth)
        return lambda r: r

    monkeypatch.setattr(D, "train_trees", train)
    wide = spark.createDataFrame([(1, 2, 0.0, *[0.0] * len(X.FEATURES))], ["incident", "account", "label", *X.FEATURES])
    asked = {}
    monkeypatch.setattr(scoring.X, "build_matrix", lambda *a, graph=True: asked.update(graph=graph) or wide.drop("label"))
    S.forget()
    scoring.tree_detector(spark, small)
    S.forget()
    assert asked == {"graph": True} and seen == {"names": list(X.FEATURES), "trees": 40, "depth": 5}


def test_activity_as_of_a_moment_equals_the_visible_transfers(spark, small):
    """Running totals looked up give what each incident's own transfers give."""
    inc, t = A.incidents(spark, small), A.transfers(spark, small)
    until = inc.select("incident", F.col("complaint").alias("until"))
    pool = A.accounts(spark, small).select("account").crossJoin(inc.select("incident"))
    got = flows.activity_at(pool.join(until, "incident"), t).select("incident", "account", "in_degree", F.round("log_total_out", 9).alias("o"))
    seen = filters.visible_edges(t, pool, until)
    want = pool.join(flows.flow_aggregate(seen, ["incident"]), ["incident", "account"], "left").fillna(0, ["in_degree", "log_total_out"]).select("incident", "account", "in_degree", F.round("log_total_out", 9).alias("o"))
    assert got.count() == pool.count() and got.exceptAll(want).isEmpty() and not want.where("in_degree > 1").isEmpty()


def test_rollouts_as_known_equal_those_over_tables_and_write_moving_parcels_only(spark, small, monkeypatch):
    inc, t, ex = A.incidents(spark, small), A.transfers(spark, small), A.exits(spark, small)
    S.forget()
    pool, until = S.frontier(spark, small), inc.selectExpr("incident", "complaint AS until")
    held = S.touched(spark, small).join(inc.selectExpr("incident", "delay AS complaint_minute"), "incident")
    S.forget()
    facts, cells = M.behaviour_tables(filters.visible_edges(t, pool, until), ex, pool)
    hops, ends = M.run_rollouts(held, facts, cells, 4, 60)
    cut, written = M.cut, []
    monkeypatch.setattr(M, "cut", lambda df: written.append(cut(df)) or written[-1])
    rests, left = M.known_rollouts(held, until, t, ex, pool, 3, 4, 60)
    rests, left = cut(rests), cut(left)
    got = rests.select(hops.columns)
    assert got.exceptAll(hops).isEmpty() and hops.exceptAll(got).isEmpty()
    first, index = M.first_rests(rests), M.blocking_index(hops)
    assert first.exceptAll(index).isEmpty() and first.count() == index.count()
    same = left.join(ends.selectExpr("incident", "rollout", "parcel", "value AS v", "exited AS e"), ["incident", "rollout", "parcel"])
    assert same.where("e = exited AND abs(v - value) < 1e-6").count() == ends.count() == left.count() > 0
    leak = {r.incident: r.expected_leak for r in M.expected_leak(ends, 4).collect()}
    assert {r.incident: r.expected_leak for r in M.expected_leak(rests, 4).collect()} == pytest.approx(leak) and sum(leak.values()) > 0
    # a parcel that rests once or twice is not written
    parcels = [w for w in written if {"code", "codes", "rollout"} & set(w.columns)]
    assert parcels and sum(w.count() for w in parcels) < hops.count() / 4
