"""Tracing, planning and replay against slow references on small graphs."""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions.scores import ACTIONS, ALLOW, CEILING, EFFECT, HARM, LEAST_ACTIVITY
from sluice.operators import interdict, replay, rollouts, trace

TX = "txn_id bigint, src bigint, dst bigint, amount double, epoch bigint, channel string"
INC = "incident bigint, victim bigint, amount double, t0 bigint, delay bigint, complaint bigint, horizon bigint"
EXITS = {7, 8}


def world(spark, seed, n=12, m=160, span=7000, grain=50):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(m):
        a, b = rng.integers(0, n, 2)
        if a != b:
            # coarse seconds force ties
            rows.append((i, int(a), int(b), float(rng.integers(200, 60_000)), int(rng.integers(0, span) // grain * grain), "UPI"))
    inc = [(100 + v, v, 40_000.0 + v, 0, 40, 2400, 7200) for v in (0, 1, 2)]
    ex = spark.createDataFrame([(e, "atm") for e in EXITS], "account bigint, exit_kind string")
    return rows, spark.createDataFrame(rows, TX), spark.createDataFrame(inc, INC), inc, ex


def slow_trace(rows, victim, amount, t0, until):
    held, through, since = {victim: amount}, {victim: amount}, {victim: t0}
    left, gone, flows = sorted((r for r in rows if t0 <= r[4] <= until), key=lambda r: (r[4], r[1], r[0])), 0.0, []
    used, clock = set(), t0
    while True:
        ready = [r for r in left if r[0] not in used and r[1] in since and r[4] >= since[r[1]] and r[4] >= clock]
        if not ready:
            return held, through, gone, flows
        r = min(ready, key=lambda r: (r[4], r[1], r[0]))
        used.add(r[0])
        clock = r[4]
        txn, src, dst, size, when, _ = r
        have = held.get(src, 0.0)
        inflow = sum(q[3] for q in rows if q[2] == src and t0 <= q[4] <= when) + (amount if src == victim else 0.0)
        base = max(inflow, through[src], have)
        share = min(1.0, through[src] / base)
        moved = min(have, size * share)
        if have <= 250 or share < 0.02 or moved <= 250:
            continue
        held[src] = have - moved
        flows.append((txn, round(moved, 4)))
        if dst in EXITS:
            gone += moved
            continue
        held[dst] = held.get(dst, 0.0) + moved
        through[dst] = through.get(dst, 0.0) + moved
        since.setdefault(dst, when)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trace_matches_the_slow_reference(spark, seed):
    rows, tx, inc_df, inc, ex = world(spark, seed)
    flows = trace.taint_flows(inc_df, tx, ex, "horizon")
    got = flows.toPandas()
    held = trace.taint_accounts(inc_df, flows).toPandas()
    summary = {r.incident: r for r in trace.taint_summary(inc_df, flows).collect()}
    for i, victim, amount, t0, _, _, horizon in inc:
        want_held, want_through, gone, want = slow_trace(rows, victim, amount, t0, horizon)
        mine = sorted((int(r.txn_id), round(r.tainted, 4)) for r in got[got.incident == i].itertuples())
        assert mine == sorted(want)
        h = held[held.incident == i].set_index("account")
        assert all(h.held[a] == pytest.approx(v, abs=0.01) for a, v in want_held.items())
        assert all(h.through[a] == pytest.approx(v, abs=0.01) for a, v in want_through.items())
        assert summary[i].held + summary[i].exited == pytest.approx(amount, abs=1)
        assert summary[i].exited == pytest.approx(gone, abs=0.01)


def test_trace_does_not_depend_on_partitions(spark):
    _, tx, inc, _, ex = world(spark, 4)
    read = lambda: sorted((r.incident, r.txn_id, round(r.tainted, 6)) for r in trace.taint_flows(inc, tx.repartition(7), ex).collect())
    one = read()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    two = read()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == two and one


def test_complaint_view_is_a_prefix_of_the_horizon(spark):
    _, tx, inc, _, ex = world(spark, 5)
    key = lambda until: {(r.incident, r.txn_id) for r in trace.taint_flows(inc, tx, ex, until).collect()}
    assert key("complaint") <= key("horizon")


def test_reach_is_time_respecting(spark):
    tx = spark.createDataFrame([(1, 0, 1, 9.0, 100, ""), (2, 1, 2, 9.0, 50, ""), (3, 1, 3, 9.0, 100, ""), (4, 3, 4, 9.0, 9000, "")], TX)
    start = spark.createDataFrame([(1, 0, 0, 7200)], "run bigint, account bigint, arrival bigint, until bigint")
    got = {r.account: (r.arrival, r.depth) for r in trace.reach(start, tx).collect()}
    assert got == {0: (0, 0), 1: (100, 1), 3: (100, 2)}


def test_frontier_limit_fills_lowest_ids_first(spark):
    tx = spark.createDataFrame([(i, 0, 10 + i, 1.0, 1, "") for i in range(6)] + [(9, 10, 30, 1.0, 1, ""), (10, 0, 7, 1.0, 1, "")], TX)
    ex = spark.createDataFrame([(7,)], "account bigint")
    start = spark.createDataFrame([(1, 0)], "incident bigint, account bigint")
    cut = spark.createDataFrame([(1, 5)], "incident bigint, until bigint")
    full = {r.account for r in trace.frontier(start, tx, ex, cut).collect()}
    assert full == {0, *range(10, 16), 30}
    few = trace.frontier(start, tx, ex, cut, limit=4).collect()
    assert {r.account for r in few} == {0, 10, 11, 12} and all(r.truncated for r in few)
    assert not any(r.truncated for r in trace.frontier(start, tx, ex, cut, limit=8).collect())


def test_frontier_packs_incidents_and_writes_no_row_per_account(spark, monkeypatch):
    """Several lists of incidents, cutoffs equal to a first payment, and exits that are not passed."""
    rng = np.random.default_rng(5)
    rows = [(i, int(a), int(b), 1.0, int(e), "") for i, (a, b, e) in enumerate(zip(rng.integers(0, 40, 160), rng.integers(0, 40, 160), rng.integers(0, 9000, 160))) if a != b]
    ex = {7, 32}
    starts = {n: (n % 40, rows[n % len(rows)][4] + n % 2) for n in range(70) if n % 40 not in ex}
    written, cut = [], trace.cut
    monkeypatch.setattr(trace, "cut", lambda df: written.append(cut(df)) or written[-1])
    monkeypatch.setattr(trace, "PART", 9, raising=False)
    got = trace.frontier(
        spark.createDataFrame([(n, a) for n, (a, _) in starts.items()], "incident bigint, account bigint"), spark.createDataFrame(rows, TX),
        spark.createDataFrame([(x,) for x in ex], "account bigint"), spark.createDataFrame([(n, u) for n, (_, u) in starts.items()], "incident bigint, until bigint"))
    want = set()
    for n, (a, until) in starts.items():
        seen = {a}
        for _ in range(3):
            seen |= {b for _, x, b, _, e, _ in rows if x in seen and e <= until and b not in ex}
        want |= {(n, x) for x in seen}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 2 * len(starts)
    assert all({"incident", "account"} - set(w.columns) for w in written)


def test_reach_follows_a_long_chain_to_its_end(spark):
    tx = spark.createDataFrame([(i, i, i + 1, 9.0, 10 * i, "") for i in range(60)], TX)
    start = spark.createDataFrame([(1, 0, 0, 7200)], "run bigint, account bigint, arrival bigint, until bigint")
    assert {r.account: r.depth for r in trace.reach(start, tx).collect()} == {i: i for i in range(61)}


def test_fold_keeps_large_ids(spark):
    big = 2**60 + 1
    debits = spark.createDataFrame([("r", 100, 7, 1, 8, 500.0, 1000.0, False, True, True, big, None, False, False, 5, 900), ("r", 200, big, 2, 9, 700.0, 500.0, False, False, False, None, None, None, None, None, 900)],
                                   "run string, epoch bigint, src bigint, pos bigint, dst bigint, amount double, inflow double, to_exit boolean, stopped boolean, rerouted boolean, alt1 bigint, alt2 bigint, exit1 boolean, exit2 boolean, delay bigint, until bigint")
    opening = spark.createDataFrame([("r", 7, 0, 1000.0, 1000.0)], "run string, account bigint, epoch bigint, held double, through double")
    got = {(r.kind, r.src, r.dst) for r in trace.ordered_fold(trace.as_events(debits, opening)).collect()}
    assert got == {("blocked", 7, 8), ("reroute_out", 7, big), ("reroute_in", 7, big), ("move", big, 9)}


def toy_hits(spark):
    hits = [(1, 5, 0, p, d, 0.9, 0.5, 10, 100.0 + p, 1.0) for p, d in ((0, 20), (1, 30), (2, 11))]
    hits += [(1, 6, 0, p, d, 0.6, 0.8, 10, 100.0 + p, 1.0) for p, d in ((1, 40), (2, 40))]
    hits += [(1, 9, 0, 3, 400, 0.4, 1.0, 10, 300.0, 0.0)]
    return spark.createDataFrame(hits, "incident bigint, account bigint, rollout int, parcel int, departs bigint, p double, weight double, told int, value double, out double")


def plan_value(hits, chosen):
    alive = {}
    for rank, (a, act) in enumerate(chosen):
        at = 10 + int(np.ceil((rank // 4 + 1) * 1.5))
        for h in hits:
            if h.account == a and h.departs >= at:
                alive[h.parcel] = alive.get(h.parcel, 1.0) * (1 - EFFECT[act])
    parcels = {h.parcel: (h.value, h.out) for h in hits}
    return sum(v * (o + 0.2) * (1 - alive.get(p, 1.0)) for p, (v, o) in parcels.items())


def test_greedy_respects_budget_and_is_near_the_best_plan(spark):
    df = toy_hits(spark)
    hits = df.collect()
    grid = [(2, 0.05), (2, 0.2), (3, 5.0)]
    plans = interdict.greedy_plans(df, 1, grid)
    steps, bound = interdict.plan_steps(plans).collect(), {(r.k, r.budget): r for r in interdict.coverage_bound(plans).collect()}
    options = [(5, a) for a in ACTIONS] + [(6, a) for a in ACTIONS[1:]] + [(9, ACTIONS[2])]
    facts = {5: (0.9, 0.5), 6: (0.6, 0.8), 9: (0.4, 1.0)}
    cost = lambda a, act: (1 - min(facts[a][0], 0.97)) * max(facts[a][1], 0.05) * HARM[act]
    for k, budget in grid:
        mine = sorted((r for r in steps if (r.k, r.budget) == (k, budget)), key=lambda r: r["rank"])
        assert len(mine) <= k and sum(r.cost for r in mine) <= budget + 1e-9 and len({r.account for r in mine}) == len(mine)
        value = plan_value(hits, [(r.account, r.action) for r in mine])
        assert value == pytest.approx(bound[(k, budget)].achieved)
        best = 0.0
        for size in range(1, k + 1):
            for group in combinations(options, size):
                if len({a for a, _ in group}) == size and sum(cost(*g) for g in group) <= budget:
                    best = max(best, plan_value(hits, group))
        assert value >= best * (1 - 1 / np.e) - 1e-9
        assert best <= bound[(k, budget)].bound + 1e-6


def test_bound_holds_on_random_cases(spark):
    """No plan of K steps, of any actions in any order, is worth more than the bound."""
    pick, rows, facts = np.random.default_rng(5), [], {}
    for case in range(12):
        n = 2 if case == 0 else int(pick.integers(2, 4))
        for a in range(n):
            p, w = (0.8, 2.5 - a / 2) if case == 0 else (float(pick.uniform(0.3, 0.97)), float(pick.uniform(0.1, 3)))
            facts[case, a] = p, w
            for parcel in [(a, 100.0 - a)] if case == 0 else [(int(k), 50.0 + 10 * k) for k in pick.choice(5, 3, replace=False).tolist()]:
                rows.append((case, a, 0, int(parcel[0]), int(pick.integers(11, 40)) if case else 400, p, w, 10, float(parcel[1]), 1.0))
    df = spark.createDataFrame(rows, "incident bigint, account bigint, rollout int, parcel int, departs bigint, p double, weight double, told int, value double, out double")
    hits = df.collect()
    grid = [(1, 0.5), (2, 0.5), (3, 9.0)]
    for r in interdict.coverage_bound(interdict.greedy_plans(df, 1, grid)).collect():
        mine = [h for h in hits if h.incident == r.incident]
        options = [(a, act) for (c, a), (p, _) in facts.items() if c == r.incident for act, floor in ALLOW if p >= floor]
        cost = lambda a, act: (1 - min(facts[r.incident, a][0], CEILING)) * max(facts[r.incident, a][1], LEAST_ACTIVITY) * HARM[act]
        for size in range(1, r.k + 1):
            for group in permutations(options, size):
                if len({a for a, _ in group}) == size and sum(cost(*g) for g in group) <= r.budget:
                    assert plan_value(mine, group) <= r.bound + 1e-6


def test_marginal_recovery_holds_the_others_fixed(spark):
    df = toy_hits(spark)
    index = df.select("incident", "account", "rollout", "parcel", "departs")
    ends = df.select("incident", "rollout", "parcel", "value", (F.col("out") == 1).alias("exited")).distinct()
    plan = spark.createDataFrame([(1, 5, 12), (1, 6, 12)], "incident bigint, account bigint, issue_at_minute bigint")
    got = {r.account: r for r in interdict.marginal_recovery(index, ends, plan, 1).collect()}
    assert got[5].saved_0 == round(1.2 * 0.98 * (100 + 101 * 0.02), 2)
    assert got[6].saved_0 == round(1.2 * 0.98 * (101 * 0.02 + 102), 2) and got[6].saved_30 == 0.0


def test_rollouts_follow_weights_and_conserve_value(spark):
    held = spark.createDataFrame([(1, 0, 3000.0, 10), (1, 1, 1000.0, 10), (1, 2, 100.0, 10)], "incident bigint, account bigint, held double, complaint_minute int")
    weights = spark.createDataFrame([(1, 0, 20, 3.0), (1, 0, 21, 1.0)], "incident bigint, account bigint, dst bigint, weight double")
    cells, sizes = rollouts.weighted_cells(weights, ["incident", "account"], "dst")
    facts = spark.createDataFrame([(1, 0, 1.0, 5.0, 1.0, 0.0, 2)], "incident bigint, account bigint, forward_prob double, delay_minutes double, delay_spread double, exit_share double, choices bigint")
    hops, ends = rollouts.run_rollouts(held, facts, cells, rollouts=10, parcels=80)
    assert ends.agg(F.sum("value")).first()[0] == pytest.approx(10 * 4000.0)
    assert ends.where("exited").count() == 0
    # a parcel that is stuck rests twice in its account, so parcels are counted and not rows
    start = hops.where("account IN (0, 1)").groupBy("account").agg(F.countDistinct("rollout", "parcel").alias("n")).collect()
    share = {r.account: r.n for r in start}
    assert 540 < share[0] < 660 and share[0] + share[1] == 800
    went = {r.account: r.n for r in hops.where("account >= 20").groupBy("account").agg(F.countDistinct("rollout", "parcel").alias("n")).collect()}
    assert went[20] + went[21] == share[0] and 0.68 < went[20] / share[0] < 0.82
    again = rollouts.run_rollouts(held.repartition(3), facts, cells, rollouts=10, parcels=80)[0]
    assert again.exceptAll(hops).isEmpty()


def run_replay(spark, seed, policies):
    rows, tx, inc_df, inc, ex = world(spark, seed, span=7000)
    flows = trace.taint_flows(inc_df, tx, ex)
    touched = trace.taint_accounts(inc_df, flows)
    gone = flows.where("to_exit").groupBy("incident").agg(F.sum("tainted").alias("exited"))
    runs = [(f"{i[0]}|{name}", i[0], name, p) for i in inc for name, _, p in policies]
    freezes = [(f"{i[0]}|{name}", i[0], a, 40, e) for i in inc for name, acts, _ in policies for a, e in acts]
    r = spark.createDataFrame(runs, "run string, incident bigint, policy string, reroute double")
    f = spark.createDataFrame(freezes, "run string, incident bigint, account bigint, issue_at_minute bigint, effectiveness double")
    labels = spark.createDataFrame([(3, True)], "account bigint, is_mule boolean")
    moves = replay.replay_moves(inc_df, touched, tx, ex, f, r)
    res = replay.replay_results(inc_df, touched, gone, moves, f, r, ex, labels)
    return inc_df, tx, ex, res, moves


@pytest.mark.parametrize("seed", [1, 6])
def test_replay_conserves_money_and_matches_the_trace_without_freezes(spark, seed):
    everyone = [(a, 1.0) for a in range(12) if a not in EXITS]
    half = [(a, 1.0) for a in range(5)]
    policies = [("none", [], 0.0), ("all", everyone, 0.0), ("half", half, 0.0), ("adaptive", half, 1.0)]
    inc, tx, ex, res, moves = run_replay(spark, seed, policies)
    rows = res.collect()
    assert all(r.accounted == pytest.approx(r.amount, abs=1) for r in rows)
    by = {(r.incident, r.policy): r for r in rows}
    full = {r.incident: r.exited for r in trace.taint_summary(inc, trace.taint_flows(inc, tx, ex, "horizon")).collect()}
    for i in full:
        assert by[(i, "none")].leaked == pytest.approx(full[i], abs=1)
        assert by[(i, "all")].leaked == by[(i, "all")].already_gone and by[(i, "all")].residual == 0
        assert by[(i, "half")].leaked <= by[(i, "none")].leaked + 1e-6
        assert by[(i, "adaptive")].recovered <= by[(i, "half")].recovered + 1e-6
    assert sum(r.rerouted for r in rows if r.policy == "adaptive") > 0
    assert all(r.frozen == 10 and r.mules == 1 and r.innocent == 9 for r in rows if r.policy == "all")
