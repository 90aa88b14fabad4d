from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import evaluation, graph
from sluice.sources import adapters as A


def edges(spark, pairs, amount=1.0):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in [(*p, amount)[:3] for p in pairs]], "src bigint, dst bigint, amount double")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "account bigint")


def random_pairs(n, m, seed):
    rng = np.random.default_rng(seed)
    return sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b})


def test_pagerank_converges_to_the_fixed_point(spark):
    pairs = random_pairs(12, 30, 4)
    got = {r.account: r.pagerank for r in graph.pagerank(nodes(spark, range(12)), graph.pair_weights(edges(spark, pairs))).collect()}
    m = np.zeros((12, 12))
    for a, b in pairs:
        m[b, a] = 1
    out = m.sum(axis=0)
    m = np.where(out > 0, m / np.maximum(out, 1), 1 / 12)
    p = np.full(12, 1 / 12)
    for _ in range(300):
        p = 0.15 / 12 + 0.85 * m @ p
    assert sum(got.values()) == pytest.approx(1.0)
    assert all(got[i] == pytest.approx(p[i], abs=2e-5) for i in range(12))


def brute_betweenness(n, pairs):
    adj = {i: [b for a, b in pairs if a == i] for i in range(n)}
    score = np.zeros(n)
    for s in range(n):
        dist, paths, order, queue = {s: 0}, {s: 1.0}, [], [s]
        while queue:
            v = queue.pop(0)
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    paths[w] = 0.0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        dep = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for w in adj[v]:
                if dist.get(w) == dist[v] + 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if v != s:
                score[v] += dep[v]
    return score / ((n - 1) * (n - 2))


def test_betweenness_with_all_pivots_is_exact(spark):
    pairs = random_pairs(10, 22, 5)
    links = edges(spark, pairs).select(F.col("src").alias("account"), F.col("dst").alias("peer")).distinct()
    got = {r.account: r.betweenness for r in graph.betweenness(nodes(spark, range(10)), links, pivots=10).collect()}
    want = brute_betweenness(10, pairs)
    assert all(got[i] == pytest.approx(want[i]) for i in range(10))


@pytest.mark.parametrize("hot", [1, 2, 4, 100])
def test_recipient_jaccard_is_exact_for_any_hot_limit(spark, hot):
    pairs = random_pairs(14, 60, 6)
    sets = {}
    for a, b in pairs:
        sets.setdefault(a, set()).add(b)
    want = {a: max([len(s & t) / len(s | t) for b, t in sets.items() if b != a and s & t], default=0.0) for a, s in sets.items()}
    got = {r.account: r.recipient_jaccard_max for r in graph.recipient_jaccard(edges(spark, pairs), hot=hot).collect()}
    assert got == pytest.approx(want)


def test_cycles_are_complete(spark):
    pairs = random_pairs(8, 26, 7)
    have = set(pairs)
    want = set()
    for size in range(3, 7):
        for group in combinations(range(8), size):
            first, rest = group[0], group[1:]
            if any(all((a, b) in have for a, b in zip((first, *p), (*p, first))) for p in permutations(rest)):
                want.add(group)
    e = edges(spark, pairs).withColumn("g", F.lit(1))
    got = {tuple(r.nodes) for r in graph.cycles(e, ["g"]).collect()}
    assert got == want


def test_ring_volume_keeps_the_largest_order(spark):
    e = edges(spark, [(1, 2, 10), (2, 3, 10), (3, 1, 10), (1, 3, 50), (3, 2, 50), (2, 1, 50)]).withColumn("g", F.lit(0))
    rows = graph.cycles(e, ["g"]).collect()
    assert [(tuple(r.nodes), r.volume) for r in rows] == [((1, 2, 3), 150.0)]
    shape = graph.ring_shapes(graph.cycles(e, ["g"]), e, ["g"]).first()
    assert (shape.shape, shape.hub) == ("STAR", 1)


def test_components_on_a_long_path(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(60, 61)], "a bigint, b bigint")
    got = {r.account: r.community for r in graph.components(nodes(spark, [*range(41), 60, 61, 70]), pairs).collect()}
    assert {got[i] for i in range(41)} == {0} and got[61] == 60 and got[70] == 70


def test_label_propagation_finds_two_cliques(spark):
    one = [(a, b, 5.0) for a, b in combinations(range(5), 2)]
    two = [(a, b, 5.0) for a, b in combinations(range(10, 15), 2)]
    w = spark.createDataFrame([*one, *two, (4, 10, 0.1)], "a bigint, b bigint, weight double")
    members = graph.label_propagation(nodes(spark, [*range(5), *range(10, 15)]), w)
    got = {r.account: r.community for r in members.collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]
    assert graph.modularity(members, w).first().modularity > 0.4
    truth = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in [*range(5), *range(10, 15)]], "account bigint, ring string")
    assert evaluation.adjusted_rand(members, truth).first().ari == pytest.approx(1.0)


def test_decay_taint_uses_the_nearest_other_seed(spark):
    chain = edges(spark, [(i, i + 1, 1) for i in range(8)])
    seeds = nodes(spark, [0, 2])
    got = {r.account: r.taint for r in graph.decay_taint(seeds, chain).collect()}
    assert got[1] == 55.0 and got[3] == 55.0 and got[0] == got[2] == 34.1
    assert got[6] == round(55 * 0.62**3, 2) and 7 not in got


def test_cross_bank_hops_follow_first_parents(spark):
    parents = spark.createDataFrame([(1, i + 1, i) for i in range(20)] + [(1, 50, 49)], "incident bigint, account bigint, parent bigint")
    acc = spark.createDataFrame([(i, i % 2 if i < 10 else 0) for i in range(60)], "account bigint, bank int")
    victims = spark.createDataFrame([(1, 0)], "incident bigint, victim bigint")
    got = {r.account: r.crossings for r in graph.cross_bank_hops(parents, acc, victims).collect()}
    assert got[0] == 0 and got[9] == 9 and got[20] == 10 and got[50] == 0


def test_hops_and_unreachable(spark):
    links = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 3)], "g int, account bigint, peer bigint")
    n = spark.createDataFrame([(1, i) for i in range(4)] + [(2, 3)], "g int, account bigint")
    start = spark.createDataFrame([(1, 0), (2, 0)], "g int, account bigint")
    got = {(r.g, r.account): r.hops_from_victim for r in graph.hops_from(n, links, start, ["g"]).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 1.0, (1, 2): 2.0, (1, 3): 99.0, (2, 3): 1.0}


def test_bridge_is_the_member_all_paths_need(spark):
    # 3 <-> 2 <-> 1 with a shortcut back, hub by out-degree tie goes to the smaller id
    e = edges(spark, [(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3), (4, 1), (1, 4), (5, 1), (1, 5), (5, 2), (2, 5)]).withColumn("g", F.lit(0))
    rings = graph.cycles(e, ["g"])
    shapes = graph.ring_shapes(rings, e, ["g"])
    roles = graph.ring_roles(rings, shapes, e, ["g"])
    assert roles.groupBy("ring").agg(F.count_if(F.col("role") == "HUB").alias("h")).where("h <> 1").isEmpty()
    path = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 2), (1, 3)]).withColumn("g", F.lit(0))
    rings = graph.cycles(path, ["g"])
    got = {r.account: r.role for r in graph.ring_roles(rings, graph.ring_shapes(rings, path, ["g"]), path, ["g"]).collect()}
    # only 2 -> 1 has no direct edge and needs 3; 1 is the hub of the tie
    assert got == {1: "HUB", 2: "MULE", 3: "BRIDGE"}


def all_cycles(links, longest):
    """Node sets of directed simple cycles with their largest volume, by search."""
    follow = {}
    for (a, b), w in links.items():
        follow.setdefault(a, []).append((b, w))
    out = {}

    def walk(first, at, path, volume):
        for b, w in follow.get(at, ()):
            if b == first and len(path) >= 3:
                key = tuple(sorted(path))
                out[key] = max(out.get(key, 0.0), volume + w)
            if b > first and b not in path and len(path) < longest:
                walk(first, b, [*path, b], volume + w)

    for first in follow:
        walk(first, first, [first], 0.0)
    return {k: round(v, 2) for k, v in out.items()}


@pytest.mark.parametrize("seed, nodes, count", [(1, 12, 30), (2, 30, 60), (3, 9, 40), (4, 40, 45)])
def test_meeting_cycles_against_search(spark, seed, nodes, count):
    import random

    pick = random.Random(seed)
    rows = [(pick.randrange(nodes), pick.randrange(nodes), float(pick.randrange(1, 100))) for _ in range(count)]
    rows = [r for r in rows if r[0] != r[1]]
    links = {}
    for a, b, w in rows:
        links[a, b] = links.get((a, b), 0.0) + w
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, amount double")
    for longest in (3, 5, 6):
        got = {tuple(r.nodes): r.volume for r in graph.meeting_cycles(edges, longest).collect()}
        assert got == all_cycles(links, longest)
    kept = {(r.src, r.dst) for r in graph.cyclic_part(graph.pair_weights(edges)).collect()}
    on_cycles = all_cycles(links, nodes)
    assert kept >= {(a, b) for a, b in links for c in on_cycles if a in c and b in c and (a, b) in links and len(c) == 3}


def test_neighbourhood_masks_beyond_one_block(spark):
    import random

    pick = random.Random(7)
    rows = [(pick.randrange(150), pick.randrange(150), 1.0) for _ in range(200)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, amount double")
    seeds = spark.createDataFrame([(i,) for i in range(0, 150)], "seed bigint")
    near = {}
    for a, b, _ in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for seed in range(150):
        level, seen = {seed}, {seed: 0}
        for h in range(1, 4):
            level = {y for x in level for y in near.get(x, ())} - seen.keys()
            seen |= {y: h for y in level}
        want |= {(seed, a): h for a, h in seen.items()}
    reach, inside = graph.neighbourhood(seeds, edges, 3)
    assert {(r.seed, r.account): r.hops for r in reach.collect()} == want
    pairs = {(a, b) for a, b, _ in rows}
    expect = {(h, s, a, b) for s in range(150) for a, b in pairs for h in (1, 2, 3) if want.get((s, a), 9) <= h and want.get((s, b), 9) <= h}
    assert {(r.hops, r.seed, r.src, r.dst) for r in inside.collect()} == expect


def test_hops_cross_midnight_and_leave_the_candidates(spark, small):
    """Every account known by a day has its row, over links of all earlier days."""
    from sluice.plans import catalog

    got = catalog.RUN["hops_from_victim"](spark, small)
    t = A.transfers(spark, small).withColumn("day", F.floor(F.col("epoch") / 86400))
    seen = t.select("day", F.col("src").alias("account")).union(t.select("day", "dst")).distinct()
    assert seen.join(got, ["day", "account"], "left_anti").isEmpty()
    far = got.where("hops_from_victim BETWEEN 1 AND 98")
    alone = t.select("day", F.col("dst").alias("account")).distinct()
    assert not far.join(alone, ["day", "account"], "left_anti").isEmpty()


@pytest.mark.parametrize("rounds", [0, 1])
def test_labels_that_swap_settle(spark, rounds):
    """Nodes left swapping by the halves come to rest at labels no neighbourhood outvotes."""
    pairs = random_pairs(60, 140, 4)
    both = {(min(p), max(p)) for p in pairs}
    w = spark.createDataFrame([(a, b, 1.0) for a, b in both], "a bigint, b bigint, weight double")
    label = {r.account: r.community for r in graph.label_propagation(nodes(spark, range(60)), w, rounds).collect()}
    assert len(label) == 60
    for v in label:
        votes = {}
        for a, b in both:
            if v in (a, b):
                other = label[b if v == a else a]
                votes[other] = votes.get(other, 0) + 1
        assert not votes or votes.get(label[v], 0) == max(votes.values())


def test_overlap_keeps_recipients_as_lists_per_range(spark, monkeypatch):
    from sluice.operators import sets

    pick = np.random.default_rng(4)
    paid = {a: {int(d) for d in pick.integers(0, 3 * sets.SPAN, 40)} | set(range(sets.SPAN - 3, sets.SPAN + a % 4)) for a in range(12)}
    edges = spark.createDataFrame([(a, d) for a, ds in paid.items() for d in ds for _ in range(2)], "src bigint, dst bigint")
    pairs = spark.createDataFrame([(a, b) for a in paid for b in paid if a != b] + [(0, 99)], "account bigint, peer bigint")
    cut, kept = sets.cut, []
    monkeypatch.setattr(sets, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = {(r.account, r.peer): r.jaccard for r in sets.overlap(edges, pairs).collect()}
    assert got == pytest.approx({(a, b): len(paid[a] & paid[b]) / len(paid[a] | paid[b]) for a in paid for b in paid if a != b})
    assert kept[0].count() == 3 * len(paid) < edges.count() / 10
