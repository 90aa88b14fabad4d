"""Iterative graph operators as joins keyed by incident or graph id.

Loops run until nothing changes, unless a caller asks for a number of rounds. A round
writes its small state to the reliable checkpoint folder, so plans stay short and a lost executor recomputes one
round, not the chain.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut
from .joins import common_payees, payee_sets
from .ranking import top_ranked

UNREACHABLE = 99.0


def pair_weights(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One directed edge per pair with its summed amount."""
    return edges.groupBy(*keys, "src", "dst").agg(F.sum("amount").alias("weight"))


def undirected(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    a = edges.select(*keys, F.col("src").alias("account"), F.col("dst").alias("peer"))
    b = edges.select(*keys, F.col("dst").alias("account"), F.col("src").alias("peer"))
    return a.unionByName(b).where("account <> peer").distinct()


def breadth_first(start: DataFrame, links: DataFrame, keys: Sequence[str], depth: int | None, link_keys: Sequence[str] | None = None, usable: Column | None = None) -> DataFrame:
    """Fewest hops from the start accounts of each key along ``links`` (account -> peer).

    ``links`` may be shared by all keys (``link_keys=[]``) or carry them; ``usable`` tells
    which of the shared links a key may take. Only the newest frontier is joined each
    round; ``depth=None`` runs until nothing is new.
    """
    keys = list(keys)
    on = [*(keys if link_keys is None else link_keys), "account"]
    seen = cut(start.select(*keys, "account").distinct().withColumn("hops", F.lit(0)))
    frontier, level = seen, 0
    while depth is None or level < depth:
        level += 1
        step = frontier.join(links, on)
        if usable is not None:
            step = step.where(usable)
        step = step.select(*keys, F.col("peer").alias("account")).distinct()
        new = cut(step.join(seen, [*keys, "account"], "left_anti").withColumn("hops", F.lit(level)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        if level % 4 == 0:
            seen = cut(seen)
        frontier = new
    return seen


def hops_from(nodes: DataFrame, links: DataFrame, starts: DataFrame, keys: Sequence[str], out: str = "hops_from_victim", depth: int | None = None, link_keys: Sequence[str] | None = None, usable: Column | None = None) -> DataFrame:
    """Directed hops from the start accounts inside each key's graph, 99 where unreachable.

    ``nodes`` and ``starts``: keys, account. ``links``: keys, account, peer, or shared as in ``breadth_first``.
    """
    keys = list(keys)
    found = breadth_first(starts, links, keys, depth, link_keys, usable)
    return nodes.join(found, [*keys, "account"], "left").select(*keys, "account", F.coalesce(F.col("hops").cast("double"), F.lit(UNREACHABLE)).alias(out))


def hops_to_exit(nodes: DataFrame, links: DataFrame, payers: DataFrame, keys: Sequence[str], depth: int = 12) -> DataFrame:
    """Hops back from the accounts that pay an exit directly (0)."""
    back = links.select(*keys, F.col("peer").alias("account"), F.col("account").alias("peer"))
    return hops_from(nodes, back, payers, keys, "hops_to_exit", depth)


def pagerank(nodes: DataFrame, weights: DataFrame, keys: Sequence[str] = (), alpha: float = 0.85, rounds: int | None = None, tolerance: float | None = 1e-6, every: int = 5) -> DataFrame:
    """Weighted PageRank per key with dangling mass spread evenly.

    Shares per edge are computed once. Each round is one join on the source and one
    aggregation on the target, both combined map-side; nodes carry a dangling mark, so
    their mass is a per-key sum. Convergence (L1 under n*tolerance for every key) is
    tested every few rounds. The state is read three times per round, so each round
    is checkpointed rather than chained. Rounds go on until all keys have converged;
    ``rounds`` with ``tolerance=None`` asks for that many instead.
    """
    if (rounds is None) == (tolerance is None):
        raise ValueError("give either a tolerance or a number of rounds")
    keys = list(keys)
    on = [*keys, "account"]
    total = weights.groupBy(*keys, "src").agg(F.sum("weight").alias("t"))
    shares = weights.join(total, [*keys, "src"]).select(*keys, F.col("src").alias("account"), "dst", (F.col("weight") / F.col("t")).alias("s"))
    shares = cut(shares)
    senders = total.where("t > 0").select(*keys, F.col("src").alias("account"), F.lit(False).alias("dangling"))
    sizes = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    attach = (lambda d: d.join(sizes, keys)) if keys else (lambda d: d.join(sizes))
    state = cut(attach(nodes.join(senders, on, "left").fillna(True, ["dangling"])).withColumn("rank", F.lit(1.0) / F.col("n")))
    for i in count(1) if rounds is None else range(1, rounds + 1):
        got = state.join(shares, on).groupBy(*keys, F.col("dst").alias("account")).agg(F.sum(F.col("rank") * F.col("s")).alias("got"))
        lost = state.groupBy(*keys).agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("lost"))
        base = state.join(lost, keys) if keys else state.join(lost)
        nxt = base.join(got, on, "left").select(
            *on, "n", "dangling", F.col("rank").alias("old"),
            (F.lit(1.0 - alpha) / F.col("n") + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))).alias("rank"),
        )
        nxt = cut(nxt)
        state = nxt.drop("old")
        if tolerance is not None and i % every == 0:
            open_ = nxt.groupBy(*keys, "n").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).where(F.col("d") >= F.col("n") * tolerance)
            if open_.isEmpty():
                break
    return state.select(*on, F.col("rank").alias("pagerank"))


def betweenness(nodes: DataFrame, links: DataFrame, keys: Sequence[str] = (), pivots: int = 64, seed: int = 7, max_depth: int | None = None) -> DataFrame:
    """Directed betweenness from seeded pivots of each key, scaled to all nodes and normalised.

    Shortest-path counts go out level by level from all pivots of all keys at once,
    dependencies come back the same way, until no level is new. ``max_depth`` is for
    graphs that are known to end there. ``links``: keys, account -> peer, distinct.
    """
    keys = list(keys)
    on, full = [*keys, "account"], [*keys, "pivot", "account"]
    start = top_ranked(nodes.select(*on), keys or [F.lit(0)], [F.md5(F.concat_ws("/", F.lit(seed), "account")), F.col("account")], pivots)
    seen = cut(start.select(*keys, F.col("account").alias("pivot"), "account", F.lit(0).alias("level"), F.lit(1.0).alias("paths")))
    frontier, levels = seen, [seen]
    for level in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(links, on).groupBy(*keys, "pivot", F.col("peer").alias("account")).agg(F.sum("paths").alias("paths"))
        new = cut(step.join(seen, full, "left_anti").select(*full, F.lit(level).alias("level"), "paths"))
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new)
        frontier = new
    later, merged = None, None
    for level in range(len(levels) - 1, 0, -1):
        here = levels[level].withColumn("dep", F.lit(0.0)) if later is None else levels[level].join(later, full, "left").fillna(0.0, ["dep"])
        here = cut(here)
        merged = here.select(*on, "dep") if merged is None else merged.unionByName(here.select(*on, "dep"))
        above = levels[level - 1].select(*full, F.col("paths").alias("up"))
        child = here.select(*keys, "pivot", F.col("account").alias("peer"), "paths", "dep")
        later = above.join(links, on).join(child, [*keys, "pivot", "peer"]).groupBy(*full).agg(
            F.sum(F.col("up") / F.col("paths") * (1 + F.col("dep"))).alias("dep")
        )
    if merged is None:
        return nodes.select(*on, F.lit(0.0).alias("betweenness"))
    sizes = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    scale = F.when(n > 2, n / F.least(n, F.lit(pivots)) / ((n - 1) * (n - 2))).otherwise(0.0)
    got = merged.groupBy(*on).agg(F.sum("dep").alias("dep"))
    rows = nodes.select(*on).join(got, on, "left").fillna(0.0, ["dep"])
    rows = rows.join(sizes, keys) if keys else rows.join(sizes)
    return rows.select(*on, (F.col("dep") * scale).alias("betweenness"))


def reciprocity(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Two-way partners over all partners, and over payees plus one."""
    keys = list(keys)
    out = edges.select(*keys, F.col("src").alias("account"), F.col("dst").alias("peer")).distinct().withColumn("o", F.lit(1))
    inn = edges.select(*keys, F.col("dst").alias("account"), F.col("src").alias("peer")).distinct().withColumn("i", F.lit(1))
    both = out.join(inn, [*keys, "account", "peer"], "full_outer").groupBy(*keys, "account").agg(
        F.count_if(F.col("o").isNotNull() & F.col("i").isNotNull()).alias("mutual"), F.count(F.lit(1)).alias("either"), F.count("o").alias("payees")
    )
    return both.select(
        *keys, "account", (F.col("mutual") / F.col("either")).alias("reciprocity"), (F.col("mutual") / (F.col("payees") + 1)).alias("reciprocity_score")
    )


def recipient_jaccard(edges: DataFrame, keys: Sequence[str] = (), hot: int = 500) -> DataFrame:
    """Largest Jaccard of an account's payees with any account sharing one, exactly.

    Payees with at most ``hot`` payers pair their payers. Busier payees would emit
    every pair, so for pairs that meet only there the best partner is found per
    pattern of hot payees: within a pattern the smallest payee set wins, and one
    spare is kept so an account never partners itself.
    """
    keys = list(keys)
    _, facts = payee_sets(edges, keys, hot)
    met = common_payees(edges, keys, hot)
    met = met.select(*keys, F.col("a").alias("account"), F.col("b").alias("peer"), "common").unionByName(
        met.select(*keys, F.col("b").alias("account"), F.col("a").alias("peer"), "common")
    )
    sized = lambda who, n: facts.select(*keys, F.col("account").alias(who), F.col("n").alias(n))
    direct = met.join(sized("account", "na"), [*keys, "account"]).join(sized("peer", "nb"), [*keys, "peer"]).select(
        *keys, "account", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("j")
    )
    # patterns: few, because hot payees are few; the two smallest members stand for each
    crowded = facts.where(F.size("hot") > 0)
    two = W.partitionBy(*keys, "hot").orderBy("n", "account")
    reps = crowded.withColumn("r", F.row_number().over(two)).where("r <= 2").select(*keys, F.col("account").alias("peer"), F.col("n").alias("nb"), F.col("hot").alias("hb"))
    shapes = crowded.select(*keys, "hot").distinct()
    per_payee = shapes.withColumn("d", F.explode("hot")).join(reps.withColumn("d", F.explode("hb")), [*keys, "d"])
    meet = per_payee.select(*keys, "hot", "peer", "nb", "hb").distinct().withColumn("h", F.array_size(F.array_intersect("hot", "hb")))
    # for one pattern and one overlap only the smallest partners can win
    tight = W.partitionBy(*keys, "hot", "h").orderBy("nb", "peer")
    meet = meet.withColumn("r", F.row_number().over(tight)).where("r <= 2").drop("r")
    remote = crowded.join(meet, [*keys, "hot"]).where("account <> peer").select(
        *keys, "account", (F.col("h") / (F.col("n") + F.col("nb") - F.col("h"))).alias("j")
    )
    best = direct.unionByName(remote).groupBy(*keys, "account").agg(F.max("j").alias("recipient_jaccard_max"))
    return facts.select(*keys, "account").join(best, [*keys, "account"], "left").fillna(0.0, ["recipient_jaccard_max"])


def same_window_openings(edges: DataFrame, accounts: DataFrame, keys: Sequence[str] = (), days: int = 21) -> DataFrame:
    """Distinct neighbours that opened within ``days`` of the account."""
    opened = lambda c, o: accounts.select(F.col("account").alias(c), F.col("open_day").alias(o))
    near = undirected(edges, keys).join(opened("account", "mine"), "account").join(opened("peer", "theirs"), "peer")
    return near.groupBy(*keys, "account").agg(F.count_if(F.abs(F.col("mine") - F.col("theirs")) <= days).cast("double").alias("same_window_openings"))


def projection(edges: DataFrame, shared: DataFrame) -> DataFrame:
    """Undirected weights: log of each direction's total, plus shared infrastructure."""
    flow = pair_weights(edges).where("src <> dst").select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.log1p("weight").alias("weight")
    )
    return flow.unionByName(shared.select("a", "b", "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Connected components by smallest label with pointer jumping.

    ``pairs``: a, b. Labels fall to the neighbours' minimum and then to the label of
    the label, so the rounds grow with the logarithm of the diameter; they end when no label falls.
    """
    links = cut(pairs.select(F.col("a").alias("account"), F.col("b").alias("peer")).unionByName(pairs.select(F.col("b").alias("account"), F.col("a").alias("peer"))))
    state = cut(nodes.select("account", F.col("account").alias("label")))
    while True:
        near = links.join(state.select(F.col("account").alias("peer"), "label"), "peer").groupBy("account").agg(F.min("label").alias("m"))
        low = state.join(near, "account", "left").select("account", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = low.join(low.select(F.col("account").alias("label"), F.col("label").alias("root")), "label", "left")
        nxt = cut(jump.select("account", "was", F.least("label", F.coalesce("root", "label")).alias("label")))
        done = nxt.where("was <> label").isEmpty()
        state = nxt.select("account", "label")
        if done:
            break
    return state.select("account", F.col("label").alias("community"))


def label_propagation(nodes: DataFrame, weights: DataFrame, rounds: int = 100) -> DataFrame:
    """Weighted label propagation with deterministic ties and alternating halves.

    A node takes the label with the largest summed weight among its neighbours (its
    own label holds on a tie); halves picked by hash move in turn, which stops most
    labels swapping forever. It ends when neither half moves. Labels that still swap
    after ``rounds`` move one of each linked pair at a time: a move then always adds to
    the weight inside labels, so they settle. ``weights``: a, b, weight.
    """
    links = cut(
        weights.select(F.col("a").alias("account"), F.col("b").alias("peer"), "weight")
        .unionByName(weights.select(F.col("b").alias("account"), F.col("a").alias("peer"), "weight"))
    )

    def votes_of(moving, state):
        """Every moving node with its label and the one its neighbours ask for."""
        votes = moving.join(state.select(F.col("account").alias("peer"), "label"), "peer").groupBy("account", "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        best = votes.groupBy("account").agg(F.max(F.struct("w", (-F.col("label")).alias("neg"))).alias("m"))
        own = votes.select("account", F.col("label").alias("label"), F.col("w").alias("own"))
        nxt = state.join(best, "account", "left").join(own, ["account", "label"], "left")
        stay = F.col("m").isNull() | (F.coalesce("own", F.lit(-1.0)) >= F.col("m.w"))
        return nxt.select("account", F.col("label").alias("was"), F.when(stay, F.col("label")).otherwise(-F.col("m.neg")).alias("label"))

    state, still = cut(nodes.select("account", F.col("account").alias("label"))), 0
    for i in range(rounds):
        nxt = cut(votes_of(links.where(F.pmod(F.xxhash64("account"), F.lit(2)) == i % 2), state))
        still = still + 1 if nxt.where("was <> label").isEmpty() else 0
        state = nxt.select("account", "label")
        if still == 2:
            return state.select("account", F.col("label").alias("community"))
    for i in count():
        asks = cut(votes_of(links, state).where("was <> label"))
        if asks.isEmpty():
            return state.select("account", F.col("label").alias("community"))
        turn = lambda c: F.struct(F.xxhash64(c, F.lit(i)), F.col(c))
        other = asks.select(F.col("account").alias("peer"))
        behind = links.join(asks.select("account"), "account").join(other, "peer").where(turn("peer") < turn("account")).select("account").distinct()
        moved = asks.join(behind, "account", "left_anti").select("account", F.col("label").alias("next"))
        state = cut(state.join(moved, "account", "left").select("account", F.coalesce("next", "label").alias("label")))


def modularity(members: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted modularity of a partition. ``members``: account, community."""
    side = lambda c, o: members.select(F.col("account").alias(c), F.col("community").alias(o))
    rows = weights.join(side("a", "ca"), "a").join(side("b", "cb"), "b")
    inside = rows.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("in"))
    half = rows.select(F.col("ca").alias("c"), "weight").unionByName(rows.select(F.col("cb").alias("c"), "weight"))
    degree = half.groupBy("c").agg(F.sum("weight").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("sq"), F.count(F.lit(1)).alias("communities"))
    return inside.join(degree).select("communities", (F.col("in") / F.col("m") - F.col("sq") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def community_fraud_rate(members: DataFrame, marks: DataFrame, high: float = 0.30) -> DataFrame:
    """Share of marked members per community, attached to each member.

    Rates are aggregated first, so a giant community is one row on the joining side.
    """
    rows = members.join(marks, "account", "left")
    rate = rows.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.avg(F.coalesce(F.col("marked").cast("double"), F.lit(0.0))).alias("rate"))
    return members.join(rate, "community").select("account", "community", "size", "rate", (F.col("rate") > high).alias("high_risk"))


def cycles(edges: DataFrame, keys: Sequence[str], longest: int = 6) -> DataFrame:
    """Directed simple cycles of 3..``longest`` accounts inside each key's graph.

    Complete, one row per node set: paths start at the cycle's smallest account and
    grow by one join per step; of several orders of a set the largest volume stays.
    ``keys`` bounds the graph (a day of transfers), which bounds the path count.
    """
    keys = list(keys)
    links = cut(pair_weights(edges, keys))
    hop = links.select(*keys, F.col("src").alias("last"), F.col("dst").alias("nxt"), F.col("weight").alias("w"))
    close = links.select(*keys, F.col("src").alias("last"), F.col("dst").alias("start"), F.col("weight").alias("w"))
    paths = links.where("src < dst").select(
        *keys, F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"), F.col("weight").alias("volume")
    )
    found = None
    for size in range(3, longest + 1):
        paths = paths.join(hop, [*keys, "last"]).where((F.col("nxt") > F.col("start")) & ~F.array_contains("path", F.col("nxt"))).select(
            *keys, "start", F.col("nxt").alias("last"), F.array_append("path", F.col("nxt")).alias("path"), (F.col("volume") + F.col("w")).alias("volume")
        )
        if size < longest:
            paths = cut(paths)
        rings = paths.join(close, [*keys, "last", "start"]).select(
            *keys, F.sort_array("path").alias("nodes"), F.lit(size).alias("size"), (F.col("volume") + F.col("w")).alias("volume")
        )
        found = rings if found is None else found.unionByName(rings)
    return found.groupBy(*keys, "nodes", "size").agg(F.round(F.max("volume"), 2).alias("volume"))


def cyclic_part(links: DataFrame) -> DataFrame:
    """The links that can lie on a cycle.

    Accounts without a payee or without a payer are peeled off until none is left; then
    the largest id that reaches an account goes forward as its colour, and links between
    colours go, as all accounts of a cycle share theirs. ``links``: src, dst, and more.
    """
    links, n = cut(links), -1
    while n != (left := links.count()):
        n = left
        payers, payees = links.select(F.col("src").alias("dst")).distinct(), links.select(F.col("dst").alias("src")).distinct()
        links = cut(links.join(payers, "dst", "left_semi").join(payees, "src", "left_semi").select(*links.columns))
    colour = cut(links.select(F.col("src").alias("account")).distinct().withColumn("colour", F.col("account")))
    while True:
        came = links.join(colour.select(F.col("account").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("account")).agg(F.max("colour").alias("came"))
        nxt = cut(colour.join(came, "account", "left").select("account", F.col("colour").alias("was"), F.greatest("colour", "came").alias("colour")))
        done, colour = nxt.where("was <> colour").isEmpty(), nxt.select("account", "colour")
        if done:
            break
    side = lambda end: colour.select(F.col("account").alias(end), F.col("colour").alias(f"c_{end}"))
    return links.join(side("src"), "src").join(side("dst"), "dst").where("c_src = c_dst").select(*links.columns)


def meeting_cycles(edges: DataFrame, longest: int = 6) -> DataFrame:
    """Directed simple cycles of 3..``longest`` accounts of a whole graph, one row per set of accounts.

    A cycle is two half paths that meet: out of its first account, and back to it, keyed
    by both ends, so no path longer than three links is ever spelled out. The first account
    is the one with the fewest links (ties: the smallest id), so a busy account starts
    few half paths. Of several orders of a set the largest volume stays.
    """
    if not 3 <= longest <= 6:
        raise ValueError("half paths are laid out for cycles of three to six accounts")
    links = cyclic_part(pair_weights(edges))
    degree = links.select(F.explode(F.array("src", "dst")).alias("account")).groupBy("account").agg(F.count(F.lit(1)).alias("d"))
    place = cut(degree.select("account", F.struct("d", "account").alias("o")))
    side = lambda end, o: place.select(F.col("account").alias(end), F.col("o").alias(o))
    links = cut(links.join(side("src", "o_src"), "src").join(side("dst", "o_dst"), "dst"))
    # out: from the first account, over later ones only; back: to it, the same
    out = {1: links.where("o_src < o_dst").select(F.col("src").alias("first"), F.col("o_src").alias("o"), F.col("dst").alias("last"), F.array().cast("array<bigint>").alias("between"), F.col("weight").alias("v"))}
    back = {1: links.where("o_dst < o_src").select(F.col("dst").alias("first"), F.col("o_dst").alias("o"), F.col("src").alias("last"), F.array().cast("array<bigint>").alias("between"), F.col("weight").alias("v"))}
    for k in range(2, -(-longest // 2) + 1):
        for halves, near, far in ((out, "src", "dst"), (back, "dst", "src")):
            if halves is back and k > longest // 2:
                continue
            step = links.select(F.col(near).alias("last"), F.col(far).alias("next"), F.col(f"o_{far}").alias("o_next"), F.col("weight").alias("w"))
            grown = halves[k - 1].join(step, "last").where((F.col("o_next") > F.col("o")) & ~F.array_contains("between", F.col("next")))
            halves[k] = cut(grown.select("first", "o", F.col("next").alias("last"), F.array_append("between", F.col("last")).alias("between"), (F.col("v") + F.col("w")).alias("v")))
    found = []
    for size in range(3, longest + 1):
        there, home = out[-(-size // 2)], back[size // 2].select("first", "last", F.col("between").alias("others"), F.col("v").alias("w"))
        met = there.join(home, ["first", "last"]).where(~F.arrays_overlap("between", "others"))
        nodes = F.sort_array(F.concat(F.array("first", "last"), "between", "others"))
        found.append(met.select(nodes.alias("nodes"), F.lit(size).alias("size"), (F.col("v") + F.col("w")).alias("volume")))
    return reduce(DataFrame.unionByName, found).groupBy("nodes", "size").agg(F.round(F.max("volume"), 2).alias("volume"))


def ring_membership(rings: DataFrame) -> DataFrame:
    return rings.select(F.explode("nodes").alias("account"), "volume").groupBy("account").agg(F.count(F.lit(1)).alias("rings"), F.round(F.sum("volume"), 2).alias("ring_volume"))


def ring_shapes(rings: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shape and hub of each ring from the edges among its members.

    Out-degrees inside the ring decide; the hub is the member paying most others.
    """
    keys = list(keys)
    ring = F.array_join("nodes", "-").alias("ring")
    base = rings.select(*keys, ring, "size", "nodes")
    member = base.select(*keys, "ring", "size", F.explode("nodes").alias("src"))
    pairs = edges.select(*keys, "src", "dst").distinct()
    inside = member.join(pairs, [*keys, "src"]).join(member.select(*keys, "ring", F.col("src").alias("dst")), [*keys, "ring", "dst"])
    deg = member.join(inside.groupBy(*keys, "ring", "src").agg(F.count(F.lit(1)).alias("d")), [*keys, "ring", "src"], "left").fillna(0, ["d"])
    agg = deg.groupBy(*keys, "ring", "size").agg(
        F.max("d").alias("top"), F.sum("d").alias("m"), F.count_if(F.col("d") <= 1).alias("thin"), F.max(F.struct("d", (-F.col("src")).alias("neg"))).alias("h")
    )
    n = F.col("size")
    shape = (
        F.when(F.col("top") >= n * 0.6, "STAR").when(F.col("m") / (n * (n - 1)) >= 0.6, "DENSE_CLUSTER")
        .when(F.col("thin") >= n * 0.4, "CHAIN").otherwise("CYCLE")
    )
    return agg.select(*keys, "ring", "size", shape.alias("shape"), (-F.col("h.neg")).alias("hub"))


def ring_roles(rings: DataFrame, shapes: DataFrame, edges: DataFrame, keys: Sequence[str], longest: int = 6) -> DataFrame:
    """HUB, BRIDGE or MULE for every member of every ring.

    A bridge is not the hub and carries more than twice the ring's mean betweenness,
    taken exactly over the edges among the ring's few members, all rings together.
    """
    keys = list(keys)
    on = [*keys, "ring"]
    member = rings.select(*keys, F.array_join("nodes", "-").alias("ring"), F.explode("nodes").alias("account"))
    pairs = edges.select(*keys, F.col("src").alias("account"), F.col("dst").alias("peer")).distinct()
    links = member.join(pairs, [*keys, "account"]).join(member.withColumnRenamed("account", "peer"), [*on, "peer"], "left_semi")
    between = betweenness(cut(member), cut(links.select(*on, "account", "peer")), on, longest)
    mean = between.groupBy(*on).agg(F.avg("betweenness").alias("mean"))
    rows = between.join(mean, on).join(shapes.select(*on, "hub"), on)
    bridge = F.round("betweenness", 9) > F.round(F.col("mean") * 2, 9)
    return rows.select(*on, "account", F.when(F.col("account") == F.col("hub"), "HUB").when(bridge, "BRIDGE").otherwise("MULE").alias("role"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    deg = undirected(edges).groupBy("account").agg(F.count(F.lit(1)).alias("d"))
    return nodes.select("account").join(deg, "account", "left").select("account", (F.coalesce("d", F.lit(0)) / (n - 1)).alias("network_score"))


def seed_masks(seeds: DataFrame) -> DataFrame:
    """(seed, block, bit): every seed has a bit of its own in a 64-bit mask of one of the blocks."""
    numbered = cut(seeds.select("seed").distinct().withColumn("n", F.monotonically_increasing_id()))
    return numbered.select("seed", F.shiftright("n", 6).alias("block"), F.expr("shiftleft(CAST(1 AS BIGINT), CAST(n & 63 AS INT))").alias("bit"))


def expanded(masks: DataFrame, bits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per seed whose bit is set in ``mask``."""
    return masks.join(bits, "block").where(F.col("mask").bitwiseAND(F.col("bit")) != 0).select("seed", *columns)


def neighbourhood(seeds: DataFrame, edges: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Accounts within ``hops`` of each seed, and the pair totals among them after each hop.

    Returns (seed, account, hops) and (hops, seed, src, dst, n, total). ``seeds``: seed.
    An account holds the set of seeds that reach it as bit masks, 64 seeds a row, which a
    hop merges by OR; the newest bits go out only. An edge lies in a neighbourhood as soon
    as both its ends do. Masks are spelled out as seeds at the very end.
    """
    links = cut(undirected(edges))
    bits = cut(seed_masks(seeds))
    start = bits.groupBy(F.col("seed").alias("account"), "block").agg(F.bit_or("bit").alias("mask"))
    frontier = seen = cut(start)
    found = [frontier.withColumn("hops", F.lit(0))]
    for level in range(1, hops + 1):
        step = frontier.join(links, "account").groupBy(F.col("peer").alias("account"), "block").agg(F.bit_or("mask").alias("mask"))
        old = seen.select("account", "block", F.col("mask").alias("old"))
        step = step.join(old, ["account", "block"], "left").withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0)))))
        frontier = cut(step.where("mask <> 0").select("account", "block", "mask"))
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("hops", F.lit(level)))
        seen = cut(seen.unionByName(frontier).groupBy("account", "block").agg(F.bit_or("mask").alias("mask")))
    masks = cut(reduce(DataFrame.unionByName, found))
    reach = expanded(masks, bits, ["account", "hops"])
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    side = lambda c, m, h: masks.select(F.col("account").alias(c), "block", F.col("mask").alias(m), F.col("hops").alias(h))
    both = pairs.join(side("src", "ma", "ha"), "src").join(side("dst", "mb", "hb"), ["dst", "block"])
    both = both.select("src", "dst", "n", "total", "block", F.col("ma").bitwiseAND(F.col("mb")).alias("mask"), F.greatest("ha", "hb").alias("first")).where("mask <> 0")
    inside = expanded(both, bits, ["src", "dst", "n", "total", "first"])
    each = F.explode(F.sequence(F.greatest("first", F.lit(1)), F.lit(hops))).alias("hops")
    return reach, inside.select(each, "seed", "src", "dst", "n", F.round("total", 2).alias("total"))


def decay_taint(seeds: DataFrame, edges: DataFrame, max_hops: int = 4, start: float = 55.0, decay: float = 0.62) -> DataFrame:
    """Strongest taint per account over all confirmed seeds.

    Taint falls with the distance to a seed, so only the nearest seed other than the
    account itself matters. Two nearest seeds per account are enough to know it, and
    one search carries them for any number of seeds.
    """
    links = cut(undirected(edges))
    state = cut(seeds.select("account", F.col("account").alias("origin"), F.lit(0).alias("d")))
    rank = W.partitionBy("account").orderBy("d", "origin")
    for level in range(1, max_hops + 1):
        step = state.where(F.col("d") == level - 1).join(links, "account").select(F.col("peer").alias("account"), "origin", F.lit(level).alias("d"))
        merged = state.unionByName(step).groupBy("account", "origin").agg(F.min("d").alias("d"))
        state = cut(merged.withColumn("r", F.row_number().over(rank)).where("r <= 2").drop("r"))
    near = state.where("origin <> account").groupBy("account").agg(F.min("d").alias("d"))
    return near.select("account", F.round(F.pow(F.lit(decay), F.col("d") - 1) * start, 2).alias("taint"))


def neighbour_means(features: DataFrame, links: DataFrame, names: Sequence[str], hops: int = 2) -> DataFrame:
    """Mean of the neighbours' features, applied once per hop.

    ``links``: account, peer (distinct). Means combine map-side, so a hub costs one
    partial row per task.
    """
    state, out = features.select("account", *names), features.select("account", *names)
    for h in range(1, hops + 1):
        mean = links.join(state.withColumnRenamed("account", "peer"), "peer").groupBy("account").agg(*[F.avg(c).alias(c) for c in names])
        state = features.select("account").join(mean, "account", "left").fillna(0.0, list(names))
        out = out.join(state.select("account", *[F.col(c).alias(f"{c}_h{h}") for c in names]), "account")
    return out


def cross_bank_hops(parents: DataFrame, accounts: DataFrame, victims: DataFrame) -> DataFrame:
    """Bank changes along the first-parent chain back to the victim.

    Pointer doubling over the parent links, until every chain has ended. A chain that
    does not reach the victim counts its crossings until it ends; a loop, which first
    parents never form, raises an error. ``parents``: incident, account, parent.
    """
    bank = lambda c, b: accounts.select(F.col("account").alias(c), F.col("bank").alias(b))
    rows = parents.join(victims.select("incident", F.col("victim").alias("account")), ["incident", "account"], "left_anti")
    state = rows.join(bank("account", "x"), "account", "left").join(bank("parent", "y"), "parent", "left").select(
        "incident", "account", F.col("parent").alias("up"), F.when(F.col("x").eqNullSafe(F.col("y")), 0).otherwise(1).cast("bigint").alias("crossings")
    )
    state, links, steps = cut(state), rows.count(), 1
    while not state.where("up IS NOT NULL").isEmpty():
        if steps > 2 * links:
            raise RuntimeError("the parent links hold a loop")
        nxt = state.select("incident", F.col("account").alias("up"), F.col("up").alias("up2"), F.col("crossings").alias("more"))
        state = cut(state.join(nxt, ["incident", "up"], "left").select(
            "incident", "account", F.col("up2").alias("up"), (F.col("crossings") + F.coalesce("more", F.lit(0))).alias("crossings")
        ))
        steps *= 2
    return state.select("incident", "account", "crossings").unionByName(
        victims.select("incident", F.col("victim").alias("account"), F.lit(0).cast("bigint").alias("crossings"))
    )
