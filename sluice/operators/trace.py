"""Following stolen money forward in time, all incidents in one job.

Spark bounds the events an incident can see (reach), computes what each debit's
share depends on (inflow so far) and sorts them; the only ordered Python is a fold
that streams one incident after another with the tainted balances as its state, so a
task never holds an incident's events in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import HOUR, interval_join, ordinal, running_sum
from ..session import cut
from .graph import breadth_first
from .ranking import top_ranked

# Smallest tainted move, smallest share, hops.
FLOOR = 250.0
MIN_SHARE = 0.02
CANDIDATE_HOPS = 3
FOLD_EVERY = 8
# incidents in one list of short numbers
PART = 4096
# moves a task holds before it hands them on
MOVES = 50_000


def reach(starts: DataFrame, transfers: DataFrame, exits: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Earliest arrival and hop depth along time-respecting transfers.

    ``starts``: run, account, arrival, until. ``extra``: run, src, dst links usable at
    any time (rerouted payments). Each round joins only arrivals that improved; a hot
    sender splits by hour. Accounts in ``exits`` are reached and not left. Rounds only
    add what improved and go on until nothing does; every few rounds the additions are
    folded into one state.
    """
    moves = transfers.select("src", "dst", "epoch")
    new = cut(starts.select("run", "account", "arrival", "until", F.lit(0).alias("depth")))
    parts = [new]

    def best_of(rows: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, rows).groupBy("run", "account").agg(F.min(F.struct("arrival", "depth", "until")).alias("b")).select(
            "run", "account", F.col("b.arrival").alias("arrival"), F.col("b.until").alias("until"), F.col("b.depth").alias("depth")
        )

    while True:
        ask = new if exits is None else new.join(exits.select("account"), "account", "left_anti")
        ask = ask.withColumnRenamed("account", "src")
        step = interval_join(ask, moves, ["src"], "epoch", "arrival", "until").select(
            "run", F.col("dst").alias("account"), F.col("epoch").alias("arrival"), "until", (F.col("depth") + 1).alias("depth")
        )
        if extra is not None:
            jump = ask.join(extra, ["run", "src"]).select("run", F.col("dst").alias("account"), "arrival", "until", (F.col("depth") + 1).alias("depth"))
            step = step.unionByName(jump)
        best = step.groupBy("run", "account").agg(F.min(F.struct("arrival", "depth", "until")).alias("b"))
        was = reduce(DataFrame.unionByName, parts).groupBy("run", "account").agg(F.min("arrival").alias("was"))
        new = best.join(was, ["run", "account"], "left").where(F.col("was").isNull() | (F.col("b.arrival") < F.col("was")))
        new = cut(new.select("run", "account", F.col("b.arrival").alias("arrival"), F.col("b.until").alias("until"), F.col("b.depth").alias("depth")))
        if new.isEmpty():
            return cut(best_of(parts))
        parts.append(new)
        if len(parts) > FOLD_EVERY:
            parts = [cut(best_of(parts))]


EVENT = (
    "run string, epoch bigint, opening int, src bigint, pos bigint, dst bigint, amount double, inflow double, to_exit boolean, "
    "held0 double, through0 double, stopped boolean, rerouted boolean, alt1 bigint, alt2 bigint, exit1 boolean, exit2 boolean, delay bigint, until bigint"
)
MOVE = "run string, kind string, src bigint, dst bigint, amount double, tainted double, epoch bigint, txn_id bigint"
FIELDS = [f.strip().split()[0] for f in EVENT.split(",")]


def _fold(batches: Iterator) -> Iterator:
    """Apply events in (time, account, position) order, one run after another."""
    import heapq

    import pandas as pd

    names = [f.split()[0] for f in MOVE.split(", ")]

    def rows():
        for pdf in batches:
            yield from zip(*(pdf[c].tolist() for c in FIELDS))

    def settle(run, events):
        out: list[tuple] = []
        held, through, known = {}, {}, set()
        waiting, retries = [], {}

        def pay_in(dst, amount, leaves):
            through[dst] = through.get(dst, 0.0) + amount
            if not leaves:
                held[dst] = held.get(dst, 0.0) + amount
                known.add(dst)

        def arrivals(upto):
            while waiting and waiting[0][0] <= upto:
                when, src, dst, amount, leaves = heapq.heappop(waiting)
                pay_in(dst, amount, leaves)
                out.append((run, "reroute_in", src, dst, amount, amount, when, -1))

        for epoch, second in groupby(events, key=lambda r: r[1]):
            if len(out) >= MOVES:
                yield out
                out.clear()
            # accounts reached inside this second may still spend later in it
            todo, parked = [], {}
            arrivals(epoch)
            for r in second:
                if r[2]:
                    held[r[3]], through[r[3]] = r[9], r[10]
                    known.add(r[3])
                elif r[3] in known:
                    heapq.heappush(todo, (r[3], r[4], r))
                else:
                    parked.setdefault(r[3], []).append(r)
            while todo:
                src, pos, r = heapq.heappop(todo)
                available = held.get(src, 0.0)
                if available <= FLOOR:
                    continue
                tainted = through.get(src, 0.0)
                base = max(r[7], tainted, available)
                share = min(1.0, tainted / base) if base > 0 else 0.0
                moved = min(available, r[6] * share)
                if share < MIN_SHARE or moved <= FLOOR:
                    continue
                if r[11]:
                    out.append((run, "blocked", src, r[5], r[6], moved, epoch, pos))
                    tries = retries.get(src, 0)
                    target, leaves = ((r[13], r[15]), (r[14], r[16]))[min(tries, 1)]
                    if r[12] and tries < 2 and target >= 0:
                        retries[src] = tries + 1
                        if epoch + r[17] <= r[18]:
                            held[src] = available - moved
                            heapq.heappush(waiting, (epoch + r[17], src, target, moved, bool(leaves)))
                            out.append((run, "reroute_out", src, target, r[6], moved, epoch, pos))
                    continue
                held[src] = available - moved
                fresh = r[5] not in known
                pay_in(r[5], moved, r[8])
                out.append((run, "move", src, r[5], r[6], moved, epoch, pos))
                if fresh and not r[8]:
                    for later in parked.pop(r[5], ()):
                        heapq.heappush(todo, (later[3], later[4], later))
        arrivals(float("inf"))
        if out:
            yield out

    for run, events in groupby(rows(), key=lambda r: r[0]):
        for out in settle(run, events):
            yield pd.DataFrame(out, columns=names)


def ordered_fold(events: DataFrame) -> DataFrame:
    """Run the fold over sorted events; ``run`` decides the task, time the order."""
    ready = events.select(*FIELDS).repartition("run").sortWithinPartitions("run", "epoch", F.desc("opening"), "src", "pos")
    return ready.mapInPandas(_fold, MOVE)


def exposed_debits(reached: DataFrame, transfers: DataFrame, exits: DataFrame, runs: DataFrame) -> DataFrame:
    """Debits a run can touch, each with the account's inflow since the theft.

    ``reached``: run, account, arrival, until. ``runs``: run, t0, victim, stolen. A
    debit of at most the floor can never move taint and is left out; inflow counts
    every credit of the same or an earlier second, the victim's the stolen sum too.
    """
    ends = exits.select(F.col("account").alias("dst"), F.lit(True).alias("to_exit"))
    ask = reached.join(exits.select("account"), "account", "left_anti").join(runs, "run")
    debits = interval_join(ask.withColumnRenamed("account", "src"), transfers.where(F.col("amount") > FLOOR).select("src", "dst", "amount", "epoch", "txn_id"), ["src"], "epoch", "arrival", "until")
    credits = interval_join(
        ask.select("run", F.col("account").alias("dst"), "t0", "until"), transfers.select("dst", F.col("amount").alias("credit"), "epoch"), ["dst"], "epoch", "t0", "until"
    ).select("run", F.col("dst").alias("src"), "epoch", "credit")
    d = debits.select("run", "src", "epoch", F.lit(0.0).alias("credit"), "txn_id", "dst", "amount", "until", "victim", "stolen")
    line = d.unionByName(credits, allowMissingColumns=True)
    run = running_sum(line, ["run", "src"], F.floor(F.col("epoch") / HOUR), ["epoch"], F.col("credit"), "received")
    inflow = F.col("received") + F.when(F.col("src") == F.col("victim"), F.col("stolen")).otherwise(0.0)
    return run.where("txn_id IS NOT NULL").join(ends, "dst", "left").select(
        "run", "epoch", "src", F.col("txn_id").alias("pos"), "dst", "amount", inflow.alias("inflow"), F.coalesce("to_exit", F.lit(False)).alias("to_exit"), "until"
    )


def as_events(debits: DataFrame, opening: DataFrame) -> DataFrame:
    """Debits and opening balances in the fold's layout. ``opening``: run, account, epoch, held, through."""
    # -1 stands for no account, as a null would turn the column into doubles
    have, none = set(debits.columns), F.lit(-1).cast("bigint")
    default = {"stopped": F.lit(False), "rerouted": F.lit(False), "alt1": none, "alt2": none, "exit1": F.lit(False), "exit2": F.lit(False), "delay": F.lit(0).cast("bigint")}
    d = debits.select(
        F.col("run").cast("string").alias("run"), "epoch", F.lit(0).alias("opening"), "src", "pos", "dst", "amount", "inflow", "to_exit",
        F.lit(0.0).alias("held0"), F.lit(0.0).alias("through0"), *[F.coalesce(F.col(c), v).alias(c) if c in have else v.alias(c) for c, v in default.items()], "until",
    )
    o = opening.select(
        F.col("run").cast("string").alias("run"), "epoch", F.lit(1).alias("opening"), F.col("account").alias("src"), F.lit(-1).cast("bigint").alias("pos"),
        F.lit(-1).cast("bigint").alias("dst"), F.lit(0.0).alias("amount"), F.lit(0.0).alias("inflow"), F.lit(False).alias("to_exit"),
        F.col("held").alias("held0"), F.col("through").alias("through0"), *[v.alias(c) for c, v in default.items()], F.lit(0).cast("bigint").alias("until"),
    )
    return d.unionByName(o)


def taint_flows(incidents: DataFrame, transfers: DataFrame, exits: DataFrame, until: str = "complaint") -> DataFrame:
    """Every move of stolen money up to ``until``: incident, src, dst, amount, tainted, epoch.

    ``incidents``: incident, victim, amount, t0 and the ``until`` column.
    """
    runs = incidents.select(F.col("incident").alias("run"), "victim", F.col("amount").alias("stolen"), "t0", F.col(until).alias("until"))
    big = transfers.where(F.col("amount") > FLOOR)
    reached = reach(runs.select("run", F.col("victim").alias("account"), F.col("t0").alias("arrival"), "until"), big, exits)
    debits = exposed_debits(reached.drop("depth"), transfers, exits, runs.drop("until"))
    opening = runs.select("run", F.col("victim").alias("account"), F.col("t0").alias("epoch"), F.col("stolen").alias("held"), F.col("stolen").alias("through"))
    moves = cut(ordered_fold(as_events(debits, opening)))
    ends = exits.select(F.col("account").alias("dst"), F.lit(True).alias("to_exit"))
    return moves.select(F.col("run").cast("bigint").alias("incident"), "src", "dst", "amount", "tainted", "epoch", "txn_id").join(ends, "dst", "left").withColumn(
        "to_exit", F.coalesce("to_exit", F.lit(False))
    )


def taint_accounts(incidents: DataFrame, flows: DataFrame) -> DataFrame:
    """held, through and first_seen per incident and account, exits left out."""
    start = incidents.select("incident", F.col("victim").alias("account"), F.col("amount").alias("i"), F.lit(0.0).alias("o"), F.col("t0").alias("epoch"))
    came = flows.where(~F.col("to_exit")).select("incident", F.col("dst").alias("account"), F.col("tainted").alias("i"), F.lit(0.0).alias("o"), "epoch")
    went = flows.select("incident", F.col("src").alias("account"), F.lit(0.0).alias("i"), F.col("tainted").alias("o"), F.lit(None).cast("bigint").alias("epoch"))
    return start.unionByName(came).unionByName(went).groupBy("incident", "account").agg(
        (F.sum("i") - F.sum("o")).alias("held"), F.sum("i").alias("through"), F.min("epoch").alias("first_seen")
    )


def taint_summary(incidents: DataFrame, flows: DataFrame) -> DataFrame:
    """Still inside and gone per incident; the two add up to the sum stolen."""
    gone = flows.groupBy("incident").agg(F.sum(F.when(F.col("to_exit"), F.col("tainted")).otherwise(0.0)).alias("exited"), F.count(F.lit(1)).alias("flows"))
    held = taint_accounts(incidents, flows).groupBy("incident").agg(F.sum("held").alias("held"), F.count(F.lit(1)).alias("touched"))
    return incidents.select("incident", "amount").join(held, "incident").join(gone, "incident", "left").fillna(0, ["exited", "flows"])


def taint_depth(incidents: DataFrame, flows: DataFrame) -> DataFrame:
    """Hops from the victim along the path the money took."""
    links = flows.select("incident", F.col("src").alias("account"), F.col("dst").alias("peer")).distinct()
    return breadth_first(incidents.select("incident", F.col("victim").alias("account")), links, ["incident"], None)


def frontier(touched: DataFrame, transfers: DataFrame, exits: DataFrame, cutoffs: DataFrame, hops: int = CANDIDATE_HOPS, limit: int | None = None) -> DataFrame:
    """Accounts within ``hops`` observed payments of the tainted ones, exits left out.

    ``touched``: incident, account. ``cutoffs``: incident, until. Past links are
    reduced to the first time each pair was used, so a busy pair costs one row. With a
    ``limit`` the lowest ids fill the room left, hop by hop, and ``truncated`` tells
    whether an incident lost accounts to it.
    """
    first = transfers.groupBy("src", "dst").agg(F.min("epoch").alias("first")).join(exits.select(F.col("account").alias("dst")), "dst", "left_anti")
    start = touched.join(exits.select("account"), "account", "left_anti").select("incident", "account").distinct()
    return _packed_frontier(start, first, cutoffs, hops).rows() if limit is None else _limited_frontier(start, first, cutoffs, hops, limit)


def packed_frontier(touched: DataFrame, transfers: DataFrame, exits: DataFrame, cutoffs: DataFrame, hops: int = CANDIDATE_HOPS) -> Packed:
    """``frontier`` without a limit, as it is written."""
    first = transfers.groupBy("src", "dst").agg(F.min("epoch").alias("first")).join(exits.select(F.col("account").alias("dst")), "dst", "left_anti")
    start = touched.join(exits.select("account"), "account", "left_anti").select("incident", "account").distinct()
    return _packed_frontier(start, first, cutoffs, hops)


class Packed:
    """Accounts in reach of incidents: ``numbered`` (incident, until, n) and rows of ``lists`` (account, part, places), n being part * PART + place.

    An account may have several lists of one part, without a number in common.
    """

    def __init__(self, numbered: DataFrame, lists: DataFrame):
        self.numbered, self.lists = numbered, lists

    def rows(self) -> DataFrame:
        every = self.lists.select("account", "part", F.explode("places").alias("place"))
        return every.select("account", (F.col("part") * PART + F.col("place")).alias("n")).join(self.numbered.select("n", "incident"), "n").select("incident", "account")

    def holding(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (incident, account) that are in reach; the lists are not spelled out."""
        n = F.col("n")
        asked = pairs.join(self.numbered, "incident").groupBy("account", F.floor(n / PART).alias("part")).agg(F.collect_list(F.struct((n % PART).cast("smallint").alias("place"), "incident")).alias("asked"))
        met = asked.join(self.lists, ["account", "part"])
        return met.select("account", F.explode(F.filter("asked", lambda x: F.array_contains("places", x["place"]))).alias("x")).select("x.incident", "account")


def numbered_since(rows: DataFrame, numbered: DataFrame, at: str) -> DataFrame:
    """``rows`` with ``since``, the number of the first incident whose cutoff is not before ``at``."""
    marks = rows.withColumn("epoch", F.col(at)).withColumn("one", F.lit(0)).unionByName(
        numbered.select(F.col("until").alias("epoch"), F.lit(1).alias("one")), allowMissingColumns=True)
    return running_sum(marks, [], F.floor(F.col("epoch") / HOUR), ["epoch", "one"], F.col("one"), "since", peers=False).where("one = 0").select(*rows.columns, "since")


def _packed_frontier(start: DataFrame, first: DataFrame, cutoffs: DataFrame, hops: int) -> Packed:
    """All accounts of the frontier. ``start``: incident, account. ``first``: src, dst, first.

    Incidents are numbered by their cutoff, so those that know a link are the numbers
    from one on, looked up once per link. An account holds the incidents that reach it as
    lists of short numbers, one per ``PART`` incidents; a hop sends whole lists along the
    links and spells them out only where they are merged, as bits.
    """
    numbered = cut(ordinal(cutoffs, [], F.floor(F.col("until") / HOUR), ["until", "incident"], "n").select("incident", "until", (F.col("n") - 1).alias("n")))
    links = cut(numbered_since(first.select(F.col("src").alias("account"), F.col("dst").alias("to"), "first"), numbered, "first").drop("first"))
    part, place = F.floor(F.col("n") / PART), (F.col("n") % PART).cast("smallint")
    packed = lambda rows: rows.groupBy("account", "part").agg(F.collect_list("place").alias("places"))
    found = [cut(packed(start.join(numbered, "incident").select("account", part.alias("part"), place.alias("place"))))]
    for _ in range(hops):
        low = F.col("since") - F.col("part") * PART
        knowing = F.when(low <= 0, F.col("places")).otherwise(F.filter("places", lambda x: x >= low))
        step = found[-1].join(links, "account").where(low < PART).select(F.col("to").alias("account"), "part", knowing.alias("places"), F.lit(False).alias("old")).where(F.size("places") > 0)
        for had in found:
            step = step.unionByName(had.withColumn("old", F.lit(True)))
        each = step.repartition("account", "part").select("account", "part", "old", F.explode("places").alias("place"))
        bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(place & 63 AS INT))")
        words = each.groupBy("account", "part", F.shiftright("place", 6).alias("word")).agg(
            F.bit_or(F.when(F.col("old"), bit).otherwise(0)).alias("had"), F.bit_or(bit).alias("mask"))
        new = words.withColumn("mask", F.col("mask").bitwiseXOR(F.col("had"))).where("mask <> 0").select(
            "account", "part", "word", "mask", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).where("(shiftright(mask, i) & 1) = 1")
        new = cut(packed(new.select("account", "part", (F.col("word") * 64 + F.col("i")).cast("smallint").alias("place"))))
        if new.isEmpty():
            break
        found.append(new)
    return Packed(numbered, reduce(DataFrame.unionByName, found))


def _limited_frontier(start: DataFrame, first: DataFrame, cutoffs: DataFrame, hops: int, limit: int) -> DataFrame:
    """At most ``limit`` accounts an incident. ``start``: incident, account. ``first``: src, dst, first."""
    first = cut(first)
    seen = cut(start.join(cutoffs, "incident"))
    edge, lost = seen, []
    for _ in range(hops):
        room = seen.groupBy("incident").agg((F.lit(limit) - F.count(F.lit(1))).alias("room"))
        step = edge.join(first.withColumnRenamed("src", "account"), "account").where(F.col("first") <= F.col("until")).select("incident", F.col("dst").alias("account"), "until").distinct()
        new = cut(step.join(seen.select("incident", "account"), ["incident", "account"], "left_anti"))
        edge = cut(top_ranked(new, ["incident"], [F.col("account")], limit).join(room, "incident").where("rank <= room").select("incident", "account", "until"))
        lost.append(new.select("incident", "account").join(edge, ["incident", "account"], "left_anti").select("incident"))
        if edge.isEmpty():
            break
        seen = cut(seen.unionByName(edge.select(*seen.columns)))
    cut_off = reduce(DataFrame.unionByName, lost).distinct().withColumn("truncated", F.lit(True))
    return seen.select("incident", "account").join(cut_off, "incident", "left").fillna(False, ["truncated"])


def incident_graph(incidents: DataFrame, flows: DataFrame, transfers: DataFrame, accounts: DataFrame, labels: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of every incident: the traced core and one hop around it.

    ``flows`` are traced to the horizon; links are the window's transfers inside the kept
    set. With a ``limit`` the context accounts fill the room left by the core, lowest ids
    first, and ``truncated`` marks the nodes of incidents that lost some.
    """
    state = taint_accounts(incidents, flows)
    gone = flows.where("to_exit").select("incident", F.col("dst").alias("account"), "epoch", "tainted").groupBy("incident", "account").agg(
        F.lit(0.0).alias("held"), F.sum("tainted").alias("through"), F.lit(None).cast("bigint").alias("first_seen")
    )
    core = cut(state.unionByName(gone.select(*state.columns)))
    frame = incidents.select("incident", "victim", "t0", "horizon")
    traced = core.where("first_seen IS NOT NULL").select("incident", "account").join(frame, "incident")
    touch = []
    for near, far in (("src", "dst"), ("dst", "src")):
        rows = interval_join(traced.withColumnRenamed("account", near), transfers.select("src", "dst", "epoch"), [near], "epoch", "t0", "horizon")
        touch.append(rows.select("incident", F.col(far).alias("account")))
    extra = touch[0].unionByName(touch[1]).distinct().join(core.where("first_seen IS NOT NULL").select("incident", "account"), ["incident", "account"], "left_anti")
    sizes = core.where("first_seen IS NOT NULL").groupBy("incident").agg(F.count(F.lit(1)).alias("core"))
    context = extra.select("incident", "account")
    if limit is not None:
        extra = cut(context)
        context = top_ranked(extra, ["incident"], [F.col("account")], limit).join(sizes, "incident").where(F.col("rank") <= F.lit(limit) - F.col("core")).select("incident", "account")
    keep = cut(traced.select("incident", "account").unionByName(context))
    side = keep.join(frame, "incident").withColumnRenamed("account", "src")
    inside = interval_join(side, transfers.select("txn_id", "src", "dst", "amount", "epoch", "channel"), ["src"], "epoch", "t0", "horizon").join(
        keep.withColumnRenamed("account", "dst"), ["incident", "dst"], "left_semi"
    )
    taint = flows.select("incident", "txn_id", "tainted")
    links = cut(inside.join(taint, ["incident", "txn_id"], "left").select(
        "incident", "txn_id", "src", "dst", "amount", F.round(F.coalesce("tainted", F.lit(0.0)), 2).alias("tainted"), F.floor((F.col("epoch") - F.col("t0")) / 60).alias("minute"), "channel"
    ))
    sent = links.groupBy("incident", F.col("src").alias("account")).agg(F.round(F.sum("amount"), 2).alias("amount_out"))
    got = links.groupBy("incident", F.col("dst").alias("account")).agg(F.round(F.sum("amount"), 2).alias("amount_in"))
    depth = taint_depth(incidents, flows)
    rows = (
        keep.join(frame, "incident").join(accounts.select("account", "bank", "archetype"), "account").join(labels.select("account", "is_mule", "ring_id", "layer_index"), "account", "left")
        .join(core, ["incident", "account"], "left").join(depth, ["incident", "account"], "left").join(sent, ["incident", "account"], "left").join(got, ["incident", "account"], "left")
    )
    mule = F.coalesce("is_mule", F.lit(False))
    kind = F.when(F.col("account") == F.col("victim"), "victim").when(F.col("archetype") == "exit_point", "exit").when(mule, "mule").otherwise("legit")
    nodes = rows.select(
        "incident", "account", kind.alias("kind"), "bank", mule.alias("is_mule"), F.coalesce("ring_id", F.lit("")).alias("ring_id"),
        F.coalesce(F.col("layer_index"), F.lit(-1)).alias("layer_index"), F.coalesce("hops", F.lit(-1)).alias("depth"),
        F.coalesce(F.floor((F.col("first_seen") - F.col("t0")) / 60), F.lit(-1)).alias("first_seen_minute"),
        F.coalesce("amount_in", F.lit(0.0)).alias("amount_in"), F.coalesce("amount_out", F.lit(0.0)).alias("amount_out"), F.round(F.coalesce("through", F.lit(0.0)), 2).alias("tainted_in"),
    )
    if limit is not None:
        cut_off = extra.join(keep, ["incident", "account"], "left_anti").select("incident").distinct().withColumn("truncated", F.lit(True))
        nodes = nodes.join(cut_off, "incident", "left").fillna(False, ["truncated"])
    return nodes, links


EXIT_TYPES = {"atm": "atm", "exchange": "crypto", "crossborder": "forex"}


def case_flows(flows: DataFrame, incidents: DataFrame, exits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traced transfers between accounts, and typed cash-outs, with offsets."""
    t = flows.join(incidents.select("incident", "t0"), "incident").withColumn("t_offset_sec", F.greatest(F.lit(0), F.col("epoch") - F.col("t0")))
    moves = t.where(~F.col("to_exit")).select("incident", "src", "dst", F.round("tainted", 2).alias("amount"), F.round("amount", 2).alias("gross"), "t_offset_sec")
    kind = F.when(F.col("exit_kind") == "atm", "atm").when(F.col("exit_kind") == "exchange", "crypto").when(F.col("exit_kind") == "crossborder", "forex").otherwise("merchant")
    outs = t.where("to_exit").join(exits.select(F.col("account").alias("dst"), "exit_kind"), "dst", "left").select(
        "incident", F.col("src").alias("account"), F.round("tainted", 2).alias("amount"), "t_offset_sec", kind.alias("type")
    )
    return moves, outs


def raw_events(incidents: DataFrame, pool: DataFrame, transfers: DataFrame, lookback: int = 30 * 86400) -> DataFrame:
    """Transfers touching the pool from 30 days before the theft to the horizon, signed offset."""
    from .filters import visible_edges

    rows = visible_edges(transfers, pool, incidents.select("incident", F.col("horizon").alias("until")))
    return rows.join(incidents.select("incident", "t0"), "incident").where(F.col("epoch") >= F.col("t0") - lookback).select(
        "incident", "txn_id", "src", "dst", "amount", (F.col("epoch") - F.col("t0")).alias("offset_sec")
    )
