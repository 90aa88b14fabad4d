"""Joins: as-of, co-occurrence, time-respecting, truth and profile joins.

No side is hinted as broadcast: Spark broadcasts by measured size and otherwise
uses a sort-merge join with skewed partitions split at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import exact_quantiles, interval_join, latest_before
from .ranking import top_ranked


def residence(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Seconds since the latest credit, for every debit that follows one.

    A credit in the same second counts. Debits and credits are one union, so the
    as-of lookup is a window over (account, day) with the earlier days carried in.
    """
    keys = list(keys)
    credits = edges.select(*keys, F.col("dst").alias("account"), "epoch", F.lit(0).alias("debit"), F.lit(None).cast("bigint").alias("txn_id"))
    debits = edges.select(*keys, F.col("src").alias("account"), "epoch", F.lit(1).alias("debit"), "txn_id")
    both = credits.unionByName(debits)
    seen = latest_before(both, [*keys, "account"], "epoch", F.when(F.col("debit") == 0, F.col("epoch")), "credit_epoch", tie=F.col("debit"))
    return seen.where("debit = 1 AND credit_epoch IS NOT NULL").select(
        *keys, "txn_id", "account", "epoch", "credit_epoch", (F.col("epoch") - F.col("credit_epoch")).alias("gap")
    )


def forwarding_delay(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median (averaging) and nearest-rank quartiles of the delay in minutes."""
    keys = [*keys, "account"]
    gaps = residence(edges, keys[:-1]).withColumn("minutes", F.col("gap") / 60.0)
    mid = exact_quantiles(gaps, keys, "minutes", {"median_delay": 0.5})
    quarts = exact_quantiles(gaps, keys, "minutes", {"q25": 0.25, "q75": 0.75}, method="nearest")
    return mid.join(quarts, keys)


def shared_infrastructure(accounts: DataFrame, columns: Sequence[str], weight: float = 2.5, largest: int | None = None) -> DataFrame:
    """Pairs sharing an identifier.

    Pairs grow with the square of a group. Where large groups count as an artefact,
    ``largest`` leaves those above it out; ``shared_groups`` has them as a table of accounts.
    """
    parts = []
    for c in columns:
        rows = accounts.where(F.col(c).isNotNull()).select("account", F.col(c).alias("value"))
        sizes = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
        if largest is not None:
            sizes = sizes.where(F.col("n") <= largest)
        kept = rows.join(sizes.select("value"), "value")
        parts.append(
            kept.select(F.col("account").alias("a"), "value")
            .join(kept.select(F.col("account").alias("b"), "value"), "value")
            .where("a < b").select("a", "b", F.lit(weight).alias("weight"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def shared_groups(accounts: DataFrame, columns: Sequence[str], least: int = 2) -> DataFrame:
    """Accounts with each identifier that at least ``least`` of them share: column, value, account, n; one row per account, whatever the group's size."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("g")
    rows = accounts.select("account", named).select("g.column", "g.value", "account").where("value IS NOT NULL")
    sizes = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return rows.join(sizes, ["column", "value"])


def cooccurrence_edges(cards: DataFrame, columns: Sequence[str], largest: int | None = None, generic: Sequence[str] = ()) -> DataFrame:
    """Both-way edges among the largest flows sharing an attribute value.

    With ``largest`` only that many accounts by flow are kept per value. The edge carries
    the mean flow of its group, and a pair found twice keeps the larger amount.
    """
    parts = []
    for c in columns:
        value = F.trim(F.col(c).cast("string"))
        rows = cards.where(F.col(c).isNotNull() & (value != "") & ~F.lower(value).isin(*(generic or ["\0"])))
        flows = rows.groupBy(value.alias("value"), "card").agg(F.sum("amt").alias("flow"))
        kept = flows if largest is None else top_ranked(flows, ["value"], [F.desc("flow"), F.col("card")], largest)
        mean = kept.groupBy("value").agg(F.avg("flow").alias("amount"), F.count(F.lit(1)).alias("n")).where("n >= 2")
        kept = kept.join(mean, "value")
        parts.append(
            kept.select("value", F.col("card").alias("source"), "amount")
            .join(kept.select("value", F.col("card").alias("target")), "value")
            .where("source <> target").select("source", "target", "amount")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source", "target").agg(F.max("amount").alias("amount"))


def usable_edges(arrivals: DataFrame, transfers: DataFrame, until: str) -> DataFrame:
    """Edges an account can use: sent at or after arrival and no later than the limit.

    A busy account splits by hour.

    ``arrivals``: incident, account, arrival, plus the ``until`` column.
    """
    ask = arrivals.select("incident", F.col("account").alias("src"), "arrival", F.col(until).alias("until"))
    moves = transfers.select("txn_id", "src", "dst", "amount", "epoch", "channel")
    return interval_join(ask, moves, ["src"], "epoch", "arrival", "until").select("incident", "txn_id", "src", "dst", "amount", "epoch", "channel")


def intercepted(parcels: DataFrame, freezes: DataFrame) -> DataFrame:
    """Parcels a freeze catches: it lands no later than the departure.

    ``parcels``: incident, parcel, account, departs. ``freezes``: incident, account, at_minute.
    """
    return parcels.join(freezes, ["incident", "account"]).where(F.col("departs") >= F.col("at_minute"))


def payee_sets(edges: DataFrame, keys: Sequence[str] = (), hot: int = 500) -> tuple[DataFrame, DataFrame]:
    """Payees split by how busy they are.

    Returns the distinct (payer, payee) rows of payees with 2..``hot`` payers, and per
    payer its number of payees and the sorted list of its hot payees.
    """
    keys = list(keys)
    sets = edges.select(*keys, F.col("src").alias("account"), "dst").distinct()
    marked = sets.join(sets.groupBy(*keys, "dst").agg(F.count(F.lit(1)).alias("payers")), [*keys, "dst"])
    busy = marked.where(F.col("payers") > hot).groupBy(*keys, "account").agg(F.sort_array(F.collect_list("dst")).alias("hot"))
    size = sets.groupBy(*keys, "account").agg(F.count(F.lit(1)).alias("n"))
    none = F.array().cast(f"array<{edges.schema['dst'].dataType.simpleString()}>")
    facts = size.join(busy, [*keys, "account"], "left").withColumn("hot", F.coalesce("hot", none))
    return marked.where(F.col("payers").between(2, hot)).select(*keys, "account", "dst"), facts


def common_payees(edges: DataFrame, keys: Sequence[str] = (), hot: int | None = None) -> DataFrame:
    """Pairs of payers (a < b) with the exact number of payees they share.

    All pairs are listed, which grows with the square of a payee's payers; where the pairs
    of interest are known, ``listed_common_payees`` counts just those. With ``hot`` only
    payees of at most that many payers pair their payers, the others are then added to
    those pairs' counts; ``graph.recipient_jaccard`` finds the best of the rest.
    """
    keys = list(keys)
    if hot is None:
        sets = edges.select(*keys, F.col("src").alias("account"), "dst").distinct()
        side = lambda c: sets.withColumnRenamed("account", c)
        return side("a").join(side("b"), [*keys, "dst"]).where("a < b").groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("common"))
    cold, facts = payee_sets(edges, keys, hot)
    side = lambda c: cold.withColumnRenamed("account", c)
    met = side("a").join(side("b"), [*keys, "dst"]).where("a < b").groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("cold"))
    crowd = facts.where(F.size("hot") > 0)
    f = lambda c, h: crowd.select(*keys, F.col("account").alias(c), F.col("hot").alias(h))
    rows = met.join(f("a", "ha"), [*keys, "a"], "left").join(f("b", "hb"), [*keys, "b"], "left")
    extra = F.coalesce(F.array_size(F.array_intersect("ha", "hb")), F.lit(0))
    return rows.select(*keys, "a", "b", (F.col("cold") + extra).alias("common"))


def listed_common_payees(edges: DataFrame, pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``pairs`` (keys, a, b) with the number of payees both pay, 0 included; linear in the pairs' payees."""
    keys = list(keys)
    sets = edges.select(*keys, F.col("src").alias("account"), "dst").distinct()
    asked = pairs.select(*keys, "a", "b").distinct()
    mine = asked.join(sets.withColumnRenamed("account", "a"), [*keys, "a"])
    both = mine.join(sets.withColumnRenamed("account", "b"), [*keys, "b", "dst"], "left_semi").groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("common"))
    return asked.join(both, [*keys, "a", "b"], "left").fillna(0, ["common"])


def truth_join(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Decisions with truth and layer; an unlabelled account is innocent."""
    return decisions.join(labels.select("account", "is_mule", "layer_index"), "account", "left").withColumn(
        "is_mule", F.coalesce("is_mule", F.lit(False))
    ).withColumn("layer_index", F.coalesce(F.col("layer_index"), F.lit(-1)))


def watchlist_exposure(edges: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Per account: neighbours, and those on the watchlist from training rings."""
    both = edges.select(F.col("src").alias("account"), F.col("dst").alias("peer")).unionByName(
        edges.select(F.col("dst").alias("account"), F.col("src").alias("peer"))
    ).distinct()
    marked = both.join(watchlist.select(F.col("account").alias("peer"), F.lit(1).alias("known")), "peer", "left")
    return marked.groupBy("account").agg(
        F.count(F.lit(1)).alias("neighbours"), F.count("known").alias("known_neighbours")
    ).withColumn("known_share", F.col("known_neighbours") / F.col("neighbours"))


def node_profiles(nodes: DataFrame, scores: DataFrame, attributions: DataFrame, explanations: DataFrame) -> DataFrame:
    """Node with score, attributions and explanation; missing parts are empty."""
    parts = attributions.groupBy("node").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "feature", F.format_string("%.3f", "contribution")))), ",").alias("attributions")
    )
    return (
        nodes.select("node").join(scores, "node", "left").join(parts, "node", "left").join(explanations, "node", "left")
        .fillna("", ["attributions", "explanation"])
    )


def known_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose two ends are known nodes; unparsable amounts become 0."""
    ends = lambda c: nodes.select(F.col("node").alias(c))
    amount = F.coalesce(F.expr("try_cast(amount AS double)"), F.lit(0.0))
    return (
        links.join(ends("source"), "source", "left_semi").join(ends("target"), "target", "left_semi")
        .select("source", "target", amount.alias("amount"))
    )


def endpoint_lookup(rows: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """A node attribute attached to both ends; rows lacking an end are kept out and countable."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col(value).alias(f"{c}_{value}"))
    return rows.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
