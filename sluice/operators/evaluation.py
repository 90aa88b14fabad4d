"""Scoring of detectors, plans and policies."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..core import exact_quantiles, running_sum
from .ranking import top_ranked

CELLS = 4096


def policy_summary(outcomes: DataFrame) -> DataFrame:
    """Recovery and harm per policy, and latency where it was measured.

    ``outcomes``: incident, policy, amount, prevented, innocent, mules, frozen,
    first_freeze and, if known, solve_ms.
    """
    rows = outcomes.withColumn("rate", F.col("prevented") / F.greatest("amount", F.lit(1.0)))
    q = exact_quantiles(rows, ["policy"], "rate", {"median_recovery": 0.5, "p10": 0.1, "p90": 0.9})
    ff = exact_quantiles(rows, ["policy"], "first_freeze", {"median_first_freeze": 0.5})
    agg = rows.groupBy("policy").agg(
        F.count(F.lit(1)).alias("incidents"), F.avg("rate").alias("mean_recovery"),
        F.sum("prevented").alias("total_prevented"), F.sum("amount").alias("total_amount"),
        F.sum("innocent").alias("innocent_total"),
        F.coalesce(F.try_divide(F.sum("innocent"), F.sum("frozen")), F.lit(0.0)).alias("innocent_rate"),
        F.coalesce(F.try_divide(F.sum("mules"), F.sum("frozen")), F.lit(0.0)).alias("precision"),
    )
    out = agg.join(q, "policy").join(ff, "policy", "left")
    if "solve_ms" not in outcomes.columns:
        return out
    return out.join(exact_quantiles(rows, ["policy"], "solve_ms", {"p50_ms": 0.5, "p95_ms": 0.95}), "policy", "left")


def recovery_histogram(outcomes: DataFrame, buckets: int = 10) -> DataFrame:
    rate = F.col("prevented") / F.greatest("amount", F.lit(1.0))
    cell = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(rate * buckets)))
    return outcomes.groupBy("policy", cell.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def curve(outcomes: DataFrame, grid: str, policies: Sequence[str]) -> DataFrame:
    """Mean rate per grid point with a column per policy."""
    return outcomes.groupBy(grid).pivot("policy", list(policies)).agg(F.avg("rate"))


def gap_summary(rows: DataFrame) -> DataFrame:
    """``rows``: incident, achieved, bound."""
    gap = F.greatest(F.lit(0.0), (F.col("bound") - F.col("achieved")) / F.greatest("bound", F.lit(1e-9)))
    g = rows.withColumn("gap", gap)
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap")).join(
        exact_quantiles(g, [], "gap", {"median_gap": 0.5})
    )


def confusion(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and rates from boolean ``predicted`` and ``actual``; undefined rates are 0."""
    p, a = F.col("predicted"), F.col("actual")
    c = rows.groupBy(*keys).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn")
    )
    div = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumn("precision", div(tp, tp + fp)).withColumn("recall", div(tp, tp + fn))
    return c.withColumns({
        "f1": div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        "accuracy": div(tp + tn, tp + fp + fn + tn), "fpr": div(fp, fp + tn), "fnr": div(fn, fn + tp),
    })


def rank_normalise(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Midpoint of the tied block over n, so only the order of a model counts.

    Equal scores are counted first and the running count splits by score range, so
    a model scoring very many accounts is not one sort.
    """
    keys = list(keys)
    blocks = scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("k"))
    upto = running_sum(blocks, keys, F.floor(F.col("score") * CELLS), ["score"], F.col("k"), "upto")
    n = blocks.groupBy(*keys).agg(F.sum("k").alias("n"))
    mid = (F.col("upto") - F.col("k") + (F.col("k") - 1) / 2.0 + 1) / F.col("n")
    value = upto.join(n, keys).select(*keys, "score", F.round(F.when(F.col("n") == 1, 1.0).otherwise(mid), 6).alias("normalised"))
    return scores.join(value, [*keys, "score"])


def apply_budget(scores: DataFrame, keys: Sequence[str], budget: int, threshold: float) -> DataFrame:
    """Accounts flagged within the budget and at or above the threshold."""
    return top_ranked(scores, keys, [F.desc("score"), F.col("account")], budget).where(F.col("score") >= threshold)


def score_order(scores: DataFrame, keys: Sequence[str], out: str = "rank") -> DataFrame:
    """Full rank by score desc, id asc, split by score range."""
    from ..core import ordinal

    return ordinal(scores, keys, -F.floor(F.col("score") * CELLS), [F.desc("score"), F.col("account")], out)


def decision_queue(scores: DataFrame, complaints: DataFrame, keys: Sequence[str], budget: int, threshold: float, parallel: int = 4, latency: int = 90) -> DataFrame:
    """Flag or clear with the second each decision takes effect.

    Flagged rows are a prefix of the order (both rules fall with the score), so the
    number committed before a row is its own rank.
    """
    ranked = score_order(scores, keys).join(complaints, "incident")
    flag = (F.col("rank") <= budget) & (F.col("score") >= threshold)
    wave = F.when(flag, F.ceil(F.col("rank") / parallel)).otherwise(F.ceil(F.least(F.col("rank"), F.lit(budget + 1)) / parallel))
    return ranked.select(
        *keys, "account", "score", "rank", F.when(flag, "flag").otherwise("clear").alias("decision"),
        (F.col("complaint_offset") + wave * latency).alias("t_decision_sec"),
    )


def first_crossings(ticks: DataFrame, complaints: DataFrame, threshold: float, budget: int, parallel: int = 4, latency: int = 90) -> DataFrame:
    """First tick each account crosses, then the dispatch queue after the complaint.

    ``ticks``: incident, model, t, account, score.
    """
    ranked = top_ranked(ticks.where(F.col("score") >= threshold), ["incident", "model", "t"], [F.desc("score"), F.col("account")], budget)
    first = ranked.groupBy("incident", "model", "account").agg(F.min(F.struct("t", "rank", "score")).alias("f")).select(
        "incident", "model", "account", F.col("f.t").alias("t_flag_sec"), F.col("f.rank").alias("rank"), F.col("f.score").alias("score")
    )
    queue = W.partitionBy("incident", "model").orderBy("t_flag_sec", "rank", "account")
    rows = first.withColumn("pos", F.row_number().over(queue)).join(complaints, "incident")
    at = F.greatest(F.col("t_flag_sec"), F.col("complaint_offset") + F.ceil(F.col("pos") / parallel) * latency)
    return rows.select("incident", "model", "account", "t_flag_sec", "rank", "pos", at.alias("t_decision_sec"))


def net_benefit_curve(outcomes: DataFrame, lambdas: Sequence[float]) -> DataFrame:
    """recovered - lambda * wrongly frozen per system, plus the do-nothing anchor at zero."""
    lam = F.explode(F.array(*[F.lit(float(x)) for x in lambdas])).alias("lam")
    totals = outcomes.groupBy("model").agg(F.sum("recovered").alias("r"), F.sum("wrongly_frozen").alias("w"))
    rows = totals.select("model", "r", "w", lam).select(F.col("model").cast("string").alias("model"), "lam", (F.col("r") - F.col("lam") * F.col("w")).alias("net_benefit"))
    anchor = totals.groupBy().agg(F.lit("no_system").alias("model")).select("model", lam, F.lit(0.0).alias("net_benefit"))
    return rows.unionByName(anchor)


def spread(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    mid = exact_quantiles(rows, keys, value, {"median": 0.5})
    return rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")).join(mid, list(keys))


def score_histogram(scores: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Counts over [0, 1] with the last bin closed and empty bins present."""
    cell = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")
    counted = scores.groupBy(*keys).agg(*[F.count_if(cell == b).alias(f"b{b}") for b in range(bins)])
    pairs = ", ".join(f"{b}, b{b}" for b in range(bins))
    return counted.selectExpr(*keys, f"stack({bins}, {pairs}) AS (bin, n)")


def pr_points(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative true and false positives at each distinct score, high to low.

    ``scored``: keys, score in [0, 1], positive (boolean). Rows collapse to one per
    distinct score before the running sums, which split by score range.
    """
    keys = list(keys)
    blocks = scored.groupBy(*keys, "score").agg(F.sum(F.col("positive").cast("int")).alias("p"), F.count(F.lit(1)).alias("k"))
    bucket = -F.floor(F.col("score") * CELLS)
    up = running_sum(blocks, keys, bucket, [F.desc("score")], F.col("p"), "tp")
    up = running_sum(up, keys, bucket, [F.desc("score")], F.col("k"), "taken")
    return up.withColumn("fp", F.col("taken") - F.col("tp"))


def best_threshold(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score with the best F1 over the precision-recall curve, within [0.01, 0.99]."""
    points = pr_points(scored, keys)
    total = scored.groupBy(*keys).agg(F.sum(F.col("positive").cast("int")).alias("pos"))
    pts = points.join(total, list(keys)).withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("taken") + F.col("pos")), F.lit(0.0)))
    return pts.groupBy(*keys).agg(F.max(F.struct(F.round("f1", 12).alias("f1"), "score")).alias("m")).select(
        *keys, F.col("m.f1").alias("best_f1"), F.least(F.greatest(F.col("m.score"), F.lit(0.01)), F.lit(0.99)).alias("threshold")
    )


def grid_thresholds(scored: DataFrame, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """F1 at fixed thresholds, one pass over the scores."""
    pos = F.col("positive")
    aggs = []
    for i, g in enumerate(grid):
        hit = F.col("score") >= g
        aggs += [F.count_if(hit & pos).alias(f"tp{i}"), F.count_if(hit).alias(f"k{i}")]
    row = scored.groupBy(*keys).agg(F.count_if(pos).alias("pos"), *aggs)
    pairs = ", ".join(f"CAST({g!r} AS double), tp{i}, k{i}" for i, g in enumerate(grid))
    long = row.selectExpr(*keys, "pos", f"stack({len(grid)}, {pairs}) AS (threshold, tp, k)")
    return long.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("k") + F.col("pos")), F.lit(0.0)))


def average_precision(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean precision at every positive, ties by account id; and ranked AUC."""
    keys = list(keys)
    ranked = score_order(scored, keys)
    hits = running_sum(ranked, keys, -F.floor(F.col("score") * CELLS), [F.desc("score"), "account"], F.col("positive").cast("int"), "tp")
    ap = hits.where("positive").groupBy(*keys).agg(F.avg(F.col("tp") / F.col("rank")).alias("average_precision"))
    return scored.select(*keys).distinct().join(ap, keys, "left").fillna(0.0, ["average_precision"])


def auc(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probability a positive outranks a negative, ties counting half."""
    pts = pr_points(scored, keys)
    neg = F.col("k") - F.col("p")
    wins = pts.groupBy(*keys).agg(F.sum(neg * (F.col("tp") - F.col("p") / 2.0)).alias("wins"), F.sum("p").alias("pos"), F.sum(neg).alias("neg"))
    return wins.select(*keys, F.try_divide(F.col("wins"), F.col("pos") * F.col("neg")).alias("auc"))


def evaluate_tier(scored: DataFrame, keys: Sequence[str], ks: Sequence[int] = (50, 100)) -> DataFrame:
    from .ranking import precision_at

    flags = scored.withColumn("predicted", F.col("score") >= 0.5).withColumn("actual", F.col("positive"))
    half = confusion(flags, keys).select(*keys, "precision", "recall", (F.col("tp") + F.col("fp")).alias("flagged"))
    return average_precision(scored, keys).join(precision_at(scored, keys, ks), list(keys), "left").join(half, list(keys))


def operating_points(scored: DataFrame, keys: Sequence[str], budget: int, target_fpr: float, native: float) -> DataFrame:
    """Thresholds of the three modes with their false and true positive rates.

    Equal-FPR takes the score of the round(fpr*n)-th innocent. The rank is read off
    the running innocent count per distinct score.
    """
    keys = list(keys)
    innocents = scored.where(~F.col("positive"))
    n = innocents.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    allowed = F.bround(F.col("n") * target_fpr, 0)
    pts = pr_points(innocents, keys).join(n, keys)
    cut = pts.where(F.col("taken") >= allowed).groupBy(*keys).agg(F.max("score").alias("at"))
    equal = n.join(cut, keys, "left").select(
        *keys, F.lit("equal_fpr").alias("mode"), F.lit(10**6).alias("budget"),
        F.when(allowed >= 1, F.col("at")).otherwise(F.col("top") + 1e-9).alias("threshold"),
    )
    fixed = n.select(*keys, F.explode(F.array(
        F.struct(F.lit("equal_alert_budget").alias("mode"), F.lit(budget).alias("budget"), F.lit(1e-9).alias("threshold")),
        F.struct(F.lit("native").alias("mode"), F.lit(10**6).alias("budget"), F.lit(float(native)).alias("threshold")),
    )).alias("p")).select(*keys, "p.*")
    points = equal.unionByName(fixed)
    hit = F.col("score") >= F.col("threshold")
    rates = scored.join(points, keys).groupBy(*keys, "mode", "budget", "threshold").agg(
        F.coalesce(F.try_divide(F.count_if(hit & ~F.col("positive")), F.count_if(~F.col("positive"))), F.lit(0.0)).alias("fpr"),
        F.coalesce(F.try_divide(F.count_if(hit & F.col("positive")), F.count_if(F.col("positive"))), F.lit(0.0)).alias("tpr"),
    )
    return rates


def adjusted_rand(assignment: DataFrame, truth: DataFrame) -> DataFrame:
    """Agreement of communities with true rings over labelled accounts they share.

    ``assignment``: account, community. ``truth``: account, ring.
    """
    both = assignment.join(truth, "account")
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    cells = both.groupBy("community", "ring").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("community").agg(F.sum("n").alias("n"))
    cols = cells.groupBy("ring").agg(F.sum("n").alias("n"))
    total = cells.agg(F.sum("n").alias("shared"), F.sum(pairs("n")).alias("idx"))
    a = rows.agg(F.sum(pairs("n")).alias("a"), F.count(F.lit(1)).alias("communities"))
    b = cols.agg(F.sum(pairs("n")).alias("b"), F.count(F.lit(1)).alias("rings"))
    t = truth.agg(F.count(F.lit(1)).alias("truth"))
    one = total.join(a).join(b).join(t)
    expected = F.col("a") * F.col("b") / (F.col("shared") * (F.col("shared") - 1) / 2.0)
    best = (F.col("a") + F.col("b")) / 2.0
    return one.select(
        F.when(best == expected, 1.0).otherwise((F.col("idx") - expected) / (best - expected)).alias("ari"),
        F.col("shared").alias("accounts"), "communities", "rings", (F.col("shared") / F.greatest("truth", F.lit(1))).alias("coverage"),
    )


def rule_fraction(fired: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted share of rules fired. ``fired``: account and one boolean per rule."""
    total = sum(weights.values()) or 1.0
    hit = sum((F.when(F.col(r), F.lit(w)).otherwise(0.0) for r, w in weights.items()), F.lit(0.0))
    return fired.select("account", (hit / total).alias("rule_fraction"))


# Cumulative Poisson(1) probabilities, and the modulus and factors of the draws.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
MODULUS, FACTORS = 2147483647, (1103515245, 69069, 48271, 16807)


def resampling_weights(case_id: int, rounds: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of a case in each round, from whole-number arithmetic that SQL can repeat."""
    a, b, c, d = FACTORS
    x = (case_id % MODULUS * a + np.arange(rounds, dtype=np.int64) * b + seed) % MODULUS
    for factor in (c, d, c):
        x = ((x ^ (x >> 13)) * factor + 1) % MODULUS
    return np.searchsorted(np.array(POISSON), x / MODULUS, side="left")


def paired_bootstrap(pairs: DataFrame, rounds: int = 5000, seed: int = 7) -> DataFrame:
    """Interval of the mean paired difference over resampled cases.

    Each case draws a Poisson(1) weight per round from its own hashed seed (the
    large-sample form of resampling with replacement). A task sums the weights and weighted
    differences of all its cases as vectors over the rounds, so it sends one row a round
    however many cases it has. ``pairs``: case_id (a long), a, b; cases without both are left out.
    """
    known = pairs.select(F.col("case_id").cast("long").alias("case_id"), (F.col("a") - F.col("b")).cast("double").alias("d")).where("d IS NOT NULL AND case_id IS NOT NULL")

    def sums(batches):
        total, weight, any_ = np.zeros(rounds), np.zeros(rounds, np.int64), False
        for batch in batches:
            for case, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = resampling_weights(case, rounds, seed)
                total, weight, any_ = total + d * w, weight + w, True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds, dtype=np.int32)), pa.array(total), pa.array(weight)], names=["round", "total", "weight"])

    drawn = known.mapInArrow(sums, "round int, total double, weight bigint")
    means = drawn.groupBy("round").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("m"))
    ci = exact_quantiles(means, [], "m", {"low": 0.025, "high": 0.975})
    obs = known.agg(F.avg("d").alias("mean_difference"), F.count(F.lit(1)).alias("cases"))
    return obs.join(ci).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def half_tail(k: int, n: int) -> float:
    """P(X <= k) of a fair binomial: the incomplete beta function I(1/2; n - k, k + 1).

    Its continued fraction (modified Lentz) converges within some multiple of the root of
    n steps, whatever the counts; the side on which it converges fast is taken.
    """
    if k >= n:
        return 1.0
    a, b = float(n - k), float(k + 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - (a + b) * math.log(2))
    flip = 0.5 > (a + 1) / (a + b + 2)
    if flip:
        a, b = b, a
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1 - (a + b) * 0.5 / (a + 1)) or tiny)
    value, m = d, 0
    while True:
        m += 1
        for step in (m * (b - m) * 0.5 / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * 0.5 / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    tail = front * value / a
    return 1 - tail if flip else tail


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Exact two-sided test on discordant pairs. ``pairs``: a_correct, b_correct.

    The counts are one row, so are the tails; no array as long as the counts is built.
    """
    b = F.count_if(F.col("a_correct") & ~F.col("b_correct"))
    c = F.count_if(~F.col("a_correct") & F.col("b_correct"))

    def tails(batches):
        for batch in batches:
            rows = batch.to_pylist()
            p = [min(1.0, 2 * half_tail(min(r["b"], r["c"]), r["b"] + r["c"])) for r in rows]
            yield batch.append_column("p_value", pa.array(p, pa.float64()))

    return pairs.agg(b.alias("b"), c.alias("c")).mapInArrow(tails, "b bigint, c bigint, p_value double")


def weakness_note(cases: DataFrame, ours: int) -> DataFrame:
    """One sentence per case on where our system loses.

    ``cases``: incident, model, net_benefit, fn, fp, wrongly_frozen, first_hop.
    """
    mine = cases.where(F.col("model") == ours).drop("model")
    rival = cases.where(F.col("model") != ours).groupBy("incident").agg(
        F.max(F.struct("net_benefit", (-F.col("model")).alias("neg"), "fn", "fp")).alias("r")
    )
    rows = mine.join(rival, "incident", "left")
    whole = lambda c: F.format_string("%d", F.round(c, 0).cast("bigint"))
    note = (
        F.when(
            F.col("r.net_benefit") > F.col("net_benefit"),
            F.concat(
                F.lit("system "), (-F.col("r.neg")).cast("string"), F.lit(" has the better net benefit ("), whole(F.col("r.net_benefit")),
                F.lit(" against "), whole(F.col("net_benefit")), F.lit("); "),
                F.when(F.col("fn") > F.col("r.fn"), F.concat(F.lit("missed mules: "), F.col("fn").cast("string")))
                .otherwise(F.concat(F.lit("innocent frozen: "), F.col("fp").cast("string"))),
            ),
        )
        .when(F.col("fn") > 0, F.concat(F.lit("best here, missed mules: "), F.col("fn").cast("string"), F.lit(", first correct flag at hop "), F.coalesce(F.col("first_hop").cast("string"), F.lit("none"))))
        .when(F.col("fp") > 0, F.concat(F.lit("best here, innocent frozen: "), F.col("fp").cast("string"), F.lit(", locking "), whole(F.col("wrongly_frozen"))))
        .otherwise("best here without a miss or a wrong freeze")
    )
    return rows.select("incident", note.alias("note"))
