"""The split windows give what one window over the whole key gives."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice import core


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    # key 0 holds two thirds of the rows
    key = np.where(rng.random(600) < 0.66, 0, rng.integers(1, 6, 600))
    t = rng.integers(0, 6 * core.DAY, 600)
    t[:120] = t[120:240]  # ties
    pdf = pd.DataFrame({"id": range(600), "key": key, "t": t, "v": rng.integers(1, 50, 600).astype(float)})
    return pdf, spark.createDataFrame(pdf)


def test_running_sum_includes_peers(skewed):
    pdf, df = skewed
    got = core.running_sum(df, ["key"], F.floor(F.col("t") / core.DAY), ["t"], F.col("v"), "s").select("id", "s").toPandas()
    want = {r.id: pdf[(pdf.key == r.key) & (pdf.t <= r.t)].v.sum() for r in pdf.itertuples()}
    assert all(want[r.id] == r.s for r in got.itertuples())


def test_ordinal_is_the_row_number(skewed):
    pdf, df = skewed
    got = core.ordinal(df, ["key"], F.floor(F.col("t") / core.HOUR), ["t", "id"], "o").toPandas()
    want = pdf.sort_values(["t", "id"]).groupby("key").cumcount() + 1
    assert (got.set_index("id").o.sort_index() == want.sort_index()).all()


def test_ordinal_without_keys_and_descending(skewed):
    pdf, df = skewed
    got = core.ordinal(df, [], -F.floor(F.col("t") / core.DAY), [F.desc("t"), F.col("id")], "o").toPandas().set_index("id").o
    want = pd.Series(range(1, 601), index=pdf.sort_values(["t", "id"], ascending=[False, True]).id)
    assert (got.sort_index() == want.sort_index()).all()


def test_latest_before_carries_over_days(skewed):
    pdf, df = skewed
    mark = F.when(F.col("id") % 5 == 0, F.col("t"))
    got = core.latest_before(df, ["key"], "t", mark, "m", tie=F.col("id") % 5).toPandas()
    marks = pdf[pdf.id % 5 == 0]
    for r in got.itertuples():
        seen = marks[(marks.key == r.key) & (marks.t <= r.t)].t
        assert (np.isnan(r.m) and seen.empty) or r.m == seen.max()


@pytest.mark.parametrize("cells", [2, 64, 1024])
def test_exact_quantiles_match_numpy(skewed, cells):
    pdf, df = skewed
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = core.exact_quantiles(df, ["key"], "v", probs, cells=cells).toPandas().set_index("key")
    for k, g in pdf.groupby("key"):
        for name, p in probs.items():
            assert got.loc[k, name] == pytest.approx(np.quantile(g.v, p))


def test_exact_quantiles_nearest_and_no_keys(skewed):
    pdf, df = skewed
    got = core.exact_quantiles(df, [], "v", {"q": 0.25}, method="nearest").first().q
    assert got == sorted(pdf.v)[int(599 * 0.25 + 0.5)]


def test_interval_join(spark):
    asks = spark.createDataFrame([(1, 10, 7000, "a"), (1, 50, 40, "b"), (2, 0, 3600, "c")], "k int, lo int, hi int, n string")
    rows = spark.createDataFrame([(1, 10), (1, 3600), (1, 7000), (1, 7001), (2, 3600), (3, 5)], "k int, t int")
    got = {(r.n, r.t) for r in core.interval_join(asks, rows, ["k"], "t", "lo", "hi").collect()}
    assert got == {("a", 10), ("a", 3600), ("a", 7000), ("c", 3600)}


def test_attributions_of_one_row_are_ranked_without_a_sort_across_rows(spark, small):
    from sluice.operators import ranking
    from sluice.plans import limits_sets, scalars

    data = [(1, [("b", -2.0), ("a", 2.0), ("c", None), ("d", float("nan")), ("e", 0.5)]), (2, [("x", -0.0), ("w", 0.0)]), (3, [])]
    rows = spark.createDataFrame(data, "node bigint, parts array<struct<feature: string, contribution: double>>")
    got = ranking.strongest(rows, ["node"], F.col("parts"), 4)
    want = ranking.top_attributions(rows.select("node", F.explode("parts").alias("p")).select("node", "p.*"), ["node"], 4)
    text = lambda d: sorted(str((r.node, r.rank, r.feature)) for r in d.collect())
    assert got.columns == want.columns and text(got) == text(want) and got.count() == 6
    for query in (limits_sets.top_attributions, scalars.reason_phrases):
        plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort " not in plan
