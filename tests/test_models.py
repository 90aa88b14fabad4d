from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check  # noqa: E402
from sluice.operators import detectors, forest  # noqa: E402
from sluice.plans import catalog  # noqa: E402


def test_isolation_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    x[:6] += 9
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "node bigint, a double, b double, c double")
    trees = forest.fit_forest(df, "node", ["a", "b", "c"], trees=30, sample=128)
    assert trees.select("tree").distinct().count() == 30
    assert trees.where("depth = 0").agg(F.max("size")).first()[0] == 128
    got = forest.score_forest(df, ["node"], ["a", "b", "c"], trees, sample=128)
    top = [r.node for r in got.orderBy(F.desc("raw")).limit(6).collect()]
    assert set(top) == set(range(6))
    again = forest.score_forest(df.repartition(5), ["node"], ["a", "b", "c"], forest.fit_forest(df.repartition(3), "node", ["a", "b", "c"], trees=30, sample=128), sample=128)
    assert again.exceptAll(got).isEmpty()
    why = forest.ablation_importance(df.where("node < 3"), "node", ["a", "b", "c"], trees)
    assert why.count() == 9


def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(40):
        for a in range(15):
            y = float(rng.random() < 0.2)
            out.append((i, a, y, float(y * 2 + rng.normal()), float(rng.normal())))
    return spark.createDataFrame(out, "incident bigint, account bigint, label double, f double, g double")


def test_detectors_separate_the_classes(spark):
    df = rows(spark)
    fit, held = detectors.calibration_split(df)
    assert fit.select("incident").distinct().intersect(held.select("incident").distinct()).isEmpty() and not held.isEmpty()
    linear, weights = detectors.train_linear(df, ["f", "g"])
    trees = detectors.train_trees(df, ["f", "g"], trees=5, depth=3)
    assert weights["f"] > abs(weights["g"])
    for score in (linear, trees):
        s = score(df).join(df.select("incident", "account", "label"), ["incident", "account"]).groupBy("label").agg(F.avg("score").alias("m")).collect()
        m = {r.label: r.m for r in s}
        assert m[1.0] > m[0.0] + 0.1
    assert trees(df).where("score < 0.0001 OR score > 0.9999").isEmpty()


@pytest.fixture(scope="module")
def broke(small, tmp_path_factory):
    """The smallest tables with mean balances of -1, where the burst divides by zero."""
    folder = tmp_path_factory.mktemp("broke")
    for source in Path(small).glob("*.parquet"):
        if source.name != "customer.parquet":
            (folder / source.name).symlink_to(source)
    duckdb.connect().execute(
        f"COPY (SELECT * REPLACE (CASE WHEN c_custkey % 7 = 3 THEN -1.0 ELSE c_acctbal END AS c_acctbal) FROM '{small}/customer.parquet') TO '{folder}/customer.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["anomaly_features", "interaction_features"])
def test_features_of_a_balance_of_minus_one_equal_the_sql(spark, broke, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{broke}/{t}.parquet'")
    message, ok = check.compare(spark, con, broke, name, catalog.RUN[name], catalog.CHECK[name])
    assert ok, message


def test_forest_and_ablation_stand_infinite_features(spark, broke):
    scored = catalog.RUN["isolation_forest"](spark, broke)
    n = spark.read.parquet(f"{broke}/customer.parquet").count()
    assert scored.count() == n and scored.where("raw IS NULL OR isnan(raw) OR raw <= 0 OR raw >= 1").isEmpty()
    assert scored.select(F.round("raw", 6)).distinct().count() > 10
    assert catalog.RUN["ablation_importance"](spark, broke).count() == 3 * n


def test_case_signals_take_legs_of_candidates_only(spark, small, monkeypatch):
    from sluice.operators import signals
    from sluice.plans import scoring
    from sluice.sources import adapters as A

    seen, whole = [], signals.signal_features
    monkeypatch.setattr(signals, "signal_features", lambda prof, legs, *rest: (seen.append(legs), whole(prof, legs, *rest))[1])
    scoring.case_signal_score(spark, small)
    pool = A.candidates(spark, small)
    assert not seen[0].isEmpty()
    assert seen[0].join(pool, ["incident", "account"], "left_anti").isEmpty()
