"""Rules that rarely fire on the shared tables, on literal rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from sluice.operators import cards, flows, joins
from sluice.sources import datasets

TX = "txn_id bigint, src bigint, dst bigint, amount double, epoch bigint, channel string"


def tx(spark, rows):
    return spark.createDataFrame([(i, *r, "UPI") for i, r in enumerate(rows)], TX)


def test_peak_fanout_window_is_open_on_the_left(spark):
    rows = [(1, 10, 5.0, 0), (1, 11, 5.0, 100), (1, 12, 5.0, 599), (1, 10, 5.0, 600), (1, 13, 5.0, 600), (2, 9, 1.0, 0), (2, 9, 1.0, 1)]
    got = {r.account: r.max_fanout_10min for r in flows.peak_fanout(tx(spark, rows)).collect()}
    assert got == {1: 4, 2: 1}


def test_peak_fanout_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 3)), int(10 + rng.integers(0, 6)), 1.0, int(rng.integers(86_000, 90_000))) for _ in range(300)]
    pdf = pd.DataFrame(rows, columns=["src", "dst", "a", "t"])
    want = {s: max(g[(g.t > t - 600) & (g.t <= t)].dst.nunique() for t in g.t) for s, g in pdf.groupby("src")}
    got = {r.account: r.max_fanout_10min for r in flows.peak_fanout(tx(spark, rows)).collect()}
    assert got == want


def test_residence_counts_a_credit_of_the_same_second(spark):
    rows = [(9, 1, 50.0, 100), (1, 2, 10.0, 100), (1, 2, 10.0, 99), (1, 3, 10.0, 86_400 * 3)]
    got = {r.txn_id: r.gap for r in joins.residence(tx(spark, rows)).collect()}
    assert got == {1: 0, 3: 86_400 * 3 - 100}


def test_shared_infrastructure_skips_large_groups(spark):
    rows = [(i, 1, i // 2) for i in range(30)]
    acc = spark.createDataFrame(rows, "account int, device int, ip int")
    got = joins.shared_infrastructure(acc, ["device", "ip"], largest=25).collect()
    assert len(got) == 15 and {r.weight for r in got} == {2.5}
    assert joins.shared_infrastructure(acc, ["device", "ip"]).count() == 30 * 29 // 2
    groups = joins.shared_groups(acc, ["device", "ip"], least=26).collect()
    assert {(r.column, r.value, r.n) for r in groups} == {("device", "1", 30)} and len(groups) == 30


def test_common_payees_are_whole_without_a_limit(spark):
    rows = [(payer, 50, 1.0, payer) for payer in range(4)] + [(0, 51, 1.0, 9), (1, 51, 1.0, 9)]
    edges = tx(spark, rows)
    got = {(r.a, r.b): r.common for r in joins.common_payees(edges).collect()}
    assert got == {(a, b): 2 if (a, b) == (0, 1) else 1 for a in range(4) for b in range(a + 1, 4)}
    asked = spark.createDataFrame([(0, 1), (2, 3), (0, 99)], "a bigint, b bigint")
    assert {(r.a, r.b): r.common for r in joins.listed_common_payees(edges, asked).collect()} == {(0, 1): 2, (2, 3): 1, (0, 99): 0}


def test_recruiter_ladder(spark):
    rows = [(1, 100 + i, 500.0, i) for i in range(20)] + [(2, 100 + i, 500.0, i) for i in range(5)] + [(3, 100 + i, 50_000.0, i) for i in range(9)]
    got = {r.account: r["class"] for r in flows.recruiters(tx(spark, rows)).collect()}
    assert got == {1: "INDUSTRIAL_ORCHESTRATOR", 2: "FACILITATOR"}


def test_behaviour_defaults_and_exit_share(spark):
    rows = [(1, 2, 100.0, 60), (1, 7, 300.0, 120), (3, 1, 400.0, 0)]
    ex = spark.createDataFrame([(7, "atm")], "account bigint, exit_kind string")
    got = {r.account: r for r in flows.behaviour(tx(spark, rows), ex).collect()}
    assert got[1].exit_share == 0.75 and got[1].forward_prob == 0.97 and got[1].split_count == 2
    assert got[1].delay_minutes == pytest.approx(1.5) and got[3].delay_minutes == 60.0


def test_amount_entropy_is_zero_for_constant_and_single(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("b", 1.0), ("c", 1.0), ("c", 2.0)], "card string, amt double")
    got = {r.card: r.amount_entropy for r in cards.amount_entropy(df).collect()}
    assert got == {"a": 0.0, "b": 0.0, "c": 1.0}


def test_foreign_columns_error_names_what_is_there():
    with pytest.raises(ValueError, match="nonsense"):
        datasets.resolve_columns(["nonsense", "sender"])


def test_missing_dataset_files_are_all_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError) as err:
        datasets.load_dataset(spark, str(tmp_path))
    assert all(n in str(err.value) for n in ("accounts", "transactions", "labels", "episodes"))


def test_dataset_round_trip(spark, tmp_path):
    from sluice.schema import DATASET

    for name, ddl in DATASET.items():
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert set(datasets.load_dataset(spark, str(tmp_path))) == set(DATASET)


def test_reset_windows_restart_after_expiry(spark):
    day = 86_400
    legs = spark.createDataFrame(
        [(1, "OUT", 5, 10.0, 0), (1, "OUT", 6, 20.0, day), (1, "IN", 7, 40.0, day + 1), (1, "OUT", 5, 80.0, day + 2)],
        "account bigint, direction string, peer bigint, amount double, epoch bigint",
    )
    r = flows.reset_aggregates(legs).first()
    assert (r.total_out_24h, r.total_in_24h, r.txn_count_24h) == (80.0, 40.0, 2)
    assert (r.total_out_7d, r.txn_count_7d, r.unique_counterparties_7d) == (110.0, 4, 3)
