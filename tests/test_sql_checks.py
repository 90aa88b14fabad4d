"""Registered queries against DuckDB on the smallest tables.

A spread of cheap queries runs by default; SLUICE_ALL_CHECKS=1 runs every one.
"""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check  # noqa: E402
from sluice.plans import catalog  # noqa: E402

FAST = (
    "scan_transfers scan_incidents warehouse_views foreign_csv_ingest edge_list_load finalised_transfers sealed_packages visible_edges "
    "tick_schedule quality_report residence_asof shared_infrastructure cooccurrence_edges graph_export flow_aggregate window_ratios "
    "amount_features population_deviation ring_summary behaviour_fit card_node_features reset_aggregates enforcement_stats fairness "
    "policy_summary case_outcomes peak_fanout rank_normalise decision_queue stolen_balance context_rank average_precision audit_verification "
    "block_verification top_subgraph draw_list recipient_overlap reference_numbers risk_factors flexible_timestamps pagerank recipient_jaccard "
    "short_cycles temporal_reach taint_conservation account_profile risk_fusion ensemble_metrics operating_points stream_identity"
).split()


def names():
    return list(catalog.CHECK) if os.environ.get("SLUICE_ALL_CHECKS") else FAST


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, con, small, name):
    message, ok = check.compare(spark, con, small, name, catalog.RUN[name], catalog.CHECK[name])
    assert ok or message == "ok 0", message


def test_every_check_has_a_query():
    assert set(catalog.CHECK) <= set(catalog.RUN)


def test_no_filter_defeats_the_scan(spark, small):
    """Column pruning and a date-free filter reach the parquet scan."""
    from sluice.sources import adapters as A

    plan = A.table(spark, small, "events").where("event_type = 'error'").select("user_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan
