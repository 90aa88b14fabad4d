"""Pipeline stages shared by incident queries, written once per session and folder.

Incident queries build on the same trace, candidates and rollouts. A stage is
checkpointed in the shared folder on first use and read from there afterwards;
``forget`` drops all stages, as after new data in a folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trace as T
from ..session import cut
from ..sources import adapters as A

_DONE: dict = {}


def stage(spark, sf, name, build):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _DONE:
        _DONE[key] = cut(build())
    return _DONE[key]


def kept(spark, sf, name, build):
    """For what its operator writes itself, as far as it has to."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _DONE:
        _DONE[key] = build()
    return _DONE[key]


def forget() -> None:
    _DONE.clear()


def flows(spark, sf, until="complaint"):
    return stage(spark, sf, f"flows-{until}", lambda: T.taint_flows(A.incidents(spark, sf), A.transfers(spark, sf), A.exits(spark, sf), until))


def touched(spark, sf):
    return stage(spark, sf, "touched", lambda: T.taint_accounts(A.incidents(spark, sf), flows(spark, sf)))


def packed(spark, sf, hops=T.CANDIDATE_HOPS):
    cutoffs = A.incidents(spark, sf).select("incident", F.col("complaint").alias("until"))
    # written by the operator
    return kept(spark, sf, f"frontier-{hops}", lambda: T.packed_frontier(touched(spark, sf), A.transfers(spark, sf), A.exits(spark, sf), cutoffs, hops))


def frontier(spark, sf, hops=T.CANDIDATE_HOPS):
    return packed(spark, sf, hops).rows()
