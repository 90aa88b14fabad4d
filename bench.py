"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_ONLY a comma list of
query names. Every query runs to completion into a no-op sink and starts without the
stages of earlier queries. Operators whose time per incident is published follow, over all
incidents of BENCH_INCIDENT_DIR (the tables of sf0.01 beside the others, named in the
output as ``incident_sample``), until BENCH_LIMIT seconds have passed; BENCH_PUBLISHED=0
leaves them out.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sluice.plans import catalog, stages
from sluice.session import local_session
from sluice.sources import adapters

HEADLINE = (
    "account_profile", "flow_aggregate", "window_ratios", "residence_asof", "residence_summary", "peak_fanout", "amount_features",
    "behaviour_fit", "six_signal_features", "card_node_features", "cooccurrence_edges", "identity_reuse", "reset_aggregates",
    "shared_recipients", "recipient_jaccard", "reciprocity", "pagerank", "short_cycles", "components", "decay_taint",
    "batch_scoring", "rank_normalise", "average_precision", "case_outcomes", "enforcement_stats", "audit_verification",
    "merkle_roots", "temporal_reach", "taint_flows", "finalised_transfers", "stream_node_counters", "stream_fingerprints",
)
# operators with a published time per incident: each starts from the tables, without stages of an earlier query
PUBLISHED = ("feature_matrix", "greedy_plans", "policy_benchmark")
# seconds after which no further one of these is begun
LIMIT = float(os.environ.get("BENCH_LIMIT", "240"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    spark = local_session(cpus, "sluice-bench", partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # one small query first, so JVM start-up is not charged to the first headline
    catalog.RUN["scan_transfers"](spark, folder).limit(1).collect()
    times, failed, skipped, began = {}, {}, [], time.perf_counter()
    sample = os.environ.get("BENCH_INCIDENT_DIR", os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.01"))
    more = PUBLISHED if os.environ.get("BENCH_PUBLISHED", "1") != "0" and os.path.isdir(sample) else ()
    for name in only or (*HEADLINE, *more):
        if name in more and time.perf_counter() - began > LIMIT:
            skipped.append(name)
            continue
        stages.forget()
        start = time.perf_counter()
        try:
            catalog.RUN[name](spark, sample if name in more else folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as exc:  # noqa: BLE001 - one failing query must not hide the others
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
        print(name, times.get(name, failed.get(name)), file=sys.stderr, flush=True)
    out = {
        "metric": "headline_total", "value": round(sum(s for q, s in times.items() if q not in PUBLISHED), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    done = [q for q in PUBLISHED if q in times and q in more]
    incidents = adapters.incidents(spark, sample).count() if done else 0
    out["incident_sample"], out["incidents"] = os.path.basename(sample.rstrip("/")), incidents
    out["seconds_per_incident"] = {q: round(times[q] / max(incidents, 1), 4) for q in done}
    if failed:
        out["failed"] = failed
    if skipped:
        out["skipped"] = skipped
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
