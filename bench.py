"""Time the headline queries and print one JSON line.

Every query runs over its whole tables and writes to the no-op sink, so all columns are computed. It runs three times
and the median counts, so code generation of the first run does not; BENCH_RUNS sets another number of runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sightline.catalog import load_all  # noqa: E402
from sightline.catalog.registry import QUERIES  # noqa: E402
from sightline.session import build_session  # noqa: E402

HEADLINE = [
    "subject_evidence_report",
    "dedupe_keep_last",
    "evidence_rollup",
    "evidence_digest",
    "temporal_bounds",
    "timing_rollup",
    "observations_with_status",
    "lookup_records",
    "asof_neighbours",
    "nearest_anchor_join",
    "interval_overlap_join",
    "resolve_refs_join",
    "merge_intervals_touching",
    "merge_labelled_events",
    "temporal_rerank",
    "segment_ngrams",
    "fixed_windows",
    "keyword_topk",
    "embedding_topk",
    "observe_captions",
    "observe_ocr",
    "build_evidence",
    "evidence_status_step",
    "export_triples",
    "plan_lint",
    "atomic_chunks",
    "low_signal_filter",
    "salvage_model_json",
    "apply_model",
    "ledger_upsert",
    "stream_tumbling_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        took = []
        for _ in range(runs):
            started = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - started)
        seconds[name] = round(statistics.median(took), 3)
    line = {"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
