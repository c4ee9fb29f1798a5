"""Wall time of the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from searchloom.plans import QUERIES, load_all  # noqa: E402
from searchloom.session import local_session  # noqa: E402

HEADLINE = (
    "a3_parse_number", "a14_landing_page_normaliser", "b1_query_pii_kind", "b5_record_scan",
    "c3_overall_metrics", "c5_cohort_comparison", "c6_top_cohorts", "c9_coverage", "c12_report_gate",
    "d3_ai_cohorts", "e2_dataset_quality", "e7_landing_page_cohorts", "e9_mapping_coverage",
    "f3_randomized_assignment", "f9_panel_completeness", "f14_standard_error_interval", "g1_chain_integrity",
    "g3_illegal_moves", "h1_page_facts", "h10_url_blocked", "h12_click_depth", "h15_duplicate_values",
    "r29_broken_internal", "r34_hreflang_return_link", "i5_source_support", "i10_text_sanity",
    "j1_recovery_signal", "k1_web_vitals", "k9_decline_candidates", "l2_streaming_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = local_session(cpus, shuffle_partitions=max(4, int(cpus) if cpus.isdigit() else 8), app="searchloom-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    line = {
        "metric": "total wall time of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
