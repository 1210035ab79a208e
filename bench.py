"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import time

from glyphmill.plans.all import CATALOG
from glyphmill.plans.evaluation import pairs
from glyphmill.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "status_funnel",
    "select_qa_candidates",
    "near_dup_audit",
    "text_disjoint_split",
    "stratified_holdout",
    "merge_labels",
    "build_suites",
    "evaluation_matrix",
    "metrics_by_length",
    "ngram_counts_char",
    "lm_score",
    "dictionary_candidates",
    "correct_text",
    "phonetic_repair",
    "otsu_threshold",
    "runs_above",
    "valley_gap_threshold",
    "ctc_collapse",
    "user_history",
    "rate_limit_breaches",
    "read_pipe_labels",
    "stream_label_ingest",
)


def main() -> None:
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(CPUS, "bench")
    # One untimed query loads classes and starts the Python workers.
    CATALOG["normalize_text"].build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name].build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    report = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
    }
    if "evaluation_matrix" in seconds:
        samples = pairs(spark, SF_DIR).count()
        report["evaluated_samples_per_sec"] = round(samples / seconds["evaluation_matrix"], 1)
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
