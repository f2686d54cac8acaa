"""Benchmark the headline analyses.

Runs each headline query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "...", "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Every query is executed to completion with the no-op sink (the full plan
runs, nothing is collected except what the operator itself needs).  After an
untimed warm-up on the smallest tables, each query runs ``BENCH_REPEAT``
times (default 2) from a clean cache and the best time is reported.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cxpulse.operators.refine import length_stars_scorer  # noqa: E402
from cxpulse.plans import catalog as C  # noqa: E402
from cxpulse.plans.report import Params, full_report  # noqa: E402
from cxpulse.session import configure, drop_scratch, local_session  # noqa: E402

HEADLINE = [
    "sentiment_scores",
    "daily_spikes",
    "spike_top_terms",
    "spike_samples",
    "term_daily_counts",
    "trending_terms",
    "novel_terms",
    "term_examples",
    "topic_vocabulary",
    "document_vocabulary",
    "emerging_topics",
    "recovery_stats",
    "daily_corrected",
    "clean_documents",
    "document_insult_scores",
    "conversation_verbatims",
    "parse_literal_hard",
    "document_recovery",
    "full_report",
]


def full_report_run(spark, sf_dir):
    """End-to-end report on the fixture rendered as text lists (parser path),
    with the stand-in model pass enabled; every output frame is executed."""
    conv = C.fixture(spark, sf_dir, form="python")
    with full_report(conv, params=Params(use_model=True), scorer_factory=length_stars_scorer) as report:
        for df in report.values():
            df.write.mode("overwrite").format("noop").save()


def reset(spark):
    spark.catalog.clearCache()
    drop_scratch(spark)
    spark.sparkContext._jvm.System.gc()
    gc.collect()


def run(spark, name, sf_dir):
    reset(spark)
    t0 = time.perf_counter()
    if name == "full_report":
        full_report_run(spark, sf_dir)
    else:
        df = C.QUERIES[name](spark, sf_dir)
        df.write.mode("overwrite").format("noop").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16,
                          driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    # untimed warm-up on the smallest tables: JIT-compiles the code paths so
    # that the timings below measure steady-state execution
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm) and warm != sf_dir:
        for name in (only or HEADLINE):
            run(spark, name, warm)
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    times = {}
    for name in (only or HEADLINE):
        times[name] = round(min(run(spark, name, sf_dir) for _ in range(repeat)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
    }))


if __name__ == "__main__":
    main()
