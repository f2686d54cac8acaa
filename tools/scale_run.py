"""Scale check: the full report on a replicated events table.

Usage: python tools/scale_run.py OUT_DIR [factor] [src_sf_dir]
Writes events x factor (ids shifted so every conversation is distinct, same
calendar) as Parquet under OUT_DIR/events, then times ``full_report`` on it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from cxpulse.operators.refine import length_stars_scorer  # noqa: E402
from cxpulse.plans.report import Params, full_report  # noqa: E402
from cxpulse.session import local_session  # noqa: E402
from cxpulse.sources.fixtures import conversations_from_events  # noqa: E402


def main():
    out = sys.argv[1]
    factor = int(sys.argv[2]) if len(sys.argv) > 2 else 200
    src = sys.argv[3] if len(sys.argv) > 3 else "/root/testdata/sf0.1"
    spark = local_session(shuffle_partitions=64, driver_memory="20g")
    spark.sparkContext.setLogLevel("ERROR")
    path = os.path.join(out, "events")
    if not os.path.exists(path):
        ev = spark.read.parquet(f"{src}/events.parquet")
        span = ev.agg(F.max("event_id")).first()[0] + 1
        rep = ev.select("*", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("_copy"))
        rep = rep.withColumn("event_id", F.col("event_id") + F.col("_copy") * F.lit(span)).drop("_copy")
        rep.repartition(64).write.parquet(path)
    events = spark.read.parquet(path)
    n = events.count()
    conv = conversations_from_events(events, form="python")
    t0 = time.perf_counter()
    report = full_report(conv, params=Params(use_model=True), scorer_factory=length_stars_scorer)
    times = {}
    for name, df in report.items():
        t = time.perf_counter()
        df.write.mode("overwrite").format("noop").save()
        times[name] = round(time.perf_counter() - t, 2)
    total = time.perf_counter() - t0
    print(json.dumps({"rows": n, "full_report_sec": round(total, 1), "write_sec": times}))
    print(report["summary"].collect())
    print(report["trending_terms"].limit(3).collect())


if __name__ == "__main__":
    main()
