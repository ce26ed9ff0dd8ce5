"""Hot-key experiment for the ordered upsert.

A third of the forecast batch (rows with seq % 3 = 0) is moved onto one key;
the audit log is computed with seq buckets of ``width`` rows and, for
comparison, with one bucket per key (a plain per-key window).  Prints the
stage whose tasks read the most records in each run.

Usage: python tools/skew_experiment.py [sf_dir] [width]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from ledgerline.operators import upsert  # noqa: E402
from ledgerline.sources import fixtures as fx  # noqa: E402
from stage_report import run_with_event_log  # noqa: E402


def skewed_batch(spark, d):
    b = fx.forecast_batch(spark, d)
    hot = F.col("seq") % 3 == 0
    return b.select("seq",
                    F.when(hot, F.lit("Supplier#000000000")).otherwise(F.col("employee")).alias("employee"),
                    F.when(hot, F.lit("Brand#1")).otherwise(F.col("project")).alias("project"),
                    "remarks",
                    F.when(hot, F.lit(1)).otherwise(F.col("month")).alias("month"),
                    F.when(hot, F.lit(1996)).otherwise(F.col("year")).alias("year"),
                    "dedication")


def main(argv):
    d = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    width = int(argv[2]) if len(argv) > 2 else 4096
    plans = (("warm-up", width), (f"seq buckets of {width}", width), ("one bucket per key", 1 << 62))
    print("| plan | seconds | window stage tasks | median shuffle records | max shuffle records "
          "| max / median task s |")
    print("|---|---|---|---|---|---|")
    for label, w in plans:
        secs = []

        def run(spark, w=w):
            t0 = time.perf_counter()
            log = upsert.upsert_log(fx.forecast_base(spark, d), skewed_batch(spark, d),
                                    ["employee", "project", "month", "year"], "dedication", "x", w)
            log.write.format("noop").mode("overwrite").save()
            secs.append(time.perf_counter() - t0)
        rows = run_with_event_log(run)
        if label == "warm-up":
            continue
        # the stage that reads the most shuffled rows in one task: the row window
        top = max(rows, key=lambda r: r["max_shuffle"])
        print(f"| {label} | {secs[0]:.2f} | {top['tasks']} | {top['med_shuffle']} | {top['max_shuffle']} | "
              f"{top['max_s']} / {top['med_s']} |")


if __name__ == "__main__":
    main(sys.argv)
