"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]
and print one JSON line {"metric", "value", "unit", "queries", "sf"}.

Each query is executed in full through the ``noop`` sink (every row is
produced, nothing is collected to the driver). A small warm-up query starts
the JVM and is not timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "j1_user_pairs",             # co-engagement pairs: distinct + tiled self-join + pair count
    "d3_user_totals",            # per-author totals over union of posts and comments
    "d10_comment_percentiles",   # post⋈comments, exact distributed percentiles
    "d14_comment_score_histogram",
    "d17_daily_engagement",      # outer-joined daily features with a spine
    "d6_dedup_interactions",     # keep-first dedup
    "a12_listing_merge",         # per-community top-k listings + merge
    "e13_auc_labels",            # extrema → segments → range labels
    "e21_running_mean",          # chunked running aggregate per thread
    "i1_document_sentiment",     # lexicon sentiment over whole documents
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from threadlens.plans import catalog
    from threadlens.session import get_spark
    spark = get_spark(f"local[{cpus}]", app="threadlens-bench", shuffle_partitions=2 * cpus)
    catalog.load_all()
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
