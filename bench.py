"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line.  Each query is fully executed with the ``noop``
sink (every row produced, nothing collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "parse_corpus", "blog_pages", "word_band", "expand_buckets", "parse_numbered",
    "count_yes", "satisfaction_summary", "find_pairs", "distinct_pairs", "knn_pairs",
    "semantic_search", "knn_top10", "attach_responses", "constraints_stage", "fit_stage",
    "evaluate_stage", "dq_constraints", "usage_rollup",
]


def _touch(batches):
    import numpy  # noqa: F401
    import pandas  # noqa: F401
    yield from batches


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from specgrade.session import get_spark
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    from specgrade.plans.catalog import QUERIES
    names = [q for q in HEADLINE if q in QUERIES]
    # warm-up: JVM, parquet footers, and the Python workers (numpy/pandas
    # imported once per worker, as on a long-running cluster)
    QUERIES["blog_pages"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(0, 64, 1, int(cpus)).mapInPandas(_touch, "id long").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
