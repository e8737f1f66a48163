"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

from cohortry import catalog
from cohortry.session import build_session

HEADLINE = [
    "dppr", "compliance", "dedupe_refills", "covered_timeline", "measure_percentiles", "agreement_at",
    "build_crosswalk", "refills_from_tree", "bucket_features", "lookback", "training_frame",
    "average_and_classify", "posterior", "describe", "corr_matrix", "skewness_report", "crosstab_share", "histogram",
    "percentile_bucket", "roc_curve", "curve_areas", "gains_lift", "confusion", "auc_ovo", "multiclass_metrics",
    "stratified_split", "cart_totals", "cart_failed_removes", "knn",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["confusion"](spark, folder).collect()  # start-up is not part of a query
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # every row and column is computed; nothing is brought to the driver
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
