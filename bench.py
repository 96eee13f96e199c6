"""Benchmark: the layers of the loan book built one after the other, then the headline queries on them.

Prints one JSON line. BENCH_SF_DIR names the star tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

LAYERS = ("int_loan_month", "source_months", "dim_loan", "fct_loan_month", "loan_outcome", "open_months", "vintage",
          "transition_base", "roll", "portfolio_snapshot", "funnel_by_channel", "fpd_by_segment", "cohort_cells")
HEADLINE = ("vintage_curve", "vintage_levels", "channel_smr", "channel_pairs_pooled", "segment_grid", "cure_rate",
            "roll_cure_summary", "first_b1_cure", "cure_by_cohort_mh", "portfolio_totals", "kpi_same_set",
            "approval_standardised", "fpd_levels", "early_split", "denominator_rules", "late_timing_grouping_sets",
            "smr_schemes", "product_ratio_cohort_mh", "cohort_curve", "bucket_share", "roll_grid_dense", "dq_summary")


def warm_up(spark: SparkSession) -> None:
    """Start the session and let the JVM compile the hot paths, on the smallest data set, before the clock."""
    from arrearview.workload.registry import book

    smallest = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest) and os.path.abspath(smallest) != os.path.abspath(SF_DIR):
        b = book(spark, smallest)
        for layer in LAYERS:
            getattr(b, layer)
        b.store.drop()
    else:
        spark.range(1000).selectExpr("sum(id)").collect()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("arrearview-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from arrearview.workload import QUERIES
    from arrearview.workload.registry import book

    warm_up(spark)
    times: dict[str, float] = {}
    b = book(spark, SF_DIR)
    for layer in LAYERS:
        start = time.perf_counter()
        getattr(b, layer)
        times[f"build_{layer}"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "loan book: layers built and headline queries, total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))
    b.store.drop()
    spark.stop()


if __name__ == "__main__":
    main()
