"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores,
BENCH_QUERIES (names, comma separated, or "all") the queries, BENCH_RUNS the runs of each; the best
run counts, the first being the warm-up. "doubled" has, for a few queries, the time on twice the sections over the
time on them once.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from coursecast.plans.registry import REGISTRY
from coursecast.session import session

HEADLINE = [
    "s1_csv_scan", "s4_table_load", "s6_sql_dump_lines", "s7_sql_dump_source", "s11_drop_folder",
    "c4_table_metadata", "c6_feature_profile", "c7_target_describe",
    "f1_year_floor", "f2_training_rows", "f11_course_number", "f16_semesters", "f18_department_label",
    "j2_temporal_join", "j3_attach_predictions", "j5_compare_actual",
    "a1_course_term", "a3_prediction_input", "a4_enrollment_by_term", "a5_numeric_series",
    "a6_history_by_year", "a7_title_conflicts", "a8_duplicate_crns", "a9_verdict",
    "a10_course_accuracy", "a12_mape_summary", "a13_trimmed_mape", "a14_mape_histogram",
    "w1_accuracy_rank", "w5_forecast_table", "w6_history_pivot",
    "m4_label_encode", "m6_ridge_search", "m7_forest", "m9_feature_importance", "m12_score_query", "m13_train_on_terms",
    "w10_top_features", "x1_course_mean", "x9_lagged_totals",
]


DOUBLED = ["a1_course_term", "a4_enrollment_by_term", "a7_title_conflicts", "j2_temporal_join", "x1_course_mean"]


def doubled(spark, sf_dir: str, out: str) -> str:
    """The tables that sections come from, with every line item twice under another order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.unionByName(lines.withColumn("l_orderkey", lines.l_orderkey + 10**12)).write.parquet(f"{out}/lineitem.parquet")
    for name in ("part", "orders"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = list(REGISTRY) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    with tempfile.TemporaryDirectory(prefix="coursecast-") as scratch:
        spark = session(
            "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
            spark__ui__enabled="false", spark__driver__memory="16g", spark__checkpoint__dir=scratch,
        )
        spark.sparkContext.setLogLevel("ERROR")
        timed(spark, "a1_course_term", sf_dir)  # start the JVM's compilers before timing
        seconds = {
            name: round(min(timed(spark, name, sf_dir) for _ in range(runs)), 3)
            for name in names
        }
        twice = doubled(spark, sf_dir, f"{scratch}/doubled")
        best = lambda name, folder: min(timed(spark, name, folder) for _ in range(2))
        ratios = {name: round(best(name, twice) / best(name, sf_dir), 2) for name in DOUBLED} if not chosen else {}
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "doubled": ratios,
            }
        )
    )


if __name__ == "__main__":
    main()
