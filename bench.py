"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the data (default /root/testdata/sf0.1), BENCH_CPUS the
local cores, BENCH_QUERIES a comma-separated subset or `all`.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slicegauge.session import build_session, drop_tables  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = [
    "assess_scorecard", "score_slices", "catalog_scores_long", "composite_scores", "representativeness",
    "free_of_error_lineitem", "duplicate_rate", "iqr_outlier_rate", "exact_quantiles", "harm_content_density",
    "dual_use_density", "edge_case_coverage", "reidentification_risk", "nmi_pairs", "inferential_harm",
    "flat_feature_table", "safe_pearson", "safe_spearman", "run_metrics", "fairness_summary", "slice_by_key",
    "stratified_bootstrap", "slice_by_label_share", "quota_per_category", "h1_quality_accuracy",
    "h2_rights_fairness", "h4_permutation_delta_r2", "mc1_score", "mc2_score", "table_fingerprint",
    "train_grid",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if picked == "all" else picked.split(",") if picked else HEADLINE
    parts = str(2 * int(cpus)) if cpus.isdigit() else "16"
    spark = build_session("bench", f"local[{cpus}]", int(parts), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for n in names:
        start = time.perf_counter()
        QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - start, 3)
        drop_tables(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
