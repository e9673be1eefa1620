"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads of the local master.
"""

from __future__ import annotations

import json
import os
import time

from tablewright.queries import QUERIES
from tablewright.session import build_session

HEADLINES = [
    "prepared_profile", "preprocessor_classification", "preprocessor_regression", "impute_median", "impute_mean",
    "label_encode", "zscore_sample", "normalize_robust", "quantile_normal", "iqr_filter", "iforest_filter",
    "iforest_sweep", "scenario_matrix", "metrics_classification", "metrics_regression", "auc_rank", "gram_matrix",
    "class_moments", "knn_topk", "clf_lr", "clf_gbt", "reg_linear", "reg_gbt", "mlp_classifier", "leaderboard",
    "automl_prepare",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"), **{
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
