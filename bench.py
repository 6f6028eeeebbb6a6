"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from duelframe.catalog import QUERIES
from duelframe.session import local_session

HEADLINE = (
    "momentum_features", "rolling_form", "ewma_form", "ewma_form_nulls", "form_diffs", "engineer_simple", "engineer_full",
    "entity_profile", "matchup_rows", "median_impute", "feature_matrix", "stratified_split", "stratified_folds",
    "roc_auc", "cv_summary", "classification_report", "compare_join", "top_disagreements", "category_drift",
    "pair_diffs", "clean_bouts", "dq_duplicates", "quality_report",
    # Cut histories, a wide table, fits and scoring.
    "momentum_sliced", "form_sliced", "form_wide", "logreg_fit", "gbt_fit", "score_upcoming", "matchup_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="duelframe-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
