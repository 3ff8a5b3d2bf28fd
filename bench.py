"""Time the headline queries on one folder of test tables; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlab.plans.catalog import QUERIES  # noqa: E402
from cohortlab.session import local_session  # noqa: E402

HEADLINE = (
    "features_final", "vitals_features", "bp_features", "lab_features", "hr_first_pass",
    "attrition", "cohort_check", "outcome_by_beds", "outcome_by_apache", "top_labs",
    "describe_vitals", "range_audit_vitals", "feature_defaults", "split_train_test",
    "roc_auc", "roc_points", "calibration", "threshold_table", "demo_model",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first: JVM start-up is not part of any figure.
    QUERIES["hospital_by_beds"](spark, folder).collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds over the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
