"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)

Each query runs whole into a sink that keeps nothing, so no column is pruned
away and no row is left out. One small job warms the session up first.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from clickward.operators.features import count_features, delta_features, trust_features  # noqa: E402
from clickward.plans.queries import queries  # noqa: E402
from clickward.session import allow_local_scratch, build_session, clear_scratch  # noqa: E402
from clickward.sources.adapters import clicks_large, table  # noqa: E402

HEADLINE = (
    "cast_events",
    "trust_features",
    "veracity_checks",
    "validation_report",
    "drift_psi_kl",
    "prior_counts",
    "prior_unique_pair",
    "prev_delta_ip",
    "temporal_split",
    "row_window_select",
    "bag_subsample",
    "rate_features",
    "pr_auc",
    "leaderboard",
    "topk_metrics",
    "calibration_bins",
    "record_hash",
    "merkle_root",
    "audit_verify",
)


def large_trust(spark, sf_dir):
    return trust_features(clicks_large(spark, sf_dir))


def large_model_features(spark, sf_dir):
    from clickward.operators.clean import prepare_events

    return delta_features(count_features(prepare_events(clicks_large(spark, sf_dir))))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "clickward-bench",
        f"local[{cpus}]",
        int(cpus),
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    allow_local_scratch(spark)
    known = queries()
    runs = {name: known[name] for name in HEADLINE}
    runs["large_trust_features"] = large_trust
    runs["large_model_features"] = large_model_features

    table(spark, sf_dir, "events").groupBy("event_type").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, run in runs.items():
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    clear_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": pathlib.Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
