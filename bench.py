"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dwellkit.plans.queries import QUERIES  # noqa: E402

try:
    from dwellkit.llm.queries import QUERIES as LLM_QUERIES  # noqa: E402
except ImportError:
    LLM_QUERIES = {}
from dwellkit.session import local_session  # noqa: E402

HEADLINE = [
    "event_features",
    "event_features_lineitem",
    "event_features_20",
    "segment_events",
    "dwell_runs",
    "dwell_cdf",
    "dwell_fit_single",
    "transition_matrix",
    "signal_smooth3",
    "signal_minmax_scaled",
    "stratified_split",
    "confusion_matrix",
    "roc_auc",
    "threshold_sweep",
    "vote_pattern",
    "feature_percentiles",
    "feature_histogram",
    "bhattacharyya",
    "pad_sequences",
]
#: Timed beside the headline queries and not part of their total.
TRAINING_DATA = ["op9_winnowing", "op11_weighted_whitening", "op12_bernoulli_mixing", "op13_drift_clustering"]


def run(query: str, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    {**QUERIES, **LLM_QUERIES}[query](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    run("event_features", spark, sf_dir)  # starts the JVM's compiler before anything is timed
    times = {name: round(min(run(name, spark, sf_dir) for _ in range(2)), 3) for name in HEADLINE}
    beside = {name: round(run(name, spark, sf_dir), 3) for name in TRAINING_DATA if name in LLM_QUERIES}
    samples = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "training_data_queries": beside,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "samples_per_sec": round(samples / times["event_features_lineitem"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
