"""Kinetic features of events (13) and of recordings (7).

All features come from dwell statistics per (event, state); samples are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.functions.columns import ratio_or_count, share
from dwellkit.operators.prefix import HOT_ROWS, join_totals
from dwellkit.operators.segment import chunk_runs

# Feature lists in the order that models and reports use.
EVENT_FEATURES = [
    "entropy",
    "first_transition_time",
    "avg_dwell_0",
    "avg_dwell_1",
    "var_dwell_0",
    "var_dwell_1",
    "longest_dwell_0",
    "longest_dwell_1",
    "event_duration",
    "probability_0",
    "probability_1",
    "ratio_0_to_1",
    "num_transitions",
]
RECORD_FEATURES = [
    "average_event_length",
    "average_event_entropy",
    "average_first_transition_time",
    "average_num_transitions",
    "overall_probability_0",
    "overall_probability_1",
    "overall_ratio_0_to_1",
]
FEATURES_13 = EVENT_FEATURES
FEATURES_12 = [f for f in EVENT_FEATURES if f != "entropy"]
FEATURES_20 = EVENT_FEATURES + RECORD_FEATURES
FEATURES_10 = [f for f in FEATURES_12 if f not in ("probability_0", "probability_1")]


def _between(total: Column, count: Column) -> Column:
    return F.try_divide(total.cast("double") * total, count.cast("double"))


def dwell_stats(signal: DataFrame, chunk_samples: int | None = None) -> DataFrame:
    """Dwell statistics per (record_id, event_id, state).

    n_runs, n_samples, within and between (squared deviations of run lengths inside a
    part, and sum^2 / count of the parts; long dwells do not cancel in them), longest,
    and the first run's start and length. A chunk is boiled down to a few rows per event before the only exchange
    after the sample exchange, so even an event that fills a recording sends one row
    per chunk and state. Pieces of a run cut by chunk edges are added up first.
    """
    length = F.col("run_len")
    per_chunk = (
        chunk_runs(signal, chunk_samples)
        .groupBy("record_id", "chunk", "event_id", "state", "link")
        .agg(
            F.count(F.lit(1)).alias("n_runs"),
            F.sum(length).alias("n_samples"),
            (F.var_pop(length) * F.count(F.lit(1))).alias("within"),
            F.max(length).alias("longest"),
            F.min("run_start").alias("start"),
            F.min_by("run_len", "run_start").alias("first_len"),
        )
        .repartition("record_id", "event_id")
    )
    by_run = per_chunk.groupBy("record_id", "event_id", "state", "link").agg(
        F.sum("n_runs").alias("n_runs"),
        F.sum("n_samples").alias("n_samples"),
        F.sum("within").alias("within"),
        F.sum(_between(F.col("n_samples"), F.col("n_runs"))).alias("between"),
        F.max("longest").alias("longest"),
        F.min("start").alias("start"),
        F.min_by("first_len", "start").alias("first_len"),
    )
    joined_run = F.col("link").isNotNull()
    n = F.col("n_samples")
    return (
        by_run.select(
            "record_id",
            "event_id",
            "state",
            "start",
            "n_samples",
            F.when(joined_run, F.lit(1).cast("long")).otherwise(F.col("n_runs")).alias("n_runs"),
            F.when(joined_run, F.lit(0.0)).otherwise(F.col("within")).alias("within"),
            F.when(joined_run, _between(n, F.lit(1))).otherwise(F.col("between")).alias("between"),
            F.when(joined_run, n).otherwise(F.col("longest")).alias("longest"),
            F.when(joined_run, n).otherwise(F.col("first_len")).alias("first_len"),
        )
        .groupBy("record_id", "event_id", "state")
        .agg(
            F.sum("n_runs").alias("n_runs"),
            F.sum("n_samples").alias("n_samples"),
            F.sum("within").alias("within"),
            F.sum("between").alias("between"),
            F.max("longest").alias("longest"),
            F.min("start").alias("start"),
            F.min_by("first_len", "start").alias("first_len"),
        )
    )


def event_features(
    signal: DataFrame, min_event_length: int = 5, chunk_samples: int | None = None
) -> DataFrame:
    """The 13 features of every event with more than ``min_event_length`` samples."""

    def of_state(k: int, column: str):
        return F.coalesce(F.max(F.when(F.col("state") == k, F.col(column))), F.lit(0))

    n = F.col("n_samples").cast("double")
    totals = (
        dwell_stats(signal, chunk_samples)
        .groupBy("record_id", "event_id")
        .agg(
            F.min("start").alias("start_idx"),
            F.sum("n_samples").alias("duration"),
            F.sum(n * F.log2(n)).alias("n_log_n"),
            F.sum("n_runs").alias("total_runs"),
            F.min_by("first_len", "start").alias("first_len"),
            *[
                of_state(k, c).alias(f"{c}_{k}")
                for k in (0, 1)
                for c in ("n_runs", "n_samples", "within", "between", "longest")
            ],
        )
        .filter(F.col("duration") > min_event_length)
    )
    d = F.col("duration").cast("double")

    def mean(k: int):
        return share(F.col(f"n_samples_{k}"), F.col(f"n_runs_{k}"))

    def variance(k: int):
        among = F.col(f"between_{k}") - F.coalesce(_between(F.col(f"n_samples_{k}"), F.col(f"n_runs_{k}")), F.lit(0.0))
        return share(F.greatest(F.col(f"within_{k}") + among, F.lit(0.0)), F.col(f"n_runs_{k}"))

    return totals.select(
        "record_id",
        "event_id",
        "start_idx",
        F.greatest(F.log2(d) - F.col("n_log_n") / d, F.lit(0.0)).alias("entropy"),
        F.when(F.col("total_runs") > 1, F.col("first_len"))
        .otherwise(F.lit(-1).cast("long"))
        .alias("first_transition_time"),
        mean(0).alias("avg_dwell_0"),
        mean(1).alias("avg_dwell_1"),
        variance(0).alias("var_dwell_0"),
        variance(1).alias("var_dwell_1"),
        F.col("longest_0").alias("longest_dwell_0"),
        F.col("longest_1").alias("longest_dwell_1"),
        F.col("duration").alias("event_duration"),
        share(F.col("n_samples_0"), F.col("duration")).alias("probability_0"),
        share(F.col("n_samples_1"), F.col("duration")).alias("probability_1"),
        ratio_or_count(F.col("n_samples_0"), F.col("n_samples_1")).alias("ratio_0_to_1"),
        (F.col("total_runs") - 1).alias("num_transitions"),
        F.col("n_samples_0").alias("samples_0"),
        F.col("n_samples_1").alias("samples_1"),
    )


def record_features(events: DataFrame, mode: str = "mean") -> DataFrame:
    """Seven features per recording, from its kept events.

    mode='mean' averages over events; mode='first' takes the first event's value,
    which is what tables written by older pipelines hold.
    """
    return _record_totals(events, mode).drop("n_events")


def _record_totals(events: DataFrame, mode: str) -> DataFrame:
    if mode == "mean":
        pick = F.avg
    elif mode == "first":

        def pick(name):
            return F.min_by(F.col(name).cast("double"), F.col("event_id"))

    else:
        raise ValueError("mode must be 'mean' or 'first'")
    totals = events.groupBy("record_id").agg(
        pick("event_duration").alias("average_event_length"),
        pick("entropy").alias("average_event_entropy"),
        pick("first_transition_time").alias("average_first_transition_time"),
        pick("num_transitions").alias("average_num_transitions"),
        F.sum("samples_0").alias("n0"),
        F.sum("samples_1").alias("n1"),
        F.sum("event_duration").alias("n_all"),
        F.count(F.lit(1)).alias("n_events"),
    )
    return totals.select(
        "record_id",
        "n_events",
        *RECORD_FEATURES[:4],
        share(F.col("n0"), F.col("n_all")).alias("overall_probability_0"),
        share(F.col("n1"), F.col("n_all")).alias("overall_probability_1"),
        ratio_or_count(F.col("n0"), F.col("n1")).alias("overall_ratio_0_to_1"),
    )


def with_record_features(events: DataFrame, mode: str = "mean", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events with all 20 features; the events of a long recording stay spread."""
    totals = _record_totals(events, mode)
    return join_totals(events, totals, ["record_id"], "n_events", F.col("event_id"), hot_rows=hot_rows)
