"""Standardisation with fitted statistics kept as a small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fit_standard(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, std): population statistics, one pass over the rows."""
    stats = train.agg(
        *[
            F.struct(
                F.avg(F.col(f).cast("double")).alias("mean"), F.stddev_pop(F.col(f).cast("double")).alias("std")
            ).alias(f)
            for f in features
        ]
    )
    return stats.unpivot([], list(features), "feature", "s").select("feature", "s.mean", "s.std")


def apply_standard(df: DataFrame, scaler: DataFrame, features: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / std per feature; a constant feature is only centred.

    The fitted table has one row per feature; it enters as one scalar value, so the
    rows need no join.
    """
    fitted = scaler.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std").alias("s"))))
    ).scalar()
    held = df.withColumn("fitted", fitted)

    def scaled(f: str):
        s = F.try_element_at("fitted", F.lit(f))
        std = F.when(s["std"] == 0, F.lit(1.0)).otherwise(s["std"])
        return ((F.col(f).cast("double") - s["mean"]) / std).alias(f + suffix)

    kept = [c for c in df.columns if suffix or c not in features]
    return held.select(*kept, *[scaled(f) for f in features])


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
