"""The driver's parquet tables as signals, scores and class tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellkit.operators import discriminant
from dwellkit.operators.features import record_features
from dwellkit.operators.prefix import index_rows, join_totals

TIME_STEP = 0.001

# Class names in label order.
CLASS_NAMES = ["PeptideA", "PeptideB", "PeptideC", "PeptideD", "PeptideE", "PeptideF", "PeptideG"]
SCORE_CLASSES = 10
DIMENSIONS = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _days(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def _as_signal(df: DataFrame) -> DataFrame:
    return df.withColumn("time", F.col("sample_idx") * F.lit(TIME_STEP))


def signal_from_events(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """One recording per user, samples in time order; the event type is the state."""
    kind = F.col("event_type")
    rows = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record_id"),
        "ts",
        "event_id",
        F.col("value").alias("current"),
        F.when(kind == "purchase", 2).when(kind.isin("error", "signup"), 1).otherwise(0).alias("state"),
    )
    ts = F.col("ts")
    seconds = _days(ts) * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts).cast("double")
    indexed = index_rows(rows, "record_id", ["ts", "event_id"], seconds)
    return _as_signal(indexed).select("record_id", "chunk", "sample_idx", "time", "current", "state", *extra)


def signal_from_lineitem(spark: SparkSession, sf_dir: str, noisy: bool = False) -> DataFrame:
    """One recording per supplier, samples in shipping order; the quantity is the state in
    three levels and the current. ``noisy`` adds discount and tax in percent to the current,
    so that the levels overlap."""
    current = F.col("l_quantity")
    if noisy:
        current = current + (F.col("l_discount") + F.col("l_tax")) * 100.0
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("record_id"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        current.alias("current"),
        F.when(F.col("l_quantity") <= 20, 0).when(F.col("l_quantity") <= 40, 1).otherwise(2).alias("state"),
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    # Order keys subdivide a day; beyond 2^40 they no longer do, which stays in order.
    day = _days(F.col("l_shipdate")) + F.least(F.col("l_orderkey") / F.lit(float(1 << 40)), F.lit(0.999))
    indexed = index_rows(rows, "record_id", order, day)
    return _as_signal(indexed).select("record_id", "chunk", "sample_idx", "time", "current", "state")


def label_of(record_id: Column, n_classes: int = len(CLASS_NAMES)) -> Column:
    return (record_id % n_classes).cast("int")


# Limits between the kinetic classes of a recording.
KINETIC_LIMITS = [0.38, 0.44, 0.48, 0.52, 0.56, 0.62]


def with_kinetic_class(events: DataFrame) -> DataFrame:
    """Events with ``label``: the class of their recording by the share of state 0 over all
    its kept events. An event shows it only roughly, so the classes overlap."""
    totals = record_features(events).select("record_id", F.col("overall_probability_0").alias("share_0"))
    counts = events.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_events"))
    label = sum((F.col("share_0") >= F.lit(x)).cast("int") for x in KINETIC_LIMITS)
    classes = totals.join(counts, "record_id").select("record_id", "n_events", label.alias("label"))
    return join_totals(events.drop("label"), classes, ["record_id"], "n_events", F.col("event_id"))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


def class_scores(vectors: DataFrame, fitted_on: DataFrame) -> DataFrame:
    """(id, label, probs): class probabilities of a linear discriminant over all dimensions.

    Vectors with an even id are scored by the discriminant of those with an odd one, and the
    other way round, so that no vector is scored by a fit it took part in."""
    odd = F.pmod("id", F.lit(2))
    fits = [discriminant.fit(fitted_on.where(odd != half), DIMENSIONS, SCORE_CLASSES) for half in (0, 1)]
    return discriminant.score(vectors, fits, fold=odd).select("id", "label", "probs")


def scores_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = labelled_vectors(spark, sf_dir)
    return class_scores(vectors, vectors)


def binary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.col("toxic").alias("pred")
    )


def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, score): purchases as the positive class, value as the raw score."""
    rows = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        F.col("value"),
    )
    top = rows.agg(F.max("value")).scalar()
    return rows.select("id", "label", (F.col("value") / top).alias("score"))


def species_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sample_id"), (F.col("event_id") % 4).cast("int").alias("species")
    )
