"""Votes of a stream's events, and the make-up of mixtures.

Votes are counted into one array of k numbers per stream; everything after that is
arithmetic inside the row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.functions.columns import argmax, class_name, class_or_null, lookup, plogp, share


def predict(scores: DataFrame, probs: str = "probs", out: str = "pred") -> DataFrame:
    return scores.withColumn(out, argmax(F.col(probs)))


def gate(
    scores: DataFrame, threshold: float = 0.2, probs: str = "probs", names: Sequence[str] | None = None
) -> DataFrame:
    """``pred``: the argmax class, NULL below the threshold; ``pred_name`` with names."""
    gated = scores.withColumn("pred", class_or_null(F.col(probs), threshold))
    return gated.withColumn("pred_name", class_name(F.col("pred"), names)) if names else gated


def confident(gated: DataFrame) -> DataFrame:
    return gated.filter(F.col("pred").isNotNull())


def _vote_array(pred: str, k: int) -> Column:
    """Counts of the classes 0 to k - 1; another class is an error, NULL is no vote."""
    counts = F.array(*[F.count_if(F.col(pred) == j) for j in range(k)])
    strange = F.count_if(~F.col(pred).between(0, k - 1)) > 0
    refused = F.raise_error(F.lit(f"{pred} outside the {k} classes")).cast("array<bigint>")
    return F.when(strange, refused).otherwise(counts)


def vote_arrays(df: DataFrame, by: Sequence[str], n_classes: int, pred: str = "pred") -> DataFrame:
    return df.groupBy(*by).agg(_vote_array(pred, n_classes).alias("votes"))


def vote_counts(df: DataFrame, stream: str, n_classes: int, pred: str = "pred") -> DataFrame:
    """(stream, pred, n) for every class, zeros included."""
    return vote_arrays(df, [stream], n_classes, pred).select(
        stream, F.posexplode("votes").alias(pred, "n")
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def vote_pattern(
    df: DataFrame,
    stream: str,
    n_classes: int,
    truth: str = "label",
    pred: str = "pred",
    entropy_base: float | None = 2,
) -> DataFrame:
    """Winner, top-1 hit, confidence, vote entropy and rank of the truth per stream.

    Ties go to the lowest class; the rank counts classes with strictly more votes.
    """
    counted = vote_arrays(df, [stream, truth], n_classes, pred).withColumn("total", _sum(F.col("votes")))
    votes, total = F.col("votes"), F.col("total")
    own = F.get(votes, F.col(truth))
    entropy = F.aggregate(
        F.transform(votes, lambda v: plogp(share(v, total), entropy_base)), F.lit(0.0), lambda a, x: a + x
    )
    return counted.select(
        stream,
        truth,
        argmax(votes).alias("winner"),
        (argmax(votes) == F.col(truth)).cast("int").alias("top1"),
        share(F.array_max(votes), total).alias("confidence"),
        entropy.alias("entropy"),
        (F.size(F.filter(votes, lambda v: v > own)) + 1).alias("rank"),
        total.alias("total_votes"),
    )


def vote_pattern_voted(
    df: DataFrame, stream: str, n_classes: int, truth: str = "label", pred: str = "pred", unvoted: str = "error"
) -> DataFrame:
    """The variant over voted classes only: natural-log entropy, equal votes ranked by
    class. A truth nobody voted for is an error, or with unvoted='null' has no rank."""
    if unvoted not in ("error", "null"):
        raise ValueError("unvoted must be 'error' or 'null'")
    base = vote_pattern(df, stream, n_classes, truth, pred, entropy_base=None)
    arrays = vote_arrays(df, [stream, truth], n_classes, pred)
    votes, own = F.col("votes"), F.get(F.col("votes"), F.col(truth))
    ahead = F.filter(
        F.transform(votes, lambda v, i: (v > own) | ((v == own) & (i < F.col(truth)))), lambda x: x
    )
    rank = F.when(own > 0, F.size(ahead) + 1)
    if unvoted == "error":
        rank = rank.otherwise(F.raise_error(F.lit("the true class has no votes")).cast("int"))
    return base.drop("rank").join(arrays.select(stream, truth, rank.alias("rank")), [stream, truth])


def vote_summary(patterns: DataFrame) -> DataFrame:
    return patterns.agg(
        F.avg("top1").alias("mean_top1"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg("entropy").alias("mean_entropy"),
        F.avg("rank").alias("mean_rank"),
    )


def fractions(df: DataFrame, column: str) -> DataFrame:
    """(label, n, fraction) of the non-NULL values of a column. Class counts are few
    rows; their total is taken from them."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("fraction", share(F.col("n"), total))


def predicted_fractions(gated: DataFrame) -> DataFrame:
    return fractions(gated, "pred")


def actual_fractions(df: DataFrame) -> DataFrame:
    return fractions(df, "label")


def mixture_fractions(gated: DataFrame, n_classes: int) -> DataFrame:
    """(label, actual, predicted) for classes truly present or confidently predicted,
    from one pass: both counts of all classes ride in one row."""
    one = gated.agg(
        _vote_array("label", n_classes).alias("truth"),
        _vote_array("pred", n_classes).alias("votes"),
    )
    rows = one.select(
        F.posexplode(F.arrays_zip("truth", "votes")).alias("label", "c"),
        _sum(F.col("truth")).alias("all_truth"),
        _sum(F.col("votes")).alias("all_votes"),
    )
    return rows.filter((F.col("c.truth") > 0) | (F.col("c.votes") > 0)).select(
        "label",
        share(F.col("c.truth"), F.col("all_truth")).alias("actual"),
        share(F.col("c.votes"), F.col("all_votes")).alias("predicted"),
    )


def mixture_error(mixed: DataFrame, over: str = "present") -> DataFrame:
    """MAE, MSE and RMSE of the fractions, over the classes truly present
    (``over='union'`` counts falsely predicted classes too)."""
    if over not in ("present", "union"):
        raise ValueError("over must be 'present' or 'union'")
    rows = mixed.filter(F.col("actual") > 0) if over == "present" else mixed
    off = F.col("predicted") - F.col("actual")
    return rows.agg(
        F.avg(F.abs(off)).alias("mae"), F.avg(off * off).alias("mse"), F.sqrt(F.avg(off * off)).alias("rmse")
    )


def mixture_compare(
    mixed: DataFrame, spec: Mapping[str, float], names: Sequence[str]
) -> DataFrame:
    """(name, defined, predicted) over the spec's and the predicted classes, by name.

    The spec is a handful of literals; the predicted side has one row per class.
    """
    index = {n: i for i, n in enumerate(names)}
    unknown = sorted(set(spec) - set(index))
    if unknown:
        raise KeyError(f"unknown classes {unknown}")
    predicted = mixed.filter(F.col("predicted") > 0).select(
        class_name(F.col("label"), names).alias("name"), F.col("predicted")
    )
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(f)).alias("defined")) for n, f in spec.items()])
    defined = mixed.sparkSession.range(1).select(F.explode(listed).alias("s")).select("s.*")
    return (
        defined.join(predicted, "name", "full")
        .select(
            "name",
            F.coalesce("defined", F.lit(0.0)).alias("defined"),
            F.coalesce("predicted", F.lit(0.0)).alias("predicted"),
        )
        .orderBy("name")
    )


def label_names(df: DataFrame, names: Sequence[str], label: str = "label") -> DataFrame:
    """Adds the class name of a label (NULL for a label without a name)."""
    return df.withColumn("name", lookup(F.col(label), list(names)))


def name_labels(df: DataFrame, labels: Mapping[str, int], name: str = "name") -> DataFrame:
    """Adds the label of a class name; a name without a label is an error."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    found = F.try_element_at(table, F.col(name))
    return df.withColumn(
        "label",
        F.when(found.isNotNull(), found).otherwise(
            F.raise_error(F.concat(F.lit("no label for class "), F.coalesce(F.col(name), F.lit("NULL")))).cast("int")
        ),
    )
