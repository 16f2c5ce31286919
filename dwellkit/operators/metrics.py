"""Evaluation of predictions. Every metric starts from one combinable aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.functions.columns import above, share
from dwellkit.operators.prefix import value_totals

# Thresholds of the sweep.
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]


def confusion(df: DataFrame, n_classes: int, label: str = "label", pred: str = "pred") -> DataFrame:
    """(label, pred, n) for all k x k cells, zeros included, and for any other label or
    prediction that occurs. Rows without a label or a prediction don't count. The empty
    cells are generated and added as rows, so the counts need no join. Rows are sorted out
    by their count: a filter on the prediction would be pushed below the count and repeat
    the expression that makes it."""
    both = F.col(label).isNotNull() & F.col(pred).isNotNull()
    counts = df.groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred")).agg(
        F.count_if(both).alias("n")
    )
    spine = df.sparkSession.range(n_classes * n_classes).select(
        F.floor(F.col("id") / n_classes).cast("int").alias("label"),
        (F.col("id") % n_classes).cast("int").alias("pred"),
        F.lit(0).cast("long").alias("n"),
    )
    return (
        counts.filter(F.col("n") > 0)
        .unionByName(spine)
        .groupBy("label", "pred")
        .agg(F.sum("n").alias("n"))
    )


def confusion_wide(cells: DataFrame, n_classes: int) -> DataFrame:
    """One row per true label, one column per predicted label; a prediction without a
    column is an error."""
    known = F.col("pred").between(0, n_classes - 1)
    n = F.when(known, F.col("n")).otherwise(F.raise_error(F.lit("a prediction outside the classes")).cast("long"))
    return cells.groupBy("label").agg(
        *[F.sum(F.when(F.col("pred") == j, n).when(known, 0).otherwise(n)).alias(f"pred_{j}") for j in range(n_classes)]
    )


def per_class(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(label, precision, recall, f1, support, predicted) from confusion cells, within
    ``by``.

    Each cell counts once for its true and once for its predicted class.
    """
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("label").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")
                ),
                F.struct(
                    F.col("pred").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")
                ),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    totals = sides.groupBy(*by, F.col("cls").alias("label")).agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )
    return totals.select(
        *by,
        "label",
        share(F.col("tp"), F.col("predicted")).alias("precision"),
        share(F.col("tp"), F.col("support")).alias("recall"),
        share(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "predicted",
        "tp",
    )


def macro_metrics(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and unweighted means over the labels seen in truth or prediction."""
    seen = per_class(cells, by).filter((F.col("support") > 0) | (F.col("predicted") > 0))
    return seen.groupBy(*by).agg(
        share(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def classification_report(cells: DataFrame) -> DataFrame:
    """Rows per class, then accuracy, macro avg and weighted avg."""
    table = per_class(cells)

    def weighted(c: str) -> Column:
        return share(F.sum(F.col(c) * F.col("support")), F.sum("support"))

    totals = table.agg(
        share(F.sum("tp"), F.sum("support")).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )
    none = F.lit(None).cast("double")

    def row(name: str, p: Column, r: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            p.alias("precision"),
            r.alias("recall"),
            f1.alias("f1"),
            F.col("support").alias("support"),
        )

    summary = totals.select(
        F.explode(
            F.array(
                row("accuracy", none, none, F.col("acc")),
                row("macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")),
                row("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")),
            )
        ).alias("s")
    ).select("s.*")
    return table.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support").unionByName(
        summary
    )


def mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Matthews correlation in doubles (count products overflow); 0 where undefined."""
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    below = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.coalesce(F.try_divide(tp * tn - fp * fn, below), F.lit(0.0))


def _rates() -> list[Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return [
        share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        mcc(tp, fp, tn, fn).alias("mcc"),
    ]


def _cells(truth: Column, hit: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((truth == 1) & (hit == 1)),
        "fp": F.count_if((truth == 0) & (hit == 1)),
        "tn": F.count_if((truth == 0) & (hit == 0)),
        "fn": F.count_if((truth == 1) & (hit == 0)),
    }


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, f1 and mcc in one row."""
    counts = df.agg(*[c.alias(n) for n, c in _cells(F.col(label), F.col(pred)).items()])
    return counts.select("tp", "fp", "tn", "fn", *_rates())


def threshold_sweep(
    df: DataFrame, label: str = "label", score: str = "score", thresholds: Sequence[float] = tuple(THRESHOLDS)
) -> DataFrame:
    """binary_metrics at every threshold from one pass; rows are not multiplied."""
    columns = []
    for i, t in enumerate(thresholds):
        columns += [c.alias(f"{n}_{i}") for n, c in _cells(F.col(label), above(F.col(score), t)).items()]
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"), *[F.col(f"{n}_{i}").alias(n) for n in ("tp", "fp", "tn", "fn")]
            )
            for i, t in enumerate(thresholds)
        ]
    )
    swept = df.agg(*columns).select(F.explode(rows).alias("r")).select("r.*")
    return swept.select("threshold", "tp", "fp", "tn", "fn", *_rates())


def _score_totals(df: DataFrame, label: str, score: str) -> DataFrame:
    by_score = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return value_totals(by_score, [], "score", ["pos", "neg"], n_keys=1, descending=True)


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, and the (0, 0) start with
    threshold +Infinity."""
    totals = _score_totals(df, label, score)
    points = totals.select(
        F.col("score").alias("threshold"),
        share(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        share(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )
    start = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Trapezoid area. A step adds own_neg wide and (cum_pos - own_pos / 2) high, so no
    row needs its neighbour. NULL with one class only."""
    step = F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2)
    area = F.col("all_pos").cast("double") * F.col("all_neg")
    return _score_totals(df, label, score).agg(F.try_divide(F.sum(step), F.max(area)).alias("auc"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))
