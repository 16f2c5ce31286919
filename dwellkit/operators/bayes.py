"""A closed-form event classifier: Gaussian features and multinomial state patterns.

Fitting is two grouped sums over the training rows: moments of each feature per class, and
totals of each pattern per class. What comes to the driver is classes x (features + patterns)
numbers. Scoring is arithmetic inside the row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellkit.functions.columns import argmax, share
from dwellkit.operators.metrics import macro_metrics

#: A class's variance of a feature is at least this share of all rows' variance, and this much.
LEAST_SHARE, LEAST = 1e-2, 1e-9


def _array(items: list[Column], kind: str = "array<double>") -> Column:
    return F.array(*items).cast(kind)


@dataclass(frozen=True)
class BayesClassifier:
    """``moments``: mean and variance of (class, feature). ``patterns``: log share of
    (class, pattern) among patterns of its size. ``priors``: log share of each class, None
    for a class that had no training row."""

    features: list[str]
    priors: list[float | None]
    moments: dict[tuple[int, str], tuple[float, float]]
    patterns: dict[tuple[int, str], float] = field(default_factory=dict)

    @property
    def sequence_columns(self) -> list[str]:
        return ["patterns"] if self.patterns else []

    def _vocabulary(self) -> list[str]:
        return sorted({p for _, p in self.patterns})

    def _table(self) -> Column:
        """The fitted numbers of all classes as one constant."""
        rows = []
        for c, prior in enumerate(self.priors):
            seen = prior is not None
            moments = [self.moments[c, f] if seen else (0.0, 1.0) for f in self.features]
            rows.append(
                F.struct(
                    F.lit(prior).cast("double").alias("prior"),
                    _array(
                        [
                            F.struct(
                                F.lit(mean).alias("mean"),
                                F.lit(2 * variance).alias("twice"),
                                F.lit(-0.5 * math.log(2 * math.pi * variance)).alias("top"),
                            )
                            for mean, variance in moments
                        ],
                        "array<struct<mean: double, twice: double, top: double>>",
                    ).alias("moments"),
                    _array([F.lit(self.patterns[c, p] if seen else 0.0) for p in self._vocabulary()]).alias("shares"),
                )
            )
        return F.array(*rows)

    def score(self, events: DataFrame) -> DataFrame:
        """Adds ``probs`` and ``pred``. A missing feature and a pattern that no training row
        had say nothing; a class never seen has probability 0."""
        values = _array([F.col(f).cast("double") for f in self.features])
        counts = _array(
            [F.coalesce(F.try_element_at("patterns", F.lit(p)), F.lit(0)).cast("double") for p in self._vocabulary()]
        )

        def added(terms: Column) -> Column:
            return F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

        def log_score(c: Column) -> Column:
            near = F.zip_with("feature_values", c["moments"], lambda x, m: m["top"] - (x - m["mean"]) * (x - m["mean"]) / m["twice"])
            return c["prior"] + added(near) + added(F.zip_with("pattern_counts", c["shares"], lambda n, p: n * p))

        weights = F.transform("logs", lambda s: F.coalesce(F.exp(s - F.col("most")), F.lit(0.0)))
        total = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
        return (
            events.withColumns({"feature_values": values, "pattern_counts": counts})
            .select(*events.columns, F.transform(self._table(), log_score).alias("logs"))
            .withColumn("most", F.array_max("logs"))
            .select(*events.columns, "logs", weights.alias("weights"))
            .select(*events.columns, F.transform("weights", lambda w: share(w, total)).alias("probs"), argmax(F.col("logs")).alias("pred"))
        )

    def save(self, path: str) -> None:
        """The fitted numbers as one small table."""
        rows = [("prior", c, "", p, None) for c, p in enumerate(self.priors)]
        rows += [("feature", c, f, *self.moments.get((c, f), (None, None))) for c in range(len(self.priors)) for f in self.features]
        rows += [("pattern", c, p, v, None) for (c, p), v in self.patterns.items()]
        spark = SparkSession.getActiveSession()
        table = spark.createDataFrame(rows, "kind string, label int, name string, value double, variance double")
        table.withColumn("place", F.monotonically_increasing_id()).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> BayesClassifier:
    rows = spark.read.parquet(path).orderBy("place").collect()
    kinds = {k: [r for r in rows if r["kind"] == k] for k in ("prior", "feature", "pattern")}
    return BayesClassifier(
        list(dict.fromkeys(r["name"] for r in kinds["feature"])),
        [r["value"] for r in kinds["prior"]],
        {(r["label"], r["name"]): (r["value"], r["variance"]) for r in kinds["feature"] if r["value"] is not None},
        {(r["label"], r["name"]): r["value"] for r in kinds["pattern"]},
    )


def fit(train: DataFrame, features: Sequence[str], n_classes: int, sequence: bool = False) -> BayesClassifier:
    """Class of an event from its features and, with ``sequence``, from the pairs and triples
    of its whole state sequence (column ``patterns`` of ``event_patterns``).

    Rows without a label are no training rows; a label outside the classes is an error. A
    pattern's share is smoothed by one for each pattern of its size.
    """
    features = list(features)
    doubles = {f: F.col(f).cast("double") for f in features}
    stats = [F.struct(F.avg(x).alias("mean"), F.var_pop(x).alias("variance")).alias(f"f_{f}") for f, x in doubles.items()]
    labelled = train.where(F.col("label").isNotNull())
    per_class = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *stats).collect()
    strange = sorted(r["label"] for r in per_class if not 0 <= r["label"] < n_classes)
    if strange:
        raise ValueError(f"labels {strange} outside the {n_classes} classes")
    whole = labelled.agg(F.count(F.lit(1)), *stats).first()
    total = sum(r["n"] for r in per_class)
    priors: list[float | None] = [None] * n_classes
    moments = {}
    for r in per_class:
        priors[r["label"]] = math.log(r["n"] / total)
        for f in features:
            overall = whole[f"f_{f}"]["variance"] or 0.0
            mean, variance = r[f"f_{f}"]["mean"], r[f"f_{f}"]["variance"]
            if mean is None:  # no value in this class: as all rows
                mean, variance = whole[f"f_{f}"]["mean"] or 0.0, overall
            moments[r["label"], f] = (mean, variance + LEAST_SHARE * overall + LEAST)
    return BayesClassifier(features, priors, moments, _pattern_shares(labelled, priors) if sequence else {})


def _pattern_shares(labelled: DataFrame, priors: Sequence[float | None]) -> dict[tuple[int, str], float]:
    counts = (
        labelled.select("label", F.explode("patterns").alias("pattern", "n"))
        .where(F.col("pattern").contains(","))
        .groupBy("label", "pattern")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    seen = {(r["label"], r["pattern"]): r["n"] for r in counts}
    vocabulary = sorted({p for _, p in seen})
    out = {}
    for c in [c for c, p in enumerate(priors) if p is not None]:
        for size in {p.count(",") for p in vocabulary}:
            names = [p for p in vocabulary if p.count(",") == size]
            total = sum(seen.get((c, p), 0) for p in names) + len(names)
            out |= {(c, p): math.log((seen.get((c, p), 0) + 1) / total) for p in names}
    return out


def select(
    train: DataFrame, candidates: Mapping[str, tuple[Sequence[str], bool]], n_classes: int, flag: str = "is_validation"
) -> tuple[str, BayesClassifier, DataFrame]:
    """The candidate (features, sequence) with the best macro F1 on the validation rows, fitted
    on the others; on ties the first. Also the table (candidate, macro_f1) of all.

    Features and patterns add up, so one fit of all of them holds every candidate, and one
    pass over the validation rows scores them all.
    """
    every = list(dict.fromkeys(f for features, _ in candidates.values() for f in features))
    whole = fit(train.where(~F.col(flag)), every, n_classes, any(sequence for _, sequence in candidates.values()))
    fitted = {
        name: replace(whole, features=list(features), patterns=whole.patterns if sequence else {})
        for name, (features, sequence) in candidates.items()
    }
    judged, preds = train.where(flag), []
    for i, model in enumerate(fitted.values()):
        judged = model.score(judged).withColumnsRenamed({"pred": f"pred_{i}"}).drop("probs")
        preds.append(F.col(f"pred_{i}"))
    rows = judged.select("label", F.posexplode(F.array(*preds)).alias("place", "pred"))
    cells = rows.groupBy("place", "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    f1 = {r["place"]: r["macro_f1"] for r in macro_metrics(cells, ["place"]).collect()}
    scores = [(name, f1.get(i) or 0.0) for i, name in enumerate(candidates)]
    best = max(scores, key=lambda s: s[1])[0]
    return best, fitted[best], train.sparkSession.createDataFrame(scores, "candidate string, macro_f1 double")
