"""Classifiers of samples and of events on Spark ML, and permutation importance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import CountVectorizer, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellkit.functions.columns import argmax
from dwellkit.operators.bayes import BayesClassifier
from dwellkit.operators.metrics import macro_metrics
from dwellkit.operators.prefix import hash_key, number_by_hash
from dwellkit.operators.sampling import EVENT_ID
from dwellkit.operators.scaling import apply_standard, fit_standard

GRAMS = (2, 3)


def _estimator(family: str, n_classes: int, n_inputs: int | None, seed: int):
    common = {"featuresCol": "inputs", "labelCol": "label", "probabilityCol": "scores", "predictionCol": "guess"}
    if family == "logistic":
        return LogisticRegression(**common, family="binomial" if n_classes == 2 else "multinomial", maxIter=50)
    if family == "tree":
        # One input leaves room for many split candidates.
        return DecisionTreeClassifier(**common, maxDepth=6, maxBins=256, seed=seed)
    if family == "forest":
        return RandomForestClassifier(**common, numTrees=40, maxDepth=8, seed=seed)
    if family == "mlp":
        if n_inputs is None:
            raise ValueError("family 'mlp' needs a fixed number of inputs; use sequence=False")
        return MultilayerPerceptronClassifier(**common, layers=[n_inputs, 32, 64, n_classes], maxIter=100, seed=seed)
    raise ValueError("family must be logistic, tree, forest or mlp")


def _scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``probs`` and ``pred``; the model's own columns are dropped."""
    out = model.transform(df).withColumn("probs", vector_to_array("scores"))
    return out.select(*df.columns, "probs", argmax(F.col("probs")).alias("pred"))


def train_state_classifier(
    signal: DataFrame, n_states: int, family: str = "logistic", column: str = "scaled", seed: int = 42
) -> PipelineModel:
    """State of a sample from its scaled current. ``signal`` carries the truth in
    ``label`` (the state itself, or 0/1 for the binary form)."""
    stages = [
        VectorAssembler(inputCols=[column], outputCol="inputs"),
        _estimator(family, n_states, 1, seed),
    ]
    return Pipeline(stages=stages).fit(signal.select(F.col("label").cast("double").alias("label"), column))


def score_states(model: PipelineModel, signal: DataFrame) -> DataFrame:
    return _scored(model, signal)


def as_signal(scored: DataFrame) -> DataFrame:
    """Predicted states in place of the state column: a signal again, ready to segment."""
    kept = [c for c in scored.columns if c not in ("state", "pred", "probs", "label", "scaled")]
    return scored.select(*kept, F.col("pred").alias("state"))


@dataclass(frozen=True)
class EventClassifier:
    model: PipelineModel
    features: list[str]
    scaler: DataFrame | None = None
    sequence: bool = False

    @property
    def sequence_columns(self) -> list[str]:
        return ["states"] if self.sequence else []

    def prepare(self, events: DataFrame) -> DataFrame:
        out = apply_standard(events, self.scaler, self.features, "_in") if self.scaler is not None else events
        if self.scaler is None:
            out = out.withColumns({f"{f}_in": F.col(f).cast("double") for f in self.features})
        if self.sequence:
            out = out.withColumn("symbols", F.transform("states", lambda s: s.cast("string")))
        return out

    def score(self, events: DataFrame) -> DataFrame:
        """Adds ``probs`` and ``pred``."""
        prepared = self.prepare(events)
        return _scored(self.model, prepared).select(*events.columns, "probs", "pred")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.getActiveSession()
        settings = [(",".join(self.features), self.sequence, self.scaler is not None)]
        spark.createDataFrame(settings, "features string, sequence boolean, scaled boolean").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/settings")
        if self.scaler is not None:
            self.scaler.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")


def load_event_classifier(spark: SparkSession, path: str) -> EventClassifier:
    row = spark.read.parquet(f"{path}/settings").first()
    scaler = spark.read.parquet(f"{path}/scaler") if row["scaled"] else None
    return EventClassifier(PipelineModel.load(f"{path}/model"), row["features"].split(","), scaler, row["sequence"])


def train_event_classifier(
    train: DataFrame,
    features: Sequence[str],
    n_classes: int,
    family: str = "forest",
    scale: bool = True,
    sequence: bool = False,
    seed: int = 42,
) -> EventClassifier:
    """Class of an event from its features and, with ``sequence``, from the counts of
    short state patterns in a ``states`` column that holds whole sequences; for events of
    any length, ``bayes.fit`` reads the patterns from run-length rows instead."""
    features = list(features)
    scaler = fit_standard(train, features) if scale else None
    untrained = EventClassifier(None, features, scaler, sequence)
    inputs = [f"{f}_in" for f in features]
    stages = []
    if sequence:
        for n in GRAMS:
            stages += [
                NGram(n=n, inputCol="symbols", outputCol=f"grams_{n}"),
                CountVectorizer(inputCol=f"grams_{n}", outputCol=f"counts_{n}", vocabSize=3**n),
            ]
            inputs.append(f"counts_{n}")
    n_inputs = None if sequence else len(features)
    stages += [VectorAssembler(inputCols=inputs, outputCol="inputs"), _estimator(family, n_classes, n_inputs, seed)]
    prepared = untrained.prepare(train).withColumn("label", F.col("label").cast("double"))
    wanted = [c for c in prepared.columns if c.endswith("_in") or c in ("symbols", "label")]
    return replace(untrained, model=Pipeline(stages=stages).fit(prepared.select(*wanted)))


def permutation_importance(
    classifier: EventClassifier | BayesClassifier, events: DataFrame, seed: str = "importance", ids: Sequence[str] = EVENT_ID
) -> DataFrame:
    """(feature, baseline_f1, shuffled_f1, importance): loss of macro F1 when one
    feature is shuffled over all events.

    One permutation serves all features. Every row becomes one row for the baseline
    and one per feature with that slot replaced, all scored in a single pass; what is
    shuffled is the row with its feature array, once.
    """
    names = classifier.features
    packed = F.array(*[F.col(f).cast("double") for f in names])
    extra = classifier.sequence_columns
    rows = events.select(*ids, "label", *extra, packed.alias("own"))
    targets = number_by_hash(rows.withColumn("draw", hash_key(*ids, seed=f"{seed}-to")), "draw", ids, "place")
    givers = number_by_hash(
        rows.select(*ids, F.col("own").alias("given")).withColumn("draw", hash_key(*ids, seed=f"{seed}-from")),
        "draw",
        ids,
        "place",
    ).select("place", "given")
    slots = F.sequence(F.lit(-1), F.lit(len(names) - 1))
    variants = targets.join(givers, "place").select("label", *extra, "own", "given", F.explode(slots).alias("slot"))
    filled = variants.select(
        "label",
        "slot",
        *extra,
        *[F.when(F.col("slot") == i, F.col("given")[i]).otherwise(F.col("own")[i]).alias(f) for i, f in enumerate(names)],
    )
    cells = classifier.score(filled).groupBy("slot", "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    f1 = macro_metrics(cells, ["slot"]).select("slot", "macro_f1")
    by_slot = f1.agg(F.map_from_entries(F.collect_list(F.struct("slot", "macro_f1"))).alias("f"))
    baseline = F.try_element_at("f", F.lit(-1))
    return by_slot.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("feature"),
                        baseline.alias("baseline_f1"),
                        F.try_element_at("f", F.lit(i)).alias("shuffled_f1"),
                        (baseline - F.try_element_at("f", F.lit(i))).alias("importance"),
                    )
                    for i, name in enumerate(names)
                ]
            )
        ).alias("r")
    ).select("r.*")
