"""A linear discriminant of vectors: one sum of products, one small system, dot products.

Each task adds up the products of its vectors and class marks in one matrix; the matrices are
summed in Spark. The driver solves a system of as many equations as a vector has entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pooled covariance plus this many times its mean variance on the diagonal. One draws
#: scores of few, noisy vectors to the middle.
SHRINKAGE = 1.0


def _products(dimensions: int, n_classes: int) -> Callable:
    """Sums over the rows of a task of (vector, class marks) times the same, transposed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = dimensions + n_classes
        out = np.zeros((size, size))
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            rows = np.concatenate([x.astype(np.float64), np.eye(n_classes)[label]], axis=1)
            out += rows.T @ rows
        ends = pa.array(np.arange(size + 1, dtype=np.int32) * size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))],
            names=["place", "products"],
        )

    return run


@dataclass(frozen=True)
class Discriminant:
    """``weights``: one vector for each class; ``offsets``: one number, None for a class that
    had no vector."""

    weights: list[list[float]]
    offsets: list[float | None]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each class, for rows of vectors; 0 for a class never seen."""
        offsets = np.array([-np.inf if b is None else b for b in self.offsets])
        logs = x @ np.array(self.weights).T + offsets
        weights = np.exp(logs - logs.max(axis=1, keepdims=True))
        return weights / weights.sum(axis=1, keepdims=True)


def _scorer(fits: Sequence[Discriminant], vector: str, fold: str) -> Callable:
    dimensions, n_classes = len(fits[0].weights[0]), len(fits[0].offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vector)
            whole = pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False)
            x = column.filter(whole).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.float64)
            folds = batch.column(fold).filter(whole).to_numpy(zero_copy_only=False)
            probs = np.empty((len(x), n_classes))
            for k, one in enumerate(fits):
                probs[folds == k] = one.probabilities(x[folds == k])
            found = np.zeros(batch.num_rows, bool)
            found[np.flatnonzero(whole.to_numpy(zero_copy_only=False))] = np.isfinite(probs).all(axis=1)
            ends = np.concatenate([[0], np.cumsum(np.where(found, n_classes, 0))]).astype(np.int32)
            values = pa.array(probs[np.isfinite(probs).all(axis=1)].reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(~found))
            kept = [n for n in batch.schema.names if n != fold]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], lists], names=[*kept, "probs"])

    return run


def score(df: DataFrame, fits: Sequence[Discriminant], vector: str = "vector", fold: Column | None = None) -> DataFrame:
    """Adds ``probs``, the probability of each class by the fit that ``fold`` numbers from 0
    (the first where there is no ``fold``). NULL for a vector that is null, has another
    number of entries or a null or non-finite one. One product of a batch with the weights."""
    held = df.withColumn("discriminant_fold", (F.lit(0) if fold is None else fold).cast("int"))
    schema = T.StructType([*df.schema.fields, T.StructField("probs", T.ArrayType(T.DoubleType()))])
    return held.mapInArrow(_scorer(list(fits), vector, "discriminant_fold"), schema)


def fit(
    df: DataFrame,
    dimensions: int,
    n_classes: int,
    vector: str = "vector",
    label: str = "label",
    shrinkage: float = SHRINKAGE,
) -> Discriminant:
    """Linear discriminant of the rows that have a label and a whole vector.

    A row without a label, or whose vector is null, has another number of entries or a null
    or non-finite one, takes no part; a label outside the classes is an error. Classes weigh
    as often as they occur. (dimensions + classes)^2 numbers come to the driver.
    """
    known = F.col(label).between(0, n_classes - 1)
    refused = F.raise_error(F.lit(f"a label outside the {n_classes} classes")).cast("int")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(F.col(label).isNotNull() & (F.size(vector) == dimensions) & finite).select(
        F.col(vector).alias("vector"), F.when(known, F.col(label)).otherwise(refused).alias("label")
    )
    cells = (
        rows.mapInArrow(_products(dimensions, n_classes), "place int, products array<double>")
        .select("place", F.posexplode("products").alias("other", "product"))
        .groupBy("place", "other")
        .agg(F.sum("product").alias("product"))
        .collect()
    )
    size = dimensions + n_classes
    sums = np.zeros((size, size))
    for c in cells:
        sums[c["place"], c["other"]] = c["product"]
    return _solved(sums, dimensions, n_classes, shrinkage)


def _solved(sums: np.ndarray, dimensions: int, n_classes: int, shrinkage: float) -> Discriminant:
    counts = np.diag(sums)[dimensions:]
    seen = counts > 0
    total = counts.sum()
    if not total:
        return Discriminant([[0.0] * dimensions] * n_classes, [None] * n_classes)
    means = sums[dimensions:, :dimensions] / np.maximum(counts, 1)[:, None]
    within = (sums[:dimensions, :dimensions] - (means.T * counts) @ means) / total
    spread = np.trace(within) / dimensions
    # Vectors that do not vary within their classes leave nothing to divide by.
    solid = within + (shrinkage * spread if spread > 0 else 1.0) * np.eye(dimensions)
    weights = np.linalg.solve(solid, means.T).T
    priors = np.log(np.maximum(counts, 1) / total)
    offsets = priors - 0.5 * (means * weights).sum(axis=1)
    return Discriminant(weights.tolist(), [float(b) if s else None for b, s in zip(offsets, seen)])
