"""Whitening of embeddings by the covariance of their distinct vectors.

Identical vectors are grouped first. The covariance is a weighted centred product over the
distinct ones, each counted once or as often as it occurs; each distinct vector is whitened
once, and the rows get its coordinates back by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellkit.llm.store import stored
from dwellkit.llm.vectors import lists, matrix, whole_numbers
from dwellkit.operators.prefix import join_totals

DIMENSIONS = 64
SCALE = 256
COMPONENTS = 4
#: Largest whole number that an entry may become.
MOST = 1 << 40
#: Directions with less than this share of the variance count as having none.
FLAT = 1e-12
_EXACT = pa.decimal128(38, 0)


def _weights(batch: pa.RecordBatch, by_count: bool) -> np.ndarray:
    n = batch.column("n_rows").to_numpy(zero_copy_only=False)
    return n if by_count else np.ones(len(n), np.int64)


def _totals(dimensions: int, by_count: bool) -> Callable:
    """Weight and exact sum of each dimension, a few rows for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, sums = 0, [0] * dimensions
        for batch in batches:
            x, w = matrix(batch.column("x"), dimensions), _weights(batch, by_count)
            # 2^20 rows of 2^40 fit 64 bits; weights are split off where they are not one.
            if by_count:
                part = (x.astype(object) * w[:, None].astype(object)).sum(axis=0)
            else:
                part = x.sum(axis=0)
            weight += int(w.sum())
            sums = [a + int(b) for a, b in zip(sums, part)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(dimensions), pa.int32()),
                pa.array([Decimal(s) for s in sums], _EXACT),
                pa.array([weight] * dimensions, pa.int64()),
            ],
            names=["dim", "total", "weight"],
        )

    return run


def _products(mean: np.ndarray, by_count: bool) -> Callable:
    """Weighted products of centred vectors, one matrix for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(mean), len(mean)))
        for batch in batches:
            centred = matrix(batch.column("x"), len(mean)) - mean
            out += (centred * _weights(batch, by_count)[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(mean)), pa.int32()), lists(out, pa.float64())], names=["dim", "products"]
        )

    return run


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - sum)^2, exact at any size."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    farthest = max(map(abs, sums), default=0)
    fits = x.shape[1] * largest * max(largest, farthest) < 1 << 62
    rows, s = (x, np.array(sums, np.int64)) if fits else (x.astype(object), np.array(sums, object))
    squares, along = (rows * rows).sum(axis=1).tolist(), (rows @ s).tolist()
    constant = sum(v * v for v in sums)
    return [n * n * a - 2 * n * b + constant for a, b in zip(squares, along)]


def _whitener(mean: np.ndarray, axes: np.ndarray, n: int, sums: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), len(mean))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("x"),
                    batch.column("n_rows"),
                    pa.array([Decimal(v) for v in deviations(x, n, sums)], _EXACT),
                    lists((x - mean) @ axes, pa.float64()),
                ],
                names=["x", "n_rows", "deviation", "whitened"],
            )

    return run


def _axes(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors by falling eigenvalue, and the trace. Of the two
    signs, the one whose largest entry is positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs), float(np.trace(covariance))


def _identity_error(table: DataFrame, components: list[int], by_count: bool) -> float:
    """Largest entry of the whitened vectors' own covariance minus the identity."""
    if not components:
        return 0.0
    w = F.col("n_rows").cast("double") if by_count else F.lit(1.0)
    y = {c: F.get("whitened", F.lit(c)) for c in components}
    first = table.agg(F.sum(w).alias("n"), *[F.sum(w * y[c]).alias(f"s{c}") for c in components]).first()
    centred = {c: y[c] - F.lit(first[f"s{c}"] / first["n"]) for c in components}
    pairs = [(a, b) for a in components for b in components if a <= b]
    second = table.agg(*[F.sum(w * centred[a] * centred[b]).alias(f"p{a}_{b}") for a, b in pairs]).first()
    return max(abs(second[f"p{a}_{b}"] / first["n"] - (a == b)) for a, b in pairs)


def whiten(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    dimensions: int = DIMENSIONS,
    weights: str = "one",
    carry: str | None = None,
) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) for each row with a whole vector.

    A vector's entries c become x = floor(scale * c). The fit is over the distinct x
    vectors, each with weight one or, with ``weights='count'``, its number of rows; n is the
    sum of weights. whitened: the coordinates of x minus the mean on the first eigenvectors
    of the covariance, over the root of the eigenvalue; explained: the eigenvalues over the
    trace; deviation: the sum over dimensions of (n * x - weighted sum)^2 as an exact decimal.

    Rows go whose vector is null, has another number of entries than ``dimensions``, or a
    null or non-finite one. A direction without variance (as where all vectors are equal)
    has coordinate NULL and does not count in identity_error; explained is 0 where there is
    no variance at all. Repeated rows are rows of their own, in the fit they weigh as one.
    An empty table gives no row. An entry beyond 2^40 / scale is an error. Only the named
    columns are read, whatever the others are called.

    The driver holds one matrix of dimensions x dimensions; tasks hold a batch and one such
    matrix. A vector shared by very many rows is one row of the fit after partial counts, and
    its rows leave their partition in the join back.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be 'one' or 'count'")
    by_count, spark = weights == "count", df.sparkSession
    rows = whole_numbers(df, id_col, vector_col, dimensions, scale, MOST, carry)
    distinct = stored(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n_rows")), "distinct-vectors")
    fitted = (
        distinct.mapInArrow(_totals(dimensions, by_count), "dim int, total decimal(38,0), weight long")
        .groupBy("dim")
        .agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("weight").alias("weight"))
        .orderBy("dim")
        .collect()
    )
    sums, n = [int(r["total"]) for r in fitted], fitted[0]["weight"] if fitted else 0
    kept = [f.name for f in rows.schema if f.name != "x"]
    if not n:
        return rows.limit(0).select(
            *_named(kept, id_col, carry),
            F.lit(0).cast("long").alias("n"),
            F.lit(0).cast("decimal(38,0)").alias("deviation"),
            *[F.array().cast("array<double>").alias(c) for c in ("whitened", "explained")],
            F.lit(0.0).alias("identity_error"),
        )
    mean = np.array([s / n for s in sums])
    cells = (
        distinct.mapInArrow(_products(mean, by_count), "dim int, products array<double>")
        .select("dim", F.posexplode("products").alias("other", "product"))
        .groupBy("dim", "other")
        .agg(F.sum("product").alias("product"))
        .collect()
    )
    covariance = np.zeros((dimensions, dimensions))
    for cell in cells:
        covariance[cell["dim"], cell["other"]] = cell["product"] / n
    values, vectors, trace = _axes(covariance, components)
    spread = [c for c, v in enumerate(values) if v > FLAT * max(trace, 0.0) and v > 0]
    axes = np.full(vectors.shape, np.nan)
    axes[:, spread] = vectors[:, spread] / np.sqrt(values[spread])
    table = stored(
        distinct.mapInArrow(
            _whitener(mean, axes, n, sums), "x array<long>, n_rows long, deviation decimal(38,0), whitened array<double>"
        ),
        "whitened-vectors",
    )
    error = _identity_error(table, spread, by_count)
    explained = F.array(*[F.lit(float(v / trace) if trace > 0 else 0.0) for v in values])
    coordinates = F.transform("whitened", lambda y: F.when(~F.isnan(y), y))
    return join_totals(rows, table, ["x"], "n_rows", F.col("id")).select(
        *_named(kept, id_col, carry),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        coordinates.alias("whitened"),
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _named(kept: list[str], id_col: str, carry: str | None) -> list:
    return [F.col(c).alias(id_col if c == "id" else carry) for c in kept]
