"""Rows of vectors as whole numbers, and as matrices inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_whole(vector: Column, dimensions: int) -> Column:
    """Whether a vector has exactly so many entries, none null, NaN or infinite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def whole_numbers(
    df: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int, most: int, carry: str | None = None
) -> DataFrame:
    """(id, x, carried) of the rows whose vector is whole: x is floor(scale * c) of each entry c.

    An entry beyond ``most``, up to which the caller's sums are exact, is an error.
    """
    picked = [F.col(id_col).alias("id"), F.col(vector_col).alias("vector")]
    picked += [F.col(carry).alias("carried")] if carry else []
    refused = F.raise_error(F.lit(f"an entry beyond {most} / {scale}")).cast("long")

    def entry(c: Column) -> Column:
        scaled = F.floor(c.cast("double") * float(scale))
        return F.when(F.abs(c.cast("double")) <= most / scale, scaled).otherwise(refused)

    return (
        df.select(*picked)
        .where(is_whole(F.col("vector"), dimensions))
        .withColumn("vector", F.transform("vector", entry))
        .withColumnRenamed("vector", "x")
    )


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """A batch's list column as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a list column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1), kind))
