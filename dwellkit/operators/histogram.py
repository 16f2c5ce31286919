"""State of a sample from the histogram of its scaled current in each state.

One grouped count over (state, bin) is the whole fit: the share of a state's samples that
fall into a bin, smoothed, is the likelihood of the bin in that state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellkit.functions.columns import lookup

BINS = 64
#: Added to the count of each bin of a state.
SMOOTHING = 1.0


@dataclass(frozen=True)
class StateHistogram:
    """``posteriors``: for each bin the probability of each state."""

    posteriors: list[list[float]]
    column: str = "scaled"

    def score(self, signal: DataFrame) -> DataFrame:
        """Adds ``probs`` and ``pred``, both NULL without a current."""
        bins = len(self.posteriors)
        rows = F.array(*[F.array(*[F.lit(p) for p in row]) for row in self.posteriors])
        classes = [max(range(len(row)), key=row.__getitem__) for row in self.posteriors]
        place = bin_of(F.col(self.column), bins)
        return signal.withColumns({"probs": F.get(rows, place), "pred": lookup(place, classes)})

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        rows = [(self.column, i, p) for i, p in enumerate(self.posteriors)]
        spark.createDataFrame(rows, "column string, bin int, probs array<double>").coalesce(1).write.mode(
            "overwrite"
        ).parquet(path)


def load(spark: SparkSession, path: str) -> StateHistogram:
    rows = spark.read.parquet(path).orderBy("bin").collect()
    return StateHistogram([list(r["probs"]) for r in rows], rows[0]["column"])


def bin_of(scaled: Column, bins: int) -> Column:
    """Bin of a number in [0, 1]; what lies outside counts to the nearer end, NULL has none."""
    within = F.greatest(F.least(F.floor(scaled * float(bins)), F.lit(bins - 1)), F.lit(0)).cast("int")
    return F.when(scaled.isNotNull(), within)


def fit(
    signal: DataFrame, n_states: int, column: str = "scaled", bins: int = BINS, smoothing: float = SMOOTHING
) -> StateHistogram:
    """Posterior of each state in each bin, from ``label`` and the scaled current.

    Samples without a label or a current take no part; a label outside the states is an
    error. A state never seen has probability 0 everywhere. states x bins numbers come to
    the driver.
    """
    known = F.col("label").between(0, n_states - 1)
    refused = F.raise_error(F.lit(f"a label outside the {n_states} states")).cast("int")
    counts = (
        signal.where(F.col("label").isNotNull() & F.col(column).isNotNull())
        .groupBy(F.when(known, F.col("label")).otherwise(refused).alias("label"), bin_of(F.col(column), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    cells = {(r["label"], r["bin"]): r["n"] for r in counts}
    totals = [sum(cells.get((s, b), 0) for b in range(bins)) for s in range(n_states)]
    posteriors = []
    for b in range(bins):
        joint = [t * (cells.get((s, b), 0) + smoothing) / (t + smoothing * bins) for s, t in enumerate(totals)]
        posteriors.append([j / sum(joint) if sum(joint) else 0.0 for j in joint])
    return StateHistogram(posteriors, column)
