"""Sample-level operators: windows of time, scaling, moments, smoothing, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellkit.functions.columns import binary_state, lookup, share
from dwellkit.operators.prefix import HOT_ROWS, join_totals

CHUNK_SAMPLES = 1 << 20

# Species 0-3 as conductance state and conductance level.
SPECIES_STATE = [0, 0, 1, 2]
SPECIES_LEVEL = [0.0, 0.0, 1.0, 2.0]


def time_window(signal: DataFrame, start: float, end: float) -> DataFrame:
    """Samples with start <= time <= end. A plain predicate, so it reaches the scan."""
    return signal.filter(F.col("time").between(F.lit(float(start)), F.lit(float(end))))


def sample_range(signal: DataFrame, first: int, last: int) -> DataFrame:
    """Samples first..last-1 of every recording (a slice by position)."""
    return signal.filter((F.col("sample_idx") >= first) & (F.col("sample_idx") < last))


def preview(signal: DataFrame, n: int = 10) -> DataFrame:
    """The first n samples of every recording, in order."""
    return sample_range(signal, 0, n).orderBy("record_id", "sample_idx")


def minmax_scaled(
    signal: DataFrame, column: str = "current", out: str = "scaled", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Column scaled to [0, 1] within its recording; 0 where the column is constant.

    The range is a combinable aggregate with one row per recording, joined back so
    that a long recording stays spread over tasks; a window over the recording would
    gather it.
    """
    span = signal.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.min(column).alias("low"), F.max(column).alias("high")
    )
    scaled = F.when(F.col("high") > F.col("low"), (F.col(column) - F.col("low")) / (F.col("high") - F.col("low")))
    return (
        join_totals(signal, span, ["record_id"], "n_samples", F.col("sample_idx"), hot_rows=hot_rows)
        .withColumn(out, F.when(F.col(column).isNotNull(), F.coalesce(scaled, F.lit(0.0))))
        .drop("low", "high")
    )


def nonzero_moments(signal: DataFrame, column: str = "current") -> DataFrame:
    """Mean and sd per recording that divide by the count of non-zero samples.

    sum((x - m)^2) = n * var_pop + n * (mean - m)^2, so one pass is enough and no
    large squares cancel. NULL where every sample is 0.
    """
    agg = signal.groupBy("record_id").agg(
        F.count(column).alias("n_samples"),
        F.count_if(F.col(column) != 0).alias("n_nonzero"),
        F.sum(column).alias("total"),
        F.avg(column).alias("mean"),
        F.var_pop(column).alias("spread"),
    )
    m = F.try_divide(F.col("total"), F.col("n_nonzero"))
    squares = F.col("n_samples") * (F.col("spread") + F.pow(F.col("mean") - m, 2))
    return agg.select(
        "record_id",
        "n_samples",
        "n_nonzero",
        m.alias("nonzero_mean"),
        F.sqrt(F.try_divide(squares, F.col("n_nonzero"))).alias("nonzero_sd"),
    )


def with_neighbours(signal: DataFrame, back: int, ahead: int, chunk_samples: int = CHUNK_SAMPLES) -> DataFrame:
    """Cut recordings into blocks of ``chunk_samples`` and copy the ``back`` last and
    ``ahead`` first samples of a block into the block after and before it.

    A frame of at most that width is then complete inside (record_id, block) for
    every sample with ``is_own``; only (back + ahead) / chunk_samples of the rows are
    sent twice. Needs a dense sample_idx.
    """
    if chunk_samples <= back + ahead:
        raise ValueError("chunk_samples must exceed the frame")
    block = F.floor(F.col("sample_idx") / chunk_samples).cast("long")
    place = F.col("sample_idx") % chunk_samples
    targets = F.array_compact(
        F.array(
            block,
            F.when(place >= chunk_samples - back, block + 1),
            F.when((place < ahead) & (block > 0), block - 1),
        )
    )
    return signal.select("*", block.alias("home"), F.explode(targets).alias("block")).select(
        *signal.columns, "block", (F.col("block") == F.col("home")).alias("is_own")
    )


def smooth(
    signal: DataFrame, width: int = 3, how: str = "mean", chunk_samples: int = CHUNK_SAMPLES
) -> DataFrame:
    """Centred moving mean or median of the current; the frame shrinks at the ends."""
    half = width // 2
    w = Window.partitionBy("record_id", "block").orderBy("sample_idx").rowsBetween(-half, half)
    if how == "mean":
        value: Column = F.avg("current").over(w)
    elif how == "median":
        value = F.percentile("current", F.lit(0.5)).over(w)
    else:
        raise ValueError("how must be 'mean' or 'median'")
    return (
        with_neighbours(signal, half, half, chunk_samples)
        .withColumn("smoothed", value)
        .filter("is_own")
        .drop("block", "is_own")
    )


def state_distribution(signal: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Samples and share per state (within ``by``, or overall)."""
    by = by or []
    counts = signal.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*by)
    return counts.withColumn("fraction", share(F.col("n"), F.sum("n").over(whole)))


def number_of_states(signal: DataFrame) -> DataFrame:
    """max(state) + 1 and the number of distinct states per recording."""
    return signal.groupBy("record_id").agg(
        (F.max("state") + 1).alias("num_states"),
        F.count_distinct("state").alias("distinct_states"),
    )


def recode_binary(signal: DataFrame) -> DataFrame:
    return signal.withColumn("binary_state", binary_state(F.col("state")))


def apply_species(signal: DataFrame, states=SPECIES_STATE, levels=SPECIES_LEVEL) -> DataFrame:
    """State and conductance level of each sample's species (several species may
    share a state)."""
    return signal.withColumn("state", lookup(F.col("species"), states)).withColumn(
        "level", lookup(F.col("species"), levels)
    )


def transition_matrix(signal: DataFrame, chunk_samples: int = CHUNK_SAMPLES) -> DataFrame:
    """Counts and row shares of state -> next state, per recording."""
    w = Window.partitionBy("record_id", "block").orderBy("sample_idx")
    slim = signal.select("record_id", "sample_idx", "state")
    pairs = (
        with_neighbours(slim, 0, 1, chunk_samples)
        .withColumn("next_state", F.lead("state").over(w))
        .filter(F.col("is_own") & F.col("next_state").isNotNull() & F.col("state").isNotNull())
        .groupBy("record_id", "state", "next_state")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    row = Window.partitionBy("record_id", "state")
    return pairs.withColumn("p", share(F.col("n"), F.sum("n").over(row)))
