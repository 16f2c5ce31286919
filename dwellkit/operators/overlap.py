"""How far the feature distributions of two classes overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellkit.functions.columns import share
from dwellkit.operators.features import FEATURES_10
from dwellkit.operators.prefix import before, join_small, join_totals, with_value_part

BINS = 50


def long_features(
    events: DataFrame, features: Sequence[str] = tuple(FEATURES_10), digits: int = 9
) -> DataFrame:
    """(label, feature, value): one row per event and feature, made in the scan's stage.

    Values are rounded to ``digits``: a variance may differ in its last bit with the
    order of its sum, and a value on a bin edge must not change bins for that.
    """
    slim = events.select("label", *[F.round(F.col(f).cast("double"), digits).alias(f) for f in features])
    return slim.unpivot(["label"], list(features), "feature", "value")


def percentiles(
    values: DataFrame, probs: Sequence[float] = (0.05, 0.95), n_groups: int | None = None, steps: int = 2048
) -> DataFrame:
    """(label, feature, p05, p95, ...) exactly, with linear interpolation.

    Values are counted per ordered part of their group's range, which combines before
    it moves. The wanted order statistics lie in at most two parts per probability;
    only values of those parts are then collapsed, ordered and read. The rows
    themselves are never shuffled.
    """
    keys = ["label", "feature"]
    present = _weighted(values, n_groups)
    span = present.groupBy(*keys).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("w").alias("n_values")
    )
    parted = with_value_part(_with_range(present, span, keys, n_groups), "value", "lo", "hi", steps).drop("lo", "hi")
    counts = parted.groupBy(*keys, "value_part").agg(F.sum("w").alias("n"))
    placed = counts.withColumn("base", before(F.col("n"), keys, "value_part")).join(span.drop("lo", "hi"), keys)
    last = F.col("n_values") - 1
    spots = {}
    for p in probs:
        at = F.lit(float(p)) * last
        spots[f"lo_{_tag(p)}"], spots[f"hi_{_tag(p)}"] = F.floor(at), F.ceil(at)
    wanted = placed.filter(
        F.exists(F.array(*spots.values()), lambda i: (i >= F.col("base")) & (i < F.col("base") + F.col("n")))
    ).select(*keys, "value_part", "base", "n_values")
    n_wanted = n_groups and n_groups * 2 * len(probs)
    ordered = (
        join_small(parted, wanted, [*keys, "value_part"], n_wanted)
        .groupBy(*keys, "value_part", "base", "n_values", "value")
        .agg(F.sum("w").alias("n"))
        .withColumn("first_at", F.col("base") + before(F.col("n"), [*keys, "value_part"], "value"))
    )
    inside = {
        name: F.max(F.when((F.col("first_at") <= at) & (at < F.col("first_at") + F.col("n")), F.col("value")))
        for name, at in spots.items()
    }
    found = ordered.groupBy(*keys).agg(
        F.max("n_values").alias("n_values"), *[c.alias(name) for name, c in inside.items()]
    )
    out = []
    for p in probs:
        at = F.lit(float(p)) * last
        low, high = F.col(f"lo_{_tag(p)}"), F.col(f"hi_{_tag(p)}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(_tag(p)))
    return found.select(*keys, *out)


def _tag(p: float) -> str:
    return f"p{round(p * 100):02d}"


def approximate_percentiles(
    values: DataFrame, probs: Sequence[float] = (0.05, 0.95), accuracy: int = 10_000
) -> DataFrame:
    """The same table from mergeable sketches, for a first look at very large input."""
    found = values.groupBy("label", "feature").agg(
        F.percentile_approx("value", [float(p) for p in probs], accuracy).alias("q")
    )
    return found.select("label", "feature", *[F.col("q")[i].alias(_tag(p)) for i, p in enumerate(probs)])


def _pairs_of(pairs: Sequence[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in pairs])


def _in_pairs(df: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows once per listed pair their class is part of."""
    mine = F.filter(_pairs_of(pairs), lambda p: (p["first"] == F.col("label")) | (p["second"] == F.col("label")))
    return df.select("*", F.explode(mine).alias("pair")).select(
        "*", F.col("pair.first").alias("first"), F.col("pair.second").alias("second")
    ).drop("pair")


def axis_bounds(percentile_table: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(first, second, feature, axis_low, axis_high): 0.9 and 1.1 times the outer
    percentiles of the two classes."""
    return (
        _in_pairs(percentile_table, pairs)
        .groupBy("first", "second", "feature")
        .agg((F.min("p05") * 0.9).alias("axis_low"), (F.max("p95") * 1.1).alias("axis_high"))
    )


def _weighted(values: DataFrame, n_groups: int | None) -> DataFrame:
    """Values with a weight ``w``. Without a bound on the groups equal values are
    collapsed first: rows then differ, and a hot group can be spread by value."""
    present = values.filter(F.col("value").isNotNull())
    if n_groups is None:
        return present.groupBy("label", "feature", "value").agg(F.count(F.lit(1)).alias("w"))
    return present.select("label", "feature", "value", F.lit(1).cast("long").alias("w"))


def ranges(values: DataFrame) -> DataFrame:
    """(label, feature, lo, hi, n_values); a constant sample gets half a unit either
    side."""
    weight = F.col("w") if "w" in values.columns else F.lit(1)
    span = values.groupBy("label", "feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum(weight).alias("n_values")
    )
    flat = F.col("lo") == F.col("hi")
    return span.select(
        "label",
        "feature",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        "n_values",
    )


def _with_range(values: DataFrame, span: DataFrame, keys: Sequence[str], n_groups: int | None) -> DataFrame:
    if n_groups is None:
        return join_totals(values, span, keys, "n_values", F.col("value"))
    return join_small(values, span.drop("n_values"), list(keys), n_groups)


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of x among equal-width bins; the last one is closed. Rounding at an edge is
    settled by comparing with the edge itself."""
    width = (hi - lo) / bins
    guess = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return (
        F.when(x < lo + guess * width, guess - 1)
        .when((x >= lo + (guess + 1) * width) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )


def histograms(values: DataFrame, bins: int = BINS, edges: str = "own", n_groups: int | None = None) -> DataFrame:
    """(label, feature, bin, bin_low, bin_high, n, density), empty bins included.

    edges='own': range of each class; 'pooled': range of the feature over all classes.
    """
    values = _weighted(values, n_groups)
    span = ranges(values)
    if edges == "pooled":
        over = Window.partitionBy("feature")
        span = span.select(
            "label", "feature", F.min("lo").over(over).alias("lo"), F.max("hi").over(over).alias("hi"), "n_values"
        )
    elif edges != "own":
        raise ValueError("edges must be 'own' or 'pooled'")
    counted = (
        _with_range(values, span, ["label", "feature"], n_groups)
        .groupBy("label", "feature", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.sum("w").alias("n"))
    )
    spine = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    total = Window.partitionBy("label", "feature")
    width = (F.col("hi") - F.col("lo")) / bins
    n = F.coalesce("n", F.lit(0).cast("long"))
    return spine.join(counted, ["label", "feature", "bin"], "left").select(
        "label",
        "feature",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_high"),
        n.alias("n"),
        share(n, F.sum(n).over(total) * width).alias("density"),
    )


def pair_histograms(
    values: DataFrame,
    pairs: Sequence[tuple[int, int]],
    bins: int = BINS,
    edges: str = "first",
    n_groups: int | None = None,
) -> DataFrame:
    """(first, second, feature, bin, width, density_1, density_2) for non-empty bins.

    edges='first': the first class sets the range, values of the second outside it are
    left out and its density counts what is inside. edges='pooled': both classes do.
    """
    values = _weighted(values, n_groups)
    span = ranges(values)
    if edges == "first":
        mine = F.filter(_pairs_of(pairs), lambda p: p["first"] == F.col("label"))
    elif edges == "pooled":
        mine = F.filter(_pairs_of(pairs), lambda p: (p["first"] == F.col("label")) | (p["second"] == F.col("label")))
    else:
        raise ValueError("edges must be 'first' or 'pooled'")
    # Either class may be the large one, so a pair's rows are those of both.
    sized = _in_pairs(span, pairs).groupBy("first", "second", "feature").agg(F.sum("n_values").alias("n_values"))
    spans = (
        span.select("feature", "lo", "hi", F.explode(mine).alias("pair"))
        .groupBy("pair.first", "pair.second", "feature")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .join(sized, ["first", "second", "feature"])
    )
    n_spans = n_groups and n_groups * len(pairs)
    rows = _with_range(_in_pairs(values, pairs), spans, ["first", "second", "feature"], n_spans).filter(
        F.col("value").between(F.col("lo"), F.col("hi"))
    )
    counted = rows.groupBy(
        "first",
        "second",
        "feature",
        ((F.col("hi") - F.col("lo")) / bins).alias("width"),
        _bin(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"),
    ).agg(
        F.sum(F.when(F.col("label") == F.col("first"), F.col("w")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("label") == F.col("second"), F.col("w")).otherwise(0)).alias("n2"),
    )
    total = Window.partitionBy("first", "second", "feature")
    return counted.select(
        "first",
        "second",
        "feature",
        "bin",
        "width",
        share(F.col("n1"), F.sum("n1").over(total) * F.col("width")).alias("density_1"),
        share(F.col("n2"), F.sum("n2").over(total) * F.col("width")).alias("density_2"),
    )


def overlap(pair_table: DataFrame) -> DataFrame:
    """Per pair and feature: histogram masses, Bhattacharyya coefficient and distance,
    area of intersection. Disjoint samples have distance +Infinity and area 0."""
    w = F.col("width")
    sums = pair_table.groupBy("first", "second", "feature").agg(
        F.sum(F.col("density_1") * w).alias("mass_1"),
        F.sum(F.col("density_2") * w).alias("mass_2"),
        F.least(F.sum(F.sqrt(F.col("density_1") * F.col("density_2")) * w), F.lit(1.0)).alias("coefficient"),
        F.sum(F.least("density_1", "density_2") * w).alias("overlap_area"),
    )
    distance = F.when(F.col("coefficient") > 0, F.greatest(-F.ln("coefficient"), F.lit(0.0))).otherwise(
        F.lit(float("inf"))
    )
    return sums.withColumn("distance", distance)
