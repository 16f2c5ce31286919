"""Exact sampling, splitting and encoding of event tables.

Random draws of the usual libraries depend on row order, which a distributed table
does not have. Here the draw is the order of md5(id, seed): repeatable on any cluster,
and exact in its counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellkit.functions.columns import lookup, one_hot, pad
from dwellkit.operators.prefix import before, hash_chunk, hash_key, join_totals, mark_first_by_hash, number_by_hash
from dwellkit.operators.segment import CHUNK_SAMPLES, bounded_states

EVENT_ID = ("record_id", "event_id")


def union_labelled(parts: Mapping[str, DataFrame], labels: Mapping[str, int]) -> DataFrame:
    """Event tables of several classes as one, each row with its label. A class
    without a label is an error."""
    missing = sorted(set(parts) - set(labels))
    if missing:
        raise KeyError(f"no label for {missing}")
    out = None
    for name, df in parts.items():
        labelled = df.withColumn("label", F.lit(labels[name]))
        out = labelled if out is None else out.unionByName(labelled)
    return out


def _marked(
    events: DataFrame, quota: Column, n_groups: int | None, group: str, seed: str, ids: Sequence[str], flag: str
) -> DataFrame:
    hashed = events.withColumn("draw", hash_key(*ids, seed=seed))
    counts = events.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    quotas = counts.select(group, quota.cast("long").alias("quota_rows"))
    return mark_first_by_hash(hashed, group, "draw", ids, quotas, n_groups, flag).drop("draw")


def downsample(
    events: DataFrame,
    fractions: Sequence[float | None],
    class_names: Sequence[str],
    seed: str = "42",
    ids: Sequence[str] = EVENT_ID,
) -> DataFrame:
    """Exactly int(n * fraction) events of each class, without replacement.

    None or a fraction >= 1 keeps the class whole, a fraction <= 0 drops it. A label
    without a fraction is an error.
    """
    if len(fractions) != len(class_names):
        raise ValueError(f"{len(fractions)} fractions for {len(class_names)} classes")
    wanted = lookup(F.col("label"), [1.0 if f is None else float(f) for f in fractions])
    known = F.coalesce(F.col("label").between(0, len(class_names) - 1), F.lit(False))
    refused = F.raise_error(F.lit("an event of a class without a fraction")).cast("long")
    quota = (
        F.when(~known, refused)
        .when(wanted >= 1, F.col("n_rows"))
        .when(wanted > 0, F.floor(F.col("n_rows") * wanted))
        .otherwise(F.lit(0))
    )
    return _marked(events, quota, len(class_names), "label", seed, ids, "kept").filter("kept").drop("kept")


def stratified_split(
    events: DataFrame,
    test_fraction: float = 0.2,
    seed: str = "42",
    n_classes: int | None = None,
    ids: Sequence[str] = EVENT_ID,
) -> DataFrame:
    """Adds ``is_test``: round(n * fraction) events of every class."""
    quota = F.round(F.col("n_rows") * F.lit(float(test_fraction)))
    return _marked(events, quota, n_classes, "label", seed, ids, "is_test")


def group_split(
    events: DataFrame,
    group: str = "record_id",
    test_fraction: float = 0.2,
    seed: str = "42",
    label: str | None = "label",
    ids: Sequence[str] = EVENT_ID,
) -> DataFrame:
    """Adds ``is_test`` with no group on both sides.

    In every class, groups in hash order are test groups until round(n * fraction) rows are
    reached, so a class's test rows exceed that by less than one group. A group with rows of
    two classes counts as two; with ``label=None`` all rows are one class. Rows without a
    group or class are no test rows. Only groups are numbered, one row each; the hash
    spreads them, and totals are carried between its parts.
    """
    by = [label] if label else []
    sizes = events.groupBy(group, *by).agg(F.count(F.lit(1)).alias("n_events"))
    cut = sizes.withColumn("draw", hash_key(group, seed=seed)).withColumn("hash_part", hash_chunk(F.col("draw")))
    parts = cut.groupBy(*by, "hash_part").agg(F.sum("n_events").alias("n_part"))
    carried = parts.select(
        *by,
        "hash_part",
        before(F.col("n_part"), by, "hash_part").alias("n_before"),
        F.round(F.sum("n_part").over(Window.partitionBy(*by)) * F.lit(float(test_fraction))).alias("quota_events"),
    )
    earlier = Window.partitionBy(*by, "hash_part").orderBy("draw", group).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("n_before") + F.coalesce(F.sum("n_events").over(earlier), F.lit(0))
    sides = (
        cut.join(carried, [*by, "hash_part"])
        .withColumn("is_test", so_far < F.col("quota_events"))
        .select(group, *by, "n_events", "is_test")
    )
    marked = join_totals(events, sides, [group, *by], "n_events", hash_key(*ids), "left")
    return marked.withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def validation_split(
    train: DataFrame, fraction: float = 0.2, seed: str = "val", ids: Sequence[str] = EVENT_ID
) -> DataFrame:
    """Adds ``is_validation``: the rows after the first floor(n * (1 - fraction))."""
    quota = F.floor(F.col("n_rows") * F.lit(1.0 - float(fraction)))
    # One group for all rows, by a key that is the same for every row yet not a literal,
    # so that the one-row bounds stay the build side of a hash join.
    whole = train.withColumn("everything", F.length(hash_key(*ids)))
    marked = _marked(whole, quota, 1, "everything", seed, ids, "fits")
    return marked.withColumn("is_validation", ~F.col("fits")).drop("fits", "everything")


def mixture_sample(
    events: DataFrame,
    spec: Mapping[int, float],
    total: int,
    seed: str = "mix",
    ids: Sequence[str] = EVENT_ID,
) -> DataFrame:
    """int(total * fraction) events of each class in ``spec``; more than a class holds
    is an error."""
    chosen = events.filter(F.col("label").isin(list(spec))).withColumn("draw", hash_key(*ids, seed=seed))
    # From the spec, so that a class without any event is refused too.
    counts = chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    asked = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(int(total * f)).alias("take")) for k, f in spec.items()])
    wanted = events.sparkSession.range(1).select(F.inline(asked)).join(counts, "label", "left")
    enough = F.col("take") <= F.coalesce("n_rows", F.lit(0))
    refused = F.raise_error(F.lit("a class holds fewer events than the mixture asks for")).cast("long")
    quotas = wanted.select("label", F.when(enough, F.col("take").cast("long")).otherwise(refused).alias("quota_rows"))
    # The refusal must be met even where a class has no row for a join to find.
    checked = quotas.agg(F.min("quota_rows") >= 0).scalar()
    marked = mark_first_by_hash(chosen, "label", "draw", ids, quotas, len(spec), "kept")
    return marked.filter(F.col("kept") & checked).drop("kept", "draw")


def shuffled(df: DataFrame, seed: str = "shuffle", ids: Sequence[str] = EVENT_ID) -> DataFrame:
    """Rows in hash order (a range-partitioned sort)."""
    return df.withColumn("draw", hash_key(*ids, seed=seed)).orderBy("draw", *ids).drop("draw")


def permute_column(
    df: DataFrame, column: str, seed: str = "perm", ids: Sequence[str] = EVENT_ID, out: str | None = None
) -> DataFrame:
    """One column shuffled over all rows, the others in place: the row numbered i in
    one hash order gets the value of the row numbered i in another."""
    targets = number_by_hash(df.withColumn("draw", hash_key(*ids, seed=f"{seed}-to")), "draw", ids, "place")
    givers = number_by_hash(
        df.select(*ids, F.col(column).alias("given")).withColumn("draw", hash_key(*ids, seed=f"{seed}-from")),
        "draw",
        ids,
        "place",
    ).select("place", "given")
    return targets.join(givers, "place").withColumn(out or column, F.col("given")).drop("given", "place", "draw")


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def max_sequence_length(train: DataFrame) -> DataFrame:
    """One row: the longest event among the training rows."""
    return train.agg(F.max("event_duration").alias("max_length"))


def pad_sequences(parts: DataFrame, length: int, keep: str = "head", value: float = -1.0) -> DataFrame:
    """Fixed-length float sequences per event, from ``state_parts``."""
    return bounded_states(parts, length, keep).withColumn("padded", pad(F.col("states"), length, keep, value))


def pad_parts(
    parts: DataFrame, length: Column, keep: str = "head", value: float = -1.0, part_states: int = CHUNK_SAMPLES
) -> DataFrame:
    """Sequences padded or cut to ``length``, from ``state_parts``, in rows of at most
    ``part_states``: (record_id, event_id, part, padded).

    ``length`` is an expression, such as the longest training event as a scalar: nothing is
    brought to the driver and no row grows with it. Part p holds places p * part_states and
    on; the parts of an event, one after the other, are its whole padded sequence. Longer
    events keep their head or tail. Without a length (no training event) there is no row.
    """
    if keep not in ("head", "tail"):
        raise ValueError("keep must be 'head' or 'tail'")
    event = ["record_id", "event_id"]
    size = F.lit(part_states).cast("long")
    earlier = Window.partitionBy(*event).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    left_out = F.greatest(F.col("event_duration") - F.col("length"), F.lit(0)) if keep == "tail" else F.lit(0)
    held = parts.withColumn("length", length.cast("long")).filter(F.col("length") > 0)
    placed = (
        held.withColumn("at", F.coalesce(F.sum("n_states").over(earlier), F.lit(0)) - left_out)
        .withColumn("first", F.greatest("at", F.lit(0)))
        .withColumn("last", F.least(F.col("at") + F.col("n_states"), F.col("length")) - 1)
        .filter("last >= first")
        .withColumn("part", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(F.col("last") / size))))
        .withColumn("lo", F.greatest(F.col("first"), F.col("part") * size))
        .withColumn("hi", F.least(F.col("last"), F.col("part") * size + size - 1))
    )
    piece = F.slice("states", (F.col("lo") - F.col("at") + 1).cast("int"), (F.col("hi") - F.col("lo") + 1).cast("int"))
    pieces = (
        placed.select(*event, "part", F.struct("lo", piece.alias("states")).alias("piece"))
        .groupBy(*event, "part")
        .agg(F.flatten(F.array_sort(F.collect_list("piece"))["states"]).alias("known"))
    )
    last_part = F.floor((F.col("length") - 1) / size)
    spine = held.select(*event, "length").distinct().withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last_part)))
    known = F.coalesce("known", F.array().cast("array<int>"))
    places = F.least(size, F.col("length") - F.col("part") * size).cast("int")
    fill = F.array_repeat(F.lit(float(value)).cast("float"), places - F.size(known))
    padded = F.concat(F.transform(known, lambda s: s.cast("float")), fill)
    return spine.join(pieces, [*event, "part"], "left").select(*event, "part", padded.alias("padded"))


def encode_labels(df: DataFrame, n_classes: int) -> DataFrame:
    return df.withColumn("one_hot", one_hot(F.col("label"), n_classes))


def nan_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n_nan): NaN or NULL values per column, counted in one pass."""
    counts = df.agg(
        *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns]
    )
    return counts.unpivot([], list(columns), "feature", "n_nan").withColumn("has_nan", F.col("n_nan") > 0)
