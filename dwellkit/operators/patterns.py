"""Counts of short state patterns in whole events, from run-length rows.

A run of n samples holds n - 1 equal pairs and n - 2 equal triples; all other pairs and
triples lie across the end of a run. So an event costs its runs, not its samples, and no row
grows with it. Runs meet only inside (record_id, chunk); a chunk is told the first two
samples that follow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellkit.operators.segment import OPEN_STATE, chunk_runs, chunked


def _following(samples: DataFrame) -> DataFrame:
    """(record_id, chunk, after_1, after_2): the two samples that come after a chunk that
    does not end open; an open sample, and what lies beyond it, is NULL."""
    place = Window.partitionBy("record_id", "chunk").orderBy("sample_idx")
    heads = (
        samples.withColumn("place", F.row_number().over(place))
        .where("place <= 2")
        .groupBy("record_id", "chunk")
        .agg(
            F.max(F.when(F.col("place") == 1, F.col("state"))).alias("first"),
            F.max(F.when(F.col("place") == 2, F.col("state"))).alias("second"),
        )
    )
    ends = samples.groupBy("record_id", "chunk").agg(F.max_by("state", "sample_idx").alias("last"))
    w = Window.partitionBy("record_id").orderBy("chunk")
    after_1 = F.lead("first").over(w)
    after_2 = F.coalesce(F.lead("second").over(w), F.lead("first", 2).over(w))
    shut = F.col("after_1") < OPEN_STATE
    return (
        heads.join(ends, ["record_id", "chunk"])
        .select("record_id", "chunk", "last", after_1.alias("after_1"), after_2.alias("after_2"))
        .where((F.col("last") < OPEN_STATE) & shut)
        .select("record_id", "chunk", "after_1", F.when(F.col("after_2") < OPEN_STATE, F.col("after_2")).alias("after_2"))
    )


def _name(*states: Column) -> Column:
    return F.concat_ws(",", *[s.cast("string") for s in states])


def pattern_counts(signal: DataFrame, chunk_samples: int | None = None) -> DataFrame:
    """(record_id, event_id, pattern, n): how often each single state, pair and triple of
    consecutive samples occurs in an event; patterns are states joined by commas.

    Samples that belong to no event stand in no pattern, and those around them are next to
    each other. Counts combine before they move, so an event sends a few rows per chunk.
    """
    w = Window.partitionBy("record_id", "chunk").orderBy("run_start")
    last_of_chunk = F.lead("state").over(w).isNull()
    pieces = (
        chunk_runs(signal, chunk_samples)
        .join(_following(chunked(signal, chunk_samples)), ["record_id", "chunk"], "left")
        .select(
            "record_id",
            "event_id",
            "state",
            "run_len",
            "after_1",
            "after_2",
            last_of_chunk.alias("is_last"),
            *[F.lead(c).over(w).alias(f"next_{c}") for c in ("state", "run_len", "event_id")],
            *[F.lead(c, 2).over(w).alias(f"second_{c}") for c in ("state", "event_id")],
        )
    )
    same = F.col("next_event_id") == F.col("event_id")
    then_last = F.col("second_state").isNull()
    second = F.when(F.col("second_event_id") == F.col("event_id"), F.col("second_state"))
    ahead = pieces.select(
        "record_id",
        "event_id",
        "state",
        "run_len",
        F.when(F.col("is_last"), F.col("after_1")).when(same, F.col("next_state")).alias("one"),
        F.when(F.col("is_last"), F.col("after_2"))
        .when(same & (F.col("next_run_len") > 1), F.col("next_state"))
        .when(same, F.when(then_last, F.col("after_1")).otherwise(second))
        .alias("two"),
    )
    s, n, one, two = (F.col(c) for c in ("state", "run_len", "one", "two"))
    once = F.lit(1).cast("long")
    found = [
        (_name(s), n),
        (_name(s, s), n - 1),
        (_name(s, s, s), n - 2),
        (_name(s, one), F.when(one.isNotNull(), once)),
        (_name(s, s, one), F.when(one.isNotNull() & (n > 1), once)),
        (_name(s, one, two), F.when(one.isNotNull() & two.isNotNull(), once)),
    ]
    rows = F.inline(F.array(*[F.struct(p.alias("pattern"), c.alias("n")) for p, c in found]))
    return ahead.select("record_id", "event_id", rows).where("n > 0").groupBy("record_id", "event_id", "pattern").agg(
        F.sum("n").alias("n")
    )


def event_patterns(signal: DataFrame, min_event_length: int = 5, chunk_samples: int | None = None) -> DataFrame:
    """(record_id, event_id, event_duration, patterns): kept events with their counts as a
    map, which has at most as many entries as there are patterns of three states."""
    single = ~F.col("pattern").contains(",")
    return (
        pattern_counts(signal, chunk_samples)
        .groupBy("record_id", "event_id")
        .agg(
            F.sum(F.when(single, F.col("n"))).alias("event_duration"),
            F.map_from_entries(F.collect_list(F.struct("pattern", "n"))).alias("patterns"),
        )
        .where(F.col("event_duration") > min_event_length)
    )
