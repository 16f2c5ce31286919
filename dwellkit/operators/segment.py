"""Cutting recordings into events and dwells.

An event is a maximal stretch without a sample in the open state (2). Samples above
the open state, or without a state, neither close an event nor belong to it, so they
are dropped at the scan. ``event_id`` is the number of open samples before the event
in its recording. A run is a maximal stretch of equal states inside an event.

Samples meet only inside (record_id, chunk): one exchange, one sort, and both running
sums ride on it. Runs and events that cross a chunk edge are completed from
``chunk_links``, one row per chunk, so no task ever holds a whole recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellkit.operators.prefix import HOT_ROWS, before, join_totals

OPEN_STATE = 2
CHUNK_SAMPLES = 1 << 20
# A part of a state sequence is a heavy row. An event of more parts than this fills
# that many chunks less two, which bounds how many such events there can be.
HOT_PARTS = 64


def chunked(signal: DataFrame, chunk_samples: int | None = None) -> DataFrame:
    """The samples that matter, with their chunk.

    A source may bring its own ``chunk`` (any BIGINT that never falls along
    sample_idx); it is kept unless ``chunk_samples`` asks for another cut. Samples of
    no recording are left out here, for both uses of the result: a join would add that
    filter to one of them only and keep them from sharing an exchange.
    """
    if "chunk" in signal.columns and chunk_samples is None:
        chunk: Column = F.col("chunk")
    else:
        chunk = F.floor(F.col("sample_idx") / (chunk_samples or CHUNK_SAMPLES)).cast("long")
    return (
        signal.filter((F.col("state") <= OPEN_STATE) & F.col("record_id").isNotNull())
        .select("record_id", chunk.alias("chunk"), "sample_idx", "state")
        .filter(F.col("chunk").isNotNull())
    )


def chunk_links(samples: DataFrame) -> DataFrame:
    """What a chunk must know of its neighbours, for recordings of several chunks.

    event_offset: open samples in earlier chunks. joins_prev / joins_next: the first /
    last run goes on across that edge. origin: chunk in which the run that joins from
    the left began. The aggregate combines before its exchange; the window sees one
    row per chunk.
    """
    per_chunk = samples.groupBy("record_id", "chunk").agg(
        F.count_if(F.col("state") == OPEN_STATE).alias("n_open"),
        F.min_by("state", "sample_idx").alias("first_state"),
        F.max_by("state", "sample_idx").alias("last_state"),
        F.min("sample_idx").alias("first_idx"),
        F.max("sample_idx").alias("last_idx"),
        (F.min("state") == F.max("state")).alias("one_state"),
    )
    w = Window.partitionBy("record_id").orderBy("chunk")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    prev, nxt = F.lag("last_state").over(w), F.lead("first_state").over(w)
    linked = per_chunk.select(
        "*",
        before(F.col("n_open"), ["record_id"], "chunk").alias("event_offset"),
        F.coalesce((prev == F.col("first_state")) & (prev < OPEN_STATE), F.lit(False)).alias("joins_prev"),
        F.coalesce((nxt == F.col("last_state")) & (nxt < OPEN_STATE), F.lit(False)).alias("joins_next"),
        (prev.isNotNull() | nxt.isNotNull()).alias("has_neighbour"),
    )
    passes_through = F.col("one_state") & F.col("joins_prev")
    return (
        linked.withColumn("origin", F.last(F.when(~passes_through, F.col("chunk")), ignorenulls=True).over(earlier))
        .filter("has_neighbour")
        .select("record_id", "chunk", "first_idx", "last_idx", "event_offset", "joins_prev", "joins_next", "origin")
    )


def chunk_runs(signal: DataFrame, chunk_samples: int | None = None) -> DataFrame:
    """Runs inside their chunk: (record_id, chunk, event_id, state, run_len, run_start,
    link). ``link`` is NULL for a whole run; pieces of one run that crosses chunk edges
    share the chunk number in which it began."""
    samples = chunked(signal, chunk_samples)
    w = Window.partitionBy("record_id", "chunk").orderBy("sample_idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        samples.select(
            "*",
            F.coalesce((F.col("state") != F.lag("state").over(w)).cast("long"), F.lit(0).cast("long")).alias("turn"),
        )
        .select(
            "*",
            F.sum("turn").over(so_far).alias("run_no"),
            F.sum((F.col("state") == OPEN_STATE).cast("long")).over(so_far).alias("local_event"),
        )
        .filter(F.col("state") < OPEN_STATE)
    )
    local = numbered.groupBy("record_id", "chunk", "local_event", "run_no", "state").agg(
        F.count(F.lit(1)).alias("run_len"),
        F.min("sample_idx").alias("run_start"),
        F.max("sample_idx").alias("run_end"),
    )
    tied = local.join(chunk_links(samples), ["record_id", "chunk"], "left")
    from_left = F.col("joins_prev") & (F.col("run_start") == F.col("first_idx"))
    to_right = F.col("joins_next") & (F.col("run_end") == F.col("last_idx"))
    return tied.select(
        "record_id",
        "chunk",
        (F.col("local_event") + F.coalesce("event_offset", F.lit(0).cast("long"))).alias("event_id"),
        "state",
        "run_len",
        "run_start",
        F.when(from_left, F.col("origin")).when(to_right, F.col("chunk")).alias("link"),
    )


def runs(
    signal: DataFrame, chunk_samples: int | None = None, min_event_length: int = 0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Dwells: one row per run, (record_id, event_id, run_start, state, run_len).

    The group key holds the run itself, so a long event spreads over all tasks.
    """
    pieces = chunk_runs(signal, chunk_samples)
    whole = F.when(F.col("link").isNull(), F.col("run_start"))
    merged = (
        pieces.withColumn("whole_start", whole)
        .groupBy("record_id", "event_id", "state", "link", "whole_start")
        .agg(F.sum("run_len").alias("run_len"), F.min("run_start").alias("run_start"))
        .select("record_id", "event_id", "run_start", "state", "run_len")
    )
    if min_event_length <= 0:
        return merged
    durations = (
        pieces.groupBy("record_id", "event_id")
        .agg(F.sum("run_len").alias("event_duration"), F.count(F.lit(1)).alias("n_pieces"))
        .filter(F.col("event_duration") > min_event_length)
    )
    kept = join_totals(merged, durations, ["record_id", "event_id"], "n_pieces", F.col("run_start"), hot_rows=hot_rows)
    return kept.drop("event_duration")


def run_lengths(signal: DataFrame, key: Column | str = "record_id", chunk_samples: int | None = None) -> DataFrame:
    """How many runs of each length: (key, state, run_len, n), over all events.

    ``key`` is record_id or an aliased expression on it, such as a class.

    Whole runs combine before the exchange; only pieces of runs that cross a chunk
    edge travel under their own key.
    """
    pieces = chunk_runs(signal, chunk_samples)
    cut = F.col("link").isNotNull()
    group = F.col(key) if isinstance(key, str) else key
    counted = (
        pieces.select(
            group,
            "state",
            "run_len",
            F.when(~cut, F.col("run_len")).alias("whole_len"),
            F.when(cut, F.col("record_id")).alias("cut_record"),
            "link",
        )
    )
    name = counted.columns[0]
    whole = F.col("whole_len").isNotNull()
    return (
        counted.groupBy(name, "state", "whole_len", "cut_record", "link")
        .agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("run_len").alias("pieces_len"))
        .select(
            name,
            "state",
            F.coalesce("whole_len", "pieces_len").alias("run_len"),
            F.when(whole, F.col("n_pieces")).otherwise(F.lit(1).cast("long")).alias("n"),
        )
        .groupBy(name, "state", "run_len")
        .agg(F.sum("n").alias("n"))
    )


def events(signal: DataFrame, min_event_length: int = 5, chunk_samples: int | None = None) -> DataFrame:
    """Kept events: strictly more than ``min_event_length`` surviving samples."""
    pieces = chunk_runs(signal, chunk_samples)
    return (
        pieces.groupBy("record_id", "event_id")
        .agg(F.min("run_start").alias("start_idx"), F.sum("run_len").alias("event_duration"))
        .filter(F.col("event_duration") > min_event_length)
    )


def run_parts(
    signal: DataFrame,
    min_event_length: int = 5,
    part_samples: int = CHUNK_SAMPLES,
    chunk_samples: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """State sequences of kept events, run-length encoded: (record_id, event_id, part,
    event_duration, runs array<struct<run_start, state, run_len>>).

    A run is in the part that its start falls in, counted in stretches of
    ``part_samples`` samples from the event's first one, so the rows are the same however
    the source cuts its recordings.
    """
    whole = runs(signal, chunk_samples)
    bounds = (
        whole.groupBy("record_id", "event_id")
        .agg(F.min("run_start").alias("start_idx"), F.sum("run_len").alias("event_duration"), F.count(F.lit(1)).alias("n_runs"))
        .filter(F.col("event_duration") > min_event_length)
    )
    kept = join_totals(whole, bounds, ["record_id", "event_id"], "n_runs", F.col("run_start"), hot_rows=hot_rows)
    part = F.floor((F.col("run_start") - F.col("start_idx")) / part_samples).cast("long")
    return kept.groupBy("record_id", "event_id", part.alias("part"), "event_duration").agg(
        F.array_sort(F.collect_list(F.struct("run_start", "state", "run_len"))).alias("runs")
    )


def state_parts(
    signal: DataFrame, min_event_length: int = 5, chunk_samples: int | None = None, hot_parts: int = HOT_PARTS
) -> DataFrame:
    """State sequences of kept events, whole, one row per event and chunk.

    (record_id, event_id, event_duration, chunk, n_states, states). A row holds at most
    one chunk, so an event of any length can be written and read; ``states_of`` joins
    the rows of events that fit one.
    """
    parts = (
        chunk_runs(signal, chunk_samples)
        .groupBy("record_id", "chunk", "event_id")
        .agg(
            F.sum("run_len").alias("n_states"),
            F.array_sort(F.collect_list(F.struct("run_start", "state", "run_len"))).alias("part_runs"),
        )
    )
    kept = (
        chunk_runs(signal, chunk_samples)
        .groupBy("record_id", "event_id", "chunk")
        .agg(F.sum("run_len").alias("n_states"))
        .groupBy("record_id", "event_id")
        .agg(F.sum("n_states").alias("event_duration"), F.count(F.lit(1)).alias("n_parts"))
        .filter(F.col("event_duration") > min_event_length)
    )
    states = F.flatten(F.transform("part_runs", lambda r: F.array_repeat(r["state"], r["run_len"].cast("int"))))
    joined = join_totals(parts, kept, ["record_id", "event_id"], "n_parts", F.col("chunk"), hot_rows=hot_parts)
    return joined.select("record_id", "event_id", "event_duration", "chunk", "n_states", states.alias("states"))


def _in_order(parts: DataFrame) -> DataFrame:
    return (
        parts.groupBy("record_id", "event_id", "event_duration")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "states"))).alias("ordered"))
        .select("record_id", "event_id", "event_duration", F.flatten(F.col("ordered.states")).alias("states"))
    )


def states_of(parts: DataFrame, max_states: int = 50_000_000) -> DataFrame:
    """One ``states`` array per event, from ``state_parts``.

    An event longer than a row can hold is refused with an error before anything is
    gathered; read its parts instead.
    """
    fits = F.when(F.col("event_duration") <= max_states, F.lit(True)).otherwise(
        F.raise_error(F.lit("event too long for one row; use its state_parts")).cast("boolean")
    )
    return _in_order(parts.filter(fits))


def bounded_states(parts: DataFrame, length: int, keep: str = "head") -> DataFrame:
    """First (or last) states of every event, at least ``length`` where there are so
    many, from ``state_parts``: (record_id, event_id, event_duration, states).

    Each part is cut before the exchange and parts beyond ``length`` are dropped
    before they are gathered, so an event costs its parts, not its samples.
    """
    order = F.asc("chunk") if keep == "head" else F.desc("chunk")
    earlier = Window.partitionBy("record_id", "event_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if keep == "head":
        cut = F.slice("states", 1, length)
    else:
        cut = F.slice("states", F.greatest(F.size("states") - length, F.lit(0)) + 1, F.lit(length))
    needed = (
        parts.select("record_id", "event_id", "event_duration", "chunk", "n_states", cut.alias("states"))
        .withColumn("ahead", F.coalesce(F.sum("n_states").over(earlier), F.lit(0)))
        .filter(F.col("ahead") < length)
    )
    return _in_order(needed)
