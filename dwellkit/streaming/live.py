"""Events of recordings that are still being written.

One state per recording: where the next sample is due, the open event's running dwell
statistics, and samples that arrived ahead of their turn. The state does not grow with
the length of an event. The output rows equal those of the batch job.

Spark takes a few milliseconds for each key of each micro-batch, whatever it holds. So
recordings share keys: a lane's keyed state is that of its open recordings.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from dwellkit.operators.features import FEATURES_13

OPEN_STATE = 2
WHOLE = ("first_transition_time", "longest_dwell_0", "longest_dwell_1", "event_duration", "num_transitions")
OUTPUT_COLUMNS = "event_id long, start_idx long, " + ", ".join(
    f"{f} {'long' if f in WHOLE else 'double'}" for f in FEATURES_13
)
OUTPUT = f"record_id long, {OUTPUT_COLUMNS}"
STATE = "due long, opens long, event string, early_idx array<long>, early_state array<int>, last_idx long, closed boolean"


def _close_run(event: dict) -> None:
    """Fold the run being read into its state's statistics: runs, sum, squares, longest."""
    run = event["run_len"]
    stats = event["stats"].setdefault(str(event["run_state"]), [0, 0, 0, 0])
    stats[0] += 1
    stats[1] += run
    stats[2] += run * run
    stats[3] = max(stats[3], run)
    if event["first_len"] is None:
        event["first_len"] = run


def _features(event: dict) -> dict[str, Any]:
    _close_run(event)
    stats = event["stats"]
    counts = np.array([s[1] for s in stats.values()], dtype=float)
    total, runs = int(counts.sum()), sum(s[0] for s in stats.values())
    p = counts / total
    row: dict[str, Any] = {
        "start_idx": event["start"],
        "entropy": max(float(-(p * np.log2(p)).sum()), 0.0),
        "first_transition_time": event["first_len"] if runs > 1 else -1,
        "event_duration": total,
        "num_transitions": runs - 1,
    }
    n = {}
    for k in (0, 1):
        k_runs, k_sum, k_sq, k_max = stats.get(str(k), [0, 0, 0, 0])
        n[k] = k_sum
        row[f"avg_dwell_{k}"] = k_sum / k_runs if k_runs else 0.0
        row[f"var_dwell_{k}"] = (k_sq * k_runs - k_sum * k_sum) / (k_runs * k_runs) if k_runs else 0.0
        row[f"longest_dwell_{k}"] = k_max
        row[f"probability_{k}"] = k_sum / total
    row["ratio_0_to_1"] = n[0] / n[1] if n[1] else float(n[0])
    return row


def _read(event: dict | None, opens: int, idx: np.ndarray, states: np.ndarray) -> tuple[dict | None, int, list[dict]]:
    """Read samples in order; returns the open event, the open-sample count and the
    events that closed."""
    closed = []
    keep = states <= OPEN_STATE
    idx, states = idx[keep], states[keep]
    if len(states) == 0:
        return event, opens, closed
    starts = np.flatnonzero(np.r_[True, states[1:] != states[:-1]])
    lengths = np.diff(np.r_[starts, len(states)])
    for at, length in zip(starts.tolist(), lengths.tolist()):
        state = int(states[at])
        if state == OPEN_STATE:
            if event is not None:
                closed.append({"event_id": opens, **_features(event)})
                event = None
            opens += length
        elif event is None:
            event = {"start": int(idx[at]), "stats": {}, "first_len": None, "run_state": state, "run_len": length}
        elif state == event["run_state"]:
            event["run_len"] += length
        else:
            _close_run(event)
            event["run_state"], event["run_len"] = state, length
    return event, opens, closed


def _ready(idx: np.ndarray, due: int, most_ahead: int | None) -> int:
    """How many of the waiting samples are read now: those due in a row, and, while more than
    ``most_ahead`` would wait, those after the next gap too."""
    if not len(idx):
        return 0
    ends = np.flatnonzero(np.r_[idx[1:] != idx[:-1] + 1, True]) + 1  # of the rows without a gap
    ready = int(ends[0]) if idx[0] == due else 0
    if most_ahead is not None and len(idx) - ready > most_ahead:
        ready = int(ends[np.searchsorted(ends, len(idx) - most_ahead)])
    return ready


#: Keys that recordings share. Part of the state: a stream goes on with the number it began with.
LANES = 1024
LANE_STATE = "recordings binary"
#: Types of record ids that tell recordings of a lane apart.
LANE_KINDS = ("tinyint", "smallint", "int", "bigint", "string")
NEW = (0, 0, None, [], [], None, False)


def _advance(
    value: tuple, idx: np.ndarray, states: np.ndarray, last_idx: int | None, most_ahead: int | None, timed_out: bool
) -> tuple[tuple, list[dict]]:
    """A recording's state (that of ``STATE``, the event unpacked) after these samples, in
    order of arrival, or after its silence; and the events that closed."""
    due, opens, event, early_idx, early_state, known_last, _ = value
    last_idx = known_last if last_idx is None else last_idx
    if len(early_idx):
        idx = np.concatenate([np.array(early_idx, dtype="int64"), idx])
        states = np.concatenate([np.array(early_state, dtype="int64"), states])
    order = np.argsort(idx, kind="stable")
    idx, states = idx[order], states[order]
    fresh = idx >= due
    idx, states = idx[fresh], states[fresh]
    if len(idx):
        first_seen = np.r_[True, idx[1:] != idx[:-1]]
        idx, states = idx[first_seen], states[first_seen]
    ready = len(idx) if timed_out else _ready(idx, due, most_ahead)
    event, opens, rows = _read(event, opens, idx[:ready], states[:ready])
    due = int(idx[ready - 1]) + 1 if ready else due
    if timed_out or (last_idx is not None and due > last_idx):
        if event is not None:
            rows.append({"event_id": opens, **_features(event)})
        return (due, opens, None, [], [], last_idx, True), rows
    return (due, opens, event, idx[ready:].tolist(), states[ready:].tolist(), last_idx, False), rows


def _samples(batches: Iterator[pd.DataFrame], event_time: bool, named: bool = False) -> tuple[np.ndarray, ...]:
    """Positions, states, marks of the last sample and times in ms of a key's rows (and their recordings)."""
    parts = []
    for pdf in batches:
        parts.append(
            (
                pdf["sample_idx"].to_numpy("int64"),
                # A missing state reads as "above open": it neither closes nor belongs.
                pdf["state"].fillna(OPEN_STATE + 1).to_numpy("int64"),
                pdf["is_last"].fillna(False).to_numpy(bool),
                pdf["event_time"].to_numpy("datetime64[ms]").astype("int64") if event_time else np.zeros(len(pdf), "int64"),
                *([pdf["record_id"].to_numpy()] if named else []),
            )
        )
    if not parts:
        return tuple(np.empty(0, t) for t in ("int64", "int64", bool, "int64", *(["O"] if named else [])))
    return tuple(np.concatenate(p) for p in zip(*parts))


def segmenter(
    min_event_length: int, idle_ms: int, event_time: bool, most_ahead: int | None = None, remember_closed: bool = False
):
    """The step for applyInPandasWithState where each recording is a key."""

    def keep(state, latest: int | None, *value) -> None:
        state.update(value)
        if event_time:
            state.setTimeoutTimestamp(max(latest or 0, state.getCurrentWatermarkMs()) + idle_ms)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        due, opens, event, early_idx, early_state, last_idx, closed = state.get if state.exists else NEW
        if closed:
            # Late and repeated samples of a closed recording open nothing; silence forgets it.
            if state.hasTimedOut:
                state.remove()
            else:
                keep(state, None, due, opens, None, [], [], last_idx, True)
            return
        value = (due, opens, json.loads(event) if event else None, early_idx, early_state, last_idx, False)
        idx, states, ends, times = _samples(() if state.hasTimedOut else batches, event_time)
        last = int(idx[ends].max()) if ends.any() else None
        value, rows = _advance(value, idx, states, last, most_ahead, state.hasTimedOut)
        if value[6] and not remember_closed:
            state.remove()
        else:
            packed = json.dumps(value[2]) if value[2] is not None else None
            keep(state, int(times.max()) if len(times) else None, *value[:2], packed, *value[3:])
        kept = [{"record_id": key[0], **r} for r in rows if r["event_duration"] > min_event_length]
        if kept:
            yield pd.DataFrame(kept)[["record_id", "event_id", "start_idx", *FEATURES_13]]

    return step


def lane_segmenter(
    min_event_length: int, idle_ms: int, event_time: bool, most_ahead: int | None = None, remember_closed: bool = False
) -> Callable:
    """The step for applyInPandasWithState where a key is a lane: what ``segmenter`` does, for each
    recording that has samples or, by its own deadline, has fallen silent."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_now: dict = pickle.loads(state.get[0]) if state.exists else {}  # id: (state of the recording, deadline)
        watermark = state.getCurrentWatermarkMs() if event_time else None
        rows: list[dict] = []

        def move(record, idx, states, last, latest: int | None, timed_out: bool) -> None:
            value = open_now[record][0] if record in open_now else NEW
            if value[6]:
                # As for a single recording: a mark stays while samples come, and goes with the silence.
                value, latest = None if timed_out else value, None
            else:
                value, closed = _advance(value, idx, states, last, most_ahead, timed_out)
                rows.extend({"record_id": record, **r} for r in closed if r["event_duration"] > min_event_length)
                if value[6] and not remember_closed:
                    value = None
            if value is None:
                open_now.pop(record, None)
            else:
                open_now[record] = (value, max(latest or 0, watermark) + idle_ms if event_time else None)

        idx, states, ends, times, records = _samples(() if state.hasTimedOut else batches, event_time, named=True)
        if key[0] < 0:  # samples of no recording have a lane to themselves
            codes, names = np.zeros(len(idx), "int64"), [None]
        else:
            codes, names = pd.factorize(records)
            names = names.tolist()
        order = np.argsort(codes, kind="stable")
        idx, states, ends, times, codes = (c[order] for c in (idx, states, ends, times, codes))
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else []
        for a, b in zip(cuts, cuts[1:]):
            own = idx[a:b]
            last = int(own[ends[a:b]].max()) if ends[a:b].any() else None
            move(names[codes[a]], own, states[a:b], last, int(times[a:b].max()) if event_time else None, False)
        if event_time:
            came = {names[c] for c in codes[cuts[:-1]].tolist()} if len(codes) else set()
            none = np.empty(0, "int64")
            for record in [r for r, (_, deadline) in open_now.items() if deadline < watermark and r not in came]:
                move(record, none, none, None, None, True)
        if open_now:
            state.update((pickle.dumps(open_now, pickle.HIGHEST_PROTOCOL),))
            if event_time:
                state.setTimeoutTimestamp(min(deadline for _, deadline in open_now.values()))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows)[["record_id", "event_id", "start_idx", *FEATURES_13]]

    return step


def live_events(
    stream: DataFrame,
    min_event_length: int = 5,
    idle_ms: int = 3_600_000,
    event_time: str | None = None,
    lateness: str = "10 minutes",
    most_ahead: int | None = None,
    remember_closed: bool | None = None,
    lanes: int | None = LANES,
) -> DataFrame:
    """Features of events as they close, from a streaming signal.

    ``stream`` has record_id, sample_idx (dense from 0), state and is_last (true on a
    recording's final sample). Samples may arrive in any order. A recording is flushed
    at its final sample and, where ``event_time`` names a timestamp column, also when
    the watermark shows it silent for ``idle_ms``.

    A missing sample holds back those after it. With ``most_ahead`` a recording never keeps
    more samples waiting: gaps before the others are then taken as lost, their samples are
    ignored should they still come, and the events are those of the samples that came.
    Without it a gap waits for ever, or until the recording falls silent.

    ``remember_closed`` keeps a mark of each closed recording, so that late and repeated samples
    don't open it anew. With an event time, marks are the default and go once the watermark is
    ``idle_ms`` past the last sample; without one they stay, a row for each recording.

    Recordings share ``lanes`` keys, so a micro-batch costs its samples, not its recordings; a
    lane's state is that of its open recordings. Each recording is a key without lanes, where marks
    stay for ever, and for ids that are neither whole numbers nor text.
    """
    kind = stream.schema["record_id"].dataType.simpleString()
    columns = ["record_id", "sample_idx", "state", "is_last"]
    if event_time:
        slim = stream.select(*columns, F.col(event_time).alias("event_time")).withWatermark("event_time", lateness)
        timeout = GroupStateTimeout.EventTimeTimeout
    else:
        slim = stream.select(*columns)
        timeout = GroupStateTimeout.NoTimeout
    remember = event_time is not None if remember_closed is None else remember_closed
    how = (min_event_length, idle_ms, event_time is not None, most_ahead, remember)
    output = f"record_id {kind}, {OUTPUT_COLUMNS}"
    if lanes is None or kind not in LANE_KINDS or (remember and not event_time):
        return slim.groupBy("record_id").applyInPandasWithState(segmenter(*how), output, STATE, "append", timeout)
    lane = F.when(F.col("record_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("record_id"), F.lit(lanes))).cast("int")
    by_lane = slim.withColumn("lane", lane).groupBy("lane")
    return by_lane.applyInPandasWithState(lane_segmenter(*how), output, LANE_STATE, "append", timeout)


def run_to_end(events: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is available, exactly once, into parquet, and stop."""
    query = (
        events.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
