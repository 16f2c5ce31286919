import random

import brute
import pandas as pd
import pytest

from dwellkit.operators.features import FEATURES_13
from dwellkit.streaming import live


class FakeState:
    """What the step function sees of a keyed state."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms

    def getCurrentWatermarkMs(self):
        return 0


def frame(rows):
    return pd.DataFrame(rows, columns=["sample_idx", "state", "is_last"])


def feed(step, state, batches):
    out = []
    for b in batches:
        out += [r for pdf in step((5,), iter([frame(b)]), state) for r in pdf.to_dict("records")]
    return out


def check(rows, states, min_len=5):
    want = {e: brute.features(seq) | {"start_idx": start} for e, start, seq in brute.events(states, min_len)}
    assert {r["event_id"] for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        for f in FEATURES_13:
            assert r[f] == pytest.approx(want[r["event_id"]][f], abs=1e-9), f
        assert r["start_idx"] == want[r["event_id"]]["start_idx"]


@pytest.mark.parametrize("seed", range(6))
def test_any_order_any_batches(seed):
    rng = random.Random(seed)
    states = [rng.choice([0, 0, 1, 1, 2, 3, -1, None]) for _ in range(300)] + [0] * 8
    rows = [(i, s, i == len(states) - 1) for i, s in enumerate(states)]
    rng.shuffle(rows)
    rows += rows[:20]  # replayed samples
    batches = [rows[i : i + 37] for i in range(0, len(rows), 37)]
    state = FakeState()
    out = feed(live.segmenter(5, 1000, False), state, batches)
    check(out, states)


def test_final_sample_flushes_and_forgets():
    state = FakeState()
    out = feed(live.segmenter(5, 1000, False), state, [[(i, 0, i == 9) for i in range(10)]])
    assert len(out) == 1 and not state.exists


def test_timeout_flushes_what_is_there():
    state = FakeState()
    step = live.segmenter(5, 1000, False)
    assert feed(step, state, [[(i, 1, False) for i in range(4)], [(i, 1, False) for i in range(6, 9)]]) == []
    state.hasTimedOut = True
    out = [r for pdf in step((5,), iter([]), state) for r in pdf.to_dict("records")]
    assert [r["event_duration"] for r in out] == [7] and not state.exists


def test_state_does_not_grow_with_the_event():
    state = FakeState()
    step = live.segmenter(5, 1000, False)
    sizes = []
    for b in range(20):
        feed(step, state, [[(i, i // 3 % 2, False) for i in range(b * 100, b * 100 + 100)]])
        sizes.append(len(str(state.value)))
    assert sizes[-1] < sizes[2] + 40


@pytest.mark.parametrize("seed", range(4))
def test_lost_samples_hold_back_a_bounded_number(seed):
    """Events are those of the samples that came, and no more than the bound ever waits."""
    rng = random.Random(seed)
    states = [rng.choice([0, 0, 0, 1, 1, 2]) for _ in range(400)] + [0]
    lost = set(rng.sample(range(400), 25))
    rows = [(i, s, i == 400) for i, s in enumerate(states) if i not in lost]
    state, out = FakeState(), []
    step = live.segmenter(0, 1000, False, most_ahead=10, remember_closed=True)
    for at in range(0, len(rows), 7):
        chunk = rows[at : at + 7]
        rng.shuffle(chunk)
        out += feed(step, state, [chunk])
        assert len(state.value[3]) <= 10
    # What still waits behind the last gaps comes with the timeout.
    if not state.value[6]:
        state.hasTimedOut = True
        out += [r for pdf in step((5,), iter([]), state) for r in pdf.to_dict("records")]
    came = [s for i, s in enumerate(states) if i not in lost]
    want = [brute.features(seq) for _, _, seq in brute.events(came, 0)]
    assert [r["event_duration"] for r in out] == [w["event_duration"] for w in want]
    for r, w in zip(out, want):
        assert all(r[f] == pytest.approx(w[f], abs=1e-9) for f in FEATURES_13)


def test_a_gap_waits_without_a_bound_and_goes_with_one():
    late = [[(i, 0, False) for i in range(5)], [(i, 0, False) for i in range(6, 20)], [(5, 0, False)], [(20, 2, True)]]
    assert [r["event_duration"] for r in feed(live.segmenter(5, 1000, False), FakeState(), late)] == [20]
    assert [r["event_duration"] for r in feed(live.segmenter(5, 1000, False, most_ahead=8), FakeState(), late)] == [19]


def test_closed_recordings_stay_closed_until_forgotten():
    state = FakeState()
    step = live.segmenter(5, 1000, True, remember_closed=True)

    def send(rows):
        pdf = frame(rows).assign(event_time=pd.Timestamp("2024-01-01"))
        return [r for out in step((5,), iter([pdf]), state) for r in out.to_dict("records")]

    assert len(send([(i, 0, i == 9) for i in range(10)])) == 1 and state.exists
    state.timeout = None
    assert send([(i, 0, i == 9) for i in range(10)]) == [] and state.exists and state.timeout is not None
    state.hasTimedOut = True
    assert list(step((5,), iter([]), state)) == [] and not state.exists


def test_ids_of_any_type(spark, tmp_path):
    rows = [(f"r{k}.csv", i, 0, i == 7) for k in range(2) for i in range(8)]
    schema = "record_id string, sample_idx long, state int, is_last boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    events = live.live_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), most_ahead=100)
    live.run_to_end(events, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.record_id, r.event_duration) for r in got) == [("r0.csv", 8), ("r1.csv", 8)]


def test_event_time_sets_a_timeout():
    state = FakeState()
    pdf = frame([(0, 0, False)]).assign(event_time=pd.Timestamp("2024-01-01"))
    list(live.segmenter(5, 1000, True)((5,), iter([pdf]), state))
    assert state.timeout == int(pd.Timestamp("2024-01-01").timestamp() * 1000) + 1000


def test_event_time_stream_flushes_silent_recordings(spark, tmp_path):
    """Recording 1 falls silent without a final sample; recording 2 moves the watermark."""
    for name, rec, n, start in (("a", 1, 8, 1000), ("b", 2, 3, 8000), ("c", 2, 3, 16000)):
        rows = [(rec, i + (3 if name == "c" else 0), 0, False, start + i) for i in range(n)]
        df = spark.createDataFrame(rows, "record_id long, sample_idx long, state int, is_last boolean, sec long")
        df.selectExpr("record_id", "sample_idx", "state", "is_last", "timestamp_seconds(sec) AS at").coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))
    stream = (
        spark.readStream.schema("record_id long, sample_idx long, state int, is_last boolean, at timestamp")
        .option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "in"))
    )
    events = live.live_events(stream, idle_ms=60_000, event_time="at")
    live.run_to_end(events, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.schema(live.OUTPUT).parquet(str(tmp_path / "out")).collect()
    assert [(r.record_id, r.event_duration) for r in got if r.record_id == 1] == [(1, 8)]


@pytest.mark.parametrize("event_time", [False, True])
def test_lanes_give_what_single_recordings_give(event_time):
    """Samples of many recordings in one key, one of them silent: events and what is kept are the same."""
    rng = random.Random(5)
    rows = []
    for rec in range(30):
        states = [rng.choice([0, 0, 1, 1, 2, 3, None]) for _ in range(rng.randrange(1, 60))]
        rows += [(rec, i, s, i == len(states) - 1 and rec % 3 > 0) for i, s in enumerate(states)]
    rng.shuffle(rows)
    lane, alone = FakeState(), {r: FakeState() for r in range(30)}
    how = (2, 1000, event_time, 5, event_time)
    one, many, got, want = live.segmenter(*how), live.lane_segmenter(*how), [], []
    for at in range(0, len(rows), 100):
        pdf = pd.DataFrame(rows[at : at + 100], columns=["record_id", "sample_idx", "state", "is_last"])
        pdf["event_time"] = pd.Timestamp("2024-01-01")
        got += [r for out in many((0,), iter([pdf[:40], pdf[40:]]), lane) for r in out.to_dict("records")]
        for rec, own in pdf.groupby("record_id"):
            want += [r for out in one((rec,), iter([own]), alone[rec]) for r in out.to_dict("records")]
    assert len(got) > 30 and sorted(map(str, got)) == sorted(map(str, want))
    assert set(live.pickle.loads(lane.value[0])) == {r for r, s in alone.items() if s.exists}
    if event_time:
        assert lane.timeout == min(s.timeout for s in alone.values() if s.exists)
        late = 1 + max(s.timeout for s in alone.values() if s.exists)
        lane.hasTimedOut, lane.getCurrentWatermarkMs = True, lambda: late
        got = [r for out in many((0,), iter([]), lane) for r in out.to_dict("records")]
        want = []
        for rec, s in alone.items():
            if s.exists:
                s.hasTimedOut, s.getCurrentWatermarkMs = True, lambda: late
                want += [r for out in one((rec,), iter([]), s) for r in out.to_dict("records")]
        assert got and sorted(map(str, got)) == sorted(map(str, want))
        assert set(live.pickle.loads(lane.value[0])) == {r for r, s in alone.items() if s.exists}


def test_recordings_share_keys(spark, tmp_path):
    """The state has a row for each lane, not for each recording; samples of no recording are one recording."""
    rows = [(None if k == 0 else (1 << 60) + k, i, 0, i == 7) for k in range(40) for i in range(8)]
    schema = "record_id long, sample_idx long, state int, is_last boolean"
    spark.createDataFrame(rows, schema).where("sample_idx < 5").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for at, lanes in (("lanes", 4), ("alone", None)):
        out, check = str(tmp_path / at), str(tmp_path / f"{at}-check")
        live.run_to_end(live.live_events(stream, lanes=lanes), out, check)
        state = spark.read.format("statestore").load(check)
        assert state.count() == (5 if lanes else 40)
    spark.createDataFrame(rows, schema).where("sample_idx >= 5").write.mode("append").parquet(str(tmp_path / "in"))
    live.run_to_end(live.live_events(stream, lanes=4), str(tmp_path / "lanes"), str(tmp_path / "lanes-check"))
    got = spark.read.schema(live.OUTPUT).parquet(str(tmp_path / "lanes")).collect()
    assert {(r.record_id, r.event_duration) for r in got} == {(r[0], 8) for r in rows} and len(got) == 40
