import random

import brute
import pytest
from pyspark.sql import functions as F

from dwellkit.operators import features, segment

F1 = [2, 0, 0, 1, 1, 1, 0, 2, 1, 1, 2, 0, 0, 0, 0, 0, 2, 0, 1, 3, 1, 0, 0, 1]


def make(spark, recordings):
    rows = [(r, i, s) for r, states in recordings.items() for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "record_id long, sample_idx long, state int")


def feature_rows(df):
    return {
        (r["record_id"], r["event_id"]): {f: r[f] for f in features.FEATURES_13} | {"start_idx": r["start_idx"]}
        for r in df.collect()
    }


def same(got, want):
    assert got.keys() == want.keys()
    for key in want:
        for f, v in want[key].items():
            assert got[key][f] == pytest.approx(v, abs=1e-9), (key, f)


@pytest.fixture(scope="module")
def random_recordings():
    rng = random.Random(7)
    out = {}
    for r in range(60):
        n = rng.randrange(0, 60)
        stay = rng.choice([0.2, 0.6, 0.9])
        states, s = [], 0
        for _ in range(n):
            if rng.random() > stay:
                s = rng.choice([0, 1, 2, 3, -1, None, 0, 1])
            states.append(s)
        out[r] = states
    out[60] = [0] * 50  # never closes
    out[61] = [2] * 50
    out[62] = [1, 3] * 25  # one run through dropped samples
    return out


def test_hand_fixture(spark):
    got = feature_rows(features.event_features(make(spark, {1: F1})))
    assert sorted(k[1] for k in got) == [1, 4]
    first, last = got[(1, 1)], got[(1, 4)]
    assert (first["entropy"], first["first_transition_time"], first["avg_dwell_0"], first["avg_dwell_1"]) == (1, 2, 1.5, 3)
    assert (first["var_dwell_0"], first["longest_dwell_1"], first["ratio_0_to_1"], first["num_transitions"]) == (0.25, 3, 1, 2)
    assert (last["first_transition_time"], last["avg_dwell_1"], last["var_dwell_1"], last["num_transitions"]) == (1, 1.5, 0.25, 3)


def test_hand_states(spark):
    parts = segment.state_parts(make(spark, {1: F1}), chunk_samples=4)
    got = {r["event_id"]: list(r["states"]) for r in segment.states_of(parts).collect()}
    assert got == {1: [0, 0, 1, 1, 1, 0], 4: [0, 1, 1, 0, 0, 1]}


def test_one_state_and_negative(spark):
    got = feature_rows(features.event_features(make(spark, {2: [0] * 6, 3: [-1, 0, 0, 0, 0, 1, 1, 2]})))
    flat, neg = got[(2, 0)], got[(3, 0)]
    assert (flat["entropy"], flat["first_transition_time"], flat["avg_dwell_0"], flat["ratio_0_to_1"]) == (0, -1, 6, 6)
    assert (flat["avg_dwell_1"], flat["longest_dwell_1"], flat["num_transitions"]) == (0, 0, 0)
    assert neg["entropy"] == pytest.approx(1.378783, abs=1e-6)
    assert neg["probability_0"] == pytest.approx(0.571429, abs=1e-6)
    assert (neg["event_duration"], neg["first_transition_time"], neg["ratio_0_to_1"]) == (7, 1, 2)


def test_no_events(spark):
    assert features.event_features(make(spark, {1: [2] * 9})).count() == 0
    assert features.event_features(make(spark, {})).count() == 0


@pytest.mark.parametrize("chunk", [None, 1, 2, 5, 16])
def test_features_equal_walk(spark, random_recordings, chunk):
    want = {
        (r, e): brute.features(seq) | {"start_idx": start}
        for r, states in random_recordings.items()
        for e, start, seq in brute.events(states)
    }
    same(feature_rows(features.event_features(make(spark, random_recordings), chunk_samples=chunk)), want)


@pytest.mark.parametrize("chunk", [None, 1, 3, 8])
def test_runs_equal_walk(spark, random_recordings, chunk):
    want = sorted((r, *run) for r, states in random_recordings.items() for run in brute.runs(states))
    df = segment.runs(make(spark, random_recordings), chunk_samples=chunk)
    got = sorted((x.record_id, x.event_id, x.run_start, x.state, x.run_len) for x in df.collect())
    assert got == want


@pytest.mark.parametrize("chunk", [None, 4])
def test_run_lengths(spark, random_recordings, chunk):
    sig = make(spark, random_recordings)
    want = segment.runs(sig).groupBy((F.col("record_id") % 5).alias("g"), "state", "run_len").count()
    got = segment.run_lengths(sig, (F.col("record_id") % 5).alias("g"), chunk)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("chunk", [None, 3])
def test_states_and_kept_runs(spark, random_recordings, chunk):
    sig = make(spark, random_recordings)
    want = {(r, e): seq for r, states in random_recordings.items() for e, _, seq in brute.events(states)}
    parts = segment.state_parts(sig, chunk_samples=chunk, hot_parts=4)
    got = {(r.record_id, r.event_id): list(r.states) for r in segment.states_of(parts).collect()}
    assert got == want
    for keep, cut in (("head", lambda s: s[:7]), ("tail", lambda s: s[-7:])):
        heads = segment.bounded_states(parts, 7, keep).collect()
        for r in heads:
            seq = want[(r.record_id, r.event_id)]
            assert r.event_duration == len(seq)
            states = list(r.states)
            assert (states[:7] if keep == "head" else states[-7:]) == cut(seq)
    kept = segment.runs(sig, chunk_samples=chunk, min_event_length=5, hot_rows=3)
    assert {(r.record_id, r.event_id) for r in kept.collect()} == set(want)
    sums = {(r.record_id, r.event_id): r.n for r in kept.groupBy("record_id", "event_id").agg(F.sum("run_len").alias("n")).collect()}
    assert sums == {k: len(v) for k, v in want.items()}


def test_event_too_long_is_refused(spark):
    parts = segment.state_parts(make(spark, {1: [0] * 30}), chunk_samples=10)
    assert parts.count() == 3
    with pytest.raises(Exception, match="too long"):
        segment.states_of(parts, max_states=20).collect()


def test_strict_minimum(spark):
    sig = make(spark, {1: [0] * 5 + [2] + [0] * 6})
    assert [r.event_duration for r in segment.events(sig).collect()] == [6]


def test_record_features(spark):
    ev = features.event_features(make(spark, {1: F1}))
    mean = features.record_features(ev, "mean").first()
    first = features.record_features(ev, "first").first()
    assert (mean.average_event_length, mean.average_first_transition_time, mean.average_num_transitions) == (6, 1.5, 2.5)
    assert (first.average_first_transition_time, first.average_num_transitions) == (2, 2)
    assert (mean.overall_probability_0, mean.overall_probability_1, mean.overall_ratio_0_to_1) == (0.5, 0.5, 1)
    for hot_rows in (1, 100):
        full = features.with_record_features(ev, hot_rows=hot_rows).collect()
        assert len(full) == 2 and all(r.average_event_length == 6 for r in full)
    with pytest.raises(ValueError):
        features.record_features(ev, "median")


def test_variance_of_long_dwells_does_not_cancel(spark):
    states = [0] * 40_000 + [1] + [0] * 40_002
    ev = features.event_features(make(spark, {1: states}), chunk_samples=1000).first()
    assert ev.avg_dwell_0 == 40_001 and ev.var_dwell_0 == pytest.approx(1.0, abs=1e-6)


def test_plan_exchanges_samples_once(spark, tmp_path):
    """Stored samples: one exchange of samples, one of event rows; no window or sort
    over a whole recording except on chunk rows."""
    make(spark, {1: F1}).write.parquet(str(tmp_path / "sig"))
    df = features.event_features(spark.read.parquet(str(tmp_path / "sig")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert sum("REPARTITION_BY_COL" in x for x in lines) == 1
    assert len(lines) <= 4
    pushed = plan.split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert "LessThanOrEqual(state,2)" in pushed and "IsNotNull(record_id)" in pushed
    assert "struct<record_id:bigint,sample_idx:bigint,state:int>" in plan
    assert "SinglePartition" not in plan


def test_bucketed_table_needs_no_sample_exchange(spark):
    from dwellkit.sources.recordings import write_signal_bucketed

    sig = make(spark, {1: F1, 2: [0] * 9}).withColumn("chunk", F.lit(0).cast("long"))
    write_signal_bucketed(sig, "bucketed_signal", 4)
    df = segment.chunk_runs(spark.table("bucketed_signal")).select("record_id", "run_len", "run_start")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(record_id" not in plan.split("BroadcastExchange")[0]
    assert df.count() == 10


@pytest.mark.parametrize("part", [4, 1 << 20])
def test_run_parts_do_not_depend_on_chunks(spark, random_recordings, part):
    sig = make(spark, random_recordings)
    want = {(r, e): seq for r, states in random_recordings.items() for e, _, seq in brute.events(states)}
    rows = [segment.run_parts(sig, part_samples=part, chunk_samples=chunk, hot_rows=hot).collect() for chunk, hot in ((None, 1 << 22), (3, 2))]
    plain = [sorted((r.record_id, r.event_id, r.part, r.event_duration, [tuple(x) for x in r.runs]) for r in own) for own in rows]
    assert plain[0] == plain[1]
    got = {}
    for record, event, _, duration, runs in plain[0]:
        got.setdefault((record, event), []).extend(s for _, s, n in runs for _ in range(n))
        assert duration == len(want[(record, event)])
    assert got == want
