import random

import pytest
from pyspark.sql import functions as F

from dwellkit.operators import signal


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(1)
    rows = [
        (r, i, i * 0.001, 0.0 if rng.random() < 0.2 else rng.gauss(1, 1), rng.choice([0, 1, 2]))
        for r, n in ((1, 50), (2, 1), (3, 17))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "record_id long, sample_idx long, time double, current double, state int").cache()


def by_record(samples, column):
    out = {}
    for r in samples.orderBy("record_id", "sample_idx").collect():
        out.setdefault(r.record_id, []).append(r[column])
    return out


def test_time_window_is_inclusive(samples):
    got = signal.time_window(samples, 0.010, 0.012).filter("record_id = 1").collect()
    assert sorted(r.sample_idx for r in got) == [10, 11, 12]
    assert signal.time_window(samples, 5, 6).count() == 0


def test_range_and_preview(samples):
    assert signal.sample_range(samples, 5, 9).filter("record_id = 3").count() == 4
    assert [r.sample_idx for r in signal.preview(samples, 10).filter("record_id = 1").collect()] == list(range(10))


def test_minmax(spark, samples):
    raw = by_record(samples, "current")
    for rec, values in by_record(signal.minmax_scaled(samples), "scaled").items():
        low, high = min(raw[rec]), max(raw[rec])
        want = [(x - low) / (high - low) if high > low else 0.0 for x in raw[rec]]
        assert values == pytest.approx(want)


def test_nonzero_moments(spark, samples):
    got = {r.record_id: r for r in signal.nonzero_moments(samples).collect()}
    for rec, x in by_record(samples, "current").items():
        k = sum(v != 0 for v in x)
        if k == 0:
            assert got[rec].nonzero_mean is None
            continue
        m = sum(x) / k
        assert got[rec].nonzero_mean == pytest.approx(m)
        assert got[rec].nonzero_sd == pytest.approx((sum((v - m) ** 2 for v in x) / k) ** 0.5)
    zeros = spark.createDataFrame([(1, 0.0), (1, 0.0)], "record_id long, current double")
    row = signal.nonzero_moments(zeros).first()
    assert row.nonzero_mean is None and row.nonzero_sd is None


@pytest.mark.parametrize("chunk", [1 << 20, 4, 7])
@pytest.mark.parametrize("how", ["mean", "median"])
def test_smooth(samples, chunk, how):
    got = by_record(signal.smooth(samples, how=how, chunk_samples=chunk), "smoothed")
    for rec, x in by_record(samples, "current").items():
        frames = [sorted(x[max(0, i - 1) : i + 2]) for i in range(len(x))]
        if how == "mean":
            want = [sum(f) / len(f) for f in frames]
        else:
            want = [(f[(len(f) - 1) // 2] + f[len(f) // 2]) / 2 for f in frames]
        assert got[rec] == pytest.approx(want)


@pytest.mark.parametrize("chunk", [1 << 20, 2, 5])
def test_transition_matrix(samples, chunk):
    got = {(r.record_id, r.state, r.next_state): (r.n, r.p) for r in signal.transition_matrix(samples, chunk).collect()}
    want = {}
    for rec, x in by_record(samples, "state").items():
        for a, b in zip(x, x[1:]):
            want[rec, a, b] = want.get((rec, a, b), 0) + 1
    assert {k: v[0] for k, v in got.items()} == want
    for (rec, a, _), (n, p) in got.items():
        assert p == pytest.approx(n / sum(v for k, v in want.items() if k[:2] == (rec, a)))


def test_states(spark, samples):
    dist = signal.state_distribution(samples).agg(F.sum("fraction"), F.sum("n")).first()
    assert dist[0] == pytest.approx(1) and dist[1] == 68
    one = spark.createDataFrame([(1, 0), (1, 4), (1, 4)], "record_id long, state int")
    row = signal.number_of_states(one).first()
    assert (row.num_states, row.distinct_states) == (5, 2)
    assert [r.binary_state for r in signal.recode_binary(one).orderBy("state").collect()] == [0, 1, 1]


def test_species(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "species int")
    got = signal.apply_species(df).orderBy("species").collect()
    assert [r.state for r in got] == [0, 0, 1, 2] and [r.level for r in got] == [0.0, 0.0, 1.0, 2.0]


def test_filters_reach_the_scan(spark, samples, tmp_path):
    samples.write.parquet(str(tmp_path / "s"))
    df = signal.time_window(spark.read.parquet(str(tmp_path / "s")), 0.01, 0.02).select("current")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time,0.01)" in plan and "ReadSchema: struct<time:double,current:double>" in plan
