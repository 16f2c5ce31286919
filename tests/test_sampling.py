import random

import pytest
from pyspark.sql import functions as F

from dwellkit.operators import sampling, scaling


@pytest.fixture(scope="module")
def events(spark):
    sizes = {0: 100, 1: 37, 2: 5}
    rows = [(label, i, label, float(i), i + 1) for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "record_id long, event_id long, label int, x double, event_duration long").cache()


def sizes(df, *extra):
    return {tuple(r)[:-1]: r["n"] for r in df.groupBy("label", *extra).agg(F.count(F.lit(1)).alias("n")).collect()}


def test_downsample_counts(events):
    names = ["a", "b", "c"]
    assert sizes(sampling.downsample(events, [0.29, None, 1.5], names)) == {(0,): 28, (1,): 37, (2,): 5}
    assert sizes(sampling.downsample(events, [0.5, 0.0, -1], names)) == {(0,): 50}
    assert sizes(sampling.downsample(events, [0.001, 0.5, 0.1], names)) == {(1,): 18}
    with pytest.raises(ValueError):
        sampling.downsample(events, [0.5], names)


def test_draws_repeat_and_differ_by_seed(events):
    def ids(seed):
        df = sampling.downsample(events.repartition(5), [0.5, 0.5, 0.5], ["a", "b", "c"], seed)
        return {(r.record_id, r.event_id) for r in df.collect()}

    assert ids("1") == ids("1") != ids("2")


def test_stratified_split(events):
    got = sizes(sampling.stratified_split(events, 0.2, n_classes=3), "is_test")
    assert got == {(0, True): 20, (0, False): 80, (1, True): 7, (1, False): 30, (2, True): 1, (2, False): 4}


def test_validation_split(events):
    got = sampling.validation_split(events, 0.2)
    assert got.filter("is_validation").count() == 142 - int(142 * 0.8)
    assert set(got.columns) == {*events.columns, "is_validation"}


def test_mixture(events):
    assert sizes(sampling.mixture_sample(events, {0: 0.6, 1: 0.4}, 50)) == {(0,): 30, (1,): 20}
    with pytest.raises(Exception, match="fewer events"):
        sampling.mixture_sample(events, {2: 1.0}, 50).collect()
    with pytest.raises(Exception, match="fewer events"):  # a class without any event
        sampling.mixture_sample(events, {0: 0.5, 9: 0.5}, 10).collect()
    with pytest.raises(Exception, match="without a fraction"):
        sampling.downsample(events, [0.5, 0.5], ["a", "b"]).collect()


def test_shuffles_keep_everything(events):
    assert sorted(r.x for r in sampling.shuffled(events).collect()) == sorted(r.x for r in events.collect())
    got = sampling.permute_column(events, "x").collect()
    assert sorted(r.x for r in got) == sorted(r.x for r in events.collect())
    assert any(r.x != float(r.event_id) for r in got)
    assert sampling.permute_column(events.limit(0), "x").count() == 0


def test_union_and_encodings(spark, events):
    both = sampling.union_labelled({"a": events.drop("label"), "b": events.drop("label")}, {"a": 4, "b": 5})
    assert sizes(both) == {(4,): 142, (5,): 142}
    with pytest.raises(KeyError):
        sampling.union_labelled({"z": events}, {"a": 1})
    row = sampling.encode_labels(events, 3).filter("label = 1").first()
    assert list(row.one_hot) == [0.0, 1.0, 0.0]
    assert sampling.max_sequence_length(events).first().max_length == 100
    assert sizes(sampling.class_distribution(events).select("label", F.explode(F.sequence(F.lit(1), "n")))) == {
        (0,): 100, (1,): 37, (2,): 5}


def test_padding(spark):
    rows = [(1, 1, 3, 0, 3, [0, 1, 1]), (1, 2, 6, 0, 2, [0, 0]), (1, 2, 6, 1, 4, [1, 0, 1, 1])]
    columns = "record_id long, event_id long, event_duration long, chunk long, n_states long, states array<int>"
    parts = spark.createDataFrame(rows, columns)
    head = {r.event_id: list(r.padded) for r in sampling.pad_sequences(parts, 5).collect()}
    tail = {r.event_id: list(r.padded) for r in sampling.pad_sequences(parts, 5, keep="tail").collect()}
    assert head == {1: [0, 1, 1, -1, -1], 2: [0, 0, 1, 0, 1]}
    assert tail == {1: [0, 1, 1, -1, -1], 2: [0, 1, 0, 1, 1]}


def test_nan_audit(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2), (3.0, 3)], "a double, b int")
    got = {r.feature: (r.n_nan, r.has_nan) for r in sampling.nan_audit(df, ["a", "b"]).collect()}
    assert got == {"a": (1, True), "b": (1, True)}


def test_standardize(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id int, a double, b double")
    scaler = scaling.fit_standard(df, ["a", "b"])
    scaling.save_scaler(scaler, str(tmp_path / "scaler"))
    loaded = scaling.load_scaler(spark, str(tmp_path / "scaler"))
    got = sorted(map(tuple, scaling.apply_standard(df, loaded, ["a", "b"]).collect()))
    assert got == [(1, -1.0, 0.0), (2, 1.0, 0.0)]


@pytest.mark.parametrize("keep", ["head", "tail"])
@pytest.mark.parametrize("length,part", [(5, 2), (12, 4), (40, 7), (3, 100)])
def test_pad_parts_equal_brute_force(spark, keep, length, part):
    rng = random.Random(7)
    events = {(r, e): [rng.randrange(2) for _ in range(rng.randrange(1, 30))] for r in range(3) for e in range(4)}
    rows = []
    for (r, e), states in events.items():
        at = chunk = 0
        while at < len(states):
            n = rng.randrange(1, 9)
            rows.append((r, e, len(states), chunk, len(states[at : at + n]), states[at : at + n]))
            at, chunk = at + n, chunk + rng.choice([1, 3])
    parts = spark.createDataFrame(
        rows, "record_id int, event_id int, event_duration long, chunk long, n_states long, states array<int>"
    ).repartition(5)
    longest = spark.createDataFrame([(length,)], "l long").select("l").scalar()
    got = sampling.pad_parts(parts, longest, keep, part_states=part).collect()
    assert all(len(r.padded) <= part for r in got)
    joined = {k: [x for r in sorted(got, key=lambda r: r.part) if (r.record_id, r.event_id) == k for x in r.padded] for k in events}
    for k, states in events.items():
        kept = states[:length] if keep == "head" else states[-length:]
        assert joined[k] == kept + [-1.0] * (length - len(kept))
    assert sampling.pad_parts(parts, F.lit(None), keep).collect() == []
