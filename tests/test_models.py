import random

import pytest
from pyspark.sql import functions as F

from dwellkit.operators import features, metrics, models, signal


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        label = i % 3
        states = [int(rng.random() < (0.1, 0.5, 0.9)[label]) for _ in range(20)]
        rows.append((i, 0, label, float(sum(states)), rng.random(), states))
    return spark.createDataFrame(
        rows, "record_id long, event_id long, label int, useful double, useless double, states array<int>"
    ).cache()


@pytest.mark.parametrize("family,sequence,scale", [("forest", True, True), ("mlp", False, True), ("logistic", True, False)])
def test_event_classifier(spark, events, tmp_path, family, sequence, scale):
    names = ["useful", "useless"]
    trained = models.train_event_classifier(events, names, 3, family=family, scale=scale, sequence=sequence)
    scored = trained.score(events)
    assert metrics.accuracy(scored).first().accuracy > 0.8
    row = scored.first()
    assert sum(row.probs) == pytest.approx(1) and row.probs[row.pred] == max(row.probs)
    trained.save(str(tmp_path / "m"))
    loaded = models.load_event_classifier(spark, str(tmp_path / "m"))
    want = {r.record_id: r.pred for r in scored.collect()}
    assert {r.record_id: r.pred for r in loaded.score(events).collect()} == want


def test_mlp_needs_fixed_inputs(events):
    with pytest.raises(ValueError):
        models.train_event_classifier(events, ["useful"], 3, family="mlp", sequence=True)


def test_permutation_importance(events):
    trained = models.train_event_classifier(events, ["useful", "useless"], 3)
    got = {r.feature: r for r in models.permutation_importance(trained, events).collect()}
    assert got["useful"].importance > 0.3 > abs(got["useless"].importance)
    cells = metrics.confusion(trained.score(events), 3)
    assert got["useful"].baseline_f1 == pytest.approx(metrics.macro_metrics(cells).first().macro_f1)
    assert got["useless"].importance == pytest.approx(got["useless"].baseline_f1 - got["useless"].shuffled_f1)


def test_states_from_current_to_events(spark):
    rng = random.Random(9)
    rows = []
    for r in range(4):
        s = 2
        for i in range(300):
            s = s if rng.random() < 0.85 else rng.choice([0, 1, 2])
            rows.append((r, i, rng.gauss(s, 0.05), s))
    raw = spark.createDataFrame(rows, "record_id long, sample_idx long, current double, state int")
    scaled = signal.minmax_scaled(raw).withColumn("label", F.col("state"))
    model = models.train_state_classifier(scaled, 3, family="tree")
    scored = models.score_states(model, scaled)
    assert metrics.accuracy(scored).first().accuracy > 0.98
    predicted = models.as_signal(scored)
    assert "state" in predicted.columns and features.event_features(predicted).count() > 0
    binary = scaled.withColumn("label", (F.col("state") > 0).cast("int"))
    two = models.score_states(models.train_state_classifier(binary, 2), binary)
    assert metrics.binary_metrics(two).first().accuracy > 0.98
