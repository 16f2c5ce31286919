"""Closed-form classifiers against NumPy and against what was planted."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellkit.operators import bayes, discriminant, histogram, metrics, models, sampling, votes
from dwellkit.plans import queries


# Events


def event_rows(n=400, seed=4):
    """Three classes that differ in one feature and in how states follow each other."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = i % 3
        stay = (0.3, 0.6, 0.9)[label]
        states = [rng.randrange(2)]
        for _ in range(rng.randrange(20, 60)):
            states.append(states[-1] if rng.random() < stay else 1 - states[-1])
        text = [str(s) for s in states]
        counts = Counter(",".join(text[j : j + k]) for k in (1, 2, 3) for j in range(len(text) - k + 1))
        useful = rng.gauss(label, 1.0) if i % 17 else None
        rows.append((i, 0, label if i % 23 else None, useful, rng.random(), 5.0, dict(counts)))
    return rows


SCHEMA = "record_id long, event_id long, label int, useful double, useless double, flat double, patterns map<string,bigint>"
NAMES = ["useful", "useless", "flat"]


def slow_scores(rows, names, sequence, k):
    train = [r for r in rows if r[2] is not None]
    spot = {n: 3 + i for i, n in enumerate(["useful", "useless", "flat"])}
    logs = {}
    vocabulary = sorted({p for r in train for p in r[6] if "," in p})
    model = {}
    for c in range(k):
        mine = [r for r in train if r[2] == c]
        if not mine:
            continue
        moments = {}
        for f in names:
            every = np.array([r[spot[f]] for r in train if r[spot[f]] is not None])
            own = np.array([r[spot[f]] for r in mine if r[spot[f]] is not None])
            moments[f] = (own.mean(), own.var() + 0.01 * every.var() + 1e-9)
        totals = {p: sum(r[6].get(p, 0) for r in mine) for p in vocabulary}
        shares = {}
        for p in vocabulary:
            same = [q for q in vocabulary if q.count(",") == p.count(",")]
            shares[p] = math.log((totals[p] + 1) / (sum(totals[q] for q in same) + len(same)))
        model[c] = (math.log(len(mine) / len(train)), moments, shares)
    for r in rows:
        s = [-math.inf] * k
        for c, (prior, moments, shares) in model.items():
            s[c] = prior
            for f, (m, v) in moments.items():
                if r[spot[f]] is not None:
                    s[c] += -0.5 * math.log(2 * math.pi * v) - (r[spot[f]] - m) ** 2 / (2 * v)
            if sequence:
                s[c] += sum(n * shares.get(p, 0) for p, n in r[6].items())
        logs[r[0]] = s
    return logs


@pytest.mark.parametrize("names,sequence", [(NAMES, False), ([], True), (NAMES, True)])
def test_event_scores_equal_brute_force(spark, tmp_path, names, sequence):
    rows = event_rows()
    events = spark.createDataFrame(rows, SCHEMA).repartition(5)
    trained = bayes.fit(events, names, 4, sequence)  # the fourth class has no row
    scored = {r.record_id: r for r in trained.score(events).collect()}
    for i, logs in slow_scores(rows, names, sequence, 4).items():
        weights = np.exp(np.array(logs) - max(logs))
        assert scored[i].pred == int(np.argmax(logs))
        assert scored[i].probs == pytest.approx((weights / weights.sum()).tolist(), abs=1e-9)
    trained.save(str(tmp_path / "m"))
    assert bayes.load(spark, str(tmp_path / "m")) == trained
    right = metrics.accuracy(trained.score(events.where("label is not null"))).first().accuracy
    assert right > (0.95 if sequence else 0.5)


def test_labels_outside_the_classes_and_no_rows(spark):
    events = spark.createDataFrame(event_rows(30), SCHEMA)
    with pytest.raises(ValueError, match="outside the 2 classes"):
        bayes.fit(events, NAMES, 2)
    empty = bayes.fit(events.limit(0), NAMES, 2)
    assert empty.priors == [None, None]
    assert {r.pred for r in empty.score(events).collect()} == {None}


def test_selection_takes_what_does_best(spark):
    events = spark.createDataFrame(event_rows(600), SCHEMA)
    train = sampling.validation_split(events.where("label is not null"))
    name, best, table = bayes.select(train, {"features": (NAMES, False), "patterns": ([], True)}, 3)
    scores = {r.candidate: r.macro_f1 for r in table.collect()}
    assert name == "patterns" and scores["patterns"] > 0.9 > scores["features"] and best.sequence_columns == ["patterns"]
    got = {r.feature: r.importance for r in models.permutation_importance(bayes.fit(train, NAMES, 3), train).collect()}
    assert got["useful"] > 0.2 > abs(got["useless"]) and got["flat"] == 0


# Splits


def test_groups_stay_on_one_side(spark):
    rng = random.Random(2)
    rows = [(g if g else None, i, rng.choice([g % 3, 0])) for g in range(90) for i in range(rng.choice([1, 2, 9]))]
    rows += [(7, 100 + i, 1) for i in range(200)]  # one group holds a large share
    df = spark.createDataFrame(rows, "record_id long, event_id long, label int").repartition(4)
    split = sampling.group_split(df).collect()
    assert len(split) == len(rows)
    sides, tests, sizes, most = defaultdict(set), Counter(), Counter(), Counter()
    for r in split:
        if r.record_id is None:
            assert not r.is_test
        sides[r.record_id, r.label].add(r.is_test)
        tests[r.label] += r.is_test
        sizes[r.label] += 1
        most[r.label, r.record_id] += 1
    assert all(len(s) == 1 for s in sides.values())
    for label in sizes:
        least = round(0.2 * sizes[label])
        largest = max(n for (c, _), n in most.items() if c == label)
        assert tests[label] < least + largest and tests[label] >= least - most[label, None]
    whole = sampling.group_split(df, label=None).collect()
    by_group = defaultdict(set)
    for r in whole:
        by_group[r.record_id].add(r.is_test)
    assert all(len(s) == 1 for s in by_group.values()) and any(True in s for s in by_group.values())
    assert sampling.group_split(df.limit(0)).collect() == []


# Samples


def test_state_histogram_equals_counts(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        s = rng.choice([0, 0, 1, 2])
        rows.append((s if rng.random() < 0.99 else None, min(max(rng.gauss((s + 0.5) / 3, 0.1), -0.1), 1.1)))
    rows += [(0, None), (1, 1.0), (2, 0.0)]
    df = spark.createDataFrame(rows, "label int, scaled double").repartition(3)
    model = histogram.fit(df, 4, bins=16)
    cells = Counter((s, min(max(math.floor(x * 16), 0), 15)) for s, x in rows if s is not None and x is not None)
    totals = [sum(n for (s, _), n in cells.items() if s == k) for k in range(4)]
    for b in range(16):
        joint = [t * (cells[k, b] + 1) / (t + 16) for k, t in enumerate(totals)]
        assert model.posteriors[b] == pytest.approx([j / sum(joint) for j in joint])
    scored = model.score(df).collect()
    assert all((r.pred is None) == (r.scaled is None) for r in scored)
    right = metrics.accuracy(model.score(df.where("label is not null and scaled is not null"))).first().accuracy
    assert 0.8 < right < 1
    model.save(str(tmp_path / "h"))
    assert histogram.load(spark, str(tmp_path / "h")) == model
    with pytest.raises(Exception, match="outside the 2 states"):
        histogram.fit(df, 2)


# Vectors


def slow_discriminant(x, y, k, shrinkage=1.0):
    seen = [c for c in range(k) if (y == c).any()]
    means = np.array([x[y == c].mean(axis=0) if c in seen else np.zeros(x.shape[1]) for c in range(k)])
    within = sum((x[y == c] - means[c]).T @ (x[y == c] - means[c]) for c in seen) / len(x)
    solid = within + shrinkage * np.trace(within) / x.shape[1] * np.eye(x.shape[1])
    logs = np.full((len(x), k), -np.inf)
    for c in seen:
        w = np.linalg.solve(solid, means[c])
        logs[:, c] = x @ w - 0.5 * means[c] @ w + math.log((y == c).mean())
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_discriminant_equals_numpy(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 500)
    x = rng.normal(size=(500, 6)) + y[:, None] * np.array([1, 0, 0.5, 0, 0, 0])
    rows = [(i, int(c), v.tolist(), "p") for i, (c, v) in enumerate(zip(y, x))]
    odd = [(900, 1, None, "p"), (901, 1, [1.0], "p"), (902, None, [0.0] * 6, "p"), (903, 0, [float("nan")] * 6, "p")]
    df = spark.createDataFrame(rows + odd, "id long, label int, vector array<double>, probability string").repartition(4)
    fit = discriminant.fit(df, 6, 5)
    scored = {r.id: r for r in discriminant.score(df, [fit]).collect()}
    want = slow_discriminant(x, y, 5)
    assert np.allclose([scored[i].probs for i in range(500)], want)
    assert [scored[i].probs is None for i in (900, 901, 902, 903)] == [True, True, False, True]
    assert scored[5].probability == "p"
    two = discriminant.score(df, [fit, discriminant.fit(df.where("label < 2"), 6, 5)], fold=F.col("id") % 2)
    probs = {r.id: r.probs for r in two.collect()}
    assert probs[3][2] == 0 < probs[2][2]
    with pytest.raises(Exception, match="outside the 2 classes"):
        discriminant.fit(df, 6, 2)
    none = discriminant.fit(df.where("label is null"), 6, 2)
    assert none.offsets == [None, None]


def test_equal_vectors_have_prior_probabilities(spark):
    df = spark.createDataFrame([(i, i % 4 // 3, [1.0, 2.0]) for i in range(8)], "id long, label int, vector array<double>")
    scored = discriminant.score(df, [discriminant.fit(df, 2, 2)]).collect()
    assert all(r.probs == pytest.approx([0.75, 0.25]) for r in scored)


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_gate_passes_some_rows_and_not_others(spark, size):
    sf = f"/root/testdata/sf{size}"
    n = queries.gated(spark, sf).agg(F.count("pred").alias("yes"), F.count_if(F.col("pred").isNull()).alias("no")).first()
    assert n.yes > 10 and n.no > 10
    assert votes.predicted_fractions(queries.gated(spark, sf)).count() > 1
