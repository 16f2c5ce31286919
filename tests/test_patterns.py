import random
from collections import Counter

import pytest

from dwellkit.operators import patterns


def signal(spark, recordings):
    rows = [(r, i, s) for r, states in recordings.items() for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "record_id string, sample_idx long, state int").repartition(5)


def slow_counts(states):
    events, now = [], []
    for s in [*states, 2]:
        if s == 2:
            events.append(now)
            now = []
        elif s is not None and s < 2:
            now.append(s)
    out = {}
    for event_id, e in enumerate(events):
        c = Counter()
        for size in (1, 2, 3):
            for i in range(len(e) - size + 1):
                c[",".join(map(str, e[i : i + size]))] += 1
        if e:
            out[event_id] = c
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, None])
def test_counts_equal_brute_force_at_any_cut(spark, chunk):
    rng = random.Random(6)
    recordings = {}
    for r in range(12):
        weights = rng.choice([(5, 5, 2, 1, 1, 1), (9, 1, 0, 0, 0, 0), (1, 1, 8, 1, 0, 1), (3, 3, 1, 6, 2, 2)])
        recordings[f"r{r}"] = rng.choices([0, 1, 2, 3, -1, None], weights, k=rng.randrange(1, 90))
    recordings |= {"zeros": [0] * 40, "open": [2] * 9, "far": [0, 3, 3, 3, 3, 3, 3, 3, 1, 0, 2, 0], "pair": [1, 0]}
    got = {}
    for row in patterns.pattern_counts(signal(spark, recordings), chunk).collect():
        got.setdefault((row.record_id, row.event_id), {})[row.pattern] = row.n
    want = {(r, e): dict(c) for r, states in recordings.items() for e, c in slow_counts(states).items()}
    assert got == want
    kept = patterns.event_patterns(signal(spark, recordings), 5, chunk).collect()
    lengths = {k: sum(n for p, n in c.items() if "," not in p) for k, c in want.items()}
    assert {(r.record_id, r.event_id): (r.event_duration, r.patterns) for r in kept} == {
        k: (lengths[k], want[k]) for k in want if lengths[k] > 5
    }
    one_row = kept[0].patterns
    assert all(n > 0 for n in one_row.values())


def test_no_samples(spark):
    assert patterns.event_patterns(signal(spark, {"r": [2]})).collect() == []
    empty = spark.createDataFrame([], "record_id string, sample_idx long, state int")
    assert patterns.pattern_counts(empty).collect() == []
