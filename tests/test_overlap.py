import math
import random

import numpy as np
import pytest

from dwellkit.operators import overlap


def values(spark, groups):
    rows = [(label, "x", float(v)) for label, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "label int, feature string, value double")


def test_hand_overlap(spark):
    df = values(spark, {0: [0, 0, 1, 2, 3, 4], 1: [1, 1, 4, 9]})
    r = overlap.overlap(overlap.pair_histograms(df, [(0, 1)], bins=4)).first()
    assert (r.mass_1, r.mass_2, r.coefficient) == pytest.approx((1, 1, 2 / 3))
    assert (r.distance, r.overlap_area) == pytest.approx((0.405465, 0.5), abs=1e-6)
    h = {x.bin: (x.density_1, x.density_2) for x in overlap.pair_histograms(df, [(0, 1)], bins=4).collect()}
    assert h[1] == pytest.approx((1 / 6, 2 / 3)) and h[2] == pytest.approx((1 / 6, 0))


def test_disjoint_and_constant(spark):
    df = values(spark, {0: [0, 1], 1: [8, 9], 2: [5, 5]})
    r = overlap.overlap(overlap.pair_histograms(df, [(0, 1)])).first()
    assert math.isinf(r.distance) and r.overlap_area == 0
    flat = overlap.histograms(df.filter("label = 2"), bins=4).collect()
    assert {x.bin: x.n for x in flat} == {0: 0, 1: 0, 2: 2, 3: 0}
    assert min(x.bin_low for x in flat) == 4.5 and max(x.bin_high for x in flat) == 5.5


def test_against_numpy(spark):
    rng = random.Random(5)
    a = [rng.gauss(0, 1) for _ in range(300)]
    b = [rng.gauss(0.5, 2) for _ in range(200)]
    df = values(spark, {0: a, 1: b})
    h1, edges = np.histogram(a, bins=50, density=True)
    h2, _ = np.histogram(b, bins=edges, density=True)
    got = {r.bin: r for r in overlap.histograms(df).filter("label = 0").collect()}
    assert [got[i].density for i in range(50)] == pytest.approx(list(h1))
    r = overlap.overlap(overlap.pair_histograms(df, [(0, 1)])).first()
    w = edges[1] - edges[0]
    assert r.distance == pytest.approx(-math.log(np.sum(np.sqrt(h1 * h2)) * w))
    assert r.overlap_area == pytest.approx(np.sum(np.minimum(h1, h2)) * w)
    pct = {r.label: (r.p05, r.p95) for r in overlap.percentiles(df).collect()}
    assert pct[0] == pytest.approx(tuple(np.percentile(a, [5, 95])))
    assert pct[1] == pytest.approx(tuple(np.percentile(b, [5, 95])))
    for steps, n_groups in ((1, None), (2, 2), (2048, 2)):
        again = {r.label: (r.p05, r.p50, r.p95) for r in overlap.percentiles(df, (0.05, 0.5, 0.95), n_groups, steps).collect()}
        assert again[1] == pytest.approx(tuple(np.percentile(b, [5, 50, 95])))
        assert again[0] == pytest.approx(tuple(np.percentile(a, [5, 50, 95])))
    box = overlap.axis_bounds(overlap.percentiles(df), [(0, 1)]).first()
    assert box.axis_low == pytest.approx(0.9 * min(pct[0][0], pct[1][0]))
    assert box.axis_high == pytest.approx(1.1 * max(pct[0][1], pct[1][1]))
    rough = {r.label: r.p95 for r in overlap.approximate_percentiles(df).collect()}
    assert rough[0] == pytest.approx(pct[0][1], abs=0.1)


def test_percentiles_with_one_hot_value(spark):
    df = values(spark, {0: [1.0] * 90 + [2.0] * 10, 1: [4.0]})
    pct = {r.label: (r.p05, r.p95) for r in overlap.percentiles(df).collect()}
    assert pct == {0: (1.0, 2.0), 1: (4.0, 4.0)}
