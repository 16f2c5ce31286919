import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dwellkit.operators import kinetics

# Transition matrices of seven published recordings, and their rate
# constants and state probabilities.
MATRICES = {
    "A": [[0.80, 0.15, 0.05], [0.50, 0.50, 0.00], [0.15, 0.05, 0.80]],
    "B": [[0.50, 0.25, 0.25], [0.30, 0.70, 0.00], [0.15, 0.05, 0.80]],
    "C": [[0.70, 0.20, 0.10], [0.70, 0.30, 0.00], [0.15, 0.05, 0.80]],
    "D": [[0.90, 0.05, 0.05], [0.35, 0.65, 0.00], [0.15, 0.05, 0.80]],
    "E": [[0.35, 0.55, 0.10], [0.40, 0.60, 0.00], [0.15, 0.05, 0.80]],
    "F": [[0.20, 0.75, 0.05], [0.08, 0.90, 0.02], [0.19, 0.01, 0.80]],
    "G": [[0.99, 0.00, 0.01, 0.00], [0.05, 0.50, 0.40, 0.05], [0.00, 0.50, 0.50, 0.00], [0.02, 0.00, 0.00, 0.98]],
}
SPECIES_STATE = [0, 0, 1, 2]
K0 = [188.88, 417.19, 271.29, 97.72, 516.66, 591.25, 318.98]
K1 = [420.28, 272.07, 541.63, 314.41, 344.74, 97.09, 412.15]
K_ALL = [37.65, 131.17, 71.52, 42.78, 40.60, 22.97, 4.50]
P0 = [0.755, 0.493, 0.757, 0.849, 0.402, 0.115, 0.912]


def draw(matrix, n, seed):
    rng = np.random.default_rng(seed)
    steps, u = np.cumsum(matrix, axis=1), rng.random(n)
    out = np.empty(n, dtype=np.int64)
    s = 0
    for i in range(n):
        s = min(int(np.searchsorted(steps[s], u[i], side="right")), len(matrix) - 1)
        out[i] = s
    return out


@pytest.fixture(scope="module")
def recordings(spark):
    frames = []
    for label, (name, matrix) in enumerate(MATRICES.items()):
        states = draw(matrix, 600_000 if name == "G" else 30_000, 11 + label)
        if name == "G":
            states = np.array(SPECIES_STATE)[states]
        frames.append(pd.DataFrame({"record_id": label, "sample_idx": np.arange(len(states)), "state": states}))
    df = spark.createDataFrame(pd.concat(frames)).withColumn("state", F.col("state").cast("int"))
    return df.cache()


def test_published_rates(recordings):
    label = F.col("record_id").cast("int")
    cdf = kinetics.dwell_cdf(kinetics.dwell_histogram(recordings, label, chunk_samples=10_000))
    fits = {(r.label, r.kind): r for r in kinetics.fit_rates(cdf).collect()}
    probs = {r.label: r for r in kinetics.state_probability(recordings, label).collect()}
    for i in range(7):
        assert fits[i, "state_0"].k1 == pytest.approx(K0[i], rel=0.08)
        assert fits[i, "state_1"].k1 == pytest.approx(K1[i], rel=0.08)
        assert fits[i, "event"].k1 == pytest.approx(K_ALL[i], rel=0.20 if i == 6 else 0.08)
        assert probs[i].probability_0 == pytest.approx(P0[i], abs=0.03)
        assert probs[i].probability_0 + probs[i].probability_1 == pytest.approx(1)


def test_double_fit_separates_two_rates(spark):
    t = np.arange(1, 400)
    p = 1 - (0.6 * np.exp(-400 * t * 0.001) + 0.4 * np.exp(-20 * t * 0.001))
    n = np.maximum(np.round(np.diff(np.r_[0, p]) * 1e6), 1).astype(int)
    hist = spark.createDataFrame([(6, "state_0", int(a), int(b)) for a, b in zip(t, n)], "label int, kind string, length long, n long")
    fit = kinetics.fit_rates(kinetics.dwell_cdf(hist), double=[(6, "state_0")]).first()
    assert fit.model == "double" and fit.k1 > fit.k2
    single = kinetics.fit_rates(kinetics.dwell_cdf(hist)).first()
    assert fit.rss < single.rss / 5
    assert single.k2 is None and single.model == "single"
    assert fit.k2 == pytest.approx(20, rel=0.15)


def test_collapsed_fit_equals_fit_on_all_points():
    rng = np.random.default_rng(2)
    t = np.sort(np.ceil(rng.exponential(5, 4000))) * 0.001
    p = np.arange(1, len(t) + 1) / len(t)
    ks = np.linspace(50, 400, 35_001)
    grid = ks[np.argmin([np.sum((p - (1 - np.exp(-k * t))) ** 2) for k in ks])]
    values, n = np.unique(t, return_counts=True)
    cum = np.cumsum(n)
    pdf = pd.DataFrame(
        {"label": 0, "kind": "event", "model": "single", "t": values, "n": n, "p_mean": (cum - n + (n + 1) / 2) / len(t)}
    )
    assert kinetics._fit_group(pdf).k1[0] == pytest.approx(grid, abs=0.02)


def test_cdf_points(spark):
    hist = spark.createDataFrame([(0, "event", 2, 3), (0, "event", 5, 1)], "label int, kind string, length long, n long")
    cdf = kinetics.dwell_cdf(hist)
    for block in (1, 2, 100):
        got = sorted((r.t, r.p) for r in kinetics.cdf_points(cdf, block).collect())
        assert got == [(0.002, 0.25), (0.002, 0.5), (0.002, 0.75), (0.005, 1.0)]


def test_report_keeps_missing_kinds(spark):
    sig = spark.createDataFrame([(0, i, s) for i, s in enumerate([0, 0, 2, 0, 2])], "record_id long, sample_idx long, state int")
    label = F.col("record_id").cast("int")
    fits = kinetics.fit_rates(kinetics.dwell_cdf(kinetics.dwell_histogram(sig, label)))
    row = kinetics.kinetics_report(fits, kinetics.state_probability(sig, label)).first()
    assert row.k_state_1 is None and row.k_state_0 > 0 and row.probability_0 == 1
