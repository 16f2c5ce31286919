"""Dwell-time distributions and their rate constants.

Dwell times are whole numbers of samples. A class with N samples can hold at most
sqrt(2 N) different lengths (their sum cannot exceed N), so the table of
(class, kind, length, n) stays at a few million rows for 10^13 samples. It is made by
combinable counts; only this table is ordered and fitted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellkit.functions.columns import share
from dwellkit.operators.segment import chunk_runs, run_lengths

TIME_STEP = 0.001

FIT_SCHEMA = (
    "label int, kind string, model string, n_dwells long, k1 double, a1 double, k2 double, a2 double, rss double"
)


def dwell_histogram(signal: DataFrame, label: Column, chunk_samples: int | None = None) -> DataFrame:
    """(label, kind, length, n) with kind state_0, state_1 or event, over all events.

    ``label`` is an expression on record_id.
    """
    by_state = (
        run_lengths(signal, label.alias("label"), chunk_samples)
        .filter(F.col("state").isin(0, 1))
        .select(
            "label",
            F.concat(F.lit("state_"), F.col("state").cast("string")).alias("kind"),
            F.col("run_len").alias("length"),
            "n",
        )
    )
    whole = (
        chunk_runs(signal, chunk_samples)
        .groupBy("record_id", "event_id")
        .agg(F.sum("run_len").alias("length"))
        .groupBy(label.alias("label"), "length")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("label", F.lit("event").alias("kind"), "length", "n")
    )
    return by_state.unionByName(whole)


def dwell_cdf(histogram: DataFrame, time_step: float = TIME_STEP) -> DataFrame:
    """Empirical CDF with ties collapsed: a length with n dwells stands for the n points
    p_first .. p_last in steps of 1/total; p_mean is their mean."""
    w = Window.partitionBy("label", "kind")
    so_far = w.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = histogram.withColumn("cum", F.sum("n").over(so_far)).withColumn("total", F.sum("n").over(w))
    total = F.col("total").cast("double")
    return ranked.select(
        "label",
        "kind",
        (F.col("length") * F.lit(float(time_step))).alias("t"),
        "n",
        "total",
        ((F.col("cum") - F.col("n") + 1) / total).alias("p_first"),
        (F.col("cum") / total).alias("p_last"),
        ((F.col("cum") - F.col("n") + (F.col("n") + 1) / 2) / total).alias("p_mean"),
    )


def cdf_points(cdf: DataFrame, block: int = 65_536) -> DataFrame:
    """The CDF point by point, (label, kind, t, p). A length with very many dwells is
    opened in blocks, so no row has to hold them all."""
    first = F.round(F.col("p_first") * F.col("total")).cast("long")
    last = F.round(F.col("p_last") * F.col("total")).cast("long")
    blocks = cdf.select("*", F.explode(F.sequence(first, last, F.lit(block).cast("long"))).alias("from_i"))
    to_i = F.least(F.col("from_i") + block - 1, last)
    return blocks.select("label", "kind", "t", "total", F.explode(F.sequence("from_i", to_i)).alias("i")).select(
        "label", "kind", "t", (F.col("i") / F.col("total")).alias("p")
    )


def state_probability(signal: DataFrame, label: Column) -> DataFrame:
    """P(state 0) and P(state 1) per class over all events. Every blocked or
    intermediate sample lies in an event, so counting samples is enough."""
    counts = signal.groupBy(label.alias("label")).agg(
        F.count_if(F.col("state") == 0).alias("n0"), F.count_if(F.col("state") == 1).alias("n1")
    )
    both = F.col("n0") + F.col("n1")
    return counts.filter(both > 0).select(
        "label", share(F.col("n0"), both).alias("probability_0"), share(F.col("n1"), both).alias("probability_1")
    )


def _damped_fit(t, p, w, start, model, jacobian, low, high, rounds=400):
    """(x, residual sum, converged): weighted least squares by damped Gauss-Newton steps,
    clipped to the bounds. Converged: no step lowers the sum, or the last one moved
    nothing; not so when the rounds ran out."""
    converged = False
    x = np.array(start, dtype=float)
    rss = float(np.sum(w * (p - model(t, x)) ** 2))
    damping = 1e-2
    for _ in range(rounds):
        j = jacobian(t, x)
        g = j.T @ (w * (p - model(t, x)))
        h = j.T @ (w[:, None] * j)
        moved = False
        for _ in range(40):
            lift = damping * np.diag(np.maximum(np.diag(h), 1e-300))
            try:
                step = np.linalg.solve(h + lift, g)
            except np.linalg.LinAlgError:
                damping *= 10
                continue
            trial = np.clip(x + step, low, high)
            trial_rss = float(np.sum(w * (p - model(t, trial)) ** 2))
            if np.isfinite(trial_rss) and trial_rss <= rss:
                moved = True
                break
            damping *= 4
        if not moved:
            converged = True
            break
        done = np.max(np.abs(trial - x) / (np.abs(x) + 1e-12)) < 1e-10
        x, rss, damping = trial, trial_rss, max(damping / 3, 1e-12)
        if done:
            converged = True
            break
    return x, rss, converged


def _one(t, x):
    return 1 - np.exp(-x[0] * t)


def _one_slope(t, x):
    return (t * np.exp(-x[0] * t))[:, None]


def _two(t, x):
    return 1 - (x[0] * np.exp(-x[1] * t) + x[2] * np.exp(-x[3] * t))


def _two_slope(t, x):
    e1, e2 = np.exp(-x[1] * t), np.exp(-x[3] * t)
    return np.column_stack([-e1, x[0] * t * e1, -e2, x[2] * t * e2])


def _fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    t, p = pdf["t"].to_numpy(float), pdf["p_mean"].to_numpy(float)
    w = pdf["n"].to_numpy(float) / pdf["n"].sum()
    unit = float(np.sum(w * t))
    scaled = t / unit
    model = pdf["model"].iloc[0]
    nan = float("nan")
    if model == "double":
        # Start point of the two-term fit (a1, k1, a2, k2).
        start = [0.7, 500.0 * unit, 0.3, 10.0 * unit]
        x, rss, converged = _damped_fit(scaled, p, w, start, _two, _two_slope, [0] * 4, [1, np.inf, 1, np.inf])
        if converged and np.all(np.isfinite(x)):
            (k1, a1), (k2, a2) = sorted([(x[1] / unit, x[0]), (x[3] / unit, x[2])], reverse=True)
        else:
            model = "single"
    if model == "single":
        x, rss, _ = _damped_fit(scaled, p, w, [1.0], _one, _one_slope, [0], [np.inf])
        k1, a1, k2, a2 = x[0] / unit, 1.0, nan, nan
    total = int(pdf["n"].sum())
    return pd.DataFrame(
        [[int(pdf["label"].iloc[0]), pdf["kind"].iloc[0], model, total, k1, a1, k2, a2, rss * total]],
        columns=["label", "kind", "model", "n_dwells", "k1", "a1", "k2", "a2", "rss"],
    )


def fit_rates(cdf: DataFrame, double: Sequence[tuple[int, str]] = ()) -> DataFrame:
    """Rate constants per (label, kind), least squares on the empirical CDF.

    Weighting each collapsed point with its count and using the mean p of its ties has
    the same minimum as fitting all points. ``double`` lists the (label, kind) to fit
    with two exponentials (k1 >= k2); a fit that doesn't converge falls back to one.
    """
    model = F.lit("single")
    for label, kind in double:
        model = F.when((F.col("label") == label) & (F.col("kind") == kind), F.lit("double")).otherwise(model)
    return (
        cdf.select("label", "kind", model.alias("model"), "t", "n", "p_mean")
        .groupBy("label", "kind")
        .applyInPandas(_fit_group, FIT_SCHEMA)
        .withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("k2", "a2")})
    )


def kinetics_report(fits: DataFrame, probabilities: DataFrame) -> DataFrame:
    """One row per class: k of state 0, state 1 and whole events (NULL where there was
    nothing to fit) and the state probabilities."""
    wide = fits.groupBy("label").agg(
        *[
            F.max(F.when(F.col("kind") == kind, F.col("k1"))).alias(name)
            for kind, name in (("state_0", "k_state_0"), ("state_1", "k_state_1"), ("event", "k_overall"))
        ],
        F.max(F.when(F.col("kind") == "state_0", F.col("k2"))).alias("k2_state_0"),
    )
    return wide.join(probabilities, "label", "full")
