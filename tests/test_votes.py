import math

import pytest
from pyspark.sql import functions as F

from dwellkit.functions import columns
from dwellkit.operators import votes


def stream(spark, preds, truth):
    return spark.createDataFrame([(1, truth, p) for p in preds], "stream int, label int, pred int")


def test_hand_votes(spark):
    df = stream(spark, [1, 1, 0, 0, 2], 2)
    r = votes.vote_pattern(df, "stream", 4).first()
    assert (r.winner, r.top1, r.confidence, r["rank"], r.total_votes) == (0, 0, 0.4, 3, 5)
    assert r.entropy == pytest.approx(1.521928, abs=1e-6)
    natural = votes.vote_pattern(df, "stream", 4, entropy_base=None).first()
    assert natural.entropy == pytest.approx(1.054920, abs=1e-6)
    assert [x.n for x in votes.vote_counts(df, "stream", 4).orderBy("pred").collect()] == [2, 2, 1, 0]


def test_voted_variant(spark):
    df = stream(spark, [1, 1, 0, 0, 2], 1)
    assert votes.vote_pattern(df, "stream", 4).first()["rank"] == 1
    assert votes.vote_pattern_voted(df, "stream", 4).first()["rank"] == 2
    with pytest.raises(Exception, match="no votes"):
        votes.vote_pattern_voted(stream(spark, [1, 0], 3), "stream", 4).collect()


def test_argmax_and_gate(spark):
    df = spark.createDataFrame([(1, [0.2, 0.4, 0.4]), (2, [0.1, 0.15, 0.1]), (3, [0.2, 0.0, 0.0])], "id int, probs array<double>")
    assert [r.pred for r in votes.predict(df).orderBy("id").collect()] == [1, 1, 0]
    gated = votes.gate(df, 0.20, names=["a", "b", "c"]).orderBy("id").collect()
    assert [(r.pred, r.pred_name) for r in gated] == [(1, "b"), (None, None), (0, "a")]
    assert votes.confident(votes.gate(df, 0.20)).count() == 2


def test_mixture(spark):
    rows = [(0, 0)] * 5 + [(0, None)] + [(3, 0)] * 1 + [(3, 3)] * 2 + [(3, 1)]
    df = spark.createDataFrame(rows, "label int, pred int")
    mixed = votes.mixture_fractions(df, 4)
    got = {r.label: (r.actual, r.predicted) for r in mixed.collect()}
    assert got == {0: (0.6, pytest.approx(6 / 9)), 1: (0.0, pytest.approx(1 / 9)), 3: (0.4, pytest.approx(2 / 9))}
    e = votes.mixture_error(mixed).first()
    off = [6 / 9 - 0.6, 2 / 9 - 0.4]
    assert e.mae == pytest.approx(sum(map(abs, off)) / 2)
    assert e.rmse == pytest.approx(math.sqrt(sum(x * x for x in off) / 2))
    assert votes.mixture_error(mixed, "union").first().mae == pytest.approx((sum(map(abs, off)) + 1 / 9) / 3)
    table = votes.mixture_compare(mixed, {"a": 0.5, "c": 0.5}, ["a", "b", "c", "d"]).collect()
    assert [(r.name, r.defined) for r in table] == [("a", 0.5), ("b", 0.0), ("c", 0.5), ("d", 0.0)]
    assert {r.label: r.n for r in votes.predicted_fractions(df).collect()} == {0: 6, 1: 1, 3: 2}
    assert {r.label: r.fraction for r in votes.actual_fractions(df).collect()} == {0: 0.6, 3: 0.4}
    with pytest.raises(KeyError):
        votes.mixture_compare(mixed, {"z": 1.0}, ["a"])


def test_names(spark):
    df = spark.createDataFrame([("PeptideB",)], "name string")
    assert votes.name_labels(df, {"PeptideB": 1}).first().label == 1
    with pytest.raises(Exception, match="no label for class PeptideB"):
        votes.name_labels(df, {"PeptideA": 0}).collect()
    assert votes.label_names(spark.createDataFrame([(1,)], "label int"), ["a", "b"]).first().name == "b"
    row = df.select(columns.short_name(F.col("name")), columns.fixed(F.lit(2 / 3), 2), columns.clip(F.lit(7.0), 0, 1)).first()
    assert tuple(row) == ("b", "0.67", 1.0)
