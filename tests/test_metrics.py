import pytest

from dwellkit.operators import metrics

# Two published 7 x 7 confusion matrices (rows: truth).
MATRIX_1 = [
    [78, 0, 0, 0, 0, 0, 0],
    [0, 75, 0, 1, 0, 2, 0],
    [0, 0, 77, 0, 1, 0, 0],
    [0, 0, 0, 78, 0, 0, 0],
    [0, 0, 0, 0, 78, 0, 0],
    [0, 0, 0, 0, 0, 79, 0],
    [0, 0, 0, 0, 0, 0, 79],
]
MATRIX_2 = [
    [41, 3, 18, 13, 3, 0, 0],
    [4, 40, 12, 1, 8, 13, 0],
    [29, 5, 36, 1, 7, 0, 0],
    [15, 2, 2, 58, 0, 1, 0],
    [0, 11, 7, 0, 58, 2, 0],
    [0, 9, 0, 0, 1, 69, 0],
    [4, 0, 0, 0, 4, 0, 71],
]


def predictions(spark, matrix):
    rows = [(a, b) for a, row in enumerate(matrix) for b, n in enumerate(row) for _ in range(n)]
    return spark.createDataFrame(rows, "label int, pred int")


@pytest.mark.parametrize(
    "matrix,accuracy,p,r,f1,per_class",
    [
        (MATRIX_1, 544 / 548, 0.9929, 0.9927, 0.9927, [1.0, 0.980, 0.994, 0.994, 0.994, 0.988, 1.0]),
        (MATRIX_2, 373 / 548, 0.6878, 0.6799, 0.6824, [0.480, 0.541, 0.471, 0.768, 0.730, 0.841, 0.947]),
    ],
)
def test_published_matrices(spark, matrix, accuracy, p, r, f1, per_class):
    cells = metrics.confusion(predictions(spark, matrix), 7)
    wide = metrics.confusion_wide(cells, 7).orderBy("label").collect()
    assert [list(row)[1:] for row in wide] == matrix
    m = metrics.macro_metrics(cells).first()
    assert m.accuracy == pytest.approx(accuracy)
    assert (m.macro_precision, m.macro_recall, m.macro_f1) == pytest.approx((p, r, f1), abs=1e-4)
    table = metrics.per_class(cells).orderBy("label").collect()
    assert [x.f1 for x in table] == pytest.approx(per_class, abs=1e-3)
    report = {x.label: x for x in metrics.classification_report(cells).collect()}
    assert report["macro avg"].f1 == pytest.approx(m.macro_f1) and report["accuracy"].f1 == pytest.approx(accuracy)
    assert report["weighted avg"].recall == pytest.approx(accuracy) and report["0"].support == sum(matrix[0])


def test_macro_counts_only_seen_labels(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, pred int")
    assert metrics.macro_metrics(metrics.confusion(df, 5)).first().macro_recall == pytest.approx(0.75)


def test_binary_and_mcc(spark):
    rows = [(1, 1)] * 6 + [(0, 1)] * 2 + [(0, 0)] * 3 + [(1, 0)]
    m = metrics.binary_metrics(spark.createDataFrame(rows, "label int, pred int")).first()
    assert (m.tp, m.fp, m.tn, m.fn) == (6, 2, 3, 1)
    assert m.mcc == pytest.approx((6 * 3 - 2 * 1) / (8 * 7 * 5 * 4) ** 0.5)
    assert (m.accuracy, m.precision, m.recall) == pytest.approx((0.75, 0.75, 6 / 7))
    one = metrics.binary_metrics(spark.createDataFrame([(1, 1)], "label int, pred int")).first()
    assert one.mcc == 0 and one.recall == 1


def test_mcc_of_huge_counts(spark):
    from pyspark.sql import functions as F

    big = [F.lit(4_000_000_000_000).cast("long")] * 4
    assert spark.range(1).select(metrics.mcc(*big)).first()[0] == 0


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.3), (1, 0.9)], "label int, score double")
    got = {r.threshold: (r.tp, r.fp, r.tn, r.fn) for r in metrics.threshold_sweep(df).collect()}
    assert got[0.5] == (1, 0, 1, 1) and got[0.3] == (2, 0, 1, 0) and len(got) == 5


def test_roc(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.4), (0, 0.4), (0, 0.1)]
    df = spark.createDataFrame(rows, "label int, score double")
    pairs = [(p, n) for a, p in rows if a for b, n in rows if not b]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    assert metrics.roc_auc(df).first().auc == pytest.approx(want)
    curve = sorted((r.fpr, r.tpr) for r in metrics.roc_curve(df).collect())
    assert curve[0] == (0, 0) and curve[-1] == (1, 1) and len(curve) == 5
    assert metrics.roc_auc(df.filter("label = 1")).first().auc is None
