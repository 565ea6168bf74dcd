import math

import pytest
from pyspark.ml.evaluation import (BinaryClassificationEvaluator,
                                   MulticlassClassificationEvaluator, RegressionEvaluator)
from pyspark.sql import functions as F

from conftest import SF01
from grove.operators import metrics as M
from grove.plans import fixtures as fx


def test_agreement_figures(spark):
    row = M.agreement(fx.flag_pairs(spark, SF01), "actual", "predicted").first()
    assert row.kappa == pytest.approx(0.001177, abs=1e-6)
    assert row.ba == pytest.approx(0.334117, abs=1e-6)
    assert row.accuracy == pytest.approx(0.334083, abs=1e-6)
    assert row.n == 60000


def test_confusion_matrix_sums_to_rows(spark):
    cm = M.confusion_matrix(fx.flag_pairs(spark, SF01), "actual", "predicted")
    assert cm.agg(F.sum("n")).first()[0] == 60000
    assert set(cm.columns) == {"actual", "predicted", "n"}


def test_accuracy_matches_mllib(spark):
    pairs = fx.flag_pairs(spark, SF01)
    idx = {"A": 0.0, "N": 1.0, "R": 2.0}
    m = F.create_map(*[x for k, v in idx.items() for x in (F.lit(k), F.lit(v))])
    num = pairs.select(m[F.col("actual")].alias("label"), m[F.col("predicted")].alias("prediction"))
    ours = M.accuracy(num).first().accuracy
    ev = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(num)
    assert ours == pytest.approx(ev, abs=1e-6)


def test_regression_figures(spark):
    row = M.regression_metrics(fx.price_pairs(spark, SF01)).first()
    assert row.mse == pytest.approx(3131771.419, abs=1e-3)
    assert row.rmse == pytest.approx(1769.6812, abs=1e-4)
    assert row.mae == pytest.approx(1320.4324, abs=1e-4)
    assert row.r2 == pytest.approx(0.996179, abs=1e-6)


def test_regression_matches_evaluator(spark):
    pairs = fx.price_pairs(spark, SF01)
    row = M.regression_metrics(pairs).first()
    for name, ours in [("mse", row.mse), ("rmse", row.rmse), ("mae", row.mae),
                       ("r2", row.r2), ("var", row.explained_variance)]:
        ev = RegressionEvaluator(metricName=name).evaluate(pairs)
        assert ours == pytest.approx(ev, rel=1e-6), name


def test_auc_with_ties(spark):
    assert M.area_under_roc(fx.score_pairs(spark, SF01)) == pytest.approx(0.496987, abs=1e-6)


def test_unseen_predicted_class_counts_as_error(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "b"), ("b", "b")],
                               "label string, prediction string")
    row = M.agreement(df).first()
    assert row.accuracy == pytest.approx(0.75)
    assert row.ba == pytest.approx((0.5 + 1.0) / 2)
    # PE = (2*1 + 2*2 + 0*1) / 16
    pe = 6 / 16
    assert row.kappa == pytest.approx((0.75 - pe) / (1 - pe))


def test_single_class_kappa_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 3, "label double, prediction double")
    row = M.agreement(df).first()
    assert row.kappa is None and row.accuracy == 1.0 and row.ba == 1.0


def test_constant_label_r2_null(spark):
    df = spark.createDataFrame([(1.0, 1.5), (1.0, 0.5)], "label double, prediction double")
    row = M.regression_metrics(df).first()
    assert row.r2 is None and row.mse == pytest.approx(0.25)


def test_binary_report_has_auc(spark):
    pairs = fx.score_pairs(spark, SF01).withColumn(
        "prediction", F.when(F.col("score") >= 48, 1.0).otherwise(0.0))
    row = M.binary_report(pairs, score="score").first()
    assert not math.isnan(row.auc) and 0 <= row.ba <= 1


def test_small_errors_are_not_rounded_away(spark):
    df = spark.createDataFrame([(0.0001, 0.0002), (0.0004, 0.0003)], "label double, prediction double")
    row = M.regression_metrics(df).first()
    assert row.mse == pytest.approx(1e-8) and row.mae == pytest.approx(1e-4)
    assert M.rounded(M.regression_metrics(df), 2).first().mse == 0.0


def test_figures_are_of_the_rows_that_can_be_judged(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (None, 9.0), (5.0, None)], "label double, prediction double")
    row = M.regression_metrics(df).first()
    assert (row.n, row.mse, row.r2) == (2, 2.0, pytest.approx(1 - 2 / 0.25))
    row = M.agreement(df).first()
    assert (row.n, row.accuracy) == (3, pytest.approx(1 / 3))
    assert M.accuracy(df).first().accuracy == pytest.approx(1 / 3)
    assert M.regression_metrics(df.limit(0)).first().n == 0 and M.agreement(df.limit(0)).first().n == 0


@pytest.mark.parametrize("bounds", [None, [], M.unit_bounds(), [0.25, 0.5]])
def test_roc_points_equal_a_plain_count(spark, bounds):
    import random
    rng = random.Random(4)
    rows = [(float(rng.random() < s), s) for s in (round(rng.random(), 2) for _ in range(400))]
    rows += [(None, 0.5), (1.0, None)]
    df = spark.createDataFrame(rows, "label double, score double").repartition(5)
    known = [(y, s) for y, s in rows if y is not None and s is not None]
    p = sum(y for y, _ in known)
    n = len(known) - p
    got = {r.threshold: r for r in M.roc_points(df, bounds=bounds).collect()}
    assert set(got) == {s for _, s in known}
    for t, r in got.items():
        tp = sum(y for y, s in known if s >= t)
        fp = sum(1 - y for y, s in known if s >= t)
        assert (r.tp, r.fp) == (tp, fp)
        assert (r.tpr, r.fpr, r.precision) == (pytest.approx(tp / p), pytest.approx(fp / n), pytest.approx(tp / (tp + fp)))
        assert r.ba == pytest.approx((tp / p + 1 - fp / n) / 2)
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert M.area_under_roc(df, bounds=bounds) == pytest.approx(ev.evaluate(df.dropna()), abs=1e-12)
    judged = df.withColumn("prediction", F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0))
    report = M.binary_report(judged, score="score", bounds=bounds).first()
    assert report.kappa == pytest.approx(got[min(t for t in got if t >= 0.5)].kappa, abs=0.02)
    assert report.auc == pytest.approx(M.area_under_roc(df), abs=1e-12)


def test_roc_without_one_of_the_classes(spark):
    df = spark.createDataFrame([(1.0, 0.2), (1.0, 0.4)], "label double, score double")
    assert math.isnan(M.area_under_roc(df))
    assert [(r.tpr, r.fpr) for r in M.roc_points(df).orderBy(F.desc("threshold")).collect()] == [(0.5, None), (1.0, None)]
    assert M.roc_points(df.limit(0)).count() == 0
