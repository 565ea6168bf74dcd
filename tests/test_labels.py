"""Label dictionary, class counts, weights without a join, dropped rows, retraining, folds."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF01, SF001
from grove.operators.dataset import Fixture
from grove.operators.features import chi_squared, select_features, with_class_weights
from grove.operators.forest import (ForestLearner, ForestOptions, best_setting, flat_stages,
                                    forest_stage, train, tune)
from grove.operators.labels import LabelDictionary, class_counts, with_class_count
from grove.plans import fixtures as fx
from grove.sinks.store import load_tuned, save_tuned


def test_dictionary_order_unseen_and_limit(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), (None,)], "y string")
    words = LabelDictionary.of(df, "y")
    assert words.labels == ("b", "a", "c")
    more = df.unionByName(spark.createDataFrame([("zzz",)], "y string"))
    out = words.decoder("i", "back").transform(words.indexer("y", "i").transform(more))
    assert {(r.y, r.i, r.back) for r in out.collect()} == {
        ("b", 0.0, "b"), ("a", 1.0, "a"), ("c", 2.0, "c"), (None, 3.0, "__unseen"), ("zzz", 3.0, "__unseen")}
    with pytest.raises(ValueError):
        class_counts(df, "y", most=2)
    with pytest.raises(ValueError):
        with_class_count(df, "y", 0)


def test_more_than_a_hundred_numeric_classes(spark):
    y = F.col("id") % 150
    df = spark.range(0, 3000).select("id", y.cast("double").alias("y"), (y % 15).cast("double").alias("a"),
                                     F.floor(y / 15).cast("double").alias("b"))
    f = Fixture(df, "y", ["a", "b"], ["id"], "multiclass")
    for n_classes in (None, 160):
        r = train(f, ForestOptions(trees=3, depth=12, subset="all", n_classes=n_classes), refit=False)
        assert forest_stage(r.model).numClasses == (n_classes or 150)
        assert r.metrics.first().accuracy > 0.9
        r.release()


def test_class_only_on_the_test_side_counts_as_an_error(spark):
    df = spark.range(0, 400).select("id", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("y"),
                                    (F.col("id") % 2).cast("double").alias("x"))
    other = df.limit(30).withColumn("y", F.when(F.col("id") < 10, "new").otherwise(F.col("y")))
    r = train(Fixture(df, "y", ["x"], ["id"], "multiclass"), ForestOptions(trees=2, depth=2),
              external=Fixture(other, "y", ["x"], ["id"], "multiclass"), refit=False)
    m = r.metrics.first()
    n_new = other.where("y = 'new'").count()
    assert m.n == 30 and m.accuracy == pytest.approx(1 - n_new / 30)
    # the saved model meets a class that not even the dictionary has
    late = r.model.transform(other.withColumn("y", F.lit("later")))
    assert {x.label for x in late.select("label").collect()} == {3.0}
    assert late.where("predicted_y = '__unseen'").count() == 0
    r.release()


def test_class_weights_move_no_rows(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [(None,)], "y string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        out = with_class_weights(df, "y")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert {(r.y, r.weight) for r in out.collect()} == {("a", 0.75), ("b", 1.5), (None, None)}
        assert with_class_weights(df.limit(0), "y").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def holed(spark):
    rows = [(i, float(i), None if i % 10 == 0 else float(i % 7), float("nan") if i % 15 == 0 else 1.0 * i)
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double")
    return Fixture(df.withColumn("y", F.when(F.col("id") != 5, F.col("y"))), "y", ["a", "b"], ["id"], "regression")


def test_dropped_rows_are_reported(spark):
    f = holed(spark)
    r = train(f, ForestOptions(trees=2, depth=3, handle_invalid="skip"), refit=False)
    got = {x.column_name: tuple(x)[1:] for x in r.report.frame(spark).collect()}
    bad = sum(i % 10 == 0 or i % 15 == 0 or i == 5 for i in range(300))
    assert got == {"a": (300, 30, bad, 300 - bad), "b": (300, 20, bad, 300 - bad), "label": (300, 1, bad, 300 - bad)}
    m = r.metrics.first()
    assert 0 < m.n < 300 and not math.isnan(m.rmse)
    r.release()
    with pytest.raises(Exception):
        train(f, ForestOptions(trees=2, depth=3), refit=False)
    with pytest.raises(ValueError):
        train(f, ForestOptions(handle_invalid="keep"))


def test_saved_pipeline_holds_nothing_fitted_and_retrains(spark, tmp_dir):
    df = spark.range(0, 600).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("c"),
                                    (F.col("id") % 3).cast("double").alias("v"))
    r = tune(Fixture(df, "c", ["v"], ["id"], "multiclass"), ForestOptions(trees=[1, 3], depth=3), folds=2)
    model, pipeline = load_tuned(save_tuned(r, f"{tmp_dir}/tuned"))
    (learner,) = pipeline.getStages()
    assert isinstance(learner, ForestLearner)
    assert {x.predicted_c for x in model.transform(df).collect()} == {"x", "y"}
    assert forest_stage(model).getNumTrees == r.best["numTrees"]
    more = df.unionByName(spark.range(0, 200).select("id", F.lit("z").alias("c"), F.lit(9.0).alias("v")))
    again = pipeline.fit(more)
    assert again.transform(more.where("c = 'z'")).where("predicted_c = 'z'").count() == 200
    assert again.transform(df.drop("c")).count() == 600
    assert not any(hasattr(s, "trees") for s in pipeline.getStages()) and len(flat_stages(again)) == 4
    with pytest.raises(ValueError):
        ForestLearner.of(Fixture(df, "c", ["v"], [], "multiclass"), ForestOptions(trees=[1, 2]))
    r.release()


def test_fold_figures_and_one_stored_frame(spark):
    spark.catalog.clearCache()
    jsc = spark.sparkContext._jsc.sc()
    f = fx.net_price(spark, SF001)
    r = tune(f, ForestOptions(trees=[1, 3], depth=3, subset="all"), folds=3, refit=False)
    assert len([x for x in jsc.getRDDStorageInfo() if x.numCachedPartitions() > 0]) == 1
    folds = r.fold_scores.collect()
    assert len(folds) == 6 and {(x.trees, x.fold) for x in folds} == {(t, k) for t in (1, 3) for k in range(3)}
    n_train = r.fold_scores.where("trees = 1").agg(F.sum("n_rows")).first()[0]
    assert n_train + r.metrics.first().n == 6000
    for s in r.scores.collect():
        values = [x.value for x in folds if x.trees == s.trees]
        assert s.mean == pytest.approx(sum(values) / 3)
    chosen = r.scores.where("chosen").collect()
    assert len(chosen) == 1 and chosen[0].mean == min(x.mean for x in r.scores.collect())
    assert forest_stage(r.model).getNumTrees == chosen[0].trees == r.best["numTrees"]
    r.release()
    assert not [x for x in jsc.getRDDStorageInfo() if x.numCachedPartitions() > 0]


def test_nan_is_never_the_best():
    assert best_setting([math.nan, 0.2, 0.9, 0.9], True) == 2
    assert best_setting([math.nan, 0.2, 0.2], False) == 1
    assert best_setting([math.nan, math.nan], True) == 0


def test_chi_squared_equals_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    names = ["l_linenumber", "l_quantity", "l_discount"]
    df = li.withColumn("y", (F.col("l_linenumber") % 3).cast("double"))
    got = {r.feature: r for r in chi_squared(df, names, "y").collect()}
    ready = VectorAssembler(inputCols=names, outputCol="f").transform(df)
    want = ChiSquareTest.test(ready, "f", "y").first()
    for i, c in enumerate(names):
        assert got[c].statistic == pytest.approx(want.statistics[i], rel=1e-9)
        assert got[c].dof == want.degreesOfFreedom[i] and got[c].position == i
    p = dict(zip(names, want.pValues))
    # the strength orders features as their p-values do where these differ
    assert sorted(names, key=lambda c: -got[c].strength)[0] == min(names, key=lambda c: p[c])


def test_chi_squared_nulls_and_constants(spark):
    df = spark.createDataFrame([("x", 1.0, 5.0), ("x", None, 5.0), ("y", 2.0, 5.0), ("y", None, 5.0),
                                ("y", None, 5.0), (None, 3.0, 5.0)], "y string, a double, c double")
    drop = {r.feature: r for r in chi_squared(df, ["a", "c"], "y").collect()}
    assert (drop["a"].n, drop["a"].dof, drop["a"].statistic) == (2, 1, pytest.approx(2.0))
    assert drop["c"].dof == 0 and drop["c"].strength is None and drop["c"].statistic == pytest.approx(0)
    value = {r.feature: r for r in chi_squared(df, ["a", "c"], "y", nulls="value").collect()}
    assert (value["a"].n, value["a"].dof) == (5, 2)
    chosen, table = select_features(df, ["c", "a"], "y", top=1)
    assert chosen == ["a"] and {(r.feature, r.selected) for r in table.collect()} == {("a", True), ("c", False)}
    with pytest.raises(ValueError):
        chi_squared(df, ["a"], "y", nulls="mean")


def test_feature_stages_in_training(spark):
    f = fx.doc_lang(spark, SF01)
    r = train(f, ForestOptions(trees=10, depth=6, top_features=5, max_categories=4), refit=False)
    assert forest_stage(r.model).numFeatures == 5 and r.metrics.first().accuracy > 0.8
    assert r.model.transform(f.frame.drop("lang")).count() == 1000
    r.release()
    with pytest.raises(ValueError):
        train(fx.net_price(spark, SF001), ForestOptions(trees=1, depth=2, top_features=1), refit=False)


def test_empty_and_one_class(spark):
    df = spark.range(0, 50).select("id", F.lit("only").alias("y"), F.col("id").cast("double").alias("x"))
    r = train(Fixture(df, "y", ["x"], ["id"], "multiclass"), ForestOptions(trees=1, depth=2), refit=False)
    m = r.metrics.first()
    assert m.accuracy == 1.0 and m.kappa is None
    r.release()
