import math

import pytest
from pyspark.sql import functions as F

from conftest import SF01, SF001
from grove.operators.forest import ForestOptions, feature_subset, model_summary, train, tune
from grove.operators.score import score
from grove.plans import fixtures as fx
from grove.sinks.store import load_model, save_model


def test_regression_quality(spark):
    # Three features: every split may use all of them (the default draws one third).
    r = train(fx.net_price(spark, SF01), ForestOptions(trees=20, depth=6, subset="all"),
              refit=False)
    assert r.metrics.first().r2 > 0.95


def test_binary_quality(spark):
    r = train(fx.doc_quality(spark, SF01), ForestOptions(trees=50, depth=6), refit=False)
    row = r.metrics.first()
    assert row.auc > 0.9


def test_multiclass_quality_and_decoding(spark):
    r = train(fx.doc_lang(spark, SF01), ForestOptions(trees=20, depth=6), refit=False)
    assert r.metrics.first().accuracy > 0.9
    decoded = r.test.select("predicted_lang").distinct().collect()
    assert {x[0] for x in decoded} <= {"en", "fr", "de", "es"}


def test_vector_input_shape(spark):
    r = train(fx.embedding_label(spark, SF001), ForestOptions(trees=5, depth=4), refit=False)
    assert r.metrics.first().n > 0


def test_grid_path(spark):
    r = tune(fx.net_price(spark, SF001), ForestOptions(trees=[2, 6], depth=4), folds=3)
    scores = r.scores.collect()
    assert len(scores) == 2 and sum(s.chosen for s in scores) == 1
    assert r.best["numTrees"] in (2, 6)
    assert model_summary(r.final, spark).first().trees == r.best["numTrees"]


def test_save_load_same_predictions(spark, tmp_dir):
    f = fx.net_price(spark, SF001)
    r = train(f, ForestOptions(trees=5, depth=4), refit=False)
    loaded = load_model(save_model(r.model, f"{tmp_dir}/m"))
    a = score(r.model, f.frame, keep=["l_orderkey", "l_linenumber", "l_extendedprice"])
    b = score(loaded, f.frame, keep=["l_orderkey", "l_linenumber", "l_extendedprice"])
    assert a.exceptAll(b).count() == 0


def test_same_layout_same_trees(spark):
    f = fx.order_noise(spark, SF001)
    a = train(f, ForestOptions(trees=3, depth=4), refit=False)
    b = train(f, ForestOptions(trees=3, depth=4), refit=False)
    # First line names the model's uid; the rest is the tree.
    ta = [t.toDebugString.split("\n", 1)[1] for t in a.model.stages[-1].trees]
    tb = [t.toDebugString.split("\n", 1)[1] for t in b.model.stages[-1].trees]
    assert ta == tb


def test_by_class_weights(spark):
    r = train(fx.doc_lang(spark, SF001), ForestOptions(trees=5, depth=4, weighting="by_class"),
              refit=False)
    assert r.metrics.first().n > 0


def test_options_from_vector():
    o = ForestOptions.from_vector(["1", "30", "Gini", "Uniform", "50", "Sqrt"])
    assert (o.depth, o.trees, o.subset, o.impurity, o.weighting) == (30, 50, "sqrt", "gini", "uniform")
    g = ForestOptions.from_vector(["1", "30", "Entropy", "ByClass", "50,1", "Default"])
    assert g.trees == [50, 1] and g.is_grid() and g.weighting == "by_class"
    assert feature_subset("Ln", 512) == str(math.ceil(math.log(512)))
    assert feature_subset("Default", 10) == "auto"
    with pytest.raises(ValueError):
        ForestOptions(depth=31).validated()


def test_external_validation(spark):
    f = fx.net_price(spark, SF001)
    other = fx.net_price(spark, SF01)
    r = train(f, ForestOptions(trees=3, depth=3), external=other, refit=False)
    assert r.metrics.first().n == 60000


def test_score_probability_columns(spark):
    f = fx.doc_quality(spark, SF001)
    r = train(f, ForestOptions(trees=5, depth=3), refit=False)
    out = score(r.model, f.frame, keep=["doc_id"])
    assert set(out.columns) == {"doc_id", "prediction", "confidence", "p_positive"}
    row = out.agg(F.min("confidence"), F.max("p_positive")).first()
    assert row[0] >= 0.5 and row[1] <= 1.0
