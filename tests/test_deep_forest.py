import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from grove.operators import deep_forest
from grove.operators.dataset import Fixture
from grove.operators.forest import ForestOptions, forest_stage, train
from grove.sinks.store import load_model, save_model


def _rows(spark, n=600):
    """Five count features and a label that needs more than one of them."""
    x = [F.pmod(F.hash(F.col("id"), F.lit(i)), F.lit(4 + 3 * i)).cast("double") for i in range(5)]
    rows = spark.range(n).select("id", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    y = F.col("x1") * 10 + F.col("x3") * F.col("x2") + F.pmod(F.hash("id"), F.lit(9973)) / 1000
    return rows.select("id", y.cast("double").alias("label"), array_to_vector(F.array(*[f"x{i}" for i in range(5)]))
                       .alias("features")).repartition(3, "id").sortWithinPartitions("id").cache()


def _nodes(model):
    return [t.toDebugString.split("\n", 1)[1] for t in model.trees]


@pytest.mark.parametrize("whole_node, min_rows, bins", [(1 << 12, 1, 32), (40, 7, 32), (100, 1, 6)])
def test_one_tree_is_mllibs(spark, whole_node, min_rows, bins):
    """With every row and feature nothing is drawn, so finishing nodes in tasks must give MLlib's tree."""
    est = RandomForestRegressor(numTrees=1, maxDepth=14, bootstrap=False, featureSubsetStrategy="all", seed=5,
                                minInstancesPerNode=min_rows, maxBins=bins)
    rows = _rows(spark)
    theirs, ours = est.fit(rows), deep_forest.fit_deep(rows, est, whole_node)
    assert ours.totalNumNodes == theirs.totalNumNodes and ours.numFeatures == 5
    assert ours.trees[0].depth == theirs.trees[0].depth
    both = ours.transform(theirs.transform(rows).withColumnRenamed("prediction", "theirs"))
    assert both.where(F.abs(F.col("prediction") - F.col("theirs")) > 1e-9).count() == 0
    # Features that part a node alike may be taken one for the other.
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.01)


def test_depth_ends_trees_of_large_and_small_nodes(spark):
    rows = _rows(spark)
    for whole_node in (1, 1 << 12):
        est = RandomForestRegressor(numTrees=3, maxDepth=4, seed=5)
        model = deep_forest.fit_deep(rows, est, whole_node)
        assert [t.depth for t in model.trees] == [4, 4, 4] and model.getNumTrees == 3


def test_same_trees_again_and_bags_differ(spark):
    est = RandomForestRegressor(numTrees=4, maxDepth=20, seed=5)
    a, b = (deep_forest.fit_deep(_rows(spark), est, 100) for _ in range(2))
    assert _nodes(a) == _nodes(b) and len(set(_nodes(a))) == 4


def test_deep_regression_does_not_go_level_by_level(spark, tmp_dir, monkeypatch):
    """A deep forest asks for distributed levels of its large nodes only, and its model is saved as any other."""
    seen = []
    level = deep_forest.level
    monkeypatch.setattr(deep_forest, "level", lambda *a: seen.append(len(a[2])) or level(*a))
    rows = _rows(spark).select("id", "label", F.col("features").alias("v"))
    r = train(Fixture(rows, "label", [], ["id"], "regression", vector="v"),
              ForestOptions(trees=5, depth=30, partitions=2), refit=False)
    assert seen == [5] and r.metrics.first().r2 > 0.5
    loaded = load_model(save_model(r.model, f"{tmp_dir}/m"))
    assert _nodes(forest_stage(loaded)) == _nodes(forest_stage(r.model))


def test_odd_rows(spark):
    est = RandomForestRegressor(numTrees=3, maxDepth=20, seed=5)
    rows = _rows(spark)
    same = deep_forest.fit_deep(rows.withColumn("label", F.lit(2.5)), est)
    assert same.totalNumNodes == 3 and same.transform(rows).where("prediction <> 2.5").count() == 0
    flat = deep_forest.fit_deep(rows.withColumn("features", array_to_vector(F.array(F.lit(1.0), F.lit(0.0)))), est)
    assert flat.totalNumNodes == 3
    one = deep_forest.fit_deep(rows.limit(1), est)
    assert one.getNumTrees == 3
    with pytest.raises(ValueError):
        deep_forest.fit_deep(rows.limit(0), est)
    with pytest.raises(Exception, match="null or NaN"):
        deep_forest.fit_deep(rows.withColumn("label", F.when(F.col("id") != 5, F.col("label"))), est)


def test_thresholds():
    v = np.arange(5.0)
    assert deep_forest.thresholds(v, np.ones(5, int), 32).tolist() == [0.5, 1.5, 2.5, 3.5]
    assert deep_forest.thresholds(v, np.array([96, 1, 1, 1, 1]), 3).tolist() == [0.5, 1.5]
    assert len(deep_forest.thresholds(np.arange(1000.0), np.ones(1000, int), 32)) == 31


def test_subset_size():
    size = deep_forest.subset_size
    assert [size(s, 512, 50) for s in ("auto", "all", "sqrt", "log2", "onethird", "7", "0.5")] == [171, 512, 23, 9, 171, 7, 256]
    assert size("auto", 512, 1) == 512


@pytest.mark.parametrize("whole_node, subset", [(1 << 12, "auto"), (60, "2"), (1, "all")])
def test_scored_as_by_the_loaded_model(spark, whole_node, subset):
    """Rows scored where the pieces are get what MLlib's own model says, whatever they come with."""
    est = RandomForestRegressor(numTrees=5, maxDepth=6 if whole_node == 1 else 20, seed=5, featureSubsetStrategy=subset)
    rows = _rows(spark)
    model = deep_forest.fit_deep(rows, est, whole_node)
    odd = spark.createDataFrame([(-1, -1e9), (-2, float("nan")), (-3, 0.5), (-3, 0.5)], "id long, v double")
    asked = rows.select("id", "features").unionByName(
        odd.select("id", array_to_vector(F.array(*[F.col("v")] * 5)).alias("features")))
    asked = asked.withColumn("map", F.create_map(F.lit("id"), F.col("id")))
    ours = model.transform(asked)
    assert ours.columns == ["id", "features", "map", "prediction"] and ours.count() == 604
    theirs = model.loaded().transform(asked)
    assert sorted((r.id, r.prediction) for r in ours.collect()) == sorted((r.id, r.prediction) for r in theirs.collect())
    assert model.totalNumNodes == model.loaded().totalNumNodes and model.getNumTrees == model.loaded().getNumTrees
    with pytest.raises(Exception, match="must not be null"):
        model.transform(asked.withColumn("features", F.when(F.col("id") != 7, F.col("features")))).collect()


def test_a_deep_forest_stays_out_of_the_driver(spark, monkeypatch):
    """Fixed and grid path, refit, figures and facts of the model: none of them makes MLlib's model of all nodes."""
    monkeypatch.setattr(deep_forest, "as_model", lambda *a: pytest.fail("the forest was loaded"))
    rows = _rows(spark).select("id", "label", F.col("features").alias("v"))
    for r in (train(Fixture(rows, "label", [], ["id"], "regression", vector="v"), ForestOptions(trees=t, depth=30, partitions=2),
                    folds=2) for t in (3, [3, 1])):
        assert r.metrics.first().r2 > 0.3 and r.test.count() > 0
        assert forest_stage(r.final).numFeatures == 5 and forest_stage(r.model).getNumTrees == (r.best or {"numTrees": 3})["numTrees"]
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (r.test, r.test.groupBy().count())]
        assert ["MapInArrow" in p for p in plans] == [True, False]  # counting rows scores none
        r.release()


@pytest.mark.parametrize("min_rows", [1, 3])
def test_search_in_order_and_by_histogram_agree(min_rows):
    """Nodes of few rows, of two and of many are searched in three ways for the same split."""
    rng = np.random.default_rng(3)
    size = np.array([2] * 60 + list(range(3, 60)))
    start = np.concatenate([[0], np.cumsum(size)])
    bins, w = rng.integers(0, 9, (start[-1], 7)).astype(np.uint8), rng.integers(1, 4, start[-1]).astype(float)
    bins[start[65]:start[66]] = 4
    y = rng.normal(size=start[-1])
    drawn = deep_forest.drawn_features(rng, len(size), 7, 3)
    assert all(len(set(d)) == 3 and 0 <= min(d) and max(d) < 7 for d in drawn.tolist())
    hist = np.stack([deep_forest.histogram(bins[i:j], w[i:j], w[i:j] * y[i:j], d, 9)
                     for i, j, d in zip(start, start[1:], drawn)], axis=2)
    gain, f, cut, n_left = deep_forest.best_splits(hist, min_rows)
    for j in range(len(size)):
        r, x = slice(start[j], start[j + 1]), bins[start[j]:start[j + 1]][:, drawn[j]]
        sums = [(v @ (x <= b), v.sum()) for b in range(8) for v in (w[r], w[r] * y[r])]
        with np.errstate(all="ignore"):
            drops = [np.where((n >= min_rows) & (t - n >= min_rows), s * s / n + (u - s) ** 2 / (t - n) - u * u / t, 0)
                     for (n, t), (s, u) in zip(sums[::2], sums[1::2])]
        assert np.isclose(gain[j], np.max(drops)) and (not gain[j] or n_left[j] == w[r][x[:, f[j]] <= cut[j]].sum())
    for i, j in ((60, 62), (60, 66), (66, 74), (70, 90), (60, 117)):
        got = deep_forest.splits_of_few(bins, w, w * y, start[i:j], size[i:j], drawn[i:j], min_rows)
        _agree(got, gain[i:j], f[i:j], cut[i:j])
    _agree(deep_forest.splits_of_two(bins, w, y, start[:60], drawn[:60], min_rows), gain[:60], f[:60], cut[:60])


def _agree(got, gain, f, cut):
    assert np.allclose(got[0], gain)
    # Of features that part a node alike, rounding says which is taken.
    alike = (gain > 1e-9) & (got[1] == f)
    assert alike.any() and (got[2] == cut)[alike].all()


def test_a_task_gets_its_rows_once(spark):
    """Nodes go to few tasks, each small enough, and a row that several trees of a task need is dealt to it once."""
    small = [{1: 70.0}, {2: 30.0, 3: 40.0}, {}, {2: 10.0, 3: 60.0}]
    nodes = [(t, p) for t, x in enumerate(small) for p in x]
    for rows, least, width, most in ((100, 1, 1, 1), (100, 4, 1, 5), (1 << 20, 1, 1 << 20, 5)):
        tasks = deep_forest.tasks_of(small, rows, least, width)
        assert [(t, p) for x in tasks for t, paths in x.items() for p in paths] == nodes and 1 <= len(tasks) <= most
    points = spark.createDataFrame([(i, float(i), bytes([i % 9]), bytes([i % 2, 1])) for i in range(50)], deep_forest.POINT)
    chunks = deep_forest.dealt(points.coalesce(1), deep_forest.Top(2), [{0: [1], 1: [1]}], ("y", 8), True).collect()
    assert [(r.task, r.n) for r in chunks] == [(0, 50)]
    bins, y, bag = deep_forest.gathered([(r.n, r.data) for r in chunks], 1, 8, 2)
    assert bins.ravel().tolist() == [i % 9 for i in range(50)] and y.view("<f8").ravel().tolist() == [float(i) for i in range(50)]
    assert bag.tolist() == [[i % 2 for i in range(50)], [1] * 50]
