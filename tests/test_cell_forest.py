import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from grove.operators import cell_forest
from grove.operators.dataset import Fixture
from grove.operators.forest import ForestOptions, forest_stage, tune


def _rows(spark, n=900):
    x = [F.pmod(F.hash(F.col("id"), F.lit(i)), F.lit(7 + 5 * i)).cast("double") for i in range(3)]
    y = x[0] * 10 + x[1] * x[2] + F.pmod(F.hash("id"), F.lit(9973)) / 1000
    return spark.range(n).select("id", y.cast("double").alias("label"), array_to_vector(F.array(*x)).alias("features")
                                 ).repartition(3, "id").sortWithinPartitions("id").cache()


@pytest.mark.parametrize("depth, min_rows, bins", [(0, 1, 32), (5, 1, 32), (5, 9, 6), (12, 1, 32)])
def test_one_tree_is_mllibs(spark, depth, min_rows, bins):
    """With every row and feature nothing is drawn: a tree grown on cells must be MLlib's."""
    est = RandomForestRegressor(numTrees=1, maxDepth=depth, bootstrap=False, featureSubsetStrategy="all", seed=5,
                                minInstancesPerNode=min_rows, maxBins=bins)
    rows = _rows(spark)
    theirs, ours = est.fit(rows), cell_forest.fit_cells(rows, est)
    assert ours.totalNumNodes == theirs.totalNumNodes and ours.numFeatures == 3
    both = ours.transform(theirs.transform(rows).withColumnRenamed("prediction", "theirs"))
    assert both.where(F.abs(F.col("prediction") - F.col("theirs")) > 1e-9).count() == 0
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.01)


def test_bags_and_equal_labels(spark):
    rows, est = _rows(spark), RandomForestRegressor(numTrees=4, maxDepth=5, seed=5)
    a, b = ([t.toDebugString.split("\n", 1)[1] for t in cell_forest.fit_cells(_rows(spark), est).trees] for _ in range(2))
    assert a == b and len(set(a)) == 4
    assert cell_forest.fit_cells(rows.withColumn("label", F.lit(0.1)), est).totalNumNodes == 4
    few = cell_forest.fit_cells(rows.limit(1), est)
    assert few.getNumTrees == 4 and few.totalNumNodes == 4
    with pytest.raises(Exception, match="null or NaN"):
        cell_forest.fit_cells(rows.withColumn("label", F.when(F.col("id") != 5, F.col("label"))), est)


@pytest.mark.parametrize("limit", ["MAX_CELLS", "MAX_SUMS"])
def test_many_cells_are_left_to_mllib(spark, monkeypatch, limit):
    monkeypatch.setattr(cell_forest, limit, 100)
    assert cell_forest.fit_cells(_rows(spark), RandomForestRegressor(numTrees=2, maxDepth=3)) is None


def test_grid_reads_rows_once_a_fit(spark, monkeypatch):
    """A grid on few features goes through the cells: each fit reads its rows in one pass, not in one for each level."""
    seen = []
    tables = cell_forest.tables
    monkeypatch.setattr(cell_forest, "tables", lambda *a: seen.append(a[-1].getNumTrees()) or tables(*a))
    rows = _rows(spark).select("id", "label", F.col("features").alias("v"))
    r = tune(Fixture(rows, "label", [], ["id"], "regression", vector="v"),
             ForestOptions(trees=[1, 3], depth=5, subset="all", partitions=2), folds=2)
    best = r.best["numTrees"]
    assert sorted(seen) == sorted([1, 1, 3, 3, best, best])
    assert r.metrics.first().r2 > 0.8 and forest_stage(r.final).getNumTrees == best
    r.release()
