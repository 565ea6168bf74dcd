import pytest
from pyspark.sql import functions as F

from conftest import SF01
from grove.operators.split import holdout_split, with_folds, with_side
from grove.sources.tables import table


def test_split_sizes(spark):
    orders = table(spark, SF01, "orders")
    train, test = holdout_split(orders, "o_orderkey", 0.8)
    assert (train.count(), test.count()) == (12060, 2940)


def test_fold_sizes(spark):
    orders = table(spark, SF01, "orders")
    counts = {r.fold: r["count"] for r in with_folds(orders, "o_orderkey", 3).groupBy("fold").count().collect()}
    assert counts == {0: 4991, 1: 5093, 2: 4916}


def test_split_invariant_under_repartition(spark):
    orders = table(spark, SF01, "orders").select("o_orderkey")
    a = with_side(orders, "o_orderkey")
    b = with_side(orders.repartition(13, "o_orderkey"), "o_orderkey")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_whole_orders_stay_together(spark):
    li = with_side(table(spark, SF01, "lineitem"), "l_orderkey")
    assert li.groupBy("l_orderkey").agg(F.countDistinct("side").alias("s")).where("s > 1").count() == 0


def test_one_fold_rejected(spark):
    with pytest.raises(ValueError):
        with_folds(table(spark, SF01, "orders"), "o_orderkey", 1)


def test_ratio_bounds():
    from grove.functions.hashing import side_limit
    assert side_limit(0.8) == 2000 and side_limit(1.0) == 0
    with pytest.raises(ValueError):
        side_limit(1.5)


def test_null_keys_stay(spark):
    from grove.operators.split import holdout_split, with_folds, with_side

    df = spark.range(1000).selectExpr("if(id % 10 = 0, null, id) AS k", "id % 3 AS j", "id")
    for key in ("k", ["k", "j"]):
        train, test = holdout_split(df, key, 0.7)
        sides = {r.side: r["count"] for r in with_side(df, key, 0.7).groupBy("side").count().collect()}
        assert train.count() + test.count() == 1000
        assert sides == {"train": train.count(), "test": test.count()}
        assert with_folds(df, key, 3).where("fold is null").count() == 0
