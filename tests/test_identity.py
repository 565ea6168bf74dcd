"""Row identity and canonical layout: nothing lost, nothing that depends on files or partitions."""

import inspect
import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from grove.operators.forest import ForestOptions, forest_stage, train
from grove.operators.from_file import file_rows, train_from_file
from grove.operators import identity
from grove.operators.identity import ROW_KEY, canonical_layout, layout_partitions, with_row_key
from grove.operators.split import with_side
from grove.plans import fixtures as fx
from grove.plans.queries import QUERIES, _measured_once
from grove.sources.delimited import read_table, write_delimited

ROWS = [(1, "a", 0.5), (1, "a", 0.5), (1, "a", 0.5), (1, None, 0.5), (None, None, None), (None, None, None),
        (11, ":a", 2.0), (1, "1:a", 2.0), (1, "a", -0.0), (1, "a", 0.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k long, t string, v double")


def test_identity_is_unique_and_keeps_every_row(rows):
    keyed = with_row_key(rows)
    got = keyed.collect()
    assert len(got) == len(ROWS) == len({r[ROW_KEY] for r in got})
    assert sorted(map(repr, (tuple(r)[:3] for r in got))) == sorted(
        repr((k, t, None if v is None else v + 0.0)) for k, t, v in ROWS)
    assert with_row_key(rows.limit(0)).count() == 0


@pytest.mark.parametrize("copies_at_once", [1, 2, 1 << 16])
def test_identity_does_not_depend_on_partitions(spark, copies_at_once):
    df = spark.range(0, 6000).select((F.col("id") % 7 * F.when(F.col("id") < 4000, 0).otherwise(1)).alias("a"),
                                     (F.col("id") % 3).cast("double").alias("b"))
    want = {tuple(r) for r in with_row_key(df).collect()}
    assert len(want) == 6000
    for layout in (df.repartition(13), df.repartition(5, "b"), df.coalesce(1).orderBy(F.desc("a"))):
        assert {tuple(r) for r in with_row_key(layout, copies_at_once=copies_at_once).collect()} == want


def test_copies_spread_over_partitions(spark):
    df = spark.range(0, 3000).select(F.lit(1).alias("a"))
    laid = canonical_layout(with_row_key(df), ROW_KEY, 8)
    sizes = [r["count"] for r in laid.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 500
    with pytest.raises(ValueError):
        canonical_layout(df, "a", 0)
    with pytest.raises(ValueError):
        with_row_key(with_row_key(df))


def test_few_counts_are_unfolded_by_several_tasks(spark):
    df = spark.range(0, 200_000).select((F.col("id") % 50).alias("a"))
    sizes = [r["count"] for r in with_row_key(df).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_000 and len(sizes) > 1 and max(sizes) < 100_000


def test_layout_grows_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(identity, "ROWS_A_PARTITION", 100)
    assert layout_partitions(spark.range(50), 4) == 4
    assert layout_partitions(spark.range(1001), 4) == 11
    assert layout_partitions(spark.range(0), 4) == 4
    with pytest.raises(ValueError):
        layout_partitions(spark.range(5), 0)
    r = train(fx.net_price(spark, SF001), ForestOptions(trees=1, depth=2, partitions=4), refit=False)
    assert r.cached[0].rdd.getNumPartitions() == 60
    assert set(r.test.columns) == {"l_orderkey", "l_linenumber", "net_price", "l_extendedprice", "l_discount",
                                   "l_quantity", "label", "_vector0", "features", "prediction"} - {"_vector0"}
    r.release()


def test_content_of_some_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "x"), (1, [1.0, 2.0], "x"), (2, None, "y")],
                               "a int, b array<double>, c string")
    got = with_row_key(df, ["a", "c"]).collect()
    assert len({r[ROW_KEY] for r in got}) == 3 and sorted(r.a for r in got) == [1, 1, 2]
    assert [r.b for r in got if r.a == 1] == [[1.0, 2.0]] * 2


def test_rows_fitted_twice_are_kept_once(spark):
    f = _measured_once(fx.doc_lang(spark, SF001, 4))
    assert f.frame.is_cached and f.frame.storageLevel.useDisk and f.features == fx.doc_lang(spark, SF001).features
    f.frame.unpersist()
    spark.catalog.clearCache()
    for name in ("pipeline_roundtrip", "save_tuned"):
        source = inspect.getsource(QUERIES[name])
        assert "_measured_once(" in source and "f.frame.unpersist()" in source


# ---------------------------------------------------------------- files without a key

@pytest.fixture(scope="module")
def keyless(spark, tmp_path_factory):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    rows = li.select((F.col("l_quantity") * 10).cast("int").alias("y"), "l_linenumber",
                     F.col("l_quantity").cast("int").alias("q"))
    return rows, str(tmp_path_factory.mktemp("keyless"))


def test_split_of_a_file_survives_other_files_and_partitions(spark, keyless):
    rows, folder = keyless
    sides = []
    for k, layout in enumerate((rows.coalesce(1), rows.repartition(9), rows.orderBy(F.desc("q")))):
        path = write_delimited(layout, f"{folder}/{k}")
        f = file_rows(spark, path)
        assert f.key == [ROW_KEY] and f.features == ["l_linenumber", "q"] and f.target == "y"
        got = with_side(f.frame, f.key).collect()
        assert len(got) == 6000 == len({r[ROW_KEY] for r in got})
        sides.append({(r[ROW_KEY], r.side) for r in got})
    assert sides[0] == sides[1] == sides[2]
    assert 1000 < sum(s == "test" for _, s in sides[0]) < 1400


def test_train_from_file_both_tasks(spark, keyless):
    rows, folder = keyless
    path = write_delimited(rows.withColumn("c", F.when(F.col("q") > 25, "big").otherwise("small")),
                           f"{folder}/tasks")
    r = train_from_file(spark, path, ForestOptions(trees=5, depth=6, subset="all"), ignore=["c"])
    assert r.metrics.first().r2 > 0.9 and forest_stage(r.final).numFeatures == 2
    r.release()
    c = train_from_file(spark, path, ForestOptions(trees=5, depth=4), target="c", task="multiclass",
                        text_class=True, ignore=["y"], refit=False)
    assert c.metrics.first().accuracy > 0.95
    assert {x[0] for x in c.test.select("predicted_c").distinct().collect()} == {"big", "small"}
    c.release()
    g = train_from_file(spark, path, ForestOptions(trees=[1, 2], depth=3), ignore=["c"], folds=2, refit=False)
    assert g.fold_scores.count() == 4 and g.final is None
    g.release()


def test_external_file_is_read_with_the_training_types(spark, tmp_dir):
    for name, text in (("a", "y;x\n1;2\n2;4\n3;6\n"), ("b", "x;y\n4;2\n8;4\n"), ("c", "y\n1\n"), ("d", "y;x\n1;two\n")):
        with open(f"{tmp_dir}/{name}.csv", "w") as fh:
            fh.write(text)
    opts = ForestOptions(trees=2, depth=2, partitions=2)
    r = train_from_file(spark, f"{tmp_dir}/a.csv", opts, external_path=f"{tmp_dir}/b.csv")
    assert r.metrics.first().n == 2 and r.test.select("x").dtypes == [("x", "double")]
    with pytest.raises(ValueError):
        train_from_file(spark, f"{tmp_dir}/a.csv", opts, external_path=f"{tmp_dir}/c.csv")
    with pytest.raises(Exception):
        train_from_file(spark, f"{tmp_dir}/a.csv", opts, external_path=f"{tmp_dir}/d.csv").metrics.collect()
    with pytest.raises(Exception):
        file_rows(spark, f"{tmp_dir}/d.csv").frame.collect()
    assert file_rows(spark, f"{tmp_dir}/d.csv", tolerant=True).frame.first().x is None
    with pytest.raises(ValueError):
        file_rows(spark, f"{tmp_dir}/a.csv", target="z")


# ---------------------------------------------------------------- trees

def trees_of(model):
    return [t.toDebugString.split("\n", 1)[1] for t in forest_stage(model).trees]


def test_trees_do_not_depend_on_partitions(spark):
    f = fx.net_price(spark, SF001)
    want = None
    for layout in (f.frame.repartition(4), f.frame.repartition(8, "l_quantity"), f.frame.coalesce(1)):
        r = train(type(f)(layout, f.target, f.features, f.key, f.task),
                  ForestOptions(trees=3, depth=5), refit=False)
        got = trees_of(r.model)
        r.release()
        want = want or got
        assert got == want


SCRIPT = """
import json, sys
sys.path.insert(0, {root!r})
from grove.session import local_session
from grove.operators.forest import ForestOptions, forest_stage, train
from grove.plans import fixtures as fx
from grove.plans.queries import QUERIES, _measured_once
spark = local_session(cores={cores}, shuffle_partitions={cores})
spark.sparkContext.setLogLevel("OFF")
r = train(fx.net_price(spark, {sf!r}), ForestOptions(trees=3, depth=5), refit=False)
print(json.dumps([t.toDebugString.split(chr(10), 1)[1] for t in forest_stage(r.model).trees]))
"""


def test_trees_do_not_depend_on_cores():
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = []
    for cores in (2, 4):
        out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, cores=cores, sf=SF001)],
                             capture_output=True, text=True, timeout=300, check=True,
                             env={**os.environ, "GROVE_DRIVER_MEMORY": "2g"})
        got.append(json.loads(out.stdout.strip().splitlines()[-1]))
    assert got[0] == got[1] and len(got[0]) == 3


def test_no_rdd_in_the_library():
    import os
    import grove
    base = os.path.dirname(grove.__file__)
    for folder, _, names in os.walk(base):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert ".rdd" not in open(os.path.join(folder, n)).read(), n


def test_inferred_types_equal_sparks(spark, tmp_dir):
    cells = ["i;l;d;e;b;t;day;s;none", "1;3000000000;1.5;1e3;true;2024-01-02 03:04:05;2024-01-02;x;",
             "-2;4;2;;False;2024-05-06 00:00:00;2023-12-31;7;", ";99999999999;NaN;2;;;;1.0;"]
    for name, lines in (("plain", cells), ("copies", [*cells[:2], cells[0], *cells[2:], cells[0]])):
        with open(f"{tmp_dir}/{name}.csv", "w") as fh:
            fh.write("\n".join(lines) + "\n")
    want = read_table(spark, f"{tmp_dir}/plain.csv")
    got = read_table(spark, f"{tmp_dir}/copies.csv", repeated_header=True)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
