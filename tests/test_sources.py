import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SF01
from grove.operators.features import assemble
from grove.operators.score import dataset_profile
from grove.sources.bracketed import LINE_KEY, keyed_lines, parse_bracketed
from grove.sources.delimited import (cast_target, class_label_scan, positional_label,
                                     read_table, write_delimited)
from grove.sources.tables import spread
from grove.plans import fixtures as fx


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_net_price_round_trip(spark, tmp_dir):
    frame = fx.net_price(spark, SF01).frame.select("net_price", "l_extendedprice", "l_discount", "l_quantity")
    path = write_delimited(frame, f"{tmp_dir}/net")
    back, feats = positional_label(read_table(spark, path))
    assert feats == ["l_extendedprice", "l_discount", "l_quantity"]
    assert back.count() == 60000
    assert back.exceptAll(frame.withColumnRenamed("net_price", "label")).count() == 0


def test_repeated_header_removed(spark, tmp_dir):
    p = _write(f"{tmp_dir}/rh/a.csv", "y;a;b\n1;2;3\ny;a;b\n4;5;6\ny;a;b\n")
    df = read_table(spark, p, repeated_header=True)
    assert dict(df.dtypes) == {"y": "int", "a": "int", "b": "int"}
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2, 3), (4, 5, 6)]


def test_null_feature_policies(spark, tmp_dir):
    p = _write(f"{tmp_dir}/nulls/a.csv", "y;a;b\n1;;3\n4;5;6\n")
    df = read_table(spark, p)
    assert df.where(F.col("a").isNull()).count() == 1
    with pytest.raises(Exception):
        assemble(df, ["a", "b"], handle_invalid="error").collect()
    assert assemble(df, ["a", "b"], handle_invalid="skip").count() == 1
    kept = assemble(df, ["a", "b"], handle_invalid="keep").orderBy("y").first().features
    assert kept[0] != kept[0]  # NaN


def test_bad_number_ansi_or_tolerant(spark, tmp_dir):
    p = _write(f"{tmp_dir}/bad/a.csv", "y;a\nx1;2\n3;4\n")
    raw = read_table(spark, p, infer=False)
    with pytest.raises(PySparkException):
        cast_target(raw, "y").collect()
    vals = sorted((r.y is None, r.y) for r in cast_target(raw, "y", tolerant=True).collect())
    assert vals == [(False, 3.0), (True, None)]


def test_bracketed(spark, tmp_dir):
    p = _write(f"{tmp_dir}/br/a.txt", "[1.5;2;3]\n[4;5;6]\n\n")
    df = parse_bracketed(spark, p)
    rows = sorted(r["values"] for r in df.collect())
    assert rows == [[1.5, 2.0, 3.0], [4.0, 5.0, 6.0]]
    assert sorted(r.target for r in df.collect()) == [1.5, 4.0]
    assert df.first().features.size == 3


def test_class_label_checked(spark, tmp_dir):
    ok = _write(f"{tmp_dir}/cl/ok.csv", "c;a\n0;1\n2;3\n")
    out, feats = class_label_scan(read_table(spark, ok), n_classes=3)
    assert sorted(r.label for r in out.collect()) == [0.0, 2.0] and feats == ["a"]
    bad = _write(f"{tmp_dir}/cl2/bad.csv", "c;a\n0;1\n5;3\n")
    with pytest.raises(Exception):
        class_label_scan(read_table(spark, bad), n_classes=3)[0].collect()


def test_declared_schema_skips_inference(spark, tmp_dir):
    p = _write(f"{tmp_dir}/sc/a.csv", "y;a\n1;2\n")
    df = read_table(spark, p, schema="y double, a double")
    assert df.dtypes == [("y", "double"), ("a", "double")]


def test_infer_types_narrowest(spark, tmp_dir):
    from grove.sources.delimited import infer_types
    p = _write(f"{tmp_dir}/it/a.csv", "i;l;d;s;n\n1;3000000000;1.5;x;\n-2;4;2;y;\n")
    raw = read_table(spark, p, infer=False)
    got = {f.name: f.dataType.simpleString() for f in infer_types(raw).fields}
    assert got == {"i": "int", "l": "bigint", "d": "double", "s": "string", "n": "string"}


def test_spread_follows_the_caller_alone(spark):
    narrow = spark.range(0, 1000, numPartitions=1)
    assert spread(narrow, None) is narrow
    for n in (3, 8):
        parts = spread(narrow, n).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
        assert len(parts) == n and sum(r.n for r in parts) == 1000


def test_features_are_cast_and_bad_text_fails(spark, tmp_dir):
    p = _write(f"{tmp_dir}/ft/a.csv", "c;a;b\n0;1;x\n2;3;4\n")
    raw = read_table(spark, p, infer=False)
    with pytest.raises(PySparkException):
        positional_label(raw)[0].collect()
    with pytest.raises(PySparkException):
        class_label_scan(raw)[0].collect()
    out, feats = positional_label(raw, tolerant=True)
    assert out.dtypes == [("label", "double"), ("a", "double"), ("b", "double")] and feats == ["a", "b"]
    assert sorted(map(tuple, out.fillna(-1).collect())) == [(0.0, 1.0, -1.0), (2.0, 3.0, 4.0)]


def test_lines_have_keys_that_join_back(spark, tmp_dir):
    for k in range(3):
        _write(f"{tmp_dir}/keys/{k}.txt", "".join(f"[{k};{i};{i / 4}]\n" for i in range(4000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    for size in ("16k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        lines = keyed_lines(spark, f"{tmp_dir}/keys").where("value <> ''")
        rows = lines.collect()
        assert len({(r.file, r.block, r.line) for r in rows}) == len(rows) == 12000
        if size == "16k":
            assert len({(r.file, r.block) for r in rows}) > 6
        for r in rows:
            if r.block == 0:
                assert r.value.split(";")[1] == str(r.line)
        values = parse_bracketed(spark, f"{tmp_dir}/keys", keyed=True)
        joined = lines.join(values, LINE_KEY)
        assert joined.count() == 12000
        want = F.concat(F.lit("["), F.concat_ws(";", F.col("values")[0].cast("int").cast("string"),
                                                F.col("values")[1].cast("int").cast("string")))
        assert joined.where(~F.col("value").startswith(want)).count() == 0
        seen.append({r.value for r in rows})
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1]


def test_profile_keeps_each_columns_kind(spark):
    df = spark.sql("""
      SELECT * FROM VALUES
        (9007199254740993L, CAST(1.5 AS FLOAT), -0.0D, 'b', DATE'2024-02-03', TIMESTAMP_NTZ'2024-01-01 00:00:00.000001',
         true, CAST(12.50 AS DECIMAL(9, 2)), array(1)),
        (-9007199254740993L, NULL, 0.0D, 'a', NULL, NULL, false, NULL, NULL)
      AS t(l, f, d, s, day, t, b, dec, arr)""")
    got = {r.column_name: r for r in dataset_profile(df).collect()}
    assert list(got) == df.columns and all(r.n_rows == 2 for r in got.values())
    assert (got["l"].min_long, got["l"].max_long, got["l"].min_double) == (-9007199254740993, 9007199254740993, None)
    assert (got["f"].max_double, got["f"].n_nulls) == (1.5, 1)
    assert str(got["d"].min_double) == "0.0"
    assert (got["s"].min_text, got["s"].max_text, got["s"].min_long) == ("a", "b", None)
    assert got["day"].min_text == "2024-02-03" and got["t"].max_text == "2024-01-01 00:00:00.000001"
    assert (got["b"].min_text, got["b"].max_text) == ("false", "true") and got["dec"].max_double == 12.5
    assert (got["arr"].n_nulls, got["arr"].min_text) == (1, None)
    empty = dataset_profile(df.limit(0)).collect()
    assert len(empty) == 9 and all(r.n_rows == 0 and r.min_long is None for r in empty)
