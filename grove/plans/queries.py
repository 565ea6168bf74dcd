"""Registered queries: one callable (spark, data_dir) -> DataFrame per operator.

Each reads whole driver tables (or files Spark writes from them into the
shared scratch folder) so its work grows with the data.  Queries whose
result is exact have a DuckDB twin in ``grove.plans.oracle``; model queries
(forests depend on the random seed and layout) are checked by their own tests.
"""

from __future__ import annotations

from collections.abc import Callable

from dataclasses import replace

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.operators import features as feat
from grove.operators import metrics
from grove.operators.dataset import Fixture
from grove.operators.forest import (ForestOptions, TrainResult, evaluate, forest_stage,
                                    model_summary, prepare, train, tune)
from grove.operators.from_file import file_rows, train_from_file
from grove.operators.identity import ROW_KEY
from grove.operators.score import (TIME_FORMAT, dataset_profile, preview, sample_predictions,
                                   score)
from grove.operators.split import holdout_split, with_folds, with_side
from grove.plans import fixtures as fx
from grove.session import scratch_path
from grove.sinks.store import (export_split, load_model, load_pipeline, load_tuned, save_model,
                               save_pipeline, save_tuned)
from grove.sources.bracketed import LINE_KEY, keyed_lines, parse_bracketed
from grove.sources.delimited import (cast_target, class_label_scan, positional_label,
                                     read_table, same_columns, write_delimited)
from grove.sources.tables import table
from grove.streaming.score_stream import score_stream

Query = Callable[[SparkSession, str], DataFrame]

NET_COLUMNS = ["net_price", "l_extendedprice", "l_discount", "l_quantity"]
NET_KEY = ["l_orderkey", "l_linenumber"]
TRAIN_RATIO = 0.8
SMALL = ForestOptions(trees=20, depth=6)
# net_price has three features; each split may use all of them.
NET = ForestOptions(trees=20, depth=6, subset="all")
# One split, found over all rows and all thresholds: SQL can search the same.
STUMP = ForestOptions(trees=1, depth=1, subset="all", bins=64, bootstrap=False)


def _tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: to how many tasks a table that comes in
    one split is dealt before its texts are measured."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _net_price_csv(spark: SparkSession, data_dir: str, name: str = "net_price") -> str:
    """The reference's file shape: ``;``, header, label first, numeric features."""
    frame = fx.net_price(spark, data_dir).frame.select(*NET_COLUMNS)
    return write_delimited(frame, scratch_path(spark, name))


# ------------------------------------------------------------------ sources

def q_scan_delimited(spark, d):
    """A1: scan with header and inferred types."""
    return read_table(spark, _net_price_csv(spark, d))


def q_cast_target(spark, d):
    """A2: text scan, target cast to double (tolerant)."""
    raw = read_table(spark, _net_price_csv(spark, d), infer=False)
    return cast_target(raw, "net_price", tolerant=True).select("net_price")


def q_positional_label(spark, d):
    """A3: column 0 is the label."""
    out, _ = positional_label(read_table(spark, _net_price_csv(spark, d)))
    return out


def q_class_label_scan(spark, d):
    """A4: class label first, checked to be 0..k-1."""
    li = table(spark, d, "lineitem")
    frame = li.select((F.col("l_linenumber") - 1).alias("line_class"),
                      "l_quantity", "l_discount", "l_tax")
    path = write_delimited(frame, scratch_path(spark, "class_label"))
    out, _ = class_label_scan(read_table(spark, path), n_classes=7)
    return out


def q_drop_repeated_header(spark, d):
    """A5: header copies inside the data are all removed."""
    frame = fx.net_price(spark, d).frame
    as_text = [F.col(c).cast("string").alias(c) for c in NET_COLUMNS]
    header = [F.lit(c).alias(c) for c in NET_COLUMNS]
    # Every first line of an order is followed by a copy of the header.
    rows = F.when(F.col("l_linenumber") == 1,
                  F.array(F.struct(*as_text), F.struct(*header))).otherwise(F.array(F.struct(*as_text)))
    lines = frame.select(F.explode(rows).alias("r")).select("r.*")
    path = write_delimited(lines, scratch_path(spark, "repeated_header"))
    return read_table(spark, path, repeated_header=True)


def q_external_validation(spark, d):
    """Training file = all of it, test = a second file with the same columns."""
    frame = fx.net_price(spark, d).frame
    train_df, test_df = holdout_split(frame, "l_orderkey", TRAIN_RATIO)
    train_path = write_delimited(train_df.select(*NET_COLUMNS), scratch_path(spark, "ext_train"))
    test_path = write_delimited(test_df.select(*NET_COLUMNS), scratch_path(spark, "ext_test"))
    training = read_table(spark, train_path)
    external = read_table(spark, test_path)
    same_columns(training, external)
    return (training.withColumn("side", F.lit("train"))
            .unionByName(external.withColumn("side", F.lit("test"))))


def q_parse_bracketed(spark, d):
    """``[a;b;c]`` lines without header."""
    li = table(spark, d, "lineitem")
    line = F.concat(F.lit("["), F.concat_ws(";", *[F.col(c).cast("string") for c in
                                                  ("l_extendedprice", "l_discount", "l_quantity")]),
                    F.lit("]"))
    path = scratch_path(spark, "bracketed")
    li.select(line.alias("value")).write.mode("overwrite").text(path)
    parsed = parse_bracketed(spark, path)
    return parsed.select("target", F.col("values")[1].alias("v1"), F.col("values")[2].alias("v2"),
                         F.size("values").alias("n_values"))


# ------------------------------------------------------------------ sinks

def q_export_split(spark, d):
    """B1: distributed CSV export of both sides, read back and summed."""
    frame = fx.net_price(spark, d).frame
    train_df, test_df = holdout_split(frame, "l_orderkey", TRAIN_RATIO)
    paths = export_split(train_df, test_df, scratch_path(spark, "export"), NET_COLUMNS)
    sides = [read_table(spark, p).withColumn("side", F.lit("test" if s == "test" else "train"))
             for s, p in paths.items()]
    back = sides[0].unionByName(sides[1])
    return back.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.round(F.sum("net_price"), 2).alias("sum_label"))


# ------------------------------------------------------------------ split

def q_holdout_split(spark, d):
    """Side of every order, ratio 0.8."""
    return with_side(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", TRAIN_RATIO)


def q_fold_assignment(spark, d):
    """Fold (k = 3) of every training order."""
    train_df, _ = holdout_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey",
                                TRAIN_RATIO)
    return with_folds(train_df, "o_orderkey", 3)


# ------------------------------------------------------------------ projection

def q_assemble_features(spark, d):
    """Features as one vector, spread back to check its order."""
    f = fx.net_price(spark, d)
    v = feat.assemble(f.frame, f.features)
    arr = vector_to_array(F.col("features"))
    return v.select("l_orderkey", "l_linenumber", "net_price",
                    *[arr[i].alias(f"f{i}") for i in range(len(f.features))])


def q_preview(spark, d):
    """First rows by key."""
    o = table(spark, d, "orders")
    return preview(o.withColumn("o_orderdate", F.date_format("o_orderdate", TIME_FORMAT)),
                   ["o_orderkey"], 5)


def q_dataset_profile(spark, d):
    """Rows, nulls, least and greatest value of every column of lineitem."""
    out = dataset_profile(table(spark, d, "lineitem"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("min_long", "max_long")})


# ------------------------------------------------------------------ features

def q_index_labels(spark, d):
    """Language labels by frequency, ties alphabetical."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    out, _ = feat.index_labels(docs, "lang")
    return out


def q_class_weights(spark, d):
    """By-class weights n / (k * n_class)."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    w = feat.with_class_weights(docs, "lang", "weight")
    return w.select("doc_id", "lang", F.round("weight", 6).alias("weight"))


def q_index_categories(spark, d):
    """Which features VectorIndexer treats as categorical (max 16 values)."""
    li = table(spark, d, "lineitem")
    _, info = feat.index_categories(li, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], 16)
    return info


def _binned_shares(spark, d) -> Fixture:
    """Language by letter shares in whole percent."""
    f = fx.doc_lang(spark, d, _tasks(spark))
    return replace(f, frame=f.frame.select(
        "doc_id", "lang", *[F.round(F.col(c) * 100).alias(c) for c in f.features]))


def q_select_features(spark, d):
    """Top 8 of 16 letter shares for the language label (chi-squared)."""
    f = _binned_shares(spark, d)
    _, info = feat.select_features(f.frame, f.features, f.target, top=8)
    return info.withColumn("statistic", F.round("statistic", 4))


def q_train_selected(spark, d):
    """M19 in training: the forest learns from the features that the test keeps, with categories."""
    f = _binned_shares(spark, d)
    r = train(f, replace(SMALL, top_features=8, max_categories=8), refit=False)
    return _facts(spark, r, n_features=forest_stage(r.model).numFeatures,
                  good=_at_least(r, "accuracy", 0.9))


# ------------------------------------------------------------------ metrics

def q_confusion_matrix(spark, d):
    return metrics.confusion_matrix(fx.flag_pairs(spark, d), "actual", "predicted")


def q_cohen_kappa(spark, d):
    return metrics.rounded(metrics.cohen_kappa(fx.flag_pairs(spark, d), "actual", "predicted"), 6)


def q_balanced_accuracy(spark, d):
    return metrics.rounded(
        metrics.balanced_accuracy(fx.flag_pairs(spark, d), "actual", "predicted"), 6)


def q_accuracy(spark, d):
    return metrics.rounded(metrics.accuracy(fx.flag_pairs(spark, d), "actual", "predicted"), 6)


def q_regression_metrics(spark, d):
    return metrics.rounded(metrics.regression_metrics(fx.price_pairs(spark, d)), 4, r2=6)


def q_area_under_roc(spark, d):
    return metrics.rounded(metrics.auc_frame(fx.score_pairs(spark, d)), 6)


def q_roc_points(spark, d):
    """Rates, precision, kappa and balanced accuracy at every threshold."""
    return metrics.rounded(metrics.roc_points(fx.score_pairs(spark, d)), 6)


def q_binary_report(spark, d):
    pairs = fx.score_pairs(spark, d).withColumn(
        "prediction", F.when(F.col("score") >= 48, 1.0).otherwise(0.0))
    return metrics.rounded(metrics.binary_report(pairs, "label", "prediction", score="score"), 6)


def q_classification_report(spark, d):
    """Kappa / BA / accuracy on the test side only."""
    _, test = holdout_split(fx.flag_pairs(spark, d), "l_orderkey", TRAIN_RATIO)
    return metrics.rounded(metrics.agreement(test, "actual", "predicted"), 6)


# ------------------------------------------------------------------ files to models

FILE_RATIO = 0.8
FILE_RUN = ForestOptions(trees=10, depth=8, subset="all")


def _file_rows(spark, d, *label) -> str:
    """A file without a key: whole numbers, so that equal rows repeat."""
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    frame = li.select(*label, q.alias("q"), "l_linenumber", (F.col("l_suppkey") % 5).alias("s"))
    return write_delimited(frame, scratch_path(spark, "keyless"))


def _file_number(spark, d) -> str:
    return _file_rows(spark, d, (F.col("l_quantity").cast("int") * 100
                                 + F.col("l_linenumber") * 7).alias("y"))


def q_file_row_identity(spark, d):
    """Sides of the split of a file that has no key, by the identity of its rows."""
    f = file_rows(spark, _file_number(spark, d))
    sides = with_side(f.frame, ROW_KEY, FILE_RATIO)
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.countDistinct(ROW_KEY).alias("n_keys"),
                                     F.sum("y").cast("long").alias("label_sum"))


def q_train_from_file(spark, d):
    """Regression from a file in one call."""
    r = train_from_file(spark, _file_number(spark, d), FILE_RUN)
    return _facts(spark, r, n_features=forest_stage(r.final).numFeatures,
                  good=_at_least(r, "r2", 0.9))


def q_train_from_file_classes(spark, d):
    """A4, M2: a text class from a file in one call, classes decoded."""
    q = F.col("l_quantity")
    label = F.when(q < 15, "low").when(q < 33, "mid").otherwise("high").alias("size")
    path = _file_rows(spark, d, label)
    r = train_from_file(spark, path, FILE_RUN, task="multiclass", text_class=True, refit=False)
    return _facts(spark, r, n_classes=r.test.select("predicted_size").distinct().count(),
                  good=_at_least(r, "accuracy", 0.9))


def q_train_external(spark, d):
    """All rows of one file train, a second file judges."""
    frame = fx.net_price(spark, d).frame
    sides = holdout_split(frame, "l_orderkey", TRAIN_RATIO)
    paths = [write_delimited(x.select(*NET_COLUMNS), scratch_path(spark, "external")) for x in sides]
    r = train_from_file(spark, paths[0], NET, external_path=paths[1], refit=False)
    return _facts(spark, r, good=_at_least(r, "r2", 0.95))


# ------------------------------------------------------------------ models

def _facts(spark, r: TrainResult, **facts) -> DataFrame:
    """One row: rows read and judged, trees of the model, and the given facts; then the
    run's rows are let go."""
    seen = r.report.frame(spark).first()
    row = {"n_used": seen.n_used, "n": int(r.test.count()),
           "trees": int(forest_stage(r.model).getNumTrees), **facts}
    r.release()
    kinds = {bool: "boolean", int: "bigint", str: "string", float: "double"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(
        f"{k} {kinds[type(v)]}" for k, v in row.items()))


def _measured_once(f: Fixture) -> Fixture:
    """The rows of ``f`` kept, for queries that fit or score them again outside the run: the
    features of a text are measured once.  Let go by ``f.frame.unpersist()``."""
    return replace(f, frame=f.frame.persist(StorageLevel.MEMORY_AND_DISK))


def _at_least(r: TrainResult, figure: str, floor: float) -> bool:
    value = r.metrics.first()[figure]
    return bool(value is not None and value >= floor)


def _settled(df: DataFrame, r: TrainResult) -> DataFrame:
    """The rows of ``df`` in the shared folder, and the training rows let go."""
    path = scratch_path(df.sparkSession, "scored")
    df.write.parquet(path)
    r.release()
    return df.sparkSession.read.parquet(path)


def q_train_regression(spark, d):
    """M1/M9: fixed-size regression forest, test figures."""
    r = train(fx.net_price(spark, d), NET)
    return _facts(spark, r, fixture="net_price", good=_at_least(r, "r2", 0.95))


def q_train_binary(spark, d):
    """M2: binary forest on document quality (positive class 1)."""
    r = train(fx.doc_quality(spark, d, _tasks(spark)), ForestOptions(trees=50, depth=6))
    return _facts(spark, r, fixture="doc_quality", good=_at_least(r, "auc", 0.9))


def q_train_multiclass(spark, d):
    """M2: multiclass forest on document language (string labels indexed)."""
    r = train(fx.doc_lang(spark, d, _tasks(spark)), SMALL)
    return _facts(spark, r, fixture="doc_lang", good=_at_least(r, "accuracy", 0.9))


def q_train_vector(spark, d):
    """Multiclass forest on a ready 64-wide array column."""
    r = train(fx.embedding_label(spark, d), ForestOptions(trees=10, depth=5))
    rf = forest_stage(r.model)
    return _facts(spark, r, n_classes=rf.numClasses, n_features=rf.numFeatures)


def q_train_many_classes(spark, d):
    """M2: 150 numeric classes, their number from the caller."""
    li = table(spark, d, "lineitem")
    group = F.col("l_partkey") % 150
    f = Fixture(li.select("l_orderkey", group.cast("double").alias("part_group"),
                          (group % 15).cast("double").alias("low"),
                          F.floor(group / 15).cast("double").alias("high")),
                "part_group", ["low", "high"], ["l_orderkey"], "multiclass")
    r = train(f, ForestOptions(trees=3, depth=12, subset="all", n_classes=150), refit=False)
    return _facts(spark, r, n_classes=forest_stage(r.model).numClasses,
                  n_actual=r.test.select("label").distinct().count(),
                  good=_at_least(r, "accuracy", 0.9))


def q_train_unseen_class(spark, d):
    """M2: a class that only the test side has is judged as an error, not a failure."""
    f = fx.doc_lang(spark, d, _tasks(spark))
    side = with_side(f.frame, f.key, TRAIN_RATIO)
    lang = F.when((F.col("side") == "test") & (F.col("doc_id") % 5 == 0), "rare").otherwise(F.col("lang"))
    r = train(replace(f, frame=side.withColumn("lang", lang).drop("side")), SMALL, refit=False)
    rare = r.test.where("lang = 'rare'").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("hit")).first()
    return _facts(spark, r, n_rare=rare.n, n_rare_hit=rare.hit,
                  good=_at_least(r, "accuracy", 0.9 * (1 - rare.n / max(1, r.test.count()))))


def q_train_weighted(spark, d):
    """M15 applied: by-class weights in the forest."""
    r = train(fx.doc_lang(spark, d, _tasks(spark)),
              ForestOptions(trees=10, depth=5, weighting="by_class"))
    return _facts(spark, r, good=_at_least(r, "ba", 0.9))


def q_skip_report(spark, d):
    """Rows read, unusable by column, dropped and used, counted inside the run."""
    f = fx.net_price(spark, d)
    holed = f.frame.withColumns({
        "l_quantity": F.when(F.col("l_linenumber") != 3, F.col("l_quantity")),
        "l_discount": F.when(F.col("l_quantity") > 5, F.col("l_discount")),
        "net_price": F.when(F.col("l_linenumber") < 7, F.col("net_price"))})
    r = train(replace(f, frame=holed), replace(STUMP, handle_invalid="skip"), refit=False)
    r.release()
    return r.report.frame(spark)


def q_tune_regression(spark, d):
    """Grid over tree counts, 3 keyed folds, rmse."""
    r = tune(fx.net_price(spark, d), ForestOptions(trees=[5, 15], depth=5, subset="all"), folds=3)
    best = r.scores.where("chosen").first()
    return _facts(spark, r, n_settings=r.scores.count(), good=_at_least(r, "r2", 0.9)).select(
        "n_used", "n", "n_settings", "good",
        (F.lit(best.trees) == F.col("trees")).alias("refit_as_chosen"))


def q_tune_classification(spark, d):
    """Grid classification, accuracy, refit on all rows."""
    r = tune(fx.doc_lang(spark, d, _tasks(spark)), ForestOptions(trees=[5, 15], depth=5), folds=3)
    best = r.scores.where("chosen").first()
    return _facts(spark, r, n_settings=r.scores.count(), good=_at_least(r, "accuracy", 0.9)).select(
        "n_used", "n", "n_settings", "good",
        (F.lit(best.trees) == F.col("trees")).alias("refit_as_chosen"))


def _stump_fixture(spark, d) -> Fixture:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                            "l_quantity", "l_discount", "l_tax")
    y = F.col("l_quantity") * 10 + F.col("l_discount") * 1000 + F.when(F.col("l_quantity") > 30, 400.0).otherwise(0.0)
    return Fixture(li.withColumn("y", y), "y", ["l_quantity", "l_discount", "l_tax"],
                   ["l_orderkey"], "regression")


def _root(spark, model) -> tuple:
    """(feature, threshold, left, right): the one split of a stump, from its node table."""
    path = scratch_path(spark, "stump")
    forest_stage(model).write().save(path)
    nodes = {r.nodeData.id: r.nodeData for r in spark.read.parquet(f"{path}/data").collect()}
    top = nodes[0]
    return (top.split.featureIndex, top.split.leftCategoriesOrThreshold[0],
            nodes[top.leftChild].prediction, nodes[top.rightChild].prediction)


def q_stump_regression(spark, d):
    """One split over all rows and thresholds: where it is, and its test figures."""
    r = train(_stump_fixture(spark, d), STUMP, refit=False)
    feature, threshold, left, right = _root(spark, r.model)
    m = r.metrics.first()
    r.release()
    return spark.createDataFrame(
        [(feature, threshold, left, right, m.rmse, m.n)],
        "feature int, threshold double, below double, above double, rmse double, n bigint"
    ).select("feature", F.round("threshold", 6).alias("threshold"), F.round("below", 4).alias("below"),
             F.round("above", 4).alias("above"), F.round("rmse", 4).alias("rmse"), "n")


def q_cv_fold_scores(spark, d):
    """M6-M8: the figure of every setting and fold, of stumps that SQL can search too."""
    r = tune(_stump_fixture(spark, d), replace(STUMP, trees=[1, 2]), folds=3, refit=False)
    r.release()
    return r.fold_scores.select("trees", "fold", "metric", F.round("value", 4).alias("value"), "n_rows")


def q_cv_scores(spark, d):
    """M7: mean and standard deviation of the metric per grid point."""
    r = tune(fx.doc_quality(spark, d, _tasks(spark)), ForestOptions(trees=[5, 20], depth=5),
             folds=3, refit=False)
    r.release()
    best = r.scores.agg(F.max("mean")).first()[0]
    return r.scores.select("trees", "bins", "metric",
                           ((F.col("mean") > 0.5) & (F.col("mean") <= 1) & (F.col("std") >= 0)).alias("valid"),
                           (~F.col("chosen") | (F.col("mean") == best)).alias("best_chosen"))


def q_tune_bins(spark, d):
    """Grid over maxBins."""
    r = tune(fx.net_price(spark, d), ForestOptions(trees=10, depth=5, bins=[16, 32]),
             folds=3, refit=False)
    r.release()
    best = r.scores.agg(F.min("mean")).first()[0]
    return r.scores.select("trees", "bins", "metric",
                           ((F.col("mean") > 0) & (F.col("std") >= 0)).alias("valid"),
                           (~F.col("chosen") | (F.col("mean") == best)).alias("best_chosen"))


def _summary(spark, r: TrainResult, model, depth: int) -> DataFrame:
    """What is certain of a forest: every tree is binary, so it has an odd number of nodes."""
    out = model_summary(model, spark).select(
        "trees", "n_features", "kind", (F.col("max_depth").between(1, depth)).alias("depth_kept"),
        ((F.col("nodes") - F.col("trees")) % 2 == 0).alias("binary"))
    r.release()
    return out


def q_refit_full(spark, d):
    """The model refit on all rows, summarised from its own fields."""
    r = train(fx.net_price(spark, d), NET)
    return _summary(spark, r, r.final, NET.depth)


def q_model_summary(spark, d):
    """Trees / nodes / depth of the model fitted on the training side."""
    r = train(fx.doc_lang(spark, d, _tasks(spark)), SMALL, refit=False)
    return _summary(spark, r, r.model, SMALL.depth)


# ------------------------------------------------------------------ scoring

def _priced(scored: DataFrame, r: TrainResult, *columns: str) -> DataFrame:
    """Keys and whether the predicted price is one: means of prices are positive."""
    return _settled(scored.select(*columns, (F.col("prediction") > 0).alias("priced")), r)


def q_score_batch(spark, d):
    """Save, load, score the test side with its keys."""
    f = fx.net_price(spark, d)
    r = train(f, NET, refit=False)
    loaded = load_model(save_model(r.model, scratch_path(spark, "model_net_price")))
    _, test = holdout_split(prepare(f), f.key, TRAIN_RATIO)
    return _priced(score(loaded, test, keep=NET_KEY), r, *NET_KEY)


def q_score_probability(spark, d):
    """Probability of the predicted class and of the positive class."""
    f = fx.doc_quality(spark, d, _tasks(spark))
    r = train(f, ForestOptions(trees=20, depth=5), refit=False)
    _, test = holdout_split(prepare(f), f.key, TRAIN_RATIO)
    p = F.col("p_positive")
    sound = (p.between(0, 1) & (F.abs(F.col("confidence") - F.greatest(p, 1 - p)) < 1e-9)
             & (F.col("prediction") == F.when(p > 0.5, 1.0).otherwise(0.0)))
    return _settled(score(r.model, test, keep=["doc_id"]).select("doc_id", sound.alias("sound")), r)


def q_sample_predictions(spark, d):
    """First five scored test rows with their label and features."""
    f = fx.net_price(spark, d)
    r = train(f, NET, refit=False)
    _, test = holdout_split(prepare(f), f.key, TRAIN_RATIO)
    order = [*NET_KEY, "l_extendedprice", "l_discount"]
    rows = sample_predictions(r.model, test, "label", order, 5)
    return _priced(rows.withColumns({f"f{i}": F.col("features")[i] for i in range(3)}), r,
                   *NET_KEY, "actual", "f0", "f1", "f2")


def q_model_roundtrip(spark, d):
    """Predictions of the saved-and-loaded model equal the original's."""
    f = fx.doc_lang(spark, d, _tasks(spark))
    r = train(f, SMALL, refit=False)
    loaded = load_model(save_model(r.model, scratch_path(spark, "model_doc_lang")))
    before = r.test.select("doc_id", F.col("prediction").alias("before"), *f.features, "lang")
    both = loaded.transform(before)
    return _settled(both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("before") == F.col("prediction"), 1).otherwise(0))
        .cast("long").alias("n_equal")), r)


def q_save_tuned(spark, d):
    """A tuned model and its pipeline, saved, loaded, retrained on rows with one class more."""
    f = _measured_once(fx.doc_lang(spark, d, _tasks(spark)))
    r = tune(f, ForestOptions(trees=[2, 4], depth=6, subset="all"), folds=2)
    model, pipeline = load_tuned(save_tuned(r, scratch_path(spark, "tuned")))
    known = model.transform(f.frame).where("predicted_lang = 'none'").count()
    more = f.frame.unionByName(f.frame.where("lang = 'en'").withColumns(
        {"lang": F.lit("none"), f.features[0]: F.lit(5.0)}))
    again = pipeline.fit(more).transform(more.where("lang = 'none'"))
    counts = again.agg(F.count(F.lit(1)).alias("n"),
                       F.count_if(F.col("predicted_lang") == "none").alias("hit")).first()
    out = _facts(spark, r, n_before=known, n_new=counts.n, n_new_hit=counts.hit).drop("trees")
    f.frame.unpersist()
    return out


def q_stream_score(spark, d):
    """Scoring as a file stream: parquet files in, scored parquet out."""
    f = fx.net_price(spark, d)
    r = train(f, NET, refit=False)
    src = scratch_path(spark, "stream_in")
    _, test = holdout_split(f.frame, f.key, TRAIN_RATIO)
    test.write.mode("overwrite").parquet(src)
    sink, ckpt = scratch_path(spark, "stream_out"), scratch_path(spark, "stream_ckpt")
    q = score_stream(spark, r.model, src, test.schema, sink, ckpt, keep=NET_KEY)
    q.awaitTermination()
    return _priced(spark.read.parquet(sink), r, *NET_KEY)


def q_wide_regression(spark, d):
    """The reference's timed shape: documents x 512 hashed token counts,
    50 trees, depth 30, fixed path, with refit on all rows."""
    f = fx.wide_docs(spark, d, _tasks(spark))
    r = train(f, ForestOptions(trees=50, depth=30, partitions=8))
    return _facts(spark, r, n_features=forest_stage(r.final).numFeatures,
                  good=_at_least(r, "r2", 0.5))


def q_wide_tune_regression(spark, d):
    """The reference's other timed shape: a grid of 50 and 1 trees, depth 30, 3 folds, one refit."""
    f = fx.wide_docs(spark, d, _tasks(spark))
    r = tune(f, ForestOptions(trees=[50, 1], depth=30, partitions=8), folds=3)
    best = r.scores.where("chosen").first()
    return _facts(spark, r, n_settings=r.scores.count(), good=_at_least(r, "r2", 0.3)).select(
        "n_used", "n", "n_settings", "good", (F.lit(best.trees) == F.col("trees")).alias("refit_as_chosen"))


def q_pipeline_roundtrip(spark, d):
    """The unfitted pipeline saved beside the model, loaded, refit."""
    f = _measured_once(fx.doc_lang(spark, d, _tasks(spark)))
    train_df, test_df = holdout_split(f.frame, f.key, TRAIN_RATIO)
    r = train(f, SMALL, refit=False)
    loaded = load_pipeline(save_pipeline(r.pipeline, scratch_path(spark, "pipeline_doc_lang")))
    figures = evaluate(loaded.fit(train_df).transform(test_df), f.task).first()
    out = _facts(spark, r, n_judged=figures.n, good=bool(figures.accuracy >= 0.9))
    f.frame.unpersist()
    return out


def q_train_from_vector(spark, d):
    """The reference's six-value option vector, min rows per node applied."""
    opts = ForestOptions.from_vector(["5", "6", "Entropy", "Uniform", "20", "Sqrt"])
    r = train(fx.doc_lang(spark, d, _tasks(spark)), opts, refit=False)
    rf = forest_stage(r.model)
    return _facts(spark, r, min_rows=rf.getOrDefault("minInstancesPerNode"),
                  subset=rf.getOrDefault("featureSubsetStrategy"), impurity=rf.getImpurity(),
                  good=_at_least(r, "accuracy", 0.9))


def q_score_delimited(spark, d):
    """R2 (scorer, frame path): a header CSV with the training columns minus
    the response, scored by a loaded pipeline."""
    f = fx.net_price(spark, d)
    r = train(f, NET, refit=False)
    loaded = load_model(save_model(r.model, scratch_path(spark, "model_scoring")))
    _, test = holdout_split(f.frame, f.key, TRAIN_RATIO)
    path = write_delimited(test.select(*NET_KEY, *f.features), scratch_path(spark, "to_score"))
    rows = read_table(spark, path, schema="l_orderkey bigint, l_linenumber int, l_extendedprice double, "
                                          "l_discount double, l_quantity double")
    return _priced(score(loaded, rows, keep=NET_KEY), r, *NET_KEY)


def q_score_delimited_classes(spark, d):
    """A classifier scores a header CSV without the response: decoded class, probability."""
    f = fx.doc_lang(spark, d, _tasks(spark))
    r = train(f, SMALL, refit=False)
    loaded = load_model(save_model(r.model, scratch_path(spark, "model_classes")))
    path = write_delimited(f.frame.select("doc_id", *f.features), scratch_path(spark, "classes"))
    rows = read_table(spark, path).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    scored = score(loaded, rows, keep=["doc_id"])
    known = F.col("predicted_lang").isin("en", "fr", "de", "es") & F.col("confidence").between(0.25, 1)
    return _settled(scored.select("doc_id", known.alias("known")), r)


def q_score_bracketed(spark, d):
    """R1, P2 (scorer, vector path): ``[a;b;c]`` lines without header parsed to vectors, scored
    by the forest stage alone, and joined back to their lines by the line's key."""
    f = fx.net_price(spark, d)
    r = train(f, NET, refit=False)
    _, test = holdout_split(f.frame, f.key, TRAIN_RATIO)
    line = F.concat(F.lit("["), F.concat_ws(";", *[F.col(c).cast("string") for c in f.features]),
                    F.lit("]"))
    path = scratch_path(spark, "to_score_bracketed")
    test.select(line.alias("value")).write.mode("overwrite").text(path)
    parsed = parse_bracketed(spark, path, keyed=True)
    scored = forest_stage(r.model).transform(parsed).select(*LINE_KEY, "values", "prediction")
    back = keyed_lines(spark, path).join(scored, LINE_KEY, "left")
    return _priced(back.withColumns({f"f{i}": F.col("values")[i] for i in range(3)}), r,
                   "f0", "f1", "f2")


QUERIES: dict[str, Query] = {
    name.removeprefix("q_"): query for name, query in list(globals().items())
    if name.startswith("q_")
}
