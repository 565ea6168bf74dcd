"""Random forests: fixed size, grid-tuned, refit on all rows.

Tree induction is MLlib's: level-wise histogram aggregation across the cluster,
one pass over the cached training points per group of nodes; deep regression
forests are grown by ``deep_forest``, shallow ones on few features by ``cell_forest``,
into MLlib's model.  This module
wires the pieces: label preparation, row identity and layout, keyed split, one
estimator for everything that is learned, the fold loop and the metric aggregates.
"""

from __future__ import annotations

import json
import math
import statistics
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import (BinaryClassificationEvaluator,
                                   MulticlassClassificationEvaluator, RegressionEvaluator)
from pyspark.ml.feature import VectorAssembler, VectorIndexer, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from grove.functions.hashing import is_test
from grove.operators import cell_forest, deep_forest, metrics
from grove.operators.dataset import Fixture
from grove.operators.features import strongest, vector_chi_squared
from grove.operators.identity import ROW_KEY, canonical_layout, layout_partitions, with_row_key
from grove.operators.labels import (MAX_CLASSES, LabelDictionary, class_counts, class_weight,
                                    with_class_count)
from grove.operators.split import with_folds
from grove.session import checkpoint_dir

TASKS = ("regression", "binary", "multiclass")
LABEL, FEATURES, PREDICTION, WEIGHT, FOLD = "label", "features", "prediction", "weight", "_fold"
#: The side of a row, kept with the cached rows.
TEST_SIDE = "_test_side"
#: Down to this depth it costs less to walk a tree again than to keep a node id per row and tree.
SHALLOW = 12


@dataclass(frozen=True)
class ForestOptions:
    """Named form of the reference's six-value option vector."""

    trees: int | Sequence[int] = 20
    depth: int = 5
    impurity: str = "gini"            # classification: gini | entropy
    subset: str = "auto"              # auto | all | sqrt | ln | onethird | log2 | n | fraction
    min_rows: int = 1                 # minInstancesPerNode
    weighting: str = "uniform"        # uniform | by_class
    bins: int | Sequence[int] = 32
    max_memory_mb: int = 256          # histogram memory per pass
    seed: int = 17
    subsampling: float = 1.0
    bootstrap: bool = True            # False: every tree sees all rows
    cache_node_ids: bool | None = None  # node ids kept on executors, checkpointed; None: of deep trees
    checkpoint_interval: int = 10
    handle_invalid: str = "error"     # null or NaN feature, null label: error | skip
    n_classes: int | None = None      # numeric classes 0..n-1; default: counted over all rows
    max_classes: int = MAX_CLASSES    # of a text label
    max_categories: int | None = None     # features of so many values or fewer are categorical
    unseen_category: str = "keep"     # category that training did not have: keep | skip | error
    top_features: int | None = None   # keep so many features by chi-squared test on the label
    partitions: int | None = 16       # of the training rows, at least; None: as they come (see layout)

    @classmethod
    def from_vector(cls, values: Sequence[str], **overrides) -> "ForestOptions":
        """[min rows, depth, impurity, weighting, trees, subset] as text."""
        min_rows, depth, impurity, weighting, trees, subset = (str(v).strip() for v in values)
        tree_list = [int(t) for t in trees.split(",") if t.strip()]
        opts = cls(
            trees=tree_list[0] if len(tree_list) == 1 and "," not in trees else tree_list,
            depth=int(depth),
            impurity=impurity.lower() or "gini",
            subset=subset.lower() or "auto",
            min_rows=max(1, int(float(min_rows or 1))),
            weighting=weighting.lower().replace("byclass", "by_class") or "uniform",
        )
        return replace(opts, **overrides)

    def validated(self) -> "ForestOptions":
        if not 0 <= self.depth <= 30:
            raise ValueError(f"depth must be in 0..30, got {self.depth}")
        if self.impurity not in ("gini", "entropy"):
            raise ValueError(f"impurity must be gini or entropy, got {self.impurity}")
        if self.weighting not in ("uniform", "by_class"):
            raise ValueError(f"weighting must be uniform or by_class, got {self.weighting}")
        if self.handle_invalid not in ("error", "skip"):
            raise ValueError("trees need every feature: handle_invalid must be error or skip, "
                             f"got {self.handle_invalid}")
        return self

    def tree_grid(self) -> list[int]:
        return [int(t) for t in self.trees] if isinstance(self.trees, (list, tuple)) else [int(self.trees)]

    def bin_grid(self) -> list[int]:
        return [int(b) for b in self.bins] if isinstance(self.bins, (list, tuple)) else [int(self.bins)]

    def is_grid(self) -> bool:
        """A single number means the fixed path, a list means the grid path."""
        return isinstance(self.trees, (list, tuple)) or isinstance(self.bins, (list, tuple))

    def settings(self) -> list["ForestOptions"]:
        """One option set for each point of the grid, tree counts outermost."""
        return [replace(self, trees=t, bins=b) for t in self.tree_grid() for b in self.bin_grid()]


def feature_subset(subset: str, n_features: int) -> str:
    """Map the reference's Default / All / Sqrt / Ln to Spark's strategies."""
    s = subset.strip().lower()
    if s in ("default", "auto", ""):
        return "auto"
    if s in ("all", "sqrt", "onethird", "log2"):
        return s
    if s == "ln":
        return str(max(1, math.ceil(math.log(max(n_features, 1)))))
    return s  # an integer count or a fraction, validated by Spark


# ---------------------------------------------------------------- preparation

def _is_string(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)


def prepare(fx: Fixture, tolerant: bool = False) -> DataFrame:
    """Add the double ``label`` column (not for text multiclass targets, which
    the model indexes) and turn an array feature column into a vector."""
    df = fx.frame
    target = F.col(f"`{fx.target}`")
    cast = (lambda c: c.try_cast("double")) if tolerant else (lambda c: c.cast("double"))
    if fx.task == "regression":
        df = df.withColumn(LABEL, cast(target))
    elif fx.task == "binary":
        if fx.positive is None:
            df = df.withColumn(LABEL, cast(target))
        else:
            df = df.withColumn(LABEL, F.when(target.isNull(), F.lit(None).cast("double"))
                               .when(target == F.lit(fx.positive), 1.0).otherwise(0.0))
    elif fx.task == "multiclass":
        if not _is_string(df, fx.target):
            df = df.withColumn(LABEL, cast(target))
    else:
        raise ValueError(f"task must be one of {TASKS}, got {fx.task}")
    if fx.vector is not None and isinstance(df.schema[fx.vector].dataType, T.ArrayType):
        df = df.withColumn(fx.vector, array_to_vector(F.col(fx.vector)))
    return df


def feature_inputs(fx: Fixture) -> list[str]:
    return [fx.vector] if fx.vector is not None else list(fx.features)


def _n_features(fx: Fixture, df: DataFrame) -> int:
    if fx.vector is None:
        return len(fx.features)
    first = df.select(fx.vector).where(F.col(fx.vector).isNotNull()).first()
    return first[0].size if first is not None else 1


# ---------------------------------------------------------------- the estimator

class ForestLearner(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Everything that is learned from training rows, as one estimator.

    ``fit`` takes rows with the raw target and features, and returns a PipelineModel of
    Spark's own stages: label index of a text class, feature vector, categorical and
    chi-squared stages if wanted, forest, decoded class.  The estimator itself holds
    nothing fitted: saved and loaded (alone or in a Pipeline), it learns the classes,
    categories, selected features and trees of whatever rows it is given next.
    """

    spec = Param(Params._dummy(), "spec", "target, features, task and options, as JSON",
                 typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, spec: str | None = None):
        super().__init__()
        if spec is not None:
            self._set(spec=spec)

    @classmethod
    def of(cls, fx: Fixture, opts: ForestOptions, labels: Sequence[str] | None = None
           ) -> "ForestLearner":
        """``labels``: the classes of a text target; default: those of the rows to fit."""
        opts = opts.validated()
        if opts.is_grid():
            raise ValueError("an estimator has one setting; a grid makes several")
        return cls(spec=json.dumps({
            "target": fx.target, "features": list(fx.features), "vector": fx.vector,
            "task": fx.task, "positive": fx.positive,
            "labels": None if labels is None else list(labels), "options": asdict(opts)}))

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        s = json.loads(self.getOrDefault(self.spec))
        opts = ForestOptions(**s["options"])
        fx = Fixture(dataset, s["target"], s["features"], [], s["task"], s["positive"], s["vector"])
        df = dataset if LABEL in dataset.columns else prepare(fx)
        stages, decoder = [], []
        if s["task"] == "multiclass" and _is_string(df, s["target"]):
            words = (LabelDictionary(tuple(s["labels"])) if s["labels"] is not None else
                     LabelDictionary.of(df, s["target"], opts.max_classes))
            stages.append(words.indexer(s["target"], LABEL))
            decoder = [words.decoder(PREDICTION, f"predicted_{s['target']}")]
            df = df.where(F.col(f"`{s['target']}`").isNotNull())
        elif s["task"] == "multiclass":
            df = with_class_count(df, LABEL, opts.n_classes or _classes(df, opts))
        elif s["task"] == "binary":
            df = with_class_count(df, LABEL, 2)
        if opts.handle_invalid == "skip" and LABEL in df.columns:
            df = df.where(F.col(LABEL).isNotNull())
        weight = None
        if opts.weighting == "by_class" and s["task"] != "regression":
            by = LABEL if LABEL in df.columns else s["target"]
            df = df.withColumn(WEIGHT, class_weight(class_counts(df, by, opts.max_classes), by))
            weight = WEIGHT
        indexed = stages[0].transform(df) if stages else df
        stages += _feature_stages(fx, opts, indexed)
        width = opts.top_features or _n_features(fx, df)
        forest = _forest(fx.task, opts, width, weight)
        if fx.task == "regression" and not opts.max_categories and deep_forest.fits(forest) and (
                opts.depth > SHALLOW or cell_forest.may_fit(forest, width)):
            ready = Pipeline(stages=stages).fit(df)
            fit = deep_forest.fit_deep if opts.depth > SHALLOW else cell_forest.fit_cells
            model = fit(ready.transform(df), forest)
            if model is not None:
                return PipelineModel([*ready.stages, model])
        return Pipeline(stages=[*stages, forest, *decoder]).fit(df)


def _classes(df: DataFrame, opts: ForestOptions) -> int:
    top = df.agg(F.max(LABEL)).first()[0]
    n = 1 if top is None else int(top) + 1
    if n > opts.max_classes:
        raise ValueError(f"class {top:g} is beyond the {opts.max_classes} classes allowed")
    return n


def _feature_stages(fx: Fixture, opts: ForestOptions, df: DataFrame) -> list:
    """Assembler, then the categorical (M18) and chi-squared (M19) stages that are wanted, the
    last one with the output ``features``; names and kinds of the elements are kept."""
    if opts.top_features and fx.task == "regression":
        raise ValueError("the chi-squared test needs a class label")
    stages = [VectorAssembler(inputCols=feature_inputs(fx), outputCol="_vector0",
                              handleInvalid=opts.handle_invalid)]
    if opts.max_categories:
        stages.append(VectorIndexer(inputCol="_vector0", outputCol="_vector1",
                                    maxCategories=opts.max_categories,
                                    handleInvalid=opts.unseen_category))
    if opts.top_features:
        stages = Pipeline(stages=stages).fit(df).stages
        ready = PipelineModel(stages).transform(df)
        last = f"_vector{len(stages) - 1}"
        chosen = strongest(vector_chi_squared(ready, last, LABEL), opts.top_features)
        stages = [*stages, VectorSlicer(inputCol=last, outputCol="_vector", indices=chosen)]
    stages[-1].setOutputCol(FEATURES)
    return stages


def _forest(task: str, opts: ForestOptions, n_features: int, weight: str | None):
    common = dict(
        featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION,
        numTrees=opts.tree_grid()[0], maxDepth=opts.depth, maxBins=opts.bin_grid()[0],
        minInstancesPerNode=opts.min_rows, featureSubsetStrategy=feature_subset(opts.subset, n_features),
        seed=opts.seed, subsamplingRate=opts.subsampling, maxMemoryInMB=opts.max_memory_mb,
        cacheNodeIds=(opts.depth > SHALLOW if opts.cache_node_ids is None else opts.cache_node_ids),
        checkpointInterval=opts.checkpoint_interval,
        bootstrap=opts.bootstrap,
    )
    if task == "regression":
        est = RandomForestRegressor(impurity="variance", **common)
    else:
        est = RandomForestClassifier(impurity=opts.impurity, probabilityCol="probability",
                                     rawPredictionCol="rawPrediction", **common)
    if weight is not None:
        est.setWeightCol(weight)
    return est


def build_pipeline(fx: Fixture, opts: ForestOptions,
                   labels: Sequence[str] | None = None) -> Pipeline:
    """The unfitted pipeline that is saved beside a model (B4): the estimator alone."""
    return Pipeline(stages=[ForestLearner.of(fx, opts, labels)])


# ---------------------------------------------------------------- evaluation

def positive_score(pred: DataFrame) -> DataFrame:
    """Probability of class 1 as ``score`` (binary models)."""
    return pred.withColumn("score", vector_to_array(F.col("probability"))[1])


def evaluate(pred: DataFrame, task: str) -> DataFrame:
    """One-row quality figures for a scored test side, scored once."""
    if task == "regression":
        return metrics.regression_metrics(pred, LABEL, PREDICTION)
    if task == "binary":
        return metrics.binary_report(positive_score(pred), LABEL, PREDICTION, score="score",
                                     bounds=metrics.unit_bounds())
    return metrics.agreement(pred, LABEL, PREDICTION)


def selection_evaluator(task: str):
    """M8: rmse for regression, area under ROC for binary, accuracy for multiclass."""
    if task == "regression":
        return RegressionEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="rmse")
    if task == "binary":
        return BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="probability",
                                             metricName="areaUnderROC", numBins=0)
    return MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol=PREDICTION,
                                             metricName="accuracy")


# ---------------------------------------------------------------- training rows

@dataclass
class TrainResult:
    model: PipelineModel                 # fitted on the training side
    test: DataFrame                      # scored test side (lazy)
    metrics: DataFrame                   # one row (lazy)
    final: PipelineModel | None = None   # refit on all rows
    scores: DataFrame | None = None      # grid path: one row per setting
    fold_scores: DataFrame | None = None  # grid path: one row per setting and fold
    best: dict = field(default_factory=dict)
    pipeline: Pipeline | None = None     # unfitted, at the chosen setting: for retraining
    report: "SkipReport | None" = None   # rows read, dropped by column, used
    cached: list = field(default_factory=list)

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()
        self.cached.clear()


class SkipReport:
    """Rows read, rows without a usable value by column, rows used.

    Counted by the job that fills the cache of the prepared rows, not by a pass of its own
    (without a cache: by one, when it is asked for).  An ``Observation`` would do as well, but
    with one in the session MLlib's binary models can no longer be sent to executors (their
    training summary holds the session, and that its observations).
    """

    def __init__(self, rows: DataFrame, columns: Sequence[str]):
        self.rows, self.columns = rows, list(columns)
        self._seen = None

    def count(self) -> dict:
        if self._seen is None:
            bad = [self._unusable(c) for c in self.columns]
            any_bad = reduce(lambda a, b: a | b, bad, F.lit(False))
            self._seen = self.rows.agg(
                F.count(F.lit(1)).alias("n_rows"), F.count_if(any_bad).alias("n_dropped"),
                *[F.count_if(b).alias(f"bad_{i}") for i, b in enumerate(bad)]).first().asDict()
        return self._seen

    def _unusable(self, c: str):
        v = F.col(f"`{c}`")
        floating = isinstance(self.rows.schema[c].dataType, (T.DoubleType, T.FloatType))
        return (v.isNull() | F.isnan(v)) if floating else v.isNull()

    def frame(self, spark: SparkSession) -> DataFrame:
        """(column_name, n_rows, n_unusable, n_dropped, n_used): a row for each column, with
        the totals of the whole table."""
        seen = self.count()
        rows = [(c, seen["n_rows"], seen[f"bad_{i}"], seen["n_dropped"],
                 seen["n_rows"] - seen["n_dropped"]) for i, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, "column_name string, n_rows bigint, n_unusable bigint, "
                                           "n_dropped bigint, n_used bigint")


@dataclass
class _Rows:
    data: DataFrame
    train: DataFrame
    test: DataFrame
    key: list[str]
    opts: ForestOptions
    labels: list[str] | None
    report: SkipReport
    cached: list


def _rows(fx: Fixture, opts: ForestOptions, train_ratio: float, external: Fixture | None,
          tolerant: bool, persist: bool, folds: int | None = None) -> _Rows:
    """Prepared rows in canonical layout, their two sides, and the classes of all of them.

    Side and fold are read several times by every fit, so they are computed once, before the cache.
    """
    opts = opts.validated()
    checkpoint_dir(fx.frame.sparkSession)  # cacheNodeIds checkpoints go to the shared folder
    data = prepare(fx, tolerant)
    label = LABEL if LABEL in data.columns else fx.target
    key = list(fx.key)
    if opts.partitions is not None:
        parts = layout_partitions(fx.extra.get("as_many", data), opts.partitions)
    own_key = ROW_KEY in data.columns or not key
    if ROW_KEY not in data.columns and (opts.partitions is not None or not key):
        data = with_row_key(data)
        key = key or [ROW_KEY]
    if opts.partitions is not None:
        data = canonical_layout(data, ROW_KEY, parts)
        if not own_key:
            data = data.drop(ROW_KEY)       # made for the layout alone
    if external is None:
        data = data.withColumn(TEST_SIDE, is_test(key, train_ratio))
    if folds is not None:
        data = with_folds(data, key, folds, FOLD)
    cached = []
    if persist:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        cached.append(data)
    report = SkipReport(data, [*feature_inputs(fx), label])
    if persist:
        report.count()
    if external is None:
        train_df = data.where(~F.col(TEST_SIDE)).drop(TEST_SIDE)
        test_df = data.where(TEST_SIDE).drop(TEST_SIDE, FOLD)
        data = data.drop(TEST_SIDE)
        known = data
    else:
        # Train on every row of the first source, test on the second.
        test_df = prepare(external, tolerant)
        missing = set(feature_inputs(fx)) - set(test_df.columns)
        if missing:
            raise ValueError(f"external validation set lacks columns {sorted(missing)}")
        train_df = data
        known = data.select(label).unionByName(test_df.select(label))
    labels = None
    if fx.task == "multiclass" and label == fx.target:
        labels = list(LabelDictionary.of(known, label, opts.max_classes).labels)
    elif fx.task == "multiclass" and opts.n_classes is None:
        opts = replace(opts, n_classes=_classes(known, opts))
    return _Rows(data, train_df, test_df, key, opts, labels, report, cached)


# ---------------------------------------------------------------- training

def train(fx: Fixture, opts: ForestOptions = ForestOptions(), train_ratio: float = 0.8,
          refit: bool = True, external: Fixture | None = None, tolerant: bool = False,
          persist: bool = True, folds: int = 3, parallelism: int = 2) -> TrainResult:
    """M1/M2/M9: fit at a fixed size on the training side, score the test side,
    then (optionally) refit the same setting on all rows.  A grid of settings goes to ``tune``.

    The rows are laid out by their identity in ``opts.partitions`` partitions, so the trees
    depend on the rows, the seed and that number alone, not on files or cores.
    """
    if opts.is_grid():
        return tune(fx, opts, folds=folds, train_ratio=train_ratio, parallelism=parallelism,
                    external=external, tolerant=tolerant, refit=refit, persist=persist)
    rows = _rows(fx, opts, train_ratio, external, tolerant, persist)
    learner = ForestLearner.of(fx, rows.opts, rows.labels)
    # The two fits are independent: they run as concurrent jobs, so one fills the cores
    # that the other leaves idle between tree levels.
    model, *final = _concurrently(learner.fit, [rows.train, rows.data] if refit else [rows.train])
    scored = model.transform(rows.test)
    return TrainResult(model, scored, evaluate(scored, fx.task), final[0] if final else None,
                       pipeline=build_pipeline(fx, opts), report=rows.report, cached=rows.cached)


def _concurrently(work, items: list, at_once: int = 2) -> list:
    spark = SparkSession.getActiveSession()
    run = inheritable_thread_target(spark)(work)
    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(items)))) as pool:
        return list(pool.map(run, items))


def best_setting(means: Sequence[float], larger: bool) -> int:
    """Index of the best mean; a NaN (no fold could be judged) is worse than any figure, and
    of equal ones the first wins."""
    def rank(i: int) -> float:
        return -math.inf if math.isnan(means[i]) else means[i] if larger else -means[i]
    return max(range(len(means)), key=rank)


def tune(fx: Fixture, opts: ForestOptions, folds: int = 3, train_ratio: float = 0.8,
         parallelism: int = 2, external: Fixture | None = None, tolerant: bool = False,
         refit: bool = True, persist: bool = True) -> TrainResult:
    """K-fold grid over tree counts and bins, keyed folds,
    best setting scored on the test side, then one refit of it on all rows.

    The folds are filters of the one persisted frame; no fold is stored on its own.  A
    setting's figure is the mean over the folds that gave one (a fold without rows, or without
    both classes for the area under ROC, gives NaN).
    """
    if folds < 2:
        raise ValueError(f"folds must be >= 2, got {folds}")
    rows = _rows(fx, opts, train_ratio, external, tolerant, persist, folds)
    spark = fx.frame.sparkSession
    evaluator = selection_evaluator(fx.task)
    folded = rows.train
    settings = rows.opts.settings()

    def judged(job: tuple[int, int]) -> tuple[float, int]:
        setting, fold = job
        learner = ForestLearner.of(fx, settings[setting], rows.labels)
        model = learner.fit(folded.where(F.col(FOLD) != fold))
        held = model.transform(folded.where(F.col(FOLD) == fold))
        n = held.count()
        return (evaluator.evaluate(held) if n else math.nan), n

    jobs = [(s, k) for s in range(len(settings)) for k in range(folds)]
    got = dict(zip(jobs, _concurrently(judged, jobs, parallelism)))
    name = evaluator.getMetricName()
    fold_scores = spark.createDataFrame(
        [(settings[s].trees, settings[s].bins, k, name, *got[s, k]) for s, k in jobs],
        "trees int, bins int, fold int, metric string, value double, n_rows bigint")
    values = [[v for k in range(folds) if not math.isnan(v := got[s, k][0])]
              for s in range(len(settings))]
    means = [statistics.fmean(v) if v else math.nan for v in values]
    best_i = best_setting(means, evaluator.isLargerBetter())
    scores = spark.createDataFrame(
        [(o.trees, o.bins, name, m, statistics.pstdev(v) if v else math.nan, i == best_i)
         for i, (o, m, v) in enumerate(zip(settings, means, values))],
        "trees int, bins int, metric string, mean double, std double, chosen boolean")
    chosen = settings[best_i]
    learner = ForestLearner.of(fx, chosen, rows.labels)
    # Stated deviation: one refit of the chosen setting, not a second cross-validation.
    model, *final = _concurrently(learner.fit, [rows.train, rows.data] if refit else [rows.train])
    scored = model.transform(rows.test)
    return TrainResult(model, scored, evaluate(scored, fx.task), final[0] if final else None,
                       scores, fold_scores, {"numTrees": chosen.trees, "maxBins": chosen.bins},
                       build_pipeline(fx, replace(opts, trees=chosen.trees, bins=chosen.bins)),
                       rows.report, rows.cached)


# ---------------------------------------------------------------- inspection

def flat_stages(model) -> list:
    """Stages of a pipeline model, those of nested ones in place of them."""
    return [x for s in model.stages for x in (flat_stages(s) if isinstance(s, PipelineModel) else [s])]


def forest_stage(model: PipelineModel):
    for stage in reversed(flat_stages(model)):
        if hasattr(type(stage), "trees"):  # of the class: a stored forest would be loaded for its own
            return stage
    raise ValueError("pipeline has no forest stage")


def model_summary(model: PipelineModel, spark=None) -> DataFrame:
    """Trees, nodes and depth read from the fitted model (no text parsing)."""
    rf = forest_stage(model)
    spark = spark or SparkSession.getActiveSession()
    depths = [t.depth for t in rf.trees]
    row = (int(rf.getNumTrees), int(rf.totalNumNodes), int(max(depths) if depths else 0),
           int(rf.numFeatures), type(rf).__name__)
    return spark.createDataFrame([row], "trees int, nodes int, max_depth int, n_features int, kind string")
