"""Quality figures as distributed aggregates.

Every function takes a DataFrame of (actual, predicted) or (label, score) pairs
and returns a small DataFrame; nothing is collected to the driver except by the
caller.  Classification figures come from the long confusion table, which is
the only shuffle: ``groupBy(actual, predicted)`` is partially aggregated on the
map side, so even a class holding a third of all rows leaves each task as one
row per (actual, predicted) pair.  The per-class and global figures that follow
run on at most k^2 rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grove.session import checkpoint_dir


def _ratio(num: Column, den: Column) -> Column:
    """num / den as double; null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def rounded(figures: DataFrame, digits: int, **others: int) -> DataFrame:
    """Double columns rounded to ``digits`` (those named in ``others`` to theirs).  The figures
    themselves are never rounded; this is for whoever prints or compares them."""
    return figures.select(*[F.round(c, others.get(c, digits)).alias(c) if t == "double" else c
                            for c, t in figures.dtypes])


def confusion_matrix(pairs: DataFrame, actual: str = "label",
                     predicted: str = "prediction") -> DataFrame:
    """Long table (actual, predicted, n); rows are actual classes."""
    return (pairs.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_totals(cm: DataFrame) -> DataFrame:
    """Per class k: r = rows actually k, c = rows predicted k, d = rows both.

    A class only ever predicted gets r = 0; it adds nothing to the expected
    agreement and is left out of balanced accuracy, but its rows count as errors.
    """
    zero = F.lit(0).cast("long")
    diag = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero)
    as_actual = F.struct(F.col("actual").alias("k"), F.col("n").alias("r"),
                         zero.alias("c"), diag.alias("d"))
    as_predicted = F.struct(F.col("predicted").alias("k"), zero.alias("r"),
                            F.col("n").alias("c"), zero.alias("d"))
    return (cm.select(F.explode(F.array(as_actual, as_predicted)).alias("s"))
            .select("s.*")
            .groupBy("k")
            .agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum("d").alias("d")))


def agreement_of(cm: DataFrame) -> DataFrame:
    """The figures of ``agreement`` from a long confusion table; rows of it may repeat."""
    totals = class_totals(cm.where(F.col("actual").isNotNull()))
    t = F.sum("r")
    p0 = _ratio(F.sum("d"), t)
    pe = _ratio(F.sum(F.col("r").cast("double") * F.col("c")), t.cast("double") * t)
    ba = F.avg(F.when(F.col("r") > 0, _ratio(F.col("d"), F.col("r"))))
    return totals.agg(F.try_divide(p0 - pe, F.lit(1.0) - pe).alias("kappa"), ba.alias("ba"),
                      p0.alias("accuracy"), F.coalesce(t, F.lit(0)).cast("long").alias("n"))


def agreement(pairs: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """E2, E3, E9 in one row: kappa, ba (balanced accuracy), accuracy, n.

    kappa = (P0 - PE) / (1 - PE) with P0 = sum(d)/t and PE = sum(r*c)/t^2;
    null when PE = 1 (a single class on both sides).  Rows whose actual class is null cannot
    be judged and are left out; a null prediction is an error.
    """
    return agreement_of(confusion_matrix(pairs, actual, predicted))


def cohen_kappa(pairs: DataFrame, actual: str = "label",
                predicted: str = "prediction") -> DataFrame:
    return agreement(pairs, actual, predicted).select("kappa")


def balanced_accuracy(pairs: DataFrame, actual: str = "label",
                      predicted: str = "prediction") -> DataFrame:
    return agreement(pairs, actual, predicted).select("ba")


def accuracy(pairs: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Share of rows with actual = predicted (single pass, no confusion table)."""
    hit = F.when(F.col(actual) == F.col(predicted), 1.0).otherwise(0.0)
    return pairs.where(F.col(actual).isNotNull()).agg(F.avg(hit).alias("accuracy"))


def regression_metrics(pairs: DataFrame, label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """E4-E8 in one pass: mse, rmse, mae, r2, explained_variance, n.

    Uses the stable ``var_pop`` aggregates instead of a second pass:
    SS_tot / n = var_pop(y) and mean((p - mean y)^2) = var_pop(p) + (mean p - mean y)^2.
    R^2 is null for a constant label.  All figures, ``n`` included, are of the rows that
    have both a label and a prediction.
    """
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    err = y - p
    mse = F.avg(err * err)
    return pairs.where(y.isNotNull() & p.isNotNull()).agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        (F.lit(1.0) - F.try_divide(mse, F.var_pop(y))).alias("r2"),
        (F.var_pop(p) + F.pow(F.avg(p) - F.avg(y), 2)).alias("explained_variance"),
        F.count(F.lit(1)).alias("n"),
    )


# ---------------------------------------------------------------- thresholds

#: Ranges that the distinct scores are dealt to.
SCORE_RANGES = 64


def unit_bounds(ranges: int = SCORE_RANGES) -> list[float]:
    """Evenly spaced bounds for scores that are probabilities: no pass over them is needed."""
    return [k / ranges for k in range(1, ranges)]


def _score_groups(pairs: DataFrame, label: str, score: str, n: Column) -> DataFrame:
    """(score, n_pos, n_neg) of every distinct score; rows without a label or score are left out."""
    known = pairs.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    positive = F.col(label).cast("double") == 1.0
    return known.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(positive, n).otherwise(0)).cast("long").alias("n_pos"),
        F.sum(F.when(positive, 0).otherwise(n)).cast("long").alias("n_neg"))


def _cut(groups: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder, so what is below runs once."""
    checkpoint_dir(groups.sparkSession)
    return groups.checkpoint()


def _points(groups: DataFrame, bounds: list[float] | None) -> DataFrame:
    """Running totals over (score, n_pos, n_neg) from the highest score down.

    The scores are dealt to ranges; each range sums up its own rows in order, and the totals
    of the ranges above it (one row a range) are added.  No task sees more than a range.
    """
    if bounds is None:
        shares = [k / SCORE_RANGES for k in range(1, SCORE_RANGES)]
        got = groups.agg(F.percentile_approx("score", shares, 10_000)).first()[0] or []
        bounds = sorted(set(got))
    place = reduce(lambda a, b: a + b, [(F.col("score") < F.lit(float(x))).cast("int")
                                        for x in bounds], F.lit(0))
    placed = groups.withColumn("_range", place)
    own = {r[0]: (r[1], r[2]) for r in placed.groupBy("_range").agg(
        F.sum("n_pos"), F.sum("n_neg")).collect()}       # one row a range
    above, so_far = [], [0, 0]
    for k in sorted(own):
        above.append((k, *so_far))
        so_far = [x + y for x, y in zip(so_far, own[k])]
    p, n = so_far
    def add(column: int) -> Column:
        return reduce(lambda e, r: F.when(F.col("_range") == r[0], F.lit(r[column])).otherwise(e),
                      above, F.lit(0)).cast("long")
    running = (Window.partitionBy("_range").orderBy(F.desc("score"))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tp = (F.sum("n_pos").over(running) + add(1)).alias("tp")
    fp = (F.sum("n_neg").over(running) + add(2)).alias("fp")
    return placed.select(F.col("score").alias("threshold"), "n_pos", "n_neg", tp, fp,
                         F.lit(p).cast("long").alias("all_pos"), F.lit(n).cast("long").alias("all_neg"))


def roc_points(scored: DataFrame, label: str = "label", score: str = "score",
               bounds: list[float] | None = None) -> DataFrame:
    """E10-E12 per threshold: a row for every distinct score, which counts rows of that score and above
    as positive: threshold, n_pos, n_neg, tp, fp, tpr, fpr, precision, kappa, ba.

    ``bounds``: where to cut the scores into ranges; default: their quantiles.  A rate without
    rows below the line is null.
    """
    points = _points(_cut(_score_groups(scored, label, score, F.lit(1))), bounds)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    p, n = F.col("all_pos").cast("double"), F.col("all_neg").cast("double")
    fn, tn, t = p - tp, n - fp, p + n
    hit = (tp + tn) / t
    chance = ((tp + fp) * p + (fn + tn) * n) / (t * t)
    tpr, fpr = F.try_divide(tp, p), F.try_divide(fp, n)
    return points.select(
        "threshold", "n_pos", "n_neg", "tp", "fp", tpr.alias("tpr"), fpr.alias("fpr"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(hit - chance, F.lit(1.0) - chance).alias("kappa"),
        ((tpr + 1 - fpr) / 2).alias("ba"))


def _auc(points: DataFrame) -> float:
    """Area under the points (ties count one half); NaN unless both classes occur."""
    area = F.sum(F.col("n_neg") * (F.col("tp") - F.col("n_pos") / F.lit(2.0)))
    whole = F.max("all_pos").cast("double") * F.max("all_neg")
    got = points.agg(F.try_divide(area, whole)).first()[0]
    return float("nan") if got is None else float(got)


def area_under_roc(scored: DataFrame, label: str = "label", score: str = "score",
                   bounds: list[float] | None = None) -> float:
    """Exact area under the ROC curve (ties count one half)."""
    return _auc(_points(_cut(_score_groups(scored, label, score, F.lit(1))), bounds))


def auc_frame(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """E10 as a one-row DataFrame (auc)."""
    return scored.sparkSession.range(1).select(F.lit(area_under_roc(scored, label, score)).alias("auc"))


def binary_report(pairs: DataFrame, label: str = "label", predicted: str = "prediction",
                  score: str | None = None, bounds: list[float] | None = None) -> DataFrame:
    """Kappa, ba, accuracy, n on the 0/1 label, plus auc when a score is given.

    Everything comes from one count by label, prediction and score, which is made once: a
    model that scores ``pairs`` scores them once.
    """
    if score is None:
        return agreement(pairs, label, predicted)
    counts = _cut(pairs.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted"),
                                F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n")))
    cm = counts.groupBy("actual", "predicted").agg(F.sum("n").alias("n"))
    auc = _auc(_points(_cut(_score_groups(counts, "actual", "score", F.col("n"))), bounds))
    return agreement_of(cm).withColumn("auc", F.lit(auc))
