"""Scoring with a fitted pipeline.

``PipelineModel.transform`` is a narrow, per-row projection: the forest is
shipped once per executor inside the task closure, rows never move.  The
results keep the row key so predictions can be joined or written by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grove.operators.forest import forest_stage


def _classes(model: PipelineModel) -> int | None:
    """Number of classes of the forest; None for regression."""
    return getattr(forest_stage(model), "numClasses", None)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] = (),
          probability: bool = True) -> DataFrame:
    """Key columns + prediction; classifiers also give the probability
    of the predicted class and, for two classes, of class 1; a string label
    comes back decoded as ``predicted_<target>``."""
    out = model.transform(df)
    cols = [F.col(c) for c in keep] + [F.col("prediction")]
    cols += [F.col(c) for c in out.columns if c.startswith("predicted_")]
    n_classes = _classes(model)
    if n_classes and probability:
        prob = vector_to_array(F.col("probability"))
        cols.append(F.array_max(prob).alias("confidence"))
        if n_classes == 2:
            cols.append(prob[1].alias("p_positive"))
    return out.select(*cols)


def sample_predictions(model: PipelineModel, df: DataFrame, label: str, order: Sequence[str],
                       n: int = 5) -> DataFrame:
    """Prediction, label and features of the first ``n`` rows by ``order``
    plus prediction and label (a top-n: each task keeps n rows, the driver
    merges them)."""
    out = model.transform(df)
    feats = vector_to_array(F.col("features"))
    return (out.select(*order, "prediction", F.col(label).alias("actual"), feats.alias("features"))
            .orderBy(*order, "prediction", "actual").limit(n))


def preview(df: DataFrame, order: Sequence[str], n: int = 1) -> DataFrame:
    """First rows by a total order (top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)


#: Text form of a time in a profile.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def dataset_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One pass, one row per column: n_rows, n_nulls, and the least and greatest value in
    the column's own kind: min_long/max_long (integers, exact), min_double/max_double (fractions;
    decimals as double), min_text/max_text (texts; times as ``TIME_FORMAT``, dates in ISO form,
    booleans as ``true``/``false``).  Other kinds (arrays, maps) have their counts alone."""
    columns = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    none = {"long": F.lit(None).cast("long"), "double": F.lit(None).cast("double"),
            "text": F.lit(None).cast("string")}
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, c in enumerate(columns):
        v, t = F.col(f"`{c}`"), kinds[c]
        aggs.append(F.count(v).alias(f"_nn{i}"))
        shape = None
        if isinstance(t, T.IntegralType):
            shape, form = "long", lambda x: x.cast("long")
        elif isinstance(t, (T.FractionalType,)):
            # "+ 0.0" reports a signed zero as 0 whichever zero the engine keeps.
            shape, form = "double", lambda x: x.cast("double") + 0.0
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            shape, form = "text", lambda x: F.date_format(x, TIME_FORMAT)
        elif isinstance(t, (T.StringType, T.DateType, T.BooleanType)):
            shape, form = "text", lambda x: x.cast("string")
        if shape:
            aggs += [form(F.min(v)).alias(f"_mn{i}"), form(F.max(v)).alias(f"_mx{i}")]
        ends = [(F.col(f"_{e}{i}") if k == shape else none[k]).alias(f"{w}_{k}")
                for k in none for e, w in (("mn", "min"), ("mx", "max"))]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("n_rows"),
                             (F.col("_rows") - F.col(f"_nn{i}")).alias("n_nulls"), *ends))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
