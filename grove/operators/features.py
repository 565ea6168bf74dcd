"""Feature and label preparation.

All of these are MLlib transformers or plain aggregates; none pulls rows to
the driver.  Fitting an indexer or a selector is one distributed aggregate
whose result (labels, category maps, chosen features) is bounded by the number
of classes or columns, not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.operators.labels import class_counts, class_weight


def assemble(df: DataFrame, inputs: Sequence[str], out: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    """The given columns (file order) as one dense/sparse vector column.

    ``handle_invalid``: error fails on a null feature, skip drops the row,
    keep turns it into NaN.
    """
    return VectorAssembler(inputCols=list(inputs), outputCol=out,
                           handleInvalid=handle_invalid).transform(df)


def with_class_weights(df: DataFrame, label: str, out: str = "weight",
                       method: str = "by_class") -> DataFrame:
    """Row weights.  uniform = 1; by_class = n / (k * n_class); null for a null label.

    The per-class counts are one partially aggregated count of at most ``MAX_CLASSES``
    classes, and come back as literals of the weight expression: the rows are not moved.
    """
    if method == "uniform":
        return df.withColumn(out, F.lit(1.0))
    if method != "by_class":
        raise ValueError(f"weighting must be uniform or by_class, got {method}")
    return df.withColumn(out, class_weight(class_counts(df, label), label))


def index_labels(df: DataFrame, col: str, out: str | None = None,
                 handle_invalid: str = "error") -> tuple[DataFrame, list[str]]:
    """String labels to 0..k-1 by frequency, ties alphabetical."""
    out = out or f"{col}_index"
    model = StringIndexer(inputCol=col, outputCol=out, stringOrderType="frequencyDesc",
                          handleInvalid=handle_invalid).fit(df)
    return model.transform(df), list(model.labelsArray[0])


def index_categories(df: DataFrame, inputs: Sequence[str], max_categories: int = 16,
                     spark: SparkSession | None = None, handle_invalid: str = "keep"
                     ) -> tuple[DataFrame, DataFrame]:
    """VectorIndexer; features with at most ``max_categories`` distinct values
    become categorical.  Returns the indexed frame and a table
    (feature, categorical, n_categories), n_categories 0 for a continuous feature.

    ``handle_invalid``: a null feature fails the job (error), drops its row (skip) or becomes
    NaN, a value of its own (keep).
    """
    assembled = assemble(df, inputs, "_raw_features", handle_invalid=handle_invalid)
    model = VectorIndexer(inputCol="_raw_features", outputCol="indexed_features",
                          maxCategories=max_categories).fit(assembled)
    maps = model.categoryMaps
    rows = [(name, i in maps, len(maps[i]) if i in maps else 0)
            for i, name in enumerate(inputs)]
    spark = spark or df.sparkSession
    table = spark.createDataFrame(rows, "feature string, categorical boolean, n_categories bigint")
    return model.transform(assembled).drop("_raw_features"), table


# ---------------------------------------------------------------- chi-squared selection

NULLS = ("drop", "value")


def _statistics(cells: DataFrame) -> DataFrame:
    """(position, n, statistic, dof, strength) from the cells (position, value, label) of
    all rows, one row per feature and row."""
    counts = cells.groupBy("position", "value", "label").agg(F.count(F.lit(1)).alias("o"))
    by_value = counts.groupBy(F.col("position").alias("at"), F.col("value").alias("of")).agg(
        F.sum("o").alias("nv"))
    by_label = counts.groupBy("position", "label").agg(F.sum("o").alias("nl"))
    whole = by_label.groupBy("position").agg(F.sum("nl").alias("n"), F.count(F.lit(1)).alias("labels"))
    values = by_value.groupBy(F.col("at").alias("position")).agg(F.count(F.lit(1)).alias("values"))
    # sum over all cells of (o - e)^2 / e is n * (sum of o^2 / (nv * nl) over full cells - 1)
    joined = (counts.join(by_value, (F.col("position") == F.col("at")) & F.col("value").eqNullSafe(F.col("of")))
              .select("position", "label", "o", "nv").join(by_label, ["position", "label"]))
    share = joined.groupBy("position").agg(
        F.sum(F.col("o").cast("double") * F.col("o") / (F.col("nv").cast("double") * F.col("nl")))
        .alias("share"))
    out = share.join(whole, "position").join(values, "position").select(
        "position", "n", (F.col("n") * (F.col("share") - 1)).alias("statistic"),
        ((F.col("values") - 1) * (F.col("labels") - 1)).alias("dof"))
    spread = F.lit(2.0) / (F.lit(9.0) * F.col("dof"))
    strength = F.when(F.col("dof") > 0, F.try_divide(
        F.cbrt(F.greatest(F.col("statistic"), F.lit(0.0)) / F.col("dof")) - 1 + spread, F.sqrt(spread)))
    return out.withColumn("strength", strength)


def chi_squared(df: DataFrame, inputs: Sequence[str], label: str, nulls: str = "drop") -> DataFrame:
    """The chi-squared test of independence of each feature and the label: feature,
    position, n, statistic, dof, strength.

    One grouped count of (feature, value, label), combined on the map side; what follows
    runs on its cells.  ``strength`` is the statistic on the normal scale (Wilson and Hilferty's
    cube root): it orders features of different degrees of freedom as their p-values do, also
    where those underflow to 0; null without degrees of freedom.  ``nulls``: a row with a null
    feature is left out for that feature (drop) or the null counts as a value; a null label
    leaves the row out.
    """
    if nulls not in NULLS:
        raise ValueError(f"nulls must be one of {NULLS}, got {nulls}")
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"`{c}`").cast("double").alias("value"))
                      for i, c in enumerate(inputs)])
    rows = (df.where(F.col(label).isNotNull())
            .select(F.col(label).alias("label"), F.explode(cells).alias("c")).select("label", "c.*"))
    if nulls == "drop":
        rows = rows.where(F.col("value").isNotNull())
    name = F.get(F.array(*[F.lit(c) for c in inputs]), F.col("position"))
    return _statistics(rows).select(name.alias("feature"), "*")


def vector_chi_squared(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``chi_squared`` of the elements of a vector column, by position."""
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(label).alias("label"), F.posexplode(vector_to_array(F.col(vector))).alias("position", "value"))
    return _statistics(rows)


def strongest(statistics: DataFrame, top: int) -> list[int]:
    """Positions of the ``top`` features of greatest strength (ties: the first), ascending."""
    rows = statistics.orderBy(F.desc_nulls_last("strength"), "position").limit(top)
    return sorted(r["position"] for r in rows.select("position").collect())


def select_features(df: DataFrame, inputs: Sequence[str], label: str, top: int = 50,
                    nulls: str = "drop") -> tuple[list[str], DataFrame]:
    """The ``top`` features by chi-squared test, in input order, and a table (feature,
    position, statistic, dof, selected)."""
    table = chi_squared(df, inputs, label, nulls)
    chosen = strongest(table, top)
    picked = F.col("position").isin(chosen) if chosen else F.lit(False)
    return [inputs[i] for i in chosen], table.select("feature", "position", "statistic", "dof",
                                                     picked.alias("selected"))
