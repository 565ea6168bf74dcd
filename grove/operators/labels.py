"""Class labels: the dictionary of all classes, class counts as column metadata, weights.

MLlib reads the number of classes from the label column's metadata and otherwise guesses it
from the training rows, up to 100.  Here the dictionary is made from all rows, training and
test side, so a class that only the test side has is a class like any other; a value that
not even the dictionary has (a later file) becomes one more class, ``unseen``, which is never
predicted and so counts as an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most classes a dictionary holds; they are literals of the plan and states of every node.
MAX_CLASSES = 10_000
UNSEEN = "__unseen"


def class_counts(df: DataFrame, label: str, most: int = MAX_CLASSES) -> list[tuple[object, int]]:
    """(class, rows) of every class but null, most frequent first, ties by class.

    One partially aggregated count; the classes reach the driver behind a check of
    their number (at most ``most`` + 1 rows are fetched).
    """
    counts = (df.where(F.col(label).isNotNull()).groupBy(label)
              .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(most + 1))
    rows = [(r[0], r[1]) for r in counts.collect()]
    if len(rows) > most:
        raise ValueError(f"column {label} has more than {most} classes")
    return rows


@dataclass(frozen=True)
class LabelDictionary:
    """The classes of a text label, in index order."""

    labels: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, label: str, most: int = MAX_CLASSES) -> "LabelDictionary":
        """From all rows of ``df``: most frequent first, ties alphabetical."""
        text = df.select(F.col(label).cast("string").alias("label"))
        return cls(tuple(k for k, _ in class_counts(text, "label", most)))

    def indexer(self, label: str, out: str) -> StringIndexerModel:
        """Pipeline stage: class to index; a value that is no class (or null) to the index
        ``len(labels)``.  The column carries the number of classes, that one included."""
        return StringIndexerModel.from_labels(list(self.labels), label, out, handleInvalid="keep")

    def decoder(self, index: str, out: str) -> IndexToString:
        """Pipeline stage: index back to class."""
        return IndexToString(inputCol=index, outputCol=out, labels=[*self.labels, UNSEEN])


def with_class_count(df: DataFrame, label: str, n_classes: int) -> DataFrame:
    """The numeric label column with its number of classes as metadata (0..n-1)."""
    if n_classes < 1:
        raise ValueError(f"n_classes must be positive, got {n_classes}")
    meta = {"ml_attr": {"type": "nominal", "num_vals": int(n_classes), "name": label}}
    return df.withColumn(label, F.col(label).alias(label, metadata=meta))


def class_weight(counts: list[tuple[object, int]], label: str) -> Column:
    """n / (k * n_class) as an expression over the class: no join, no exchange of rows.  Null for
    a null label and for a value that is not among the counted classes."""
    if not counts:
        return F.lit(None).cast("double")
    total, k = sum(n for _, n in counts), len(counts)
    weights = F.create_map(*[x for value, n in counts for x in (F.lit(value), F.lit(total / (k * n)))])
    return F.when(F.col(label).isNotNull(), F.try_element_at(weights, F.col(label)))
