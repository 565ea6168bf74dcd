"""Training/test split and k-fold assignment by key.

Both are narrow projections of a hash of the key: no shuffle, no skew (a hot
key lands on one side as a whole, but it is never moved to one task), and the
same row always lands on the same side, whatever the partitioning or retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.functions.hashing import fold_of, is_test


def with_side(df: DataFrame, key: str | Sequence[str], train_ratio: float = 0.8,
              col: str = "side") -> DataFrame:
    """Add ``side`` = 'test' / 'train'; ``train_ratio`` is the training share."""
    return df.withColumn(col, F.when(is_test(key, train_ratio), "test").otherwise("train"))


def holdout_split(df: DataFrame, key: str | Sequence[str],
                  train_ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(train, test); rows sharing a key stay on one side."""
    test = is_test(key, train_ratio)
    return df.where(~test), df.where(test)


def with_folds(df: DataFrame, key: str | Sequence[str], folds: int,
               col: str = "fold") -> DataFrame:
    """Add an int fold column 0..folds-1 (for CrossValidator's foldCol)."""
    return df.withColumn(col, fold_of(key, folds))
