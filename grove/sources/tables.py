"""Parquet tables of a data folder (one ``<name>.parquet`` per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, data_dir: str, name: str,
          partitions: int | None = None) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it.

    ``partitions`` (A6): deal the rows to so many tasks, for CPU-heavy work on a file that
    cannot be split.
    """
    df = spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
    return spread(df, partitions)


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """``df`` in ``partitions`` partitions (one round-robin shuffle), or as it is for None.

    The number is the caller's alone: nothing is read off the input or the cluster.  The
    deal is repeatable on retry (``spark.sql.execution.sortBeforeRepartition``).
    """
    return df if partitions is None else df.repartition(partitions)
