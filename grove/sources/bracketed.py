"""Scoring text without a header: ``[1.5;2;3]`` per line.

Parsed with built-in expressions only (strip brackets, split, cast each
element), so the parse stays in generated JVM code; no Python per row.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bracketed_values(line: Column, sep: str = ";") -> Column:
    """Array<double> of one line; ``[`` and ``]`` anywhere are removed."""
    stripped = F.regexp_replace(line, r"[\[\]]", "")
    parts = F.split(F.trim(stripped), r"\Q" + sep + r"\E")
    return F.transform(parts, lambda x: F.trim(x).cast("double"))


#: Where a line stands: its file, the offset of the read block in it, the line in the block.
LINE_KEY = ["file", "block", "line"]


def keyed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and ``LINE_KEY`` of every line below ``path``.

    Row ids ascend within a task in file order, so a line's place in its block is its id less
    the least id of the block: one small row per block, joined back.  The key is the same on every
    run that cuts the files into the same blocks (``spark.sql.files.maxPartitionBytes``); the lines
    are not moved.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"))
    first = lines.groupBy("file", "block").agg(F.min("_id").alias("_first"))
    return lines.join(first, ["file", "block"]).select(
        "file", "block", (F.col("_id") - F.col("_first")).alias("line"), "value")


def parse_bracketed(spark: SparkSession, path: str, sep: str = ";",
                    as_vector: bool = True, keyed: bool = False) -> DataFrame:
    """Every value of a line is a feature: ``values`` (array) and ``features`` (vector).

    ``target`` (A9) is the first value of the line, for files that carry it.  ``keyed``: with
    ``LINE_KEY``, which joins results back to the lines.  Blank lines are left out.
    """
    lines = keyed_lines(spark, path) if keyed else spark.read.text(path)
    lines = lines.where(F.length(F.trim("value")) > 0)
    out = lines.select(*(LINE_KEY if keyed else []),
                       bracketed_values(F.col("value"), sep).alias("values"))
    out = out.withColumn("target", F.col("values")[0])
    if as_vector:
        out = out.withColumn("features", array_to_vector(F.col("values")))
    return out
