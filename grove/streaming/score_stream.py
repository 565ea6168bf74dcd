"""Scoring a stream of files with a saved pipeline.

Scoring is a per-row projection, so the batch ``score`` applies unchanged to
a streaming DataFrame: no state, no watermark.  Progress and exactly-once
output are kept by the checkpoint, which must sit in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from grove.operators.score import score


def score_stream(spark: SparkSession, model: PipelineModel, source: str,
                 schema: T.StructType, sink: str, checkpoint: str,
                 keep: Sequence[str] = (), fmt: str = "parquet",
                 available_now: bool = True, max_files: int | None = None) -> StreamingQuery:
    """Read new ``fmt`` files under ``source``, score them, append to ``sink``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    scored = score(model, reader.load(source), keep=keep)
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("path", sink).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
