"""Persistence and exports.

Models are written with Spark ML's writer to any Hadoop path (overwrite mode
replaces an older model of the same id, on every filesystem, instead of a
driver-local delete).  Exports are distributed CSV writes: no rows pass
through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame

from grove.sources.delimited import write_delimited


def save_model(model: PipelineModel, path: str) -> str:
    """Fitted pipeline (assembler, forest, ...) to ``path``, replacing it."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """B6."""
    return PipelineModel.load(path)


def save_pipeline(pipeline: Pipeline, path: str) -> str:
    """The unfitted pipeline beside the model, for retraining."""
    pipeline.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> Pipeline:
    """B7."""
    return Pipeline.load(path)


def save_tuned(result, path: str) -> str:
    """The final model of a training result (else the training side's), and beside it the
    pipeline it came from: one unfitted estimator at the chosen setting."""
    save_model(result.final or result.model, f"{path.rstrip('/')}/model")
    save_pipeline(result.pipeline, f"{path.rstrip('/')}/pipeline")
    return path


def load_tuned(path: str) -> tuple[PipelineModel, Pipeline]:
    """(model, pipeline) that ``save_tuned`` wrote; ``pipeline.fit`` retrains."""
    return load_model(f"{path.rstrip('/')}/model"), load_pipeline(f"{path.rstrip('/')}/pipeline")


def export_split(train: DataFrame, test: DataFrame, path: str, columns: Sequence[str],
                 sep: str = ";") -> dict[str, str]:
    """B1: training and test rows as ``;`` CSV with header, label first."""
    out = {}
    for side, df in (("training", train), ("test", test)):
        out[side] = write_delimited(df.select(*columns), f"{path.rstrip('/')}/{side}", sep=sep)
    return out
