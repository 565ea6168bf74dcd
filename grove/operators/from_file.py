"""From a delimited file to a model.

The file is read as text and cast by an explicit rule: the target to a number (or kept as a
text class), every feature to double, so that a malformed number fails the job (or becomes a
null, if tolerant).  A file without a key is split by the identity of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from grove.operators.dataset import Fixture, feature_columns
from grove.operators.forest import ForestOptions, TrainResult, train
from grove.operators.identity import ROW_KEY, with_row_key
from grove.sources.delimited import as_doubles, read_table, same_columns


def file_rows(spark: SparkSession, path: str | Sequence[str], target: str | None = None,
              task: str = "regression", key: Sequence[str] = (), ignore: Sequence[str] = (),
              sep: str = ";", header: bool = True, repeated_header: bool = False,
              tolerant: bool = False, positive: object | None = None,
              text_class: bool = False) -> Fixture:
    """The rows of a file as training rows.

    ``target``: by name; default: the first column.  ``key``: columns that name a row's side
    of the split (not features); default: none, and every row gets ``row_key``, its identity.
    ``text_class``: a multiclass target is kept as text.  Other columns but ``ignore`` are features.
    """
    raw = read_table(spark, path, sep=sep, header=header, infer=False,
                     repeated_header=repeated_header)
    target = target or raw.columns[0]
    if target not in raw.columns:
        raise ValueError(f"no column {target} among {raw.columns}")
    features = feature_columns(raw, target, [*key, *ignore])
    own = [*key, target, *features]
    rows = raw.select(*[F.col(f"`{c}`") for c in own])
    if not key:
        rows = with_row_key(rows)           # of the text that the file holds
        key = [ROW_KEY]
    numbers = features + ([] if text_class or positive is not None else [target])
    return Fixture(as_doubles(rows, numbers, tolerant), target, features, list(key), task,
                   positive=positive, extra={"as_many": raw})


def external_rows(fx: Fixture, spark: SparkSession, path: str | Sequence[str], sep: str = ";",
                  header: bool = True, repeated_header: bool = False,
                  tolerant: bool = False) -> Fixture:
    """A second file as validation rows of ``fx``: its target and features by the first
    file's names and types (A7); missing ones are refused."""
    raw = read_table(spark, path, sep=sep, header=header, infer=False,
                     repeated_header=repeated_header)
    same_columns(fx.frame, raw, ignore=fx.key)
    rows = raw.select(*[F.col(f"`{c}`") for c in [fx.target, *fx.features]])
    numbers = [c for c in rows.columns if dict(fx.frame.dtypes)[c] == "double"]
    return replace(fx, frame=as_doubles(rows, numbers, tolerant))


def train_from_file(spark: SparkSession, path: str | Sequence[str],
                    opts: ForestOptions = ForestOptions(), train_ratio: float = 0.8,
                    external_path: str | Sequence[str] | None = None, refit: bool = True,
                    folds: int = 3, **reading) -> TrainResult:
    """Read, split, fit, judge and refit in one call; a grid in ``opts`` is tuned by ``folds``.

    With ``external_path`` all rows of the first file train and the second judges.
    ``reading``: options of ``file_rows``.
    """
    fx = file_rows(spark, path, **reading)
    external = None
    if external_path is not None:
        same = {k: v for k, v in reading.items()
                if k in ("sep", "header", "repeated_header", "tolerant")}
        external = external_rows(fx, spark, external_path, **same)
    return train(fx, opts, train_ratio=train_ratio, refit=refit, external=external, folds=folds)

