"""What an operator needs to know about a table: its target, features, keys and task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Fixture:
    frame: DataFrame
    target: str
    features: list[str]
    key: list[str]                 # split and fold key; empty: the row's identity
    task: str                      # regression | binary | multiclass
    positive: object | None = None
    vector: str | None = None      # name of a ready array/vector feature column, if any
    extra: dict = field(default_factory=dict)  # as_many: a frame of as many rows, cheaper to count


def feature_columns(df: DataFrame, target: str, ignore: Sequence[str] = ()) -> list[str]:
    """All columns except the target and ignored ones, in file order."""
    drop = {target, *ignore}
    return [c for c in df.columns if c not in drop]
