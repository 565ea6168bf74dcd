"""Keyed buckets for splits and folds.

A row's side of the split and its fold are pure functions of its key, so they
do not move when the data is repartitioned, re-read or recomputed after an
executor is lost (unlike ``randomSplit``, whose result depends on the layout).
The digest is md5 because DuckDB computes the same one, which lets the oracle
reproduce every assignment; digits 1-8 decide the split, digits 9-16 the fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 10_000
#: Stands for a null key part, so that a null key has a side and a fold like any other.
NULL_KEY = "\x00null"


def _key_text(keys: str | Sequence[str]) -> Column:
    """Keys as text; several key columns are joined with '|'; a null part counts as
    NULL_KEY, so no row is lost and no part skipped."""
    if isinstance(keys, str):
        keys = [keys]
    parts = [F.coalesce(F.col(k).cast("string"), F.lit(NULL_KEY)) for k in keys]
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


def _digest_slice(keys: str | Sequence[str], start: int) -> Column:
    digest = F.md5(_key_text(keys))
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


def split_bucket(keys: str | Sequence[str]) -> Column:
    """Bucket 0..9999 of the key, from md5 digits 1-8."""
    return _digest_slice(keys, 1) % BUCKETS


def side_limit(train_ratio: float) -> int:
    """Buckets below this value are the test side."""
    if not 0.0 <= train_ratio <= 1.0:
        raise ValueError(f"train_ratio must be in [0, 1], got {train_ratio}")
    return int(round((1.0 - train_ratio) * BUCKETS))


def is_test(keys: str | Sequence[str], train_ratio: float) -> Column:
    return split_bucket(keys) < F.lit(side_limit(train_ratio))


def fold_of(keys: str | Sequence[str], folds: int) -> Column:
    """Fold 0..folds-1 of the key, from md5 digits 9-16 (independent of the split)."""
    if folds < 2:
        raise ValueError(f"folds must be >= 2, got {folds}")
    return (_digest_slice(keys, 9) % folds).cast("int")
