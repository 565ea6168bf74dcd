"""Row identity for tables without a key, and the row layout built on it.

A row is identified by its content and, as equal rows may repeat, by an occurrence number.
Equal rows are interchangeable, so numbering them needs no order: they are counted (with
partial counts on the map side, so a row that makes up a third of the table costs one
row per task) and numbered when the count is unfolded again.  The identity is the same
whatever the files, splits or partitions the rows arrive in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_KEY = "row_key"
#: Copies of one row that are unfolded where the count is; a few counts can stand for the whole table.
COPIES_IN_PLACE = 8
#: Copies of a more frequent row that go to a task together.
COPIES_AT_ONCE = 1 << 12
#: Rows of a partition of the layout at most, on average.
ROWS_A_PARTITION = 1 << 18


def content_text(columns: Sequence[str]) -> Column:
    """Cells as one text that no other row has: each with its length, a null as ``-``."""
    cells = []
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text),
                                F.lit("-")))
    return F.concat(*cells) if cells else F.lit("")


def with_row_key(df: DataFrame, columns: Sequence[str] | None = None, name: str = ROW_KEY,
                 copies_at_once: int = COPIES_AT_ONCE) -> DataFrame:
    """``df`` with a text column ``name`` that is unique, and the same on every layout: md5 of
    the row's content and its occurrence number (0 for the first copy).

    ``columns``: those that make the content (default: all); rows that agree in them are
    copies, of which the others must then be functions.  Every row is kept, copies and
    nulls included.  One shuffle of distinct rows; counts above ``COPIES_IN_PLACE`` are cut into
    stretches and dealt to the session's number of shuffle partitions (given as a number, so that
    adaptive execution does not join tasks by the size of the counts), then unfolded.  Columns must
    be groupable (no maps); a negative zero counts, and comes back, as zero.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    own = list(columns if columns is not None else df.columns)
    rest = [c for c in df.columns if c not in own]
    taken = set(df.columns)
    count, chunk, copy = (next(x for x in (f"_{w}{'_' * k}" for k in range(99)) if x not in taken)
                          for w in ("count", "chunk", "copy"))
    grouped = df.groupBy(*[F.col(f"`{c}`") for c in own]).agg(
        F.count(F.lit(1)).alias(count), *[F.first(f"`{c}`").alias(c) for c in rest])
    in_place = min(COPIES_IN_PLACE, copies_at_once)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = grouped.where(F.col(count) <= in_place).withColumn(
        copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    first = F.col(chunk) * copies_at_once
    many = (grouped.where(F.col(count) > in_place)
            .withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"),
                                                    F.floor((F.col(count) - 1) / copies_at_once))))
            .repartition(tasks, *[F.col(f"`{c}`") for c in own], F.col(chunk))
            .withColumn(copy, F.explode(F.sequence(
                first, F.least(first + copies_at_once, F.col(count)) - 1)))
            .drop(chunk))
    rows = few.unionByName(many)
    key = F.md5(F.concat(content_text(own), F.lit("#"), F.col(copy).cast("string")))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], key.alias(name))


def canonical_layout(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """The rows in ``partitions`` partitions by a hash of ``key``, each in order of it.

    With a unique key every input layout, core count and retry gives the same partitions
    with the same rows in the same order, which is what an algorithm that samples per
    partition needs to repeat its result.  One shuffle; a number given by the caller is not
    changed by adaptive execution.
    """
    if partitions < 1:
        raise ValueError(f"partitions must be at least 1, got {partitions}")
    return df.repartition(partitions, F.col(key)).sortWithinPartitions(key)


def layout_partitions(df: DataFrame, least: int) -> int:
    """Partitions of the layout: ``least``, or as many more as keep ``ROWS_A_PARTITION`` rows in each.
    A function of the number of rows alone, so the layout stays independent of files and cores."""
    if least < 1:
        raise ValueError(f"partitions must be at least 1, got {least}")
    return max(least, -(-df.count() // ROWS_A_PARTITION))
