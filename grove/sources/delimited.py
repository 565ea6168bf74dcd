"""Delimited text sources.

The reference reads ``;``-separated files with a header, inferred types and
empty strings as nulls, either by name (target column chosen by name) or by
position (column 0 is the label).  Here every variant is a DataFrame scan:
the CSV reader splits files across tasks, casts are built-in expressions, and
checks are expressions that fail the task (``raise_error``), not driver loops.
At scale pass ``schema``: inference costs one extra pass over the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grove.sources.tables import spread


def read_table(spark: SparkSession, path: str | Sequence[str], sep: str = ";",
               header: bool = True, schema: T.StructType | str | None = None,
               infer: bool = True, null_value: str = "", partitions: int | None = None,
               repeated_header: bool = False) -> DataFrame:
    """A1 (+A5, A6): scan a delimited table.

    ``repeated_header``: copies of the header line inside the data (the
    reference drops *every* line equal to the first) are removed before types
    are decided.  ``partitions``: deal the rows to so many tasks.
    """
    reader = spark.read.options(sep=sep, header=str(header).lower(), nullValue=null_value,
                                mode="FAILFAST")
    paths = list(path) if isinstance(path, (list, tuple)) else [path]
    if repeated_header and header:
        raw = drop_header_copies(reader.options(inferSchema="false").csv(paths))
        if schema is None and infer:
            schema = infer_types(raw)
        df = raw if schema is None else apply_schema(raw, schema)
    elif schema is not None:
        df = reader.schema(schema).csv(paths)
    else:
        df = reader.options(inferSchema=str(infer).lower()).csv(paths)
    return spread(df, partitions)


def drop_header_copies(df: DataFrame) -> DataFrame:
    """A5: drop rows whose every value equals its column name."""
    is_header = F.lit(True)
    for c in df.columns:
        is_header = is_header & (F.col(f"`{c}`") == F.lit(c))
    return df.where(~F.coalesce(is_header, F.lit(False)))


#: Types of inferred columns, narrowest first, with the cast that decides them (fixed values:
#: the order in which Spark's own CSV inference tries them).
_LADDER = ("int", "bigint", "double", "date", "timestamp", "boolean")
_INTEGRAL = r"^[+-]?[0-9]{1,19}$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def infer_types(df: DataFrame) -> T.StructType:
    """Types of text columns as Spark's CSV inference gives them, in one aggregate: the
    first of int, bigint, double, date, timestamp and boolean that every value but null
    has; else, and without any value, text.

    Patterns stand before the casts that would raise an error per value.
    """
    checks = []
    for i, c in enumerate(df.columns):
        v = F.trim(F.col(f"`{c}`"))
        digits = v.rlike(_INTEGRAL)
        date = v.rlike(_DATE)
        fits = {
            "int": digits & v.try_cast("int").isNotNull(),
            "bigint": digits & v.try_cast("bigint").isNotNull(),
            "double": digits | v.try_cast("double").isNotNull(),
            "date": date & v.try_cast("date").isNotNull(),
            "timestamp": v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]") & v.try_cast("timestamp").isNotNull(),
            "boolean": F.lower(v).isin("true", "false"),
        }
        checks += [F.bool_and(v.isNull() | F.coalesce(fits[t], F.lit(False))).alias(f"_{i}_{t}")
                   for t in _LADDER]
        checks.append(F.count(v).alias(f"_{i}_n"))
    row = df.agg(*checks).first()

    def kind(i: int) -> str:
        return next((t for t in _LADDER if row[f"_{i}_n"] and row[f"_{i}_{t}"]), "string")

    return T.StructType([T.StructField(c, T._parse_datatype_string(kind(i)), True)
                         for i, c in enumerate(df.columns)])


def apply_schema(df: DataFrame, schema: T.StructType | str, tolerant: bool = False) -> DataFrame:
    """Cast text columns by name to a schema; ANSI cast fails on bad text unless tolerant."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    cast = (lambda c, t: c.try_cast(t)) if tolerant else (lambda c, t: c.cast(t))
    return df.select(*[cast(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields])


def cast_target(df: DataFrame, target: str, tolerant: bool = False) -> DataFrame:
    """A2: the target column as double (null instead of an error when tolerant)."""
    col = F.col(f"`{target}`")
    return df.withColumn(target, col.try_cast("double") if tolerant else col.cast("double"))


def as_doubles(df: DataFrame, columns: Sequence[str], tolerant: bool = False) -> DataFrame:
    """The named columns as double; text that is no number fails, or is null when tolerant."""
    own = set(columns)

    def cell(c: str) -> Column:
        v = F.col(f"`{c}`")
        if c not in own:
            return v
        return (v.try_cast("double") if tolerant else v.cast("double")).alias(c)

    return df.select(*[cell(c) for c in df.columns])


def positional_label(df: DataFrame, label: str = "label",
                     tolerant: bool = False) -> tuple[DataFrame, list[str]]:
    """A3: column 0 is the label (renamed ``label``), the rest are features; all as double."""
    first, *rest = df.columns
    out = as_doubles(df, df.columns, tolerant)
    return out.select(F.col(f"`{first}`").alias(label), *[F.col(f"`{c}`") for c in rest]), rest


def checked_class_label(col: Column, n_classes: int | None = None) -> Column:
    """A4: a class label that must be an integer 0..k-1; fails the task otherwise."""
    v = col.cast("double")
    bad = v.isNull() | (v < 0) | (v != F.floor(v))
    if n_classes is not None:
        bad = bad | (v >= n_classes)
    return F.when(bad, F.raise_error(F.concat(F.lit("class label not in 0..k-1: "),
                                              col.cast("string")))).otherwise(v)


def class_label_scan(df: DataFrame, n_classes: int | None = None,
                     label: str = "label") -> tuple[DataFrame, list[str]]:
    """A4: positional scan whose label is a checked class index; features as double."""
    first, *rest = df.columns
    out = as_doubles(df, rest).select(
        checked_class_label(F.col(f"`{first}`"), n_classes).alias(label),
        *[F.col(f"`{c}`") for c in rest])
    return out, rest


def same_columns(train: DataFrame, other: DataFrame, ignore: Sequence[str] = ()) -> None:
    """An external validation file must carry the training columns."""
    missing = [c for c in train.columns if c not in other.columns and c not in ignore]
    if missing:
        raise ValueError(f"validation table lacks columns {missing}")


def write_delimited(df: DataFrame, path: str, sep: str = ";", header: bool = True,
                    mode: str = "overwrite") -> str:
    """Distributed CSV write (one file per partition, each with its header)."""
    df.write.mode(mode).options(sep=sep, header=str(header).lower(), nullValue="").csv(path)
    return path
