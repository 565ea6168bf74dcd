"""Helpers shared by the text operators: slicing Arrow batches, word lists, shared tables.

Text is handled as UTF-8 bytes inside Arrow tasks: ``bytes.split()`` without an
argument cuts exactly at ``\\x20 \\x09-\\x0D``, and ``bytes.translate`` lower-cases
A-Z and blanks ASCII punctuation without touching any non-ASCII byte.
"""

from __future__ import annotations

import ctypes
import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (binary_length)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grove.session import scratch_path

#: Text bytes handled at once inside a task; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
#: Those of operators that keep a word table, whose workers hold it beside the slice.
TABLE_SLICE_BYTES = 1 << 19

#: A-Z to a-z, every other ASCII byte outside 0-9a-z to a space, non-ASCII kept.
ALNUM_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
    else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256))
#: A-Z to a-z, everything else kept.
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A given table, pruned to the columns wanted."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


#: (operator, parameters, word table) that this Python worker keeps from task to task.
_TABLE: list = []
#: Words that a table keeps between tasks; an idle worker holds no more.
IDLE_WORDS = 50_000


def kept_table(operator: str, parameters, make):
    """What ``make`` builds, kept while the worker runs tasks of the same operator and
    parameters; the table of another operator is freed."""
    if _TABLE[:2] != [operator, parameters]:
        _TABLE.clear()
        _TABLE[:] = [operator, parameters, make()]
        return_memory()                 # what reading the vocabularies took
    return _TABLE[2]


def return_memory() -> None:
    """Give what has been freed back to the system: the allocators keep it otherwise, in every
    reused worker, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc alone has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES,
           table: str | None = None, idle: int = IDLE_WORDS) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut Arrow batches into runs of rows of about ``limit`` text bytes, each with
    its texts as bytes (None for null), so a task's working set does not follow
    the batch size.  The word table that another operator than ``table`` left in this reused
    worker is freed first; that of ``table`` is cut back to ``idle`` words at the end."""
    if _TABLE and _TABLE[0] != table:
        _TABLE.clear()
        return_memory()
    yield from _slices(batches, text, limit)
    if _TABLE:
        _TABLE[2].shrink(idle)
    return_memory()


def _slices(batches: Iterator[pa.RecordBatch], text: str, limit: int):
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        size = np.array([0 if x is None else x for x in pa.compute.binary_length(col).to_pylist()],
                        dtype=np.int64)
        block = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts], [*cuts, n]):
            a, b = int(a), int(b)
            yield batch.slice(a, b - a), col.slice(a, b - a).to_pylist()


def split_alnum(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return [] if text is None else text.translate(ALNUM_TABLE).split()


def offsets(lengths) -> np.ndarray:
    """0 and the running sums of the lengths."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i]+lengths[i]-1 of every i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class WordIndex(dict):
    """word -> number in order of appearance; ``fresh`` lists the words not seen before."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


class RecentWords:
    """A bounded word -> value table: two generations of at most ``limit`` words each.
    A word met again moves to the young one, so common words stay."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def shrink(self, words: int) -> None:
        """Keep the first ``words`` of the young generation: common words come early."""
        self.old = {}
        if len(self.young) > words:
            self.young = dict(islice(self.young.items(), words))

    def missing(self, split: list[list[bytes]]) -> list[bytes]:
        """Words of the texts that no generation holds; the others are young afterwards."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young = self.young
        fresh = {w for ws in split for w in ws if w not in young}
        old, out = self.old, []
        for w in fresh:
            v = old.get(w)
            if v is None:
                out.append(w)
            else:
                young[w] = v
        return out


def _distinct_pairs(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((row, value))
    value, row = value[order], row[order]
    new = np.ones(value.size, bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def _repeated(value: np.ndarray) -> np.ndarray:
    """Which of the ascending values stand there more than once."""
    same = value[1:] == value[:-1]
    out = np.zeros(value.size, bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def repeated_values(frame: DataFrame, text: str, pairs) -> DataFrame:
    """(row, value): the values that two different rows of ``frame`` have; a pair may come twice.

    ``pairs(batch, texts)`` gives the values of a slice of rows and the number of the row that
    each belongs to (both 64-bit).  A slice sends lists of its values to buckets of their
    range, twice as many as the session has shuffle partitions.  A value that several rows of
    the slice have is known to repeat: its rows are passed on by any task, and the bucket is told
    the value once, so no bucket grows with the rows of a frequent value.
    """
    buckets = 2 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            value, row = _distinct_pairs(*pairs(batch, texts))
            if not value.size:
                continue
            known = _repeated(value)
            bucket = value.view(np.uint64) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            out = []
            for b in range(buckets):
                at = order[cuts[b]:cuts[b + 1]]
                if at.size:
                    once = at[~known[at]]
                    out.append((b, value[once], row[once], np.unique(value[at[known[at]]])))
            anywhere = zlib.crc32(row.tobytes()) % buckets
            out.append((-1 - anywhere, value[known], row[known], value[:0]))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32())] + [pa.array(c, pa.list_(pa.int64())) for c in cols[1:]],
                names=["bucket", "values", "rows", "known"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts, passed=False):
            value, row = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            if not passed:
                value, row = _distinct_pairs(value, row)
                live = _repeated(value) | np.isin(value, np.concatenate([p[2] for p in parts]))
                value, row = value[live], row[live]
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(value)], names=["row", "value"])

        held, parts = None, []
        for batch in batches:
            cols = [batch.column(k) for k in range(4)]
            for i, b in enumerate(cols[0].to_pylist()):
                part = [c.values.slice(c.offsets[i].as_py(), len(c[i])).to_numpy() for c in cols[1:]]
                if b < 0:
                    yield found([part], passed=True)
                    continue
                if b != held and parts:
                    yield found(parts)
                    parts = []
                held = b
                parts.append(part)
        if parts:
            yield found(parts)

    packed = frame.mapInArrow(
        pack, "bucket int, values array<long>, rows array<long>, known array<long>")
    dealt = packed.repartition(F.expr("if(bucket < 0, -1 - bucket, bucket)"))
    return dealt.sortWithinPartitions("bucket").mapInArrow(meet, "row long, value long")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: the lineage
    is cut, and lost executors cost only the tasks that were running on them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def free_names(columns, *wanted: str) -> list[str]:
    """The wanted internal names, each lengthened until no input column has it (Spark
    compares names without case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_text(docs: DataFrame, names: list[str], text: str) -> tuple[DataFrame, str]:
    """``docs`` cut to the named columns and its text, and the name of the text's column there.
    A text among the named columns is not sent to Python a second time."""
    cols = [F.col(c) for c in names]
    if text in names and docs.schema[text].dataType == T.StringType():
        return docs.select(*cols), text
    (inner,) = free_names(names, "_text")
    return docs.select(*cols, F.col(text).cast("string").alias(inner)), inner


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on this machine (installed on every node);
    GROVE_TOKENIZERS names another folder."""
    folder = os.environ.get("GROVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def crc_bucket(col: str, n: int):
    """crc32 of the column's text form, modulo n (folds that any engine can repeat)."""
    return F.crc32(F.col(col).cast("string")) % F.lit(n)


def hash_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of the ``total`` rows, chosen by a hash of the key (the same ones
    on every run and layout), never more than twice as many."""
    span = 1 << 30
    share = min(span, -(-rows * span // max(total, 1)))
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(span)) < share).limit(2 * rows)
