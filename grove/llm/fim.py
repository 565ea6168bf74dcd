"""Fill-in-the-middle transformation as a pyarrow.compute pipeline.

A text is cut into units (code points or lines) as one list array; the lists are flattened
with their parent indices, every unit gets its ordinal inside its text, a role (prefix,
middle or suffix) follows from the ordinal and the row's two cuts, and for each role the
units are filtered, gathered into lists again and joined.  The pieces of a row are then
joined with the sentinels in the order of its form.  Cuts and form depend on a seed and the
row's key alone, so a repeated or retried task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grove.llm.common import free_names

#: Sentinels before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Text bytes whose units are held at once; a longer text is cut and its pieces are joined.
CHUNK_BYTES = 1 << 20
UNITS = ("char", "line")

RESULT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType())])


def draws(key: str, seed: int) -> list[Column]:
    """Four numbers below 2^32 of every row: the first 8-digit groups of the hex sha256 of
    ``seed:key`` (a null key counts as the text ``null``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def check_markers(markers: Sequence[str]) -> None:
    """Three sentinels none of which can overlap or hold another, so that cutting a joined
    text at them is unambiguous."""
    if len(markers) != 3 or len(set(markers)) != 3 or not all(markers):
        raise ValueError(f"three different sentinels are needed, got {markers!r}")
    for a in markers:
        for b in markers:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} can overlap")


def _mod(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def unit_lists(texts: pa.Array, unit: str) -> pa.ListArray:
    """One list of unit strings per text; the units of a text joined are the text."""
    texts = pa.concat_arrays([texts])                    # drops the offset of a slice
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:][:len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[:bounds[-1]]
    if unit == "char":
        first = (data & 0xC0) != 0x80                    # the first byte of a code point
    else:
        first = np.zeros(data.size, bool)
        first[1:] = data[:-1] == 0x0A
        first[bounds[:-1][np.diff(bounds) > 0]] = True   # a text starts a unit
    at = np.flatnonzero(first)
    offsets = pa.py_buffer(np.append(at, data.size).astype(np.int32))
    units = pa.StringArray.from_buffers(at.size, offsets, texts.buffers()[2] or pa.py_buffer(b""))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds), pa.int32()), units)


def pieces(lists: pa.ListArray, first: pa.Array, lo: pa.Array, hi: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of every row whose units are ``lists``; the row's first unit
    has ordinal ``first``, its cuts are ``lo`` <= ``hi``."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    start = pc.subtract(pc.cast(lists.offsets.slice(0, len(lists)), pa.int64()), first)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(start, parent))
    before_lo = pc.less(ordinal, pc.take(lo, parent))
    before_hi = pc.less(ordinal, pc.take(hi, parent))
    out = []
    for role in (before_lo, pc.and_not(before_hi, before_lo), pc.invert(before_hi)):
        counts = np.bincount(pc.filter(parent, role).to_numpy(zero_copy_only=False),
                             minlength=len(lists))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        out.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(flat, role)), ""))
    return out


def _long_pieces(text: str, unit: str, lo: int, hi: int) -> list[pa.Array]:
    """``pieces`` of one long text, cut into stretches of whole units."""
    parts: list[list[str]] = [[], [], []]
    base = at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK_BYTES // 4)
        if unit == "line" and end < len(text):
            end = (text.find("\n", end - 1) + 1) or len(text)
        lists = unit_lists(pa.array([text[at:end]], pa.string()), unit)
        got = pieces(lists, *[pa.array([v], pa.int64()) for v in (base, lo, hi)])
        for part, piece in zip(parts, got):
            part.append(piece[0].as_py())
        base, at = base + len(lists.values), end
    return [pa.array(["".join(p)], pa.string()) for p in parts]


def transform_batch(texts: pa.Array, h: list[pa.Array], unit: str, fim_percent: int,
                    spm_percent: int, markers: Sequence[str]) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a batch of texts without nulls."""
    p, s, m = markers
    if len(texts) == 1 and len(texts[0].as_buffer()) > CHUNK_BYTES:
        text = texts[0].as_py()
        n = pa.array([len(text) if unit == "char"
                      else text.count("\n") + (not text.endswith("\n"))], pa.int64())
        lists = None
    else:
        lists = unit_lists(texts, unit)
        n = pc.cast(pc.list_value_length(lists), pa.int64())
    cuts = [_mod(x, pc.add(n, 1)) for x in h[:2]]
    lo, hi = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    hundred = pa.scalar(100, pa.int64())
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_mod(h[2], hundred), fim_percent))
    for marker in markers:
        plain = pc.or_(plain, pc.match_substring(texts, marker))
    spm = pc.less(_mod(h[3], hundred), spm_percent)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    prefix, middle, suffix = (pieces(lists, pa.array(np.zeros(len(texts), np.int64)), lo, hi)
                              if lists is not None else
                              _long_pieces(texts[0].as_py(), unit, lo[0].as_py(), hi[0].as_py()))
    psm_out = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")
    spm_out = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
    output = pc.if_else(plain, texts, pc.if_else(spm, spm_out, psm_out))
    null = pa.scalar(None, pa.int64())
    sizes = [pc.if_else(plain, null, pc.cast(pc.utf8_length(x), pa.int64()))
             for x in (prefix, middle)]
    return [n, form, *sizes, output]


def _row_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of rows of about CHUNK_BYTES; a longer text is alone."""
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:][:len(texts) + 1])
    a = total = 0
    for i, k in enumerate(size.tolist()):
        if i > a and total + k > CHUNK_BYTES:
            yield a, i - a
            a, total = i, 0
        total += k
    if len(size) > a:
        yield a, len(size) - a


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1,
                   fim_rate: float = 0.9, spm_rate: float = 0.2, unit: str = "char",
                   markers: Sequence[str] = MARKERS, keep: tuple[str, ...] | None = None
                   ) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) plus n (units, long), form (plain, psm or
    spm), prefix_chars, middle_chars (code points; null if plain) and output.

    A share ``fim_rate`` of the rows, chosen like the cuts by ``seed`` and ``key``, becomes
    prefix-suffix-middle, of these ``spm_rate`` suffix-prefix-middle; both rates count in
    hundredths.  Empty texts and texts that hold a sentinel stay plain; a null text is an empty
    one; a null key counts as the text ``null``; rows of one key share draws and repeated rows give repeated
    results; an empty table gives no rows; a column that clashes with a result column is
    replaced by it.  Narrow: no shuffle; units of at most ``CHUNK_BYTES`` bytes are held at
    once, also of a longer text (but for one longer line).
    """
    check_markers(markers)
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, got {unit!r}")
    percents = [round(100 * r) for r in (fim_rate, spm_rate)]
    if not all(0 <= v <= 100 for v in percents):
        raise ValueError("rates must lie in [0, 1]")
    result = [f.name for f in RESULT.fields]
    names = [c for c in (keep if keep is not None else docs.columns) if c not in result]
    inner = free_names(names, "_text", "_h1", "_h2", "_h3", "_h4")
    frame = docs.select(*[F.col(c) for c in names],
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias(inner[0]),
                        *[h.alias(c) for h, c in zip(draws(key, seed), inner[1:])])
    schema = T.StructType(frame.select(*names).schema.fields + RESULT.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            texts = at[inner[0]].cast(pa.string())
            for a, count in _row_slices(texts):
                cols = transform_batch(texts.slice(a, count),
                                       [at[c].slice(a, count) for c in inner[1:]],
                                       unit, *percents, markers)
                yield pa.RecordBatch.from_arrays(
                    [at[c].slice(a, count) for c in names] + cols, names=names + result)

    return frame.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form",
             markers: Sequence[str] = MARKERS) -> Column:
    """The text that ``fill_in_middle`` was given (null as empty), from its output and form."""
    check_markers(markers)
    part = F.split(F.col(output), "|".join(rf"\Q{m}\E" for m in markers), -1)
    return (F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
            .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1]))
            .otherwise(F.col(output)))
