"""Periodic runs of words by internal pattern matching.

A run is a maximal stretch whose smallest period ``q`` fits into it ``MIN_EXPONENT`` times or
more.  Inside a task the texts of a slice form one sequence in which every text has symbols of
its own, and every text ends with a sentinel of its own, so nothing matches across texts:

* prefix doubling gives the suffix array and, for each level, the rank of the block of
  ``2^level`` words that starts at a position; equal blocks are one interval of the array;
* for each block of a dyadic grid, a wavelet matrix over the suffix array answers the range
  successor and predecessor of its position: its nearest occurrences to the right and left;
* occurrences of a block of ``L`` words at a distance of at most ``L`` form a progression, whose
  difference is a period of what they cover: a candidate.  A run of period ``q`` holds a grid
  block of the smallest ``L >= q`` whose neighbour occurrence, too, lies inside the run, and
  that occurrence is ``q`` away, as a smaller distance would be a smaller period;
* the ranks of all levels extend a candidate to its maximal stretch in ``log`` steps.

Every step is a numpy pass over all queries of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grove.llm.common import WordIndex, free_names, offsets, ranges, slices

#: The block grid finds every run of at least this exponent.
MIN_EXPONENT = 4
MIN_LENGTH = 6
#: Text bytes whose suffix array is built at once; one longer text makes its own.
SLICE_BYTES = 1 << 20

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)),
    T.StructField("collapsed", T.StringType())])


class SuffixRanks:
    """Suffix array of a sequence, and for each level the first place of a position's block
    in it (``ranks[level]``) and the size of the block's interval (``sizes[level]``, 1 where
    the block has no other occurrence)."""

    def __init__(self, symbols: np.ndarray):
        n = symbols.size
        order = np.argsort(symbols, kind="stable")
        s = symbols[order]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])[:n])
        count = np.diff(np.append(head, n))
        rank, size = np.empty(n, np.int32), np.empty(n, np.int32)
        rank[order] = np.repeat(head, count)
        size[order] = np.repeat(count, count)
        self.order, self.ranks, self.sizes = order, [rank], [size]
        live = order[np.repeat(count, count) > 1]       # by rank: an interval's members adjoin
        step = 1
        while live.size:
            rank, size = self.ranks[-1], self.sizes[-1]
            second = rank[live + step]                  # inside the text: a live block ends in it
            live = live[np.argsort(rank[live].astype(np.int64) * n + second, kind="stable")]
            first, second = rank[live], rank[live + step]
            new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            outer = np.concatenate([[True], first[1:] != first[:-1]])
            at = np.arange(live.size)
            start = np.maximum.accumulate(np.where(outer, at, 0))
            group = np.flatnonzero(new)
            count = np.diff(np.append(group, live.size))
            order[first + (at - start)] = live
            rank, size = rank.copy(), size.copy()
            rank[live] = first + (np.repeat(group, count) - start)
            size[live] = np.repeat(count, count)
            self.ranks.append(rank)
            self.sizes.append(size)
            live = live[np.repeat(count, count) > 1]
            step *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols from i and j on (i < j)."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            last = rank.size - 1
            same = (j <= last) & (rank[np.minimum(i, last)] == rank[np.minimum(j, last)])
            i += same << level
            j += same << level
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols before i and j (i < j), these left out."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, width = self.ranks[level], 1 << level
            a, b = i - width, j - width
            same = (a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])
            i -= same << level
            j -= same << level
        return start - i


class WaveletMatrix:
    """Rank and selection by value in intervals of an array of numbers below its size."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.size - 1).bit_length())
        self.zeros = []                                 # per bit: zeros before each place
        cur = values.astype(np.int32)
        for bit in range(self.bits - 1, -1, -1):
            one = (cur >> bit) & 1
            zeros = np.zeros(cur.size + 1, np.int32)
            np.cumsum(1 - one, out=zeros[1:])
            self.zeros.append(zeros)
            one = one.astype(bool)
            cur = np.concatenate([cur[~one], cur[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers of places lo..hi-1 are below ``value``."""
        count = np.zeros(lo.size, np.int32)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1)):
            a, b = zeros[lo], zeros[hi]
            one = (value >> bit) & 1 == 1
            count += np.where(one, b - a, 0)
            lo = np.where(one, zeros[-1] + lo - a, a)
            hi = np.where(one, zeros[-1] + hi - b, b)
        return count

    def select(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number of rank ``k`` (from 0) among places lo..hi-1."""
        value = np.zeros(lo.size, np.int32)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1)):
            a, b = zeros[lo], zeros[hi]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            value |= one.astype(np.int32) << bit
            lo = np.where(one, zeros[-1] + lo - a, a)
            hi = np.where(one, zeros[-1] + hi - b, b)
        return value


def _candidates(sa: SuffixRanks, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period): grid blocks and the distance to their nearest occurrences."""
    wavelet = WaveletMatrix(sa.order)
    at, period = [], []
    for level in range(len(sa.ranks)):
        width = 1 << level
        if width > max(1, 2 * longest // MIN_EXPONENT):
            break
        x = np.arange(0, sa.order.size, width, dtype=np.int32)
        x = x[sa.sizes[level][x] > 1]
        lo = sa.ranks[level][x]
        hi = lo + sa.sizes[level][x]
        before = wavelet.below(lo, hi, x)
        for has, k, sign in ((before + 1 < hi - lo, before + 1, 1), (before > 0, before - 1, -1)):
            y = wavelet.select(lo[has], hi[has], k[has])
            far = sign * (y - x[has])
            near = (far <= width) & (far > width // 2)
            at.append(np.minimum(x[has], y)[near])
            period.append(far[near])
    return np.concatenate(at), np.concatenate(period)


def runs_of(words: np.ndarray, bound: np.ndarray, min_exponent: int = MIN_EXPONENT,
            min_length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run of the texts ``words[bound[i]:bound[i+1]]``,
    by text, start and period."""
    count = np.diff(bound)
    if min_exponent < MIN_EXPONENT:
        raise ValueError(f"the block grid finds runs of exponent {MIN_EXPONENT} and over")
    none = (np.zeros(0, np.int64),) * 4
    if not words.size:
        return none
    texts = np.arange(count.size)
    first = bound[:-1] + texts                           # places, with a sentinel after each text
    symbols = np.empty(words.size + texts.size, np.int64)
    span = int(words.max()) + 2
    symbols[ranges(first, count)] = words + 1 + np.repeat(texts * span, count)
    symbols[first + count] = texts * span
    sa = SuffixRanks(symbols)
    at, period = _candidates(sa, int(count.max()))
    if not at.size:
        return none
    at, period = at.astype(np.int64), period.astype(np.int64)
    start = at - sa.backward(at, at + period)
    length = at + period + sa.forward(at, at + period) - start
    long = length >= np.maximum(min_length, min_exponent * period)
    found = np.unique(np.stack([start[long], period[long], length[long]], axis=1), axis=0)
    start, period, length = found.T
    text = np.searchsorted(first, start, "right") - 1
    return text, start - first[text], length, period


def find_runs(docs: DataFrame, text: str = "text", min_exponent: int = MIN_EXPONENT,
              min_length: int = MIN_LENGTH, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) plus n_words (long), runs (array of start,
    length and period in words, by start, then period) and collapsed (the words outside
    runs and the first period of each run, joined by one space).

    Words are what stands between white space of ASCII.  A run has the smallest period ``q``,
    at least ``max(min_length, min_exponent * q)`` words (``min_exponent`` 4 or over) and no
    neighbouring word with the same period.  Null, empty and wordless texts have no words, no runs and
    an empty ``collapsed``; repeated rows and rows without a key are judged each for itself;
    an empty table gives no rows; a column that clashes with a result column is replaced by it.
    Narrow: no shuffle.  A slice of ``SLICE_BYTES``, or one longer text, takes about 200 bytes
    of memory a word.
    """
    if min_exponent < MIN_EXPONENT:
        raise ValueError(f"the block grid finds runs of exponent {MIN_EXPONENT} and over")
    result = [f.name for f in RESULT.fields]
    names = [c for c in (keep if keep is not None else docs.columns) if c not in result]
    (inner,) = free_names(names, "_text")
    frame = docs.select(*[F.col(c) for c in names], F.col(text).cast("string").alias(inner))
    schema = T.StructType(frame.select(*names).schema.fields + RESULT.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, inner, SLICE_BYTES):
            split = [[] if t is None else t.split() for t in texts]
            words = [w for ws in split for w in ws]
            bound = offsets([len(ws) for ws in split])
            row, start, length, period = runs_of(WordIndex().numbers(words), bound,
                                                 min_exponent, min_length)
            fall = np.zeros(len(words) + 1, np.int64)
            np.add.at(fall, bound[row] + start + period, 1)
            np.add.at(fall, bound[row] + start + length, -1)
            dropped = np.cumsum(fall)[:-1] > 0
            some = set(row.tolist())
            collapsed = [b" ".join(ws) if i not in some else
                         b" ".join([w for w, d in zip(ws, dropped[a:b].tolist()) if not d])
                         for i, (ws, a, b) in enumerate(zip(split, bound[:-1], bound[1:]))]
            runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in
                                               (start, length, period)],
                                              names=["start", "length", "period"])
            cuts = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(np.diff(bound), pa.int64()), pa.ListArray.from_arrays(cuts, runs),
                   pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=names + result)

    return frame.mapInArrow(run, schema)


def repeat_tail(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents whose ``crc32`` of the key is divisible by 10, with a periodic tail: with
    ``g = crc32 // 10`` and ``n`` words, word ``i >= a`` becomes word ``a + (i - a) % p``,
    where ``a = g % n`` and ``p = 1 + (n - a) // (3 + g % 8)``.  Other rows, rows without a key and
    texts without words stay as they are."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    turns = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), turns)), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.withColumn(text, F.when((h % 10 == 0) & (n > 0), changed).otherwise(F.col(text)))


def run_digest(runs: str = "runs") -> Column:
    """sha256 of the runs, one ``start,length,period`` line each."""
    line = F.transform(F.col(runs), lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.sha2(F.array_join(line, ""), 256)


def most_periodic(runs: str = "runs") -> Column:
    """The run of greatest exponent (length / period, compared exactly); of equal ones the
    first by start, then period; null without runs."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(F.col(runs), none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
    ).otherwise(best))
