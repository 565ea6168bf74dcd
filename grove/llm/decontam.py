"""Benchmark decontamination by Wu-Manber search over words.

Every run of ``window`` consecutive item words is a pattern (a shorter item is one
pattern).  Patterns of one length share a table: the *shift* of a block of two
words says how far a text cursor may jump before a pattern can end there; a block
with shift 0 may end a pattern, its hash selects a bucket of patterns, and a
direct comparison of all words confirms the occurrence.

Inside a task many texts are searched at once: each text is cut into lanes, every
lane holds one cursor, and a numpy round moves all cursors by their own shifts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import ranges, slices, split_alnum, with_text

WINDOW = 10
#: Shift table entries per pattern length; a collision only makes a shift smaller.
TABLE_BITS = 18
#: Cursor lanes start this many words apart.
LANE = 128
#: Most item words that one pass broadcasts; more items are searched in blocks.
BLOCK_WORDS = 2_000_000

RESULT = "n_words long, n_hit long, n_items long, items array<string>"


def _block_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
             + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class Table:
    """Wu-Manber table for patterns of ``m`` words (rows of ``words``)."""

    m: int
    words: np.ndarray        # pattern x m word numbers
    shift: np.ndarray        # by block hash
    bucket: np.ndarray       # block hash of each pattern's last block, ascending
    order: np.ndarray        # pattern of each bucket entry

    @classmethod
    def build(cls, words: np.ndarray) -> "Table":
        n, m = words.shape
        size = min(2, m)
        shift = np.full(1 << TABLE_BITS, m - size + 1, dtype=np.int64)
        last = None
        for end in range(size - 1, m):
            h = _block_hash(words[:, end - size + 1], words[:, end])
            np.minimum.at(shift, h, m - 1 - end)
            last = h
        order = np.argsort(last, kind="stable")
        return cls(m, words, shift, last[order], order)

    def search(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(start position, pattern) of every occurrence in the texts
        ``text[starts[i]:ends[i]]``."""
        m, size = self.m, min(2, self.m)
        count = np.maximum(ends - starts - m + 1, 0)      # positions a pattern can start at
        lanes = -(-count // LANE)
        first = np.repeat(starts, lanes) + LANE * (ranges(np.zeros_like(lanes), lanes))
        cursor = first + m - 1                            # where a pattern would end
        stop = np.minimum(cursor + LANE, np.repeat(ends, lanes))
        found = []
        while cursor.size:
            h = _block_hash(text[cursor - size + 1], text[cursor])
            jump = self.shift[h]
            hit = jump == 0
            if hit.any():
                found.append((cursor[hit], h[hit]))
                jump[hit] = 1
            cursor = cursor + jump
            alive = cursor < stop
            cursor, stop = cursor[alive], stop[alive]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate([f[0] for f in found]) - m + 1
        h = np.concatenate([f[1] for f in found])
        lo, hi = np.searchsorted(self.bucket, h, "left"), np.searchsorted(self.bucket, h, "right")
        at = np.repeat(at, hi - lo)
        pattern = self.order[ranges(lo, hi - lo)]
        for k in range(m):                                # direct comparison, word by word
            same = text[at + k] == self.words[pattern, k]
            at, pattern = at[same], pattern[same]
        return at, pattern


class Searcher:
    """All patterns of a block of items: word numbers, tables, and who owns a pattern."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, list[int]]] = {}
        self.items = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in split_alnum(text)]
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(w[i:i + m]), []).append(k)
        self.tables = []
        for m, owners in sorted(by_length.items()):
            self.tables.append((Table.build(np.array(list(owners), dtype=np.int64).reshape(-1, m)),
                                [sorted(set(v)) for v in owners.values()]))

    def scan(self, texts: list[bytes | None]):
        """Per text: word count, start and end of each occurrence, names of the items found."""
        get = self.vocab.get
        flat: list[int] = []
        bounds = [0]
        for t in texts:
            flat.extend([get(w, 0) for w in split_alnum(t)])
            bounds.append(len(flat))
        text = np.array(flat, dtype=np.int64)
        bound = np.array(bounds, dtype=np.int64)
        found: dict[int, tuple[list, set]] = {}
        for table, owners in self.tables:
            at, pattern = table.search(text, bound[:-1], bound[1:])
            row = np.searchsorted(bound, at, "right") - 1
            for r, a, p in zip(row.tolist(), at.tolist(), pattern.tolist()):
                spans, names = found.setdefault(r, ([], set()))
                spans.append((a - bounds[r], a - bounds[r] + table.m))
                names.update(owners[p])
        return np.diff(bound), found


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int
            ) -> list[list[tuple[str | None, bytes]]]:
    """Item texts in blocks of at most ``limit`` words each (one longer item is a block).

    A benchmark is a stated set of test items, not a corpus; its rows stream to the
    driver partition by partition.
    """
    out: list[list[tuple[str, bytes]]] = []
    room = 0
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where(
        F.col("t").isNotNull())
    for r in rows.toLocalIterator():
        raw = r["t"].encode()
        n = len(split_alnum(raw))
        if not n:
            continue
        if n > room:
            out.append([])
            room = max(limit, n)
        out[-1].append((r["i"], raw))
        room -= n
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                       item: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       block_words: int = BLOCK_WORDS, keep: tuple[str, ...] | None = None
                       ) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) plus n_words, n_hit, n_items (long),
    items (ascending array of item ids as strings) and contaminated.

    A word is hit if it lies inside any occurrence of a pattern.  Null and empty texts
    have no words and no hits; items without words (or null text) have no
    patterns; items with a null id hit like others, count as one in n_items and are not in
    items; an empty benchmark hits nothing; equal items are all reported; repeated
    documents are separate rows; a column that clashes with a result column is
    replaced by it.  Patterns are broadcast in blocks of at most ``block_words`` item
    words; further blocks make further passes over the texts, whose spans are united.
    """
    result = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    names = [c for c in (keep if keep is not None else docs.columns) if c not in result]
    frame, inner = with_text(docs, names, text)
    blocks = _blocks(benchmark, item, item_text, block_words) or [[]]
    sc = docs.sparkSession.sparkContext
    pending = [sc.broadcast(b) for b in blocks]
    schema = frame.select(*names).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = None
        for batch, texts in slices(batches, inner):
            if searchers is None:
                searchers = [Searcher(b.value, window) for b in pending[:1]]
                if len(pending) > 1:      # one block's tables are held at a time
                    searchers = [None] * len(pending)
            spans: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            words = None
            for k, s in enumerate(searchers):
                s = s or Searcher(pending[k].value, window)
                words, found = s.scan(texts)
                for r, (sp, nm) in found.items():
                    spans[r] += sp
                    items[r].update(s.items[i] for i in nm)
            listed = [sorted(x - {None}) for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(words, pa.int64()),
                   pa.array([_covered(x) for x in spans], pa.int64()),
                   pa.array([len(x) for x in items], pa.int64()),
                   pa.array(listed, pa.list_(pa.string()))],
                names=names + ["n_words", "n_hit", "n_items", "items"])

    found = frame.mapInArrow(run, f"{fields}{', ' if fields else ''}{RESULT}")
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def items_digest(items: str = "items"):
    """sha256 of the item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", F.col(items)).cast("binary"), 256)


def brute_force(texts: list[str | None], items: list[tuple[str, str]], window: int = WINDOW):
    """Plain double loop for tests: (n_words, n_hit, items, digest) per text."""
    out = []
    for t in texts:
        w = split_alnum(None if t is None else t.encode())
        hit, names = set(), set()
        for name, it in items:
            p = split_alnum(it.encode())
            m = min(window, len(p))
            for i in range(len(p) - m + 1 if m else 0):
                for j in range(len(w) - m + 1):
                    if w[j:j + m] == p[i:i + m]:
                        hit.update(range(j, j + m))
                        names.add(name)
        names = sorted(names)
        out.append((len(w), len(hit), names, hashlib.sha256(",".join(names).encode()).hexdigest()))
    return out
