"""Substring dedup with suffix automata of reference shards.

Documents are streamed word by word through suffix automata of what comes before them; the
matching statistic of a word is the length of the longest stretch ending there that the
automaton knows.  Where it reaches ``window`` words, the state says in which earliest document
the stretch stands, and every word of maximal spans that an earlier document has is removed.

The reference of a corpus is the corpus itself, so an automaton of all of it could neither be
broadcast nor searched by every document.  It is sharded by content instead, and each document
sends to a shard only the segments that can match there:

* every window of ``window`` words has an anchor, the least hash of its ``GRAM``-word grams.
  Equal windows have equal anchors; neighbouring windows mostly share one and make a segment;
* ``_live``: anchors that two documents have.  A slice of documents sends packed lists of
  its anchors to buckets of the hash range, an anchor that several of its documents have only
  once; the buckets return the anchors that other slices have too;
* ``_occurrences``: the text of segments with live anchors, most of the corpus is left out here;
* ``_first_documents``: distinct segments, dealt by anchor, are the reference shards.  A task
  builds the automaton of a shard in ascending order of documents and streams the shard's
  segments through it.  An anchor in more than ``HOT_SEGMENTS`` different segments is dealt by
  window instead, so no shard grows with the frequency of an anchor;
* the removed windows return to their documents.

Hashes choose where segments meet; whether words are equal is decided on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grove.llm.common import (WordIndex, free_names, offsets, ranges, repeated_values,
                              shared_table, slices)

WINDOW = 13
#: Words of an anchor gram.
GRAM = 5
#: Windows of a segment; a longer stretch of one anchor makes several.
SEGMENT_WINDOWS = 64
#: Different segments of one anchor that one shard may hold.
HOT_SEGMENTS = 1024
#: Words of a shard, but for the segments of its last anchor.
SHARD_WORDS = 1 << 16
#: Order of reference rows: before every document.
REFERENCE = -(1 << 63)


class SuffixAutomaton:
    """Suffix automaton of word sequences.  ``first[state]`` is the label of the sequence
    that brought the state's stretches first; sequences come in ascending order of labels."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.first = [-1], [0], [None]

    def add(self, words: list[bytes], label: int) -> None:
        nxt, link, length, first = self.next, self.link, self.len, self.first
        last = 0
        for w in words:
            known = nxt[last].get(w)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            p = last
            if known is None:
                cur = len(length)
                nxt.append({})
                length.append(length[last] + 1)
                first.append(label)
                link.append(0)
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                last = cur
                if p < 0:
                    continue
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    continue
            else:
                q = known
            clone = len(length)
            nxt.append(nxt[q].copy())
            length.append(length[p] + 1)
            first.append(first[q])
            link.append(link[q])
            link[q] = clone
            if known is None:
                link[last] = clone
            else:
                last = clone
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]

    def stream(self, words: list[bytes], most: int) -> Iterator[tuple[int, int | None]]:
        """Matching statistic at each word, ``most`` at the most, and the first label of
        the stretch it stands for."""
        nxt, link, length, first = self.next, self.link, self.len, self.first
        state = size = 0
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(w)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
                if size >= most:
                    size = most
                    while length[link[state]] >= most:
                        state = link[state]
            yield size, first[state]


def first_labels(shard: list[tuple[bytes, int]], window: int) -> list[list[int]]:
    """For each (segment, label) of a shard the least label of every window of the segment."""
    split = [seg.split() for seg, _ in shard]
    automaton = SuffixAutomaton()
    for i in sorted(range(len(shard)), key=lambda i: shard[i][1]):
        automaton.add(split[i], shard[i][1])
    return [[label for size, label in automaton.stream(ws, window) if size == window]
            for ws in split]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchored_windows(split: list[list[bytes]], window: int, gram: int):
    """(text, first word, anchor) of all windows of the texts, in order."""
    index = WordIndex()
    words = index.numbers([w for ws in split for w in ws])
    value = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in index.fresh), np.uint64,
                        len(index.fresh))[words]
    count = np.array([len(ws) for ws in split], dtype=np.int64)
    n_windows = np.maximum(count - window + 1, 0)
    if not n_windows.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(value.size - gram + 1, np.uint64)
    for k in range(gram):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + value[k:k + h.size])
    width, least = window - gram + 1, h                   # sliding minimum, by doubling
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:h.size - width + 1], least[width - span:])
    bound = offsets(count)
    text = np.repeat(np.arange(count.size), n_windows)
    place = ranges(bound[:-1], n_windows)
    return text, place - bound[text], least[place].view(np.int64)


def _read(batches, columns: tuple[str, ...], text: str, window: int, gram: int):
    """Per slice: its columns, split texts and windows."""
    for batch, texts in slices(batches, text):
        split = [[] if t is None else t.split() for t in texts]
        at = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        yield at, split, anchored_windows(split, window, gram)


def _live(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(rid, anchors): the anchors of each document that another document has, too."""
    def pairs(batch: pa.RecordBatch, texts: list) -> tuple[np.ndarray, np.ndarray]:
        split = [[] if t is None else t.split() for t in texts]
        text, _, anchor = anchored_windows(split, window, gram)
        return anchor, batch.column(batch.schema.get_field_index("rid")).to_numpy()[text]

    return (repeated_values(rows.select("rid", "text"), "text", pairs)
            .groupBy(F.col("row").alias("rid")).agg(F.collect_list("value").alias("anchors")))


def _occurrences(rows: DataFrame, live: DataFrame, window: int, gram: int) -> DataFrame:
    """(rid, ord, start, anchor, segment): the segments of documents whose anchor is live."""
    found = rows.join(live, "rid").dropDuplicates(["rid"])   # a repeated row is one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (rid, order, anchors), split, (text, first, anchor) in _read(
                batches, ("rid", "ord", "anchors"), "text", window, gram):
            if not anchor.size:
                continue
            known = np.unique(anchors.flatten().to_numpy())
            start = np.ones(anchor.size, bool)
            start[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            at = np.arange(anchor.size)
            inside = at - np.maximum.accumulate(np.where(start, at, 0))
            start |= inside % SEGMENT_WINDOWS == 0
            heads = np.flatnonzero(start)
            n_windows = np.diff(np.append(heads, anchor.size))
            keep = np.isin(anchor[heads], known)
            heads, n_windows = heads[keep], n_windows[keep]
            text, first, anchor = text[heads], first[heads], anchor[heads]
            segment = [b" ".join(split[t][a:a + n]) for t, a, n in
                       zip(text.tolist(), first.tolist(), (n_windows + window - 1).tolist())]
            yield pa.RecordBatch.from_arrays(
                [rid.take(pa.array(text)), order.take(pa.array(text)), pa.array(first, pa.int32()),
                 pa.array(anchor), pa.array(segment, pa.binary()).cast(pa.string())],
                names=["rid", "ord", "start", "anchor", "segment"])

    return found.select("rid", "ord", "anchors", "text").mapInArrow(
        run, "rid long, ord long, start int, anchor long, segment string")


def _deal_hot(occurrences: DataFrame, window: int, most: int) -> DataFrame:
    """Occurrences with ``shard``: the anchor; segments of an anchor that has more than ``most``
    different ones are cut into single windows, each a shard of its own."""
    counts = (occurrences.select("anchor", F.xxhash64("segment").alias("h")).distinct()
              .groupBy("anchor").count().where(F.col("count") > most))
    hot = shared_table(counts.select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    marked = occurrences.join(hot, "anchor", "left")
    words = F.split("segment", " ")
    cut = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.struct(
        (F.col("start") + i - 1).alias("start"),
        F.array_join(F.slice(F.split("segment", " "), i, window), " ").alias("segment")))
    whole = F.array(F.struct("start", "segment"))
    dealt = marked.select("rid", "ord", "anchor", "hot",
                          F.explode(F.when(F.col("hot"), cut).otherwise(whole)).alias("s"))
    shard = F.when(F.col("hot"), F.xxhash64("s.segment", F.lit(1))).otherwise(F.col("anchor"))
    return dealt.select("rid", "ord", "s.start", shard.alias("shard"), "s.segment",
                        F.xxhash64("s.segment").alias("h"))


def _first_documents(segments: DataFrame, window: int) -> DataFrame:
    """(shard, h, firsts): per distinct segment the least order of each of its windows, where
    a segment's document is not the first one of all."""
    reference = segments.groupBy("shard", "segment").agg(
        F.min("ord").alias("least"), F.max("ord").alias("most"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows):
            firsts = first_labels([(seg, least) for _, seg, least, _ in rows], window)
            some = [(s, seg, f) for (s, seg, _, most), f in zip(rows, firsts) if min(f) < most]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in some], pa.int64()),
                 pa.array([r[1] for r in some], pa.binary()).cast(pa.string()),
                 pa.array([r[2] for r in some], pa.list_(pa.int64()))],
                names=["shard", "segment", "firsts"])

        shard, size, held = [], 0, None
        for batch in batches:
            cols = [batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(),
                    *[batch.column(k).to_pylist() for k in (2, 3)]]
            for row in zip(*cols):
                if size >= SHARD_WORDS and row[0] != held:
                    yield judged(shard)
                    shard, size = [], 0
                held = row[0]
                shard.append(row)
                size += row[1].count(b" ") + 1
        if shard:
            yield judged(shard)

    dealt = reference.select("shard", "segment", "least", "most").repartition("shard")
    found = dealt.sortWithinPartitions("shard").mapInArrow(
        run, "shard long, segment string, firsts array<long>")
    return found.select("shard", F.xxhash64("segment").alias("h"), "firsts")


def _removed(segments: DataFrame, firsts: DataFrame) -> DataFrame:
    """(rid, starts): first words of the windows of a document that an earlier one has."""
    joined = segments.select("rid", "ord", "start", "shard", "h").join(firsts, ["shard", "h"])
    starts = F.expr("filter(transform(firsts, (f, i) -> if(f < ord, start + i, -1)), x -> x >= 0)")
    return (joined.select("rid", starts.alias("starts")).where(F.size("starts") > 0)
            .groupBy("rid").agg(F.flatten(F.collect_list("starts")).alias("starts")))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW,
                   reference: DataFrame | None = None, reference_text: str = "text",
                   gram: int = GRAM, hot_segments: int = HOT_SEGMENTS,
                   keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) plus n_words, n_removed (long), spans (array
    of start and end in words, maximal, ascending) and kept (the other words, joined by one space).

    A word is removed if a window of ``window`` words covers it whose words also stand in a row
    with a smaller integer ``key``, or in a ``reference`` row; windows are judged on the input. Words
    are what stands between white space of ASCII.  Null texts and texts of fewer words lose nothing; rows of
    equal keys, and so repeated rows, do not remove from each other; a row without a key is neither
    changed nor does it change others; empty tables give no rows; a column that clashes with a
    result column is replaced by it.  A long text is held whole with its windows, segments and
    spans by one task; no other group is.
    """
    if not 1 <= gram <= window:
        raise ValueError(f"gram must lie in 1..{window}, got {gram}")
    result = ["n_words", "n_removed", "spans", "kept"]
    names = [c for c in (keep if keep is not None else docs.columns) if c not in result]
    body, row, begins = free_names(names, "_text", "_rid", "_starts")
    rid = F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string"))
    rows = docs.select(rid.alias("rid"), F.col(key).cast("long").alias("ord"),
                       F.col(text).cast("string").alias("text")).where(F.col(key).isNotNull())
    if reference is not None:
        other = F.col(reference_text).cast("string")
        rows = rows.unionByName(reference.select(F.xxhash64(F.lit("reference"), other).alias("rid"),
                                                 F.lit(REFERENCE).alias("ord"), other.alias("text")))
    rows = rows.where(F.length("text") >= 2 * window - 1)
    live = _live(rows, window, gram)
    found = shared_table(_occurrences(rows, live, window, gram), "repeat-occurrences")
    segments = _deal_hot(found, window, hot_segments)
    firsts = shared_table(_first_documents(segments, window), "repeat-firsts")
    starts = _removed(segments, firsts).withColumnsRenamed({"rid": row, "starts": begins})
    frame = docs.select(*[F.col(c) for c in names], F.col(text).cast("string").alias(body),
                        F.when(F.col(key).isNotNull(), rid).alias(row))
    frame = frame.join(starts, row, "left")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(frame.select(*names).schema.fields + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, body):
            at = batch.column(batch.schema.get_field_index(begins)).to_pylist()
            words, removed, spans, kept = [], [], [], []
            for t, own in zip(texts, at):
                ws = [] if t is None else t.split()
                a = np.unique(np.array(own or [], dtype=np.int64))
                cut = np.flatnonzero(np.concatenate([[True], np.diff(a) > window])[:a.size])
                ends = np.append(a[cut[1:] - 1], a[-1:]) + window
                out, last = [], 0
                for s, e in zip(a[cut].tolist(), ends.tolist()):
                    out += ws[last:s]
                    last = e
                words.append(len(ws))
                out += ws[last:]
                removed.append(len(ws) - len(out))
                spans.append([{"start": s, "end": e} for s, e in zip(a[cut].tolist(), ends.tolist())])
                kept.append(b" ".join(out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                   pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                   pa.array(kept, pa.binary()).cast(pa.string())],
                names=names + result)

    return frame.select(*names, body, begins).mapInArrow(run, schema)
