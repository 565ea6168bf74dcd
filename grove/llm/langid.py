"""Language identification with averaged hashed subword embeddings.

A text's subwords are the byte n-grams of its words without a digit (``<word>``), hashed into
a fixed number of buckets; the mean of their embeddings goes into a linear softmax.  Embeddings
and softmax are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled rows.

A softmax over the learned languages has to choose one of them for any text, so a rejection
needs a second figure: the familiarity of a text, the mean log frequency of its subwords in
the language that knows a word best, as a distance from a language's own texts in standard
deviations for its length.  A part of the sample that the descent does not see sets the temperature of
the softmax and the familiarity below which a prediction is rejected: its rows count as known
texts under their own language, and as texts of a language never learned when that language
is struck out.

For scoring, embeddings and softmax are folded into one table of bucket -> score per
language, beside the log frequencies, and a worker keeps the sums of the words it has met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.llm.common import (TABLE_SLICE_BYTES, WordIndex, offsets, return_memory, slices,
                              split_alnum, with_text)

UNKNOWN = "und"
BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
DIM = 16
#: Labelled rows per language that the fit may use (twice as many at most).
SAMPLE_PER_LANG = 600
#: Most languages; more distinct values raise an error.
MAX_LANGS = 400
EPOCHS = 12
#: A known text that is rejected costs the calibration as much as so many unknown ones kept.
KNOWN_COST = 1000
#: Count that every subword has beforehand in a language.
PRIOR_COUNT = 0.1
#: Subwords of one sampled row that count towards the frequencies.
ROW_WEIGHT = 2000
#: Words whose sums a worker keeps, and new words measured at once.
CACHE_WORDS = 100_000
FRESH_WORDS = 4096

RESULT = "lang_pred string, score double, rejected boolean"
_DIGIT = re.compile(rb"[0-9]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram of every ``<word>``, n-grams of each word)."""
    text = np.frombuffer(b"<" + b"><".join(words) + b">" if words else b"", dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    buckets, owners = [], []
    for n in GRAMS:
        if text.size < n:
            continue
        h = np.full(text.size - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ text[k:text.size - n + 1 + k]) * np.uint64(0x100000001B3)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        inside = owner[:text.size - n + 1] == owner[n - 1:]
        buckets.append((h[inside] >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[:text.size - n + 1][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    bucket, own = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return bucket[order], np.bincount(own, minlength=len(words))


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER.search(text):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode())


@dataclass
class LangModel:
    """Folded model: ``table[bucket]`` holds a score per language, ``familiar[bucket]`` a log
    frequency; ``centre``, ``spread`` and ``noise`` (variance of long texts, and of one
    subword) describe the familiarity of a language's own texts."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    familiar: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    noise: np.ndarray
    temperature: float = 1.0
    reject_below: float = -np.inf

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def distances(self, mean: np.ndarray, grams: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """``mean``, familiarity less the centre, of rows with ``grams`` subwords, in standard
        deviations of texts of ``lang``."""
        return mean / np.sqrt(self.spread[lang] + self.noise[lang] / np.maximum(grams, 1))


class Scorer:
    """Summed scores, log frequencies and n-gram counts of words, kept per worker."""

    def __init__(self, model: LangModel):
        self.model = model
        self.table = np.concatenate([model.table, model.familiar], axis=1)
        self.reset()

    def reset(self):
        self.index = WordIndex()
        self.sums = np.zeros((0, len(self.model.langs) + 1))
        self.grams = np.zeros(0, np.int64)

    def _measure(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sums and n-gram counts of some words."""
        langs = len(self.model.langs)
        bucket, grams = subwords(fresh)
        sums = np.add.reduceat(self.table[bucket], offsets(grams)[:-1], axis=0)
        number = [k for k, w in enumerate(fresh) if _DIGIT.search(w)]
        sums[number], grams[number] = 0.0, 0                # keys and numbers tell nothing
        # the language that knows a word best: a text in two learned languages is known
        known = (sums[:, langs:] - self.model.centre * grams[:, None]).max(axis=1)
        return np.c_[sums[:, :langs], known], grams

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, probability, familiarity in deviations) of each text."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        split = [split_alnum(t) for t in texts]
        numbers = self.index.numbers([w for ws in split for w in ws])
        fresh, self.index.fresh = self.index.fresh, []
        if fresh:
            new = [self._measure(fresh[k:k + FRESH_WORDS])
                   for k in range(0, len(fresh), FRESH_WORDS)]
            self.sums = np.concatenate([self.sums, *[x for x, _ in new]])
            self.grams = np.concatenate([self.grams, *[x for _, x in new]])
        bound = offsets([len(ws) for ws in split])
        row = np.repeat(np.arange(len(texts)), np.diff(bound))
        total = np.bincount(row, self.grams[numbers], len(texts))
        mean = np.stack([np.bincount(row, self.sums[numbers, k], len(texts))
                         for k in range(self.sums.shape[1])], axis=1)
        mean /= np.maximum(total, 1)[:, None]
        p = self.model.probabilities(mean[:, :-1])
        best = p.argmax(axis=1)
        return (best, p[np.arange(len(best)), best],
                self.model.distances(mean[:, -1], total, best))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled texts to (lang, part, buckets, counts): each whole text, and a stretch of
    a few words, so that short texts are learned too."""
    for batch, texts in slices(batches, "_text"):
        langs = batch.column(batch.schema.get_field_index("_lang")).to_pylist()
        parts = batch.column(batch.schema.get_field_index("_part")).to_pylist()
        rows: list[tuple] = []
        for t, lang, part in zip(texts, langs, parts):
            words = [w for w in split_alnum(t) if not _DIGIT.search(w)]
            if not words:
                continue
            at = part * 7919 % len(words)
            for ws in (words, words[at:at + 1 + part % 8]):
                bucket, _ = subwords(ws)
                b, n = np.unique(bucket, return_counts=True)
                rows.append((lang, part, b, n))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                 pa.array([r[3].astype(np.float32) for r in rows], pa.list_(pa.float32()))],
                names=["lang", "part", "buckets", "counts"])


def _dense(rows: list) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for k, r in enumerate(rows):
        b, n = r
        x[k, b] = n / n.sum()
    return x


def _descend(rows: list, y: np.ndarray, langs: int, dim: int, epochs: int, seed: int):
    """Embeddings, softmax weights and bias by minibatch gradient descent."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (dim, langs)).astype(np.float32)
    b = np.zeros(langs, dtype=np.float32)
    share = np.bincount(y, minlength=langs) / max(len(y), 1)
    weight = (1 / (langs * np.maximum(share, 1e-9)))[y].astype(np.float32)
    for epoch in range(epochs):
        rate = np.float32(1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 64):
            part = order[k:k + 64]
            x = _dense([rows[i] for i in part])
            hidden = x @ e
            z = hidden @ w + b
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(len(part)), y[part]] -= 1
            d *= weight[part, None] / len(part)
            back = x.T @ (d @ w.T)
            w -= rate * 4 * (hidden.T @ d)
            b -= rate * d.sum(axis=0)
            e -= rate * 400 * back
    return e, w, b


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang",
        key: str = "doc_id", per_lang: int = SAMPLE_PER_LANG, epochs: int = EPOCHS,
        seed: int = 7) -> LangModel | None:
    """Model from the rows of ``docs`` where ``train`` holds and text and language are
    given; None without such rows.

    Only a sample of about ``per_lang`` rows of each language is used, chosen by a hash
    of the key, and only its hashed counts reach the driver.
    """
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return None
    span = 1 << 30
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(span))
    chosen = F.lit(False)
    for name, n in sorted(counts.items()):
        chosen = F.when(F.col(lang) == name,
                        place < min(span, per_lang * span // n + 1)).otherwise(chosen)
    sample = (rows.where(chosen)
              .select(F.col(text).cast("string").alias("_text"), F.col(lang).alias("_lang"),
                      F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(1)),
                             F.lit(1 << 20)).alias("_part"))
              .limit(2 * per_lang * len(counts)))
    schema = "lang string, part long, buckets array<int>, counts array<float>"
    got = sample.mapInArrow(_features, schema).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    if not langs:
        return None
    number = {v: k for k, v in enumerate(langs)}
    part = np.array(got["part"].to_pylist())
    data = [(np.asarray(b.values), np.asarray(c.values)) for b, c in
            zip(got["buckets"], got["counts"])]
    y = np.array([number[v] for v in got["lang"].to_pylist()])
    order = np.lexsort((np.array([d[0].size for d in data]), y, part))   # any layout, one order
    data, y, part = [data[k] for k in order], y[order], part[order]
    held = part % 5 == 0
    if held.all() or not held.any():
        held = np.zeros(len(y), dtype=bool)
    fitted = np.flatnonzero(~held)
    e, w, b = _descend([data[k] for k in fitted], y[fitted], len(langs), DIM, epochs, seed)
    table = e.astype(np.float64) @ w
    familiar = _frequencies([data[k] for k in fitted], y[fitted], len(langs))
    zero = np.zeros(len(langs))
    model = LangModel(langs, table, b.astype(np.float64), familiar, zero, zero, zero)
    check = np.flatnonzero(held) if held.any() else fitted
    both = np.concatenate([table, familiar], axis=1)
    mean = np.stack([(both[data[k][0]] * (data[k][1] / data[k][1].sum())[:, None]).sum(0)
                     for k in check])
    grams = np.array([data[k][1].sum() for k in check], dtype=np.float64)
    _calibrate(model, mean[:, :len(langs)], mean[:, len(langs):], grams, y[check])
    got = data = None
    return_memory()                     # the driver goes on with the model alone
    return model


def _frequencies(rows: list, y: np.ndarray, langs: int) -> np.ndarray:
    """Log frequency of every bucket in each language."""
    count = np.full((BUCKETS, langs), PRIOR_COUNT)
    for (bucket, n), lang in zip(rows, y):
        count[bucket, lang] += n * min(1.0, ROW_WEIGHT / float(n.sum()))
    return np.log(count / count.sum(axis=0))


def _calibrate(model: LangModel, mean: np.ndarray, known: np.ndarray, grams: np.ndarray,
               y: np.ndarray) -> None:
    """Temperature of least log loss, the languages' own familiarity, and the rejection
    threshold."""
    best = None
    for t in np.geomspace(0.25, 16, 49):
        model.temperature = float(t)
        p = model.probabilities(mean)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, float(t))
    model.temperature = best[1]
    langs = len(model.langs)
    figures = np.array([_own_familiarity(known[y == k, k], grams[y == k]) for k in range(langs)])
    model.centre, model.spread, model.noise = figures.T
    p = model.probabilities(mean)
    right = p.argmax(axis=1) == y
    every = np.arange(len(y))
    own = model.distances(known[every, y] - model.centre[y], grams, y)[right]
    others = p.copy()
    others[every, y] = -1.0                                 # as if never learned
    next_best = others.argmax(axis=1)
    strange = (model.distances(known[every, next_best] - model.centre[next_best], grams, next_best)
               if langs > 1 else np.zeros(0))
    model.reject_below = _threshold(own, strange)


def _own_familiarity(mean: np.ndarray, grams: np.ndarray) -> tuple[float, float, float]:
    """Median, variance of long texts and variance of a single subword; the variances from
    medians, which a few strange rows do not move."""
    if not mean.size:
        return 0.0, 1e6, 1e6                                # nothing known: reject nothing
    long = grams >= np.median(grams)
    centre = float(np.median(mean[long]))
    square = (mean - centre) ** 2
    return (centre, float(np.median(square[long])) / 0.455 + 1e-4,
            float(np.median(square * grams)) / 0.455 + 1e-4)


def _threshold(own: np.ndarray, strange: np.ndarray) -> float:
    """The distance below which the fewest rows are judged wrongly, a rejected known one
    counting ``KNOWN_COST`` times; without strange rows, that of the least known one."""
    if not own.size:
        return -np.inf
    if not strange.size:
        return float(own.min())
    own, strange = np.sort(own), np.sort(strange)
    cuts = np.unique(np.concatenate([own, strange]))
    cuts = np.concatenate([[cuts[0] - 1.0], (cuts[1:] + cuts[:-1]) / 2])
    cost = (KNOWN_COST * np.searchsorted(own, cuts) / own.size
            + 1 - np.searchsorted(strange, cuts) / strange.size)
    return float(cuts[cost.argmin()])


def predict(docs: DataFrame, model: LangModel | None, text: str = "text",
            keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) plus lang_pred, score, rejected.

    Null texts and texts without a letter (or any text without a model) get ``und``, score
    0, rejected.  Others get a learned language, its calibrated probability, and are
    rejected if they are less familiar in that language than the model's threshold.  Ties go to the first language in alphabetical
    order.  One narrow pass; a column that clashes with a result column is replaced by it.
    """
    result = ["lang_pred", "score", "rejected"]
    names = [c for c in (keep if keep is not None else docs.columns) if c not in result]
    frame, inner = with_text(docs, names, text)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, "
                     for f in frame.select(*names).schema.fields)
    # languages x buckets numbers: bounded by MAX_LANGS and BUCKETS
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = None if m is None else Scorer(m)
        for batch, texts in slices(batches, inner, TABLE_SLICE_BYTES):
            known = [scorer is not None and t is not None and has_letter(t) for t in texts]
            lang = [UNKNOWN] * len(texts)
            score = np.zeros(len(texts))
            low = np.ones(len(texts), dtype=bool)
            rows = [k for k, ok in enumerate(known) if ok]
            if rows:
                best, score[rows], distance = scorer.judge([texts[k] for k in rows])
                low[rows] = distance < m.reject_below
                for k, b in zip(rows, best.tolist()):
                    lang[k] = m.langs[b]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                   pa.array(low, pa.bool_())],
                names=names + result)

    return frame.mapInArrow(run, fields + RESULT)
