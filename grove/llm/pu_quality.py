"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts train a small network whose risk is the
non-negative unbiased estimate

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

with the sigmoid loss: unlabelled texts count as negatives, minus the part of them that
the class prior says is positive; where a minibatch drives that difference below zero,
its gradient is reversed.  No negative label is ever used.  The prior is estimated
before, as the least ratio of unlabelled to positive texts above a threshold of a
positive-against-unlabelled classifier, on texts that classifier has not seen.

Inputs of the score are measures of the text alone (shares of character classes, word
statistics, repetition); they are computed in tasks, and the driver sees only the
measures of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.llm.common import free_names, hash_sample, slices
from grove.llm.fertility import duplicate_lines, repeated_words

#: Texts of each kind that the fit may use (twice as many at most).
SAMPLE_POSITIVE = 4000
SAMPLE_UNLABELLED = 8000
HIDDEN = 24
STEPS = 3000
BATCH = 512

MEASURES = (
    "log_words", "log_chars", "word_length", "letters", "upper", "digits", "space", "stops",
    "symbols", "bars", "marks", "other_ascii", "non_ascii", "distinct_words", "top_word",
    "repeated_windows", "adjacent_repeats", "duplicate_lines", "line_words", "word_entropy")

_GROUPS = {
    "letters": [*range(65, 91), *range(97, 123)], "upper": range(65, 91), "digits": range(48, 58),
    "space": [9, 10, 11, 12, 13, 32], "stops": b".,;:'\"()-", "symbols": b"#*$%&", "bars": b"|<>",
    "marks": b"!?", "other_ascii": b"+/=@[\\]^_`{}~", "non_ascii": range(0xC0, 0x100)}
_GROUP_OF = np.zeros((256, len(_GROUPS)))
for _k, _v in enumerate(_GROUPS.values()):
    _GROUP_OF[list(_v), _k] = 1


def measure(text: bytes | None) -> np.ndarray:
    """The measures of one text, in the order of MEASURES; zeros for null or empty."""
    if not text:
        return np.zeros(len(MEASURES))
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(hist.sum() - hist[0x80:0xC0].sum())
    shares = (hist @ _GROUP_OF) / chars
    words = text.split()
    n = len(words)
    if n:
        seen: dict[bytes, int] = {}
        numbers = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
        count = np.bincount(numbers)
        share = count / n
        stats = [len(seen) / n, share.max(), repeated_words(numbers) / n,
                 float((numbers[1:] == numbers[:-1]).sum()) / n]
        entropy = float(-(share * np.log2(share)).sum()) / max(np.log2(n), 1.0)
    else:
        stats, entropy = [0.0] * 4, 0.0
    lines = text.count(b"\n") + 1
    return np.array([np.log1p(n), np.log1p(chars), (chars - hist[[9, 10, 11, 12, 13, 32]].sum())
                     / max(n, 1), *shares, *stats, duplicate_lines(text) / lines,
                     np.log1p(n / lines), entropy])


@dataclass
class PuModel:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Score from 0 to 1; 0.5 is the boundary."""
        return _sigmoid(self.raw(_scaled(x, self.mean, self.scale))[0])

    def raw(self, x: np.ndarray):
        hidden = np.maximum(x @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2, hidden


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, seed: int) -> PuModel:
    """Adam on the non-negative risk; without a prior, on plain positive against unlabelled."""
    rng = np.random.default_rng(seed)
    mean, scale = u.mean(0), np.maximum(u.std(0), 1e-3)
    m = PuModel(mean, scale, rng.normal(0, 0.3, (p.shape[1], HIDDEN)), np.zeros(HIDDEN),
                rng.normal(0, 0.3, HIDDEN), 0.0, prior or 0.0)
    p, u = _scaled(p, mean, scale), _scaled(u, mean, scale)
    moment = [[np.zeros_like(np.asarray(v)) for v in (m.w1, m.b1, m.w2, m.b2)] for _ in (0, 1)]
    for step in range(1, steps + 1):
        xp = p[rng.integers(0, len(p), BATCH)]
        xu = u[rng.integers(0, len(u), BATCH)]
        x = np.concatenate([xp, xu])
        z, hidden = m.raw(x)
        s = _sigmoid(z)
        slope = s * (1 - s)
        sp, su = slope[:BATCH], slope[BATCH:]
        # loss of label + is 1 - s, of label - is s; d holds the gradient by z
        if prior is None:
            d = np.concatenate([-sp, su]) / BATCH
        else:
            risk = s[BATCH:].mean() - prior * s[:BATCH].mean()
            negative = np.concatenate([-prior * sp, su]) / BATCH
            positive = np.concatenate([-prior * sp, np.zeros(BATCH)]) / BATCH
            d = positive + negative if risk >= 0 else -negative
        back = d[:, None] * m.w2 * (hidden > 0)
        grads = [x.T @ back + 1e-5 * m.w1, back.sum(0), hidden.T @ d + 1e-5 * m.w2, d.sum()]
        rate = 0.01 * (1 - step / (steps + 1)) + 1e-4
        new = []
        for k, (v, g) in enumerate(zip((m.w1, m.b1, m.w2, m.b2), grads)):
            moment[0][k] = 0.9 * moment[0][k] + 0.1 * g
            moment[1][k] = 0.999 * moment[1][k] + 0.001 * g * g
            a, b = moment[0][k] / (1 - 0.9 ** step), moment[1][k] / (1 - 0.999 ** step)
            new.append(v - rate * a / (np.sqrt(b) + 1e-8))
        m.w1, m.b1, m.w2, m.b2 = new[0], new[1], new[2], float(new[3])
    return m


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int = 11) -> float:
    """Share of positives among the unlabelled, from a classifier fitted on one half."""
    if len(p) < 8 or len(u) < 8:
        return 0.5
    half = _train(p[::2], u[::2], None, STEPS // 3, seed)
    a, b = np.sort(half.score(p[1::2])), np.sort(half.score(u[1::2]))
    best = 1.0
    for t in np.unique(np.concatenate([a, b])):
        above_p = (len(a) - np.searchsorted(a, t)) / len(a)
        above_u = (len(b) - np.searchsorted(b, t)) / len(b)
        if above_p < 0.25:
            break
        # the ratio's own spread is added, so that a chance dip is not taken for the least
        spread = np.sqrt(max(above_u * (1 - above_u), 1 / len(b)) / len(b)
                         + max(above_p * (1 - above_p), 1 / len(a)) / len(a)) / above_p
        best = min(best, above_u / above_p + spread)
    return float(np.clip(best, 0.02, 0.98))


def _measured(docs: DataFrame, text: str, names: list[str]) -> DataFrame:
    (inner,) = free_names(names, "_text")
    frame = docs.select(*[F.col(c) for c in names], F.col(text).cast("string").alias(inner))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, "
                     for f in frame.select(*names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, inner):
            x = [measure(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(x, pa.list_(pa.float64()))], names=names + ["_x"])

    return frame.mapInArrow(run, fields + "_x array<double>")


def fit(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text",
        key: str = "doc_id", label: str = "quality", positives: int = SAMPLE_POSITIVE,
        unlabelled: int = SAMPLE_UNLABELLED, prior: float | None = None, seed: int = 11
        ) -> PuModel | None:
    """Model from trusted positives (label 1) and unlabelled texts among the rows where
    ``train`` (a condition on the key) holds; None without any positive.

    Uses about ``positives`` and ``unlabelled`` texts chosen by a hash of the key.  The
    sampled keys are broadcast; there are never more than twice ``positives`` of them.
    """
    trusted = labels.where((F.col(label) == 1) & train).select(key).distinct()
    found = hash_sample(trusted, key, positives, trusted.count()).withColumn("_p", F.lit(True))
    rows = docs.where(train)
    total = rows.count()
    span = 1 << 30
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(3)), F.lit(span))
    rows = (rows.select(key, text).join(F.broadcast(found), key, "left")
            .withColumn("_u", place < min(span, -(-unlabelled * span // max(total, 1))))
            .where(F.col("_p") | F.col("_u")).withColumn("_p", F.coalesce("_p", F.lit(False)))
            .limit(2 * (positives + unlabelled)))
    got = _measured(rows, text, [key, "_p", "_u"]).toArrow()
    x = np.array(got["_x"].to_pylist()).reshape(-1, len(MEASURES))
    p, u = (np.array(got[c].to_pylist(), dtype=bool) for c in ("_p", "_u"))
    order = np.lexsort((*x.T, p, u))          # any layout of the rows, one order
    order = order[np.random.default_rng(seed).permutation(len(order))]
    x, p, u = x[order], p[order], u[order]
    if not p.any():
        return None
    if not u.any():
        u = p
    if prior is None:
        prior = estimate_prior(x[p], x[u], seed)
    return _train(x[p], x[u], prior, STEPS, seed)


def score_quality(docs: DataFrame, model: PuModel | None, text: str = "text",
                  keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) plus score (0 to 1) and predicted (0/1).

    Null and empty texts are scored as texts without words; without a model every score
    is 0.5.  One narrow pass; a column that clashes with a result column is replaced.
    """
    names = [c for c in (keep if keep is not None else docs.columns)
             if c not in ("score", "predicted")]
    (inner,) = free_names(names, "_text")
    frame = docs.select(*[F.col(c) for c in names], F.col(text).cast("string").alias(inner))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, "
                     for f in frame.select(*names).schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in slices(batches, inner):
            s = np.full(len(texts), 0.5) if m is None else \
                m.score(np.stack([measure(t) for t in texts]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())],
                names=names + ["score", "predicted"])

    return frame.mapInArrow(run, fields + "score double, predicted int")
