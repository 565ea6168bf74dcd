"""Quality rules from tokeniser fertility.

Public vocabularies measure each text: characters per token (byte-level BPE), the
share of tokens that fall back to single bytes, and the entropy of the token
distribution (sentencepiece BPE).  A text whose measures leave the band of its
language, or of its script where the language has none, is rejected, as is one that
fails the plain base rules (too few words, too many words in repeated 3-word windows).

Vocabularies are applied to distinct words: white space never lies inside a token of
more than one word, so a text's measures are sums over its words.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import (TABLE_SLICE_BYTES, WordIndex, kept_table, offsets,
                              ranges, slices, tokenizer_file, with_text)

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Distinct words whose tokens a worker keeps before it starts anew.
CACHE_WORDS = 300_000
#: New words that the vocabularies encode at once.
FRESH_WORDS = 4096
TABLE = "fertility"


@dataclass(frozen=True)
class Band:
    """What a clean text of a language or script may measure (inclusive).

    Measures of short texts scatter more, and their entropy is lower: a lower bound is
    reduced by its spread divided by the square root of the text's words.
    """

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float
    chars_spread: float = 0.0
    entropy_spread: float = 0.0


#: Bands by language, then by script; ``""`` is every other script.  The spreads of characters
#: per token are measured: stretches of 50 to 300 words of kept documents keep above the bound.
BANDS: dict[str, Band] = {
    "en": Band(2.20, 8.0, 0.05, 6.75, 2.5, 11.5),
    "de": Band(2.05, 8.0, 0.05, 6.58, 2.0, 11.5),
    "fr": Band(1.90, 8.0, 0.05, 6.52, 1.5, 11.5),
    "es": Band(1.85, 8.0, 0.05, 6.65, 1.1, 11.5),
    "Latn": Band(1.40, 9.0, 0.10, 4.0),
    "Grek": Band(0.40, 5.0, 0.30, 3.5),
    "Cyrl": Band(0.40, 5.0, 0.30, 3.5),
    "": Band(0.20, 9.0, 0.90, 3.0),
}

#: First bytes of UTF-8 characters of each script (a byte holds 64 or more code points).
_SCRIPT_BYTES = {
    "Latn": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "Grek": [0xCD, 0xCE, 0xCF],
    "Cyrl": [0xD0, 0xD1, 0xD2, 0xD3],
    "": [0xCC, *range(0xD4, 0xE2), *range(0xE3, 0xF0), 0xF0],
}
_SCRIPTS = list(_SCRIPT_BYTES)
_SCRIPT_OF = np.zeros((256, len(_SCRIPTS)), dtype=np.int64)
for _k, _s in enumerate(_SCRIPTS):
    _SCRIPT_OF[_SCRIPT_BYTES[_s], _k] = 1

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "chars_per_token double, byte_share double, token_entropy double, script string")


class Vocabularies:
    """Tokens of words under both vocabularies, kept per worker for distinct words."""

    def __init__(self, bpe_file: str, piece_file: str):
        import sentencepiece
        from tokenizers import Tokenizer
        # a task has one core; the library's threads would each keep an arena of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.bpe = Tokenizer.from_file(bpe_file)
        self.bpe.encode_special_tokens = True
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.is_byte = np.array([self.piece.IsByte(i) for i in range(self.piece.GetPieceSize())])
        self.reset()

    def reset(self):
        self.index = WordIndex()
        self.bpe_n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def shrink(self, words: int) -> None:
        """Keep the first ``words`` words: common ones come early."""
        if len(self.index) > words:
            first = list(islice(self.index, words))
            self.index = WordIndex()
            self.index.numbers(first)
            self.index.fresh = []
            self.bpe_n, self.at = self.bpe_n[:words].copy(), self.at[:words + 1].copy()
            self.ids = self.ids[:self.at[-1]].copy()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > CACHE_WORDS:
            self.reset()
        out = self.index.numbers(words)
        fresh, self.index.fresh = self.index.fresh, []
        for k in range(0, len(fresh), FRESH_WORDS):
            text = [w.decode() for w in fresh[k:k + FRESH_WORDS]]
            n = [len(e) for e in self.bpe.encode_batch_fast(text, add_special_tokens=False)]
            pieces = self.piece.encode(text, num_threads=1)
            flat = np.fromiter((i for p in pieces for i in p), dtype=np.int32)
            self.bpe_n = np.concatenate([self.bpe_n, n])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(p) for p in pieces])])
            self.ids = np.concatenate([self.ids, flat])
        return out


def repeated_words(numbers: np.ndarray) -> int:
    """Words in 3-word windows found twice or more (first ones included)."""
    n = numbers.size
    if n < 4:
        return 0
    if int(numbers.max()) < 1 << 21:
        key = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    else:
        # the pair's rank is below n, so rank and third word fit 63 bits again
        _, small = np.unique(numbers, return_inverse=True)
        _, pair = np.unique(small[:-2] * np.int64(n) + small[1:-1], return_inverse=True)
        key = pair.astype(np.int64) * np.int64(n) + small[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not twice.size:
        return 0
    hit = np.flatnonzero(np.isin(key, twice))
    cover = np.zeros(n, dtype=bool)
    for k in range(3):
        cover[hit + k] = True
    return int(cover.sum())


def duplicate_lines(text: bytes) -> int:
    """\\n-split lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and x.strip(SPACES)]
    return len(lines) - len(set(lines))


def _measures(words: np.ndarray, bounds: np.ndarray, v: Vocabularies):
    """Per text: tokens of the byte-level BPE, tokens and byte tokens of the piece
    vocabulary, entropy in bits of the latter's token distribution."""
    docs = bounds.size - 1
    row = np.repeat(np.arange(docs), np.diff(bounds))
    size = v.at[1:] - v.at[:-1]
    bpe = np.bincount(row, v.bpe_n[words], docs)
    key, n = np.unique(row * np.int64(len(v.index) + 1) + words, return_counts=True)
    row, word = np.divmod(key, np.int64(len(v.index) + 1))
    ids = v.ids[ranges(v.at[word], size[word])].astype(np.int64)
    weight = np.repeat(n, size[word])
    row = np.repeat(row, size[word])
    total = np.bincount(row, weight, docs)
    byte = np.bincount(row, weight * v.is_byte[ids], docs)
    key = row * np.int64(v.is_byte.size) + ids
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else key
    count = np.add.reduceat(weight, first).astype(float) if key.size else np.zeros(0)
    row = key[first] // v.is_byte.size if key.size else key
    share = count / np.maximum(total[row], 1)
    entropy = -np.bincount(row, share * np.log2(np.maximum(share, 1e-300)), docs)
    return bpe, total, byte, entropy + 0.0


def measure_fertility(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None,
                      bpe_file: str | None = None, piece_file: str | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) plus the counts and measures of RESULT.

    Null and empty texts have 0 for every count and measure and an empty script.
    One narrow pass; a column that clashes with a result column is replaced by it.
    """
    files = (bpe_file or tokenizer_file("byte_bpe_50k.json"),
             piece_file or tokenizer_file("piece_bpe_32k.model"))
    result = [x.split()[0] for x in RESULT.split(", ")]
    names = [c for c in (keep if keep is not None else docs.columns) if c not in result]
    frame, inner = with_text(docs, names, text)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, "
                     for f in frame.select(*names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = kept_table(TABLE, files, lambda: Vocabularies(*files))
        for batch, texts in slices(batches, inner, TABLE_SLICE_BYTES, TABLE):
            texts = [t or b"" for t in texts]
            split = [t.split() for t in texts]
            bounds = offsets([len(w) for w in split])
            words = v.numbers([x for w in split for x in w])
            hist = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256)
                             for t in texts])
            points = hist.sum(1) - hist[:, 0x80:0xC0].sum(1)
            chars = points - hist[:, list(SPACES)].sum(1)
            script = hist @ _SCRIPT_OF
            bpe, total, byte, entropy = _measures(words, bounds, v)
            cols = [
                np.diff(bounds), chars, hist[:, list(SYMBOLS)].sum(1),
                [duplicate_lines(t) for t in texts],
                [repeated_words(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(c, pa.int64()) for c in cols]
                + [pa.array(chars / np.maximum(bpe, 1), pa.float64()),
                   pa.array(byte / np.maximum(total, 1), pa.float64()),
                   pa.array(entropy, pa.float64()),
                   pa.array([_SCRIPTS[k] if any_ else "" for k, any_ in
                             zip(script.argmax(1).tolist(), script.any(1).tolist())])],
                names=names + result)

    return frame.mapInArrow(run, fields + RESULT)


def _in_band(band: Band):
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    return ((F.col("chars_per_token") >= F.lit(band.min_chars_per_token)
             - F.lit(band.chars_spread) / root)
            & (F.col("chars_per_token") <= band.max_chars_per_token)
            & (F.col("byte_share") <= band.max_byte_share)
            & (F.col("token_entropy") >= F.lit(band.min_entropy)
               - F.lit(band.entropy_spread) / root))


def quality_rules(docs: DataFrame, text: str = "text", lang: str | None = "lang",
                  keep: tuple[str, ...] | None = None, bands: dict[str, Band] | None = None,
                  min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
                  **files) -> DataFrame:
    """The measures plus band (its name), base_failed and kept.

    The band is that of the row's ``lang`` if ``bands`` has one, else that of the
    script with most characters, else the band ``""``; a null, unknown or missing
    language column falls back to the script.  Null and empty texts fail the base
    rule.  Rows are judged one by one, so repeated rows get equal results; an empty
    table gives an empty result.
    """
    bands = BANDS if bands is None else bands
    use_lang = lang is not None and lang in docs.columns
    names = tuple(keep if keep is not None else docs.columns)
    extra = () if not use_lang or lang in names else (lang,)
    out = measure_fertility(docs, text, names + extra, **files)
    key = F.col("script")
    if use_lang:
        langs = [b for b in bands if b and b not in _SCRIPTS]
        key = F.when(F.col(lang).isin(langs), F.col(lang)).otherwise(key)
    key = F.when(key.isin(list(bands)), key).otherwise(F.lit(""))
    verdict = F.lit(False)
    for name, band in bands.items():
        verdict = F.when(F.col("band") == name, _in_band(band)).otherwise(verdict)
    failed = ((F.col("n_words") < min_words)
              | (F.lit(100) * F.col("n_repeat_words")
                 > F.lit(max_repeat_percent) * F.col("n_words")))
    return (out.withColumn("band", key).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & verdict).drop(*extra))
