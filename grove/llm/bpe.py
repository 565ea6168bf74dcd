"""BPE encoding and decoding in batched numpy merge rounds.

A text is cut at ASCII white space into chunks; chunks seen before come from a
bounded per-worker table.  The words of all new chunks lie in one flat array of
symbols.  A round looks up every neighbouring pair by binary search over the sorted
pair keys of the vocabulary, takes the lowest rank of each word, merges its
occurrences from left to right, and closes the gaps; words without a mergeable pair
leave the array.  A very long word would need very many rounds, so words above
``LONG_WORD`` symbols are merged one by one with a heap, with equal results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grove.llm.common import (TABLE_SLICE_BYTES, RecentWords, kept_table, offsets, slices,
                              tokenizer_file, with_text)

VOCABULARY = "word_bpe_49k.json"
TABLE = "bpe"
LONG_WORD = 512
#: Distinct chunks whose tokens a worker keeps, in each of two generations.
CACHE_CHUNKS = 125_000
#: Symbols that one run of merge rounds handles at once.
FLAT_SYMBOLS = 2_000_000

#: A word of the vocabulary's pre-tokeniser.
WORD = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

RESULT = "n_tokens long, ids binary, decoded string"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    visible Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary file: pairs as sorted keys with rank and product."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t + " " for t, i in [*vocab.items(), *self.special.items()]}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        a, b, product = (np.array(x, dtype=np.int64) for x in zip(
            *((vocab[x], vocab[y], vocab[x + y]) for x, y in model["merges"])))
        key = (a << 32) | b
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.product = key[order], order.astype(np.int64), product[order]
        self.none = np.int64(len(key))
        self._split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") \
            if self.special else None
        rules = Tokenizer.from_file(file)       # its own table of merges is not kept
        self._normalizer, self._pre_tokenizer = rules.normalizer, rules.pre_tokenizer
        self._byte = {c: b for b, c in enumerate(letters)}
        self.chunks = RecentWords(CACHE_CHUNKS)

    # -- merges ------------------------------------------------------------

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or ``none``) and place in the pair table."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.key, key), self.key.size - 1)
        return np.where(self.key[at] == key, self.rank[at], self.none), at

    def _rounds(self, sym: np.ndarray, word: np.ndarray, out: list) -> None:
        """Merge all words of the flat array; ``out`` gets (word, symbols) arrays of
        words as they finish."""
        while sym.size:
            inside = word[1:] == word[:-1]
            rank, at = self._lookup(sym[:-1], sym[1:])
            rank = np.where(inside, rank, self.none)
            start = np.flatnonzero(np.concatenate([[True], ~inside]))
            best = np.minimum.reduceat(np.append(rank, self.none), start)
            size = np.diff(np.append(start, sym.size))
            done = best == self.none
            if done.any():
                gone = np.repeat(done, size)
                out.append((word[gone], sym[gone]))
                if done.all():
                    return
            merge = (rank == np.repeat(best, size)[:-1]) & (rank != self.none)
            # in a run of equal symbols every second pair is free, counted from the left
            place = np.flatnonzero(merge)
            run = np.concatenate([[True], np.diff(place) != 1])
            first = place[np.maximum.accumulate(np.where(run, np.arange(place.size), 0))]
            place = place[(place - first) % 2 == 0]
            sym = sym.copy()
            sym[place] = self.product[at[place]]
            stay = np.ones(sym.size, dtype=bool)
            stay[place + 1] = False
            if done.any():
                stay &= ~gone
            sym, word = sym[stay], word[stay]

    def _long(self, sym: list[int]) -> list[int]:
        """One long word with a heap of (rank, place)."""
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = np.array(sym, dtype=np.int64)
        rank, at = self._lookup(pairs[:-1], pairs[1:])
        heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(rank.tolist()) if r < self.none]
        heapq.heapify(heap)
        table: dict[tuple[int, int], tuple[int, int]] = {}

        def pair(a: int, b: int):
            if (a, b) not in table:
                r, p = self._lookup(np.array([a], dtype=np.int64), np.array([b], dtype=np.int64))
                table[a, b] = (int(r[0]), int(self.product[p[0]]))
            return table[a, b]

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i] = pair(a, b)[1]
            sym[j] = -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if 0 <= x and y < n:
                    r = pair(sym[x], sym[y])[0]
                    if r < self.none:
                        heapq.heappush(heap, (r, x, sym[x], sym[y]))
        return [s for s in sym if s >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each non-empty word as little-endian 32-bit integers."""
        result: list[bytes] = [b""] * len(words)
        batch: list[int] = []
        room = FLAT_SYMBOLS

        def flush():
            raw = np.frombuffer(b"".join([words[k] for k in batch]), dtype=np.uint8)
            size = np.array([len(words[k]) for k in batch], dtype=np.int64)
            sym = self.inner[raw]
            last = np.cumsum(size) - 1
            sym[last] = self.final[raw[last]]
            done: list[tuple[np.ndarray, np.ndarray]] = []
            self._rounds(sym, np.repeat(np.arange(len(batch)), size), done)
            word = np.concatenate([d[0] for d in done])
            ids = np.concatenate([d[1] for d in done])
            order = np.argsort(word, kind="stable")
            flat = ids[order].astype("<u4").tobytes()
            bound = offsets(np.bincount(word, minlength=len(batch))) * 4
            for k, a, b in zip(batch, bound[:-1].tolist(), bound[1:].tolist()):
                result[k] = flat[a:b]

        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                sym = self.inner[np.frombuffer(w, dtype=np.uint8)]
                sym[-1] = self.final[w[-1]]
                result[k] = np.array(self._long(sym.tolist()), dtype="<u4").tobytes()
                continue
            batch.append(k)
            room -= len(w)
            if room <= 0:
                flush()
                batch, room = [], FLAT_SYMBOLS
        if batch:
            flush()
        return result

    # -- texts -------------------------------------------------------------

    def _words(self, part: str) -> list[bytes]:
        """Normalised words of a text without special tokens.

        Characters up to Latin Extended-B go by the pattern; others by the library's
        own normaliser and pre-tokeniser, as character classes differ between Unicode
        versions.
        """
        if part.isascii():
            return [part.lower().encode()] if part.isalpha() else \
                [w.encode() for w in WORD.findall(part.lower())]
        if max(part) < "\u0250":
            part = unicodedata.normalize("NFC", part).lower()
            return [w.encode() for w in WORD.findall(part)]
        text = self._normalizer.normalize_str(part)
        byte = self._byte
        return [bytes([byte[c] for c in w])
                for w, _ in self._pre_tokenizer.pre_tokenize_str(text)]

    def _pieces(self, chunk: str) -> list[bytes | int]:
        """Words of a chunk without ASCII white space; special tokens as their ids."""
        if "<|" not in chunk:
            return self._words(chunk)
        out: list[bytes | int] = []
        for p in self._split.split(chunk) if self._split else [chunk]:
            if p in self.special:
                out.append(self.special[p])
            elif p:
                out += self._words(p)
        return out

    def _learn(self, chunks: list[bytes]) -> None:
        pieces = [self._pieces(c.decode()) for c in chunks]
        words = list({p for ps in pieces for p in ps if isinstance(p, bytes)})
        coded: dict = dict(zip(words, self.encode_words(words)))
        coded.update({i: i.to_bytes(4, "little") for i in self.special.values()})
        known = self.chunks.young
        for c, ps in zip(chunks, pieces):
            ids = coded[ps[0]] if len(ps) == 1 else b"".join([coded[p] for p in ps])
            known[c] = (ids, self._text(ids))

    def shrink(self, chunks: int) -> None:
        self.chunks.shrink(chunks)

    def _text(self, ids: bytes) -> bytes:
        """Token texts, each followed by a space."""
        token = self.tokens
        return "".join([token[i] for i in memoryview(ids).cast("I")]).encode()

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text) of each UTF-8 text."""
        split = [t.split() for t in texts]
        fresh = self.chunks.missing(split)
        if fresh:
            self._learn(fresh)
        known = self.chunks.young
        out = []
        for cs in split:
            found = [known[c] for c in cs]
            out.append((b"".join([f[0] for f in found]), b"".join([f[1] for f in found])[:-1]))
        return out

    def decode(self, ids: bytes) -> str:
        """Token texts joined by one space (the vocabulary file names no decoder)."""
        return self._text(ids)[:-1].decode()


def encode_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None,
                     file: str | None = None, digests: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) plus n_tokens, ids (little-endian
    unsigned 32-bit integers) and decoded (token texts joined by one space).

    ``digests``: ids_sha256 and decoded_sha256 (lower-case hex) instead of ids and
    decoded, so that whole outputs need not leave the task.  Null and empty texts have
    no tokens and an empty decoded text.  One narrow pass, row by row; a column that
    clashes with a result column is replaced by it.
    """
    file = file or tokenizer_file(VOCABULARY)
    result = ["n_tokens"] + (["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else RESULT
    names = [c for c in (keep if keep is not None else docs.columns) if c not in result]
    frame, inner = with_text(docs, names, text)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, "
                     for f in frame.select(*names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_table(TABLE, file, lambda: WordBpe(file))
        for batch, texts in slices(batches, inner, TABLE_SLICE_BYTES, TABLE):
            coded = bpe.encode([t or b"" for t in texts])
            cols = [pa.array([len(c[0]) // 4 for c in coded], pa.int64())]
            if digests:
                cols += [pa.array([hashlib.sha256(c[k]).hexdigest() for c in coded])
                         for k in (0, 1)]
            else:
                cols += [pa.array([c[0] for c in coded], pa.binary()),
                         pa.array([c[1].decode() for c in coded], pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names] + cols,
                names=names + result)

    return frame.mapInArrow(run, fields + schema)
