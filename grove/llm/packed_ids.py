"""Token-id files with fixed-width bit packing.

Every id takes the fewest bits that hold the largest id of the vocabulary.  Ids are
packed in blocks of a fixed count; a block starts on a byte, and the file's index
holds the byte offset of each block, so any id range is read by seeking to its first
block and unpacking with a few vectorised numpy shifts.

File (little-endian):
  8 bytes   magic ``GRVIDS01``
  payload   blocks, one after the other
  index     u64 byte offset of each block and of the end of the payload
  documents i64 doc key, i64 first id (within the file), i64 count of ids; one row each
  footer    u64 ids, u64 documents, u32 bits, u32 ids per block, 8 bytes magic

Documents are dealt to files by ranges of their key and sorted within them, so file
order and row order together are the order of the whole set.  A task writes to a name
of its own and renames it at the end; a repeated task replaces the file by an equal one.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from grove.llm.bpe import byte_letters
from grove.llm.common import kept_table, offsets, ranges, slices, tokenizer_file
from grove.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Stands for a null key in a file.
NO_KEY = -(1 << 63)
TABLE = "packed ids"
MAGIC = b"GRVIDS01"
#: Ids per block; a multiple of 8, so that every block ends on a byte.
BLOCK_IDS = 4096
#: A task starts another file beyond this many ids (64 MB of 16-bit ids).
FILE_IDS = 32 << 20
#: Distinct words, and their bytes, whose ids a worker keeps before it forgets rare ones.
CACHE_WORDS = 400_000
CACHE_BYTES = 8 << 20
#: Longer words are forgotten with the rare ones.
LONG_BYTES = 64

_FOOTER = np.dtype([("ids", "<u8"), ("docs", "<u8"), ("bits", "<u4"), ("block", "<u4")])


# -- packing -----------------------------------------------------------------

def bits_for(size: int) -> int:
    """Bits that hold every id below ``size``."""
    return max(1, int(size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, lowest bit first, the end filled with zero bits."""
    ids = np.asarray(ids, dtype=np.uint64)
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    # eight ids fill exactly ``bits`` bytes: or each id into the 64-bit words it touches
    groups = -(-ids.size // 64)
    padded = np.zeros(groups * 64, dtype=np.uint64)
    padded[:ids.size] = ids
    rows = padded.reshape(groups, 64)
    words = np.zeros((groups, bits + 1), dtype=np.uint64)
    for k in range(64):
        w, shift = divmod(k * bits, 64)
        words[:, w] |= rows[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, w + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return words[:, :bits].astype("<u8").tobytes()[:-(-ids.size * bits // 8)]


def unpack(raw: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=count).astype("<u4")
    groups = -(-count // 64)
    words = np.zeros((groups, bits + 1), dtype=np.uint64)
    full = np.zeros(groups * bits * 8, dtype=np.uint8)
    full[:min(len(raw), full.size)] = np.frombuffer(raw, np.uint8, min(len(raw), full.size))
    words[:, :bits] = full.view("<u8").reshape(groups, bits)
    out = np.empty((groups, 64), dtype=np.uint64)
    for k in range(64):
        w, shift = divmod(k * bits, 64)
        out[:, k] = words[:, w] >> np.uint64(shift)
        if shift + bits > 64:
            out[:, k] |= words[:, w + 1] << np.uint64(64 - shift)
    return (out.ravel()[:count] & np.uint64((1 << bits) - 1)).astype("<u4")


# -- encoding ----------------------------------------------------------------

#: White space that the word cut below does not cover.
_ODD_ASCII = b"\x00\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD_WIDE = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")
_ODD_PARTS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def _odd(t: bytes) -> bool:
    """Whether a text has white space whose surroundings the word cut does not cover, the
    character that it cuts at, or what may be a special token."""
    return (b"  " in t or b"\n\n" in t or b" \n" in t or b"\n " in t or b"<|" in t
            or t[:1] in (b" ", b"\n") or t[-1:] in (b" ", b"\n")
            or len(t.translate(None, _ODD_ASCII)) != len(t)
            or not t.isascii() and (any(x in t for x in _ODD_PARTS)
                                    or _ODD_WIDE.search(t) is not None))


#: 1: ASCII letters and digits, 2: marks that never share a token with one before them.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[b for b in range(128) if chr(b).isalnum()]] = 1
_CLASS[list(b"!\"),.:;?]}")] = 2


def _cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of texts that are not odd: the number of words before each text (and in all), each
    word's place in the list of distinct words, and that list.

    Words with the space before them, line ends, and what follows from a mark on.  They lie side by
    side in the joined texts, so that their starts are all that is needed to tell them apart.
    """
    raw = b"".join(texts)
    if not raw:
        return np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.int64), []
    flat = np.frombuffer(raw, dtype=np.uint8)
    kind = _CLASS[flat]
    start = (flat == 0x20) | (flat == 0x0A)
    start[1:] |= (flat[:-1] == 0x0A) | ((kind[1:] == 2) & (kind[:-1] == 1))
    begin = offsets([len(t) for t in texts])
    start[begin[:-1][begin[:-1] < begin[1:]]] = True
    at = np.append(np.flatnonzero(start), flat.size)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), at.size - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])
    coded = words.dictionary_encode()
    _, cuts, distinct = coded.dictionary.buffers()
    cuts = np.frombuffer(cuts, dtype=np.int64, count=len(coded.dictionary) + 1).tolist()
    distinct = distinct.to_pybytes()
    return (np.searchsorted(at, begin), coded.indices.to_numpy(),
            [distinct[a:b] for a, b in zip(cuts, cuts[1:])])


class Encoder:
    """A byte-level BPE vocabulary of the tokenizers library, applied to distinct words.

    The vocabulary's pattern always cuts before a single space, around a single line
    end between other characters, and between an ASCII letter or digit and a mark; a text
    with any other white space, or with a special token, is encoded whole.  The ids of the distinct words lie in one flat array, from
    which a slice of texts is put together at once.
    """

    def __init__(self, file: str):
        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        # a byte-level token has one letter for each of its bytes
        self.bytes = np.zeros(self.size, dtype=np.int64)
        for token, number in self.library.get_vocab(with_added_tokens=False).items():
            self.bytes[number] = len(token)
        self.letters = dict(enumerate(byte_letters()))
        self.space = self.letters[0x20]
        self.reset()

    def reset(self) -> None:
        self.words: dict[bytes, int] = {}
        self.ids = np.zeros(0, dtype="<u4")
        self.at = np.zeros(1, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int64)
        self.held = 0                      # bytes of the words

    def shrink(self, words: int) -> None:
        """Keep at most so many of the words met twice or more since they were last sorted out,
        the most frequent ones, and no long ones."""
        names = list(self.words)
        size = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
        keep = np.flatnonzero((self.uses > 1) & (size <= LONG_BYTES))
        if keep.size > words:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[:words]])
        count = (self.at[1:] - self.at[:-1])[keep]
        self.ids = self.ids[ranges(self.at[keep], count)]
        self.at = offsets(count)
        self.words = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.uses = np.zeros(keep.size, dtype=np.int64)
        self.held = int(size[keep].sum())

    @property
    def size(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def _whole(self, texts: list[bytes]) -> list[list[int]]:
        done = self.library.encode_batch_fast([t.decode() for t in texts],
                                              add_special_tokens=False)
        return [e.ids for e in done]

    def _letters(self, word: bytes) -> str | None:
        """A word that is one piece of the pattern in the vocabulary's letters for bytes; None
        if it is not known to be one.  Characters up to Latin Extended-B alone are judged
        here, as character classes differ between Unicode versions."""
        body = word[1:] if word[:1] == b" " else word
        if body.isalpha() or body.isdigit():
            return word.decode().replace(" ", self.space)
        if word.isascii():
            return None
        body = body.decode()
        if not body.isalpha() or max(body) >= "\u0250":
            return None
        return word.decode("latin-1").translate(self.letters)

    def _joined(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words.  Many make one text, a word without a space of its own after a line
        end, and the bytes of the text's tokens tell the words apart again."""
        out = []
        for k in range(0, len(words), 20_000):
            part = words[k:k + 20_000]
            if b"\n" in part:       # the line end itself cannot stand beside another one
                out += self._whole(part)
                continue
            lead = [0 if w[:1] == b" " else 1 for w in part]
            text = b"".join([b"\n" + w if x else w for w, x in zip(part, lead)])
            ids = self._whole([text])[0]
            after = np.cumsum(self.bytes[ids])
            size = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + lead
            stop = (np.searchsorted(after, np.cumsum(size)) + 1).tolist()
            out += [ids[a + x:b] for a, b, x in zip([0, *stop], stop, lead)]
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words: a single piece goes to the library's merges at once."""
        letters = [self._letters(w) for w in words]
        rest = iter(self._joined([w for w, x in zip(words, letters) if x is None]))
        merged = self.library.model.tokenize
        ids = [next(rest) if x is None else [t.id for t in merged(x)] for x in letters]
        ends = self.at[-1] + offsets(list(map(len, ids)))
        flat = np.fromiter(chain.from_iterable(ids), dtype="<u4", count=int(ends[-1] - ends[0]))
        self.ids = np.concatenate([self.ids, flat])
        self.at = np.concatenate([self.at, ends[1:]])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        if len(self.words) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.shrink(CACHE_WORDS // 2)
        odd = [_odd(t) for t in texts]
        bound, place, distinct = _cut([b"" if o else t for t, o in zip(texts, odd)])
        number = np.fromiter(map(self.words.get, distinct, repeat(-1)), dtype=np.int64,
                             count=len(distinct))
        new = np.flatnonzero(number < 0)
        number[new] = len(self.words) + np.arange(new.size)
        fresh = [distinct[i] for i in new.tolist()]
        self.words.update(zip(fresh, number[new].tolist()))
        self._learn(fresh)
        self.held += sum(map(len, fresh))
        numbers = number[place]
        uses = np.bincount(numbers, minlength=len(self.words))
        uses[:self.uses.size] += self.uses
        self.uses = uses
        size = (self.at[1:] - self.at[:-1])[numbers]
        flat = self.ids[ranges(self.at[numbers], size)]
        bound = offsets(size)[bound].tolist()
        rest = iter(self._whole([t for t, o in zip(texts, odd) if o]))
        return [np.array(next(rest), dtype="<u4") if o else flat[a:b]
                for a, b, o in zip(bound[:-1], bound[1:], odd)]


# -- files -------------------------------------------------------------------

def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") \
        else (fs.LocalFileSystem(), path)


class IdFile:
    """Writer of one file."""

    def __init__(self, folder: str, name: str, bits: int, block: int):
        self.system, base = _open(folder)
        self.system.create_dir(base, recursive=True)
        self.path, self.own = f"{base}/{name}", f"{base}/.{name}-{uuid.uuid4().hex}"
        self.bits, self.block = bits, block
        self.out = self.system.open_output_stream(self.own)
        self.out.write(MAGIC)
        self.at, self.ids = len(MAGIC), 0
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        self.index: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc: int, ids: np.ndarray, end: np.ndarray) -> None:
        size = ids.size + end.size
        self.docs.append((doc, self.ids, size))
        self.ids += size
        self.rest += (ids, end)
        self.waiting += size
        if self.waiting >= 64 * self.block:
            self._flush(self.waiting // self.block * self.block)

    def _flush(self, count: int) -> None:
        flat = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        raw = pack(flat[:count], self.bits)
        step = self.block * self.bits // 8
        self.index.append(self.at + np.arange(-(-count // self.block), dtype=np.int64) * step)
        self.out.write(raw)
        self.at += len(raw)
        self.rest, self.waiting = [flat[count:]], self.waiting - count

    def close(self) -> int:
        if self.waiting:
            self._flush(self.waiting)
        index = np.concatenate([*self.index, np.array([self.at], dtype=np.int64)])
        self.out.write(index.astype("<u8").tobytes())
        self.out.write(np.array(self.docs, dtype="<i8").reshape(-1, 3).tobytes())
        self.out.write(np.array([(self.ids, len(self.docs), self.bits, self.block)],
                                dtype=_FOOTER).tobytes() + MAGIC)
        self.out.close()
        self.system.move(self.own, self.path)
        return self.ids


class IdReader:
    """Random access to one file."""

    def __init__(self, path: str):
        self.system, self.path = _open(path)
        self.file = self.system.open_input_file(self.path)
        size = self.file.size()
        tail = self.file.read_at(_FOOTER.itemsize + len(MAGIC), size - _FOOTER.itemsize - len(MAGIC))
        if tail[-len(MAGIC):] != MAGIC:
            raise ValueError(f"not a token-id file: {path}")
        foot = np.frombuffer(tail, dtype=_FOOTER, count=1)[0]
        self.ids, n = int(foot["ids"]), int(foot["docs"])
        self.bits, self.block = int(foot["bits"]), int(foot["block"])
        blocks = -(-self.ids // self.block) + 1
        at = size - len(tail) - 24 * n
        self.docs = np.frombuffer(self.file.read_at(24 * n, at), dtype="<i8").reshape(n, 3)
        self.index = np.frombuffer(self.file.read_at(8 * blocks, at - 8 * blocks), dtype="<u8")

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids start .. start+count-1."""
        if not count:
            return np.zeros(0, dtype="<u4")
        a, b = start // self.block, -(-(start + count) // self.block)
        lo, hi = int(self.index[a]), int(self.index[b])
        got = min(b * self.block, self.ids) - a * self.block
        ids = unpack(self.file.read_at(hi - lo, lo), got, self.bits)
        return ids[start - a * self.block:start - a * self.block + count]


# -- Spark -------------------------------------------------------------------

def write_ids(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id",
              file: str | None = None, end_id: int = END_ID, block: int = BLOCK_IDS,
              file_ids: int = FILE_IDS, partitions: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids of all documents in
    ascending ``key`` order as id files below ``folder`` (shared by all executors).

    Returns the files written, in order: path, first (ids of all files before it), ids,
    docs.  Keys are integers; null and empty texts have the end id alone; a null key counts
    as the smallest long, as which it is stored; rows with equal keys stay in the order of the input; an empty table
    writes no file.  Texts are dealt by ranges of the key (and the row's place, so that
    one key cannot fill a task), which is the only shuffle.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"column {key} is no integer")
    if block % 64:
        raise ValueError("block must be a multiple of 64")
    file = file or tokenizer_file(VOCABULARY)
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_col = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))
    dealt = (docs.select(key_col.alias("_key"), F.monotonically_increasing_id().alias("_row"),
                         F.col(text).cast("string").alias("_text"))
             .repartitionByRange(n, "_key", "_row").sortWithinPartitions("_key", "_row")
             .withColumn("_part", F.spark_partition_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_table(TABLE, file, lambda: Encoder(file))
        bits = bits_for(max(coder.size, end_id + 1))
        end = np.array([end_id], dtype="<u4")
        out, part, turn = None, 0, 0

        def close():
            ids = out.close()
            return pa.RecordBatch.from_pydict(
                {"path": [f"{folder.rstrip('/')}/{out.path.rsplit('/', 1)[1]}"],
                 "ids": [ids], "docs": [len(out.docs)]})

        for batch, texts in slices(batches, "_text", table=TABLE, idle=CACHE_WORDS // 2):
            part = batch.column(batch.schema.get_field_index("_part"))[0].as_py()
            keys = batch.column(batch.schema.get_field_index("_key")).to_pylist()
            for k, ids in zip(keys, coder.encode([t or b"" for t in texts])):
                if out is None:
                    out = IdFile(folder, f"ids-{part:07d}-{turn:04d}.bin", bits, block)
                out.add(k, ids, end)
                if out.ids >= file_ids:
                    yield close()
                    out, turn = None, turn + 1
        if out is not None:
            yield close()

    made = dealt.mapInArrow(run, "path string, ids long, docs long")
    # one small row per file; its running sum is the driver's, as for any list of files
    files = sorted(made.collect(), key=lambda r: r["path"])
    first = offsets([r["ids"] for r in files]).tolist()
    return spark.createDataFrame(
        [(r["path"], first[k], r["ids"], r["docs"]) for k, r in enumerate(files)],
        "path string, first long, ids long, docs long")


def read_ids(files: DataFrame, whole: bool = True, run_ids: int = 4 << 20) -> DataFrame:
    """Documents of the files: key, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if ``whole``,
    the ids themselves.  The key NO_KEY comes back as null.  Files are read apart, in runs of about ``run_ids`` ids."""
    n = max(1, files.count())
    schema = "key long, start long, n_tokens long, ids_crc32 long"
    schema += ", ids array<long>" if whole else ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, first in zip(frame["path"], frame["first"]):
                reader = IdReader(path)
                docs = reader.docs
                step = (docs[:, 1] + docs[:, 2]) // run_ids
                cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(docs)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if a == b:
                        continue
                    lo = int(docs[a, 1])
                    ids = reader.read(lo, int(docs[b - 1, 1] + docs[b - 1, 2]) - lo)
                    own = [ids[s - lo:s - lo + c] for s, c in docs[a:b, 1:].tolist()]
                    yield pd.DataFrame({
                        "key": docs[a:b, 0], "start": first + docs[a:b, 1],
                        "n_tokens": docs[a:b, 2],
                        "ids_crc32": [zlib.crc32(x.tobytes()) for x in own],
                        **({"ids": own} if whole else {})})

    got = files.repartition(n, "path").mapInPandas(run, schema)
    return got.withColumn("key", F.when(F.col("key") != NO_KEY, F.col("key")))


def fresh_folder(spark: SparkSession) -> str:
    """A new folder for id files below the shared checkpoint folder."""
    return scratch_path(spark, "token-ids")
