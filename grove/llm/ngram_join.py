"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are blocked by set size: a pair can reach the threshold only
if its sizes lie close together, so a document takes part in its own band of sizes and in
the next ones that a partner may lie in.  Within a band the columns are cut into ``k``
blocks of the n-gram hash range, more than a linked pair can differ in n-grams; such a
pair has at least one column block in common as a whole.  Only row pairs that share a whole
block are entries of the product.  A block of such rows is multiplied one column range after
the other: equal columns of an entry's two rows meet in one sort of the block, their counts are
added to its overlap, and an entry is discarded as soon as overlap plus what is left cannot reach
the bound of its sizes, so later ranges hold fewer rows.

Only connectivity is wanted, so a block shared by many rows is first multiplied with two
of its rows alone; rows that this already connects are not compared again.  What is left of
the block across components meets inside a salted join whose condition is a bound: every set
carries the parities of its n-grams in ``PARITY_BITS`` hash classes, and two sets differ in at
least as many n-grams as in parities, so a pair whose parities differ in more than its sizes
allow cannot link.  Only the other pairs leave the join and are multiplied.  No pair is capped
or sampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import (LOWER_TABLE, WordIndex, free_names, offsets, repeated_values,
                              return_memory, shared_table, slices)

#: Largest over smallest size of a band.
BAND_RATIO = 1.4
#: Column ranges over which an overlap is accumulated between two checks of its bound.
COLUMN_RANGES = 8
#: N-grams of the rows that one block of the product holds (or those of one entry).
PRODUCT_GRAMS = 1 << 20
MAX_ROUNDS = 60
#: Hash classes whose parities a set carries (a multiple of 64).
PARITY_BITS = 512
#: Open members of a block that one task holds against the others.
SALT_MEMBERS = 256


def size_bands(limit: int) -> np.ndarray:
    """First sizes of the bands up to one that starts above ``limit``."""
    starts = [1]
    while starts[-1] <= limit:
        starts.append(max(starts[-1], int(starts[-1] * BAND_RATIO)) + 1)
    return np.array(starts, dtype=np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Ascending distinct 64-bit n-gram hashes of each text; with fewer words the whole
    sequence is one n-gram."""
    index = WordIndex()
    split = [[] if t is None else t.translate(LOWER_TABLE).split() for t in texts]
    words = index.numbers([w for ws in split for w in ws])
    value = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in index.fresh), np.uint64,
                        len(index.fresh))[words]
    bound = offsets([len(ws) for ws in split])
    out = []
    for a, b in zip(bound[:-1], bound[1:]):
        v, m = value[a:b], min(n, int(b - a))
        h = np.full(max(int(b - a) - m + 1, 0) if m else 0, m, dtype=np.uint64)
        for k in range(m):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + v[k:k + h.size])
        out.append(np.unique(h))
    return out


def block_signatures(h: np.ndarray, percent: int, bands: np.ndarray) -> np.ndarray:
    """One hash for each column block of each band the set takes part in.

    There are half as many blocks again as a pair can have differences, and only the fullest
    ones count: the largest ``c`` such that more blocks hold ``c`` n-grams or over than the set
    can differ in.  Of two linked sets, the one with the larger ``c`` has such a block in
    common with the other, which the other's smaller ``c`` admits too.
    """
    size = h.size
    out = []
    rest, whole = 100 - percent, 100 + percent
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(h), dtype=np.uint64)])
    first = int(np.searchsorted(bands, size, side="right")) - 1
    for band in range(first, len(bands) - 1):
        if percent * int(bands[band]) > 100 * size:
            break
        top = int(bands[band + 1]) - 1
        most = 2 * top * rest // whole                      # differences within the band
        k = most + most // 2 + 1
        own = (size + min(top, 100 * size // percent)) * rest // whole
        cuts = (np.arange(k + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(k)
        at = np.searchsorted(h >> np.uint64(32), cuts)
        sig = sums[at[1:]] - sums[at[:-1]]
        sig = _mix(sig ^ _mix((np.uint64(band) << np.uint64(40))
                              + np.arange(1, k + 1, dtype=np.uint64)))
        filled = np.diff(at)
        c = np.partition(filled, k - own - 1)[k - own - 1]
        out.append(sig[filled >= c])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def product(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray,
            percent: int) -> np.ndarray:
    """Overlaps of row ``k`` of the left with row ``k`` of the right incidence block, each given
    as columns of all rows one after the other and rows' sizes; -1 for entries below the bound.
    """
    entries = len(left_size)
    need = -(-percent * (left_size + right_size) // (100 + percent))
    alive = np.minimum(left_size, right_size) >= need
    sides = []
    for columns, size in ((left, left_size), (right, right_size)):
        sides.append((np.repeat(np.arange(entries), size), columns, size.copy()))
    count = np.zeros(entries, dtype=np.int64)
    width = 64 - (COLUMN_RANGES - 1).bit_length()
    for part in range(COLUMN_RANGES):
        rows, columns = [], []
        for row, column, rest in sides:
            here = alive[row] & ((column >> np.uint64(width)) == part)
            rows.append(row[here])
            columns.append(column[here])
            rest -= np.bincount(row[here], minlength=entries)
        row, column = np.concatenate(rows), np.concatenate(columns)
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
        both = (row[1:] == row[:-1]) & (column[1:] == column[:-1])
        count += np.bincount(row[1:][both], minlength=entries)
        alive &= count + np.minimum(sides[0][2], sides[1][2]) >= need
    return np.where(alive, count, -1)


def parities(h: np.ndarray) -> np.ndarray:
    """Parity of the n-grams of each hash class, as 64-bit integers."""
    odd = np.bincount((h % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _digest(h: np.ndarray) -> bytes | None:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if h.size else None


def _sizes(docs: DataFrame, text: str, key: str, n: int) -> DataFrame:
    """key, n_shingles, set_id (digest of the set; null if empty)."""
    frame = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = frame.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "_text"):
            sets = ngram_sets(texts, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("_key")),
                 pa.array([s.size for s in sets], pa.int64()),
                 pa.array([_digest(s) for s in sets], pa.binary())],
                names=["_key", "n_shingles", "set_id"])

    return frame.mapInArrow(run, f"_key {kind}, n_shingles long, set_id binary")


def _row_number(set_id: str = "set_id"):
    """The first 8 bytes of a set's digest, as a number."""
    return F.conv(F.hex(F.substring(F.col(set_id), 1, 8)), 16, -10).cast("long")


def _shared_blocks(docs: DataFrame, text: str, classes: DataFrame, n: int, percent: int,
                   largest: int) -> DataFrame:
    """(sig, set_id, size): the column blocks of every set that another set has, too."""
    bands = size_bands(max(1, 100 * largest // percent + 1))

    def pairs(batch: pa.RecordBatch, texts: list) -> tuple[np.ndarray, np.ndarray]:
        seen = {}
        for s in ngram_sets(texts, n):
            if s.size:
                seen.setdefault(_digest(s), s)
        sigs = [block_signatures(s, percent, bands) for s in seen.values()]
        number = np.array([int.from_bytes(d[:8], "big", signed=True) for d in seen], dtype=np.int64)
        if not sigs:
            return number, number
        return np.concatenate(sigs).view(np.int64), np.repeat(number, [s.size for s in sigs])

    found = repeated_values(docs.select(F.col(text).cast("string").alias("_text")), "_text", pairs)
    # equal numbers of two sets only make more candidates, which are multiplied all the same
    named = classes.select(_row_number().alias("row"), "set_id", "size")
    return found.join(named, "row").select(F.col("value").alias("sig"), "set_id", "size")


def _sets(docs: DataFrame, text: str, key: str, chosen: DataFrame, n: int) -> DataFrame:
    """(set_id, grams, parity) of the chosen (set_id, _key) rows."""
    rows = (docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
            .join(chosen.select("set_id", "_key"), "_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "_text"):
            want = batch.column(batch.schema.get_field_index("set_id")).to_pylist()
            got = [(w, s) for w, s in zip(want, ngram_sets(texts, n)) if _digest(s) == w]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in got], pa.binary()),
                 pa.array([s.view(np.int64) for _, s in got], pa.list_(pa.int64())),
                 pa.array([parities(s) for _, s in got], pa.list_(pa.int64()))],
                names=["set_id", "grams", "parity"])

    return rows.mapInArrow(run, "set_id binary, grams array<long>, parity array<long>")


def _multiply(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose accumulated overlap reaches the bound."""
    joined = (pairs.join(sets.select(F.col("set_id").alias("a"), F.col("grams").alias("_ga")), "a")
              .join(sets.select(F.col("set_id").alias("b"), F.col("grams").alias("_gb")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, sizes = [], []
            for name in ("_ga", "_gb"):
                rows = batch.column(batch.schema.get_field_index(name))
                columns.append(rows.flatten().to_numpy().view(np.uint64))
                sizes.append(rows.value_lengths().to_numpy().astype(np.int64))
            at = [offsets(size) for size in sizes]
            block = (at[0][1:] + at[1][1:]) // PRODUCT_GRAMS
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            ok = [product(columns[0][at[0][i]:at[0][j]], sizes[0][i:j],
                          columns[1][at[1][i]:at[1][j]], sizes[1][i:j], percent) >= 0
                  for i, j in zip(cuts, cuts[1:])]
            ok = pa.array(np.concatenate(ok), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)).filter(ok)
                 for c in ("a", "b")], names=["a", "b"])
        batch = rows = columns = None
        return_memory()

    return joined.select("a", "b", "_ga", "_gb").mapInArrow(run, "a binary, b binary")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v``, which is no other's ``u``: neither star changes such edges."""
    ends = (edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"),
                                      F.lit(1).alias("down"))))
    most = ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n")).where("n > 1")
    # a root has any number of edges down, counted once, and none up
    return most.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the least node reachable, for every node of a link (a, b).

    Alternating large and small stars until the edges are stars; every round is written to the
    shared folder, so lineage stays short, and a hub is only ever aggregated with map-side minima.
    """
    links = links.where("a <> b")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m")
                                                            .alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = shared_table(small, "components")
        if _are_stars(edges):
            roots = edges.select(F.col("v").alias("node")).distinct()
            return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .unionByName(roots.select("node", F.col("node").alias("root"))))
    raise RuntimeError("components did not settle")


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 3,
                       percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: the key, n_shingles (its set's size), component_id
    (least key reachable over links, itself included).

    Two texts link when 100 * intersection >= percent * union of their distinct word
    n-grams (``percent`` above 72).  Texts without words, and null ones, have an empty set
    and link with nothing; rows with a null key link with nothing and have a null
    component.  Repeated rows and texts with equal sets are one class, so that copies
    never meet as pairs.  An empty table gives an empty result; other columns are not read.
    """
    if not 72 < percent <= 100:
        raise ValueError("percent has to lie above 72 and not above 100")
    rows = shared_table(_sizes(docs, text, key, n), "ngram-sizes")
    known = rows.where(F.col("_key").isNotNull() & F.col("set_id").isNotNull())
    classes = known.groupBy("set_id").agg(F.min("_key").alias("_key"), F.count("*").alias("_n"),
                                          F.max("n_shingles").alias("size"))
    links = _links(docs.where(F.col(key).isNotNull()), text, key, classes, n, percent,
                   int(rows.agg(F.max("n_shingles")).first()[0] or 0))
    root = components(links) if links is not None else None
    # only classes with copies or links need a look-up; every other row is its own component
    if root is None:
        grouped = classes.where("_n > 1").select("set_id", F.col("_key").alias("_c"))
    else:
        found = classes.join(root.withColumnRenamed("node", "set_id"), "set_id", "left")
        found = found.where("_n > 1 or root is not null").withColumn(
            "root", F.coalesce("root", "set_id"))
        least = found.groupBy("root").agg(F.min("_key").alias("_c"))
        grouped = found.join(least, "root").select("set_id", "_c")
    return (rows.join(grouped, "set_id", "left")
            .select(F.col("_key").alias(key), "n_shingles",
                    F.when(F.col("_key").isNotNull(), F.coalesce("_c", "_key"))
                    .alias("component_id")))


def _links(docs, text, key, classes, n, percent, largest) -> DataFrame | None:
    """Links (a, b) of set ids that connect exactly what all links connect."""
    if not largest:
        return None
    placed = shared_table(_shared_blocks(docs, text, classes, n, percent, largest).distinct(),
                          "ngram-placed")
    heads = placed.groupBy("sig").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi"))
    # column blocks that at least two sets share, with the two heads of each
    shared = shared_table(placed.join(heads.where("lo <> hi"), "sig"), "ngram-blocks")
    star = (shared.select("set_id", F.explode(F.array("lo", "hi")).alias("b"))
            .where("set_id <> b")
            .select(F.least("set_id", "b").alias("a"), F.greatest("set_id", "b").alias("b"))
            .distinct())
    members = shared.select("set_id").distinct()
    sets = shared_table(_sets(docs, text, key, classes.join(members, "set_id", "left_semi"), n)
                        .dropDuplicates(["set_id"]), "ngram-sets")
    done = shared_table(_multiply(star, sets, percent), "ngram-links")
    rest = _within_bound(_open_blocks(shared, done), sets, percent)
    return done.unionByName(shared_table(_multiply(rest, sets, percent), "ngram-rest"))


def _within_bound(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open members of one block, of different components, whose sizes and
    parities allow a link."""
    words = range(PARITY_BITS // 64)
    left = left.join(sets.select("set_id", *[F.get("parity", F.lit(k)).alias(f"p{k}")
                                             for k in words]), "set_id")
    salts = F.ceil(F.col("members") / SALT_MEMBERS).cast("int")
    place = F.pmod(F.xxhash64("set_id"), salts).cast("int")
    a, b = (side.select("sig", "salt", F.struct("set_id", "root", "size",
                                                *[f"p{k}" for k in words]).alias(name))
            for side, name in ((left.withColumn("salt", place), "a"),
                               (left.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))),
                                "b")))
    apart = sum((F.bit_count(F.col(f"a.p{k}").bitwiseXOR(F.col(f"b.p{k}"))) for k in words),
                F.lit(0))
    small, large = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    return (a.join(b, (a["sig"] == b["sig"]) & (a["salt"] == b["salt"])
                   & (F.col("a.set_id") < F.col("b.set_id")) & (F.col("a.root") != F.col("b.root"))
                   & (F.lit(100) * small >= F.lit(percent) * large)
                   & (F.lit(100 + percent) * apart <= F.lit(100 - percent) * (small + large)))
            .select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")).distinct())


def _open_blocks(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Members (sig, set_id, size, root, members: how many) of the blocks whose members the
    links have not brought into one component."""
    placed = (shared.select("sig", "set_id", "size")
              .join(components(links).withColumnRenamed("node", "set_id"), "set_id", "left")
              .withColumn("root", F.coalesce("root", "set_id")))
    apart = (placed.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"),
                                      F.count("*").alias("members"))
             .where("x <> y").select("sig", "members"))
    return shared_table(placed.join(apart, "sig"), "ngram-open")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5,
               percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each component: that of the least key, of repeated rows any one.

    A null key comes after every other.  Rows are told apart by a row id, written once to the
    shared folder, so repeated rows and rows without a key are grouped by their texts like
    others.  Texts without words link with nothing; all their rows stay.
    """
    row, by = free_names(docs.columns, "_row", "_order")
    rows = shared_table(docs.withColumn(row, F.monotonically_increasing_id()), "ngram-rows")
    order = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"),
                     F.col(row).alias("row"))
    found = jaccard_components(rows.withColumn(by, order), text, by, n, percent)
    gone = found.where(F.col(by) != F.col("component_id")).select(
        F.col(f"{by}.row").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)
