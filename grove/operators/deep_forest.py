"""Deep regression forests: large nodes split level by level over the cluster, small ones finished in a task.

MLlib sends a dense histogram of every drawn feature and bin for each open node and partition; with a
row a leaf that is nearly all of the time of a depth-30 forest.  Here only nodes of more bagged rows than
``whole_node`` are split so.  The rows of a smaller node go to one group, as many groups as
there are such nodes, several in a task, and the rest of its tree is grown there.  Bins, bags, features drawn for each node,
gain and stopping rules are MLlib's.

The nodes of such a forest grow with the rows, so they stay in the shared folder as *pieces*, a row for each
group; rows are scored where the pieces are (``StoredForest``).  What needs MLlib's own model (the trees one
by one, importances, saving) loads it from a table of the nodes, in the driver as MLlib does.

A node is named by its number in a full binary tree: 1 the root, 2p and 2p + 1 the children of p.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.ml.linalg import SparseVector
from pyspark.ml.param import Params
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.session import scratch_path

#: Bagged rows of a node at most that one group may finish, and bytes of their bins beyond ``LEAST_WHOLE`` rows.
WHOLE_NODE, LEAST_WHOLE, WHOLE_BYTES = 1 << 16, 1 << 12, 1 << 25
#: Rows from which MLlib takes the bins of a feature: so many, or the square of the bins.
ROWS_FOR_BINS = 10_000
#: Bytes of the bins of a task's rows at most.
TASK_BYTES = 1 << 26
#: Rows whose bins are dealt out together, in bytes; rows whose features are numbers at once.
DEALT_BYTES, DENSE_ROWS = 1 << 24, 1 << 11
#: Nodes of so many distinct rows or fewer are searched in order of their rows, larger ones by histograms.
FEW_ROWS = 16
#: Drawn features of so many nodes that are searched at once, in order of rows and by histograms: what fits a CPU's cache.
IN_ORDER_AT_ONCE, HISTOGRAMS_AT_ONCE = 1 << 14, 1 << 12

POINT = "row long, y double, bins binary, bag binary"
NODE = ("tree int, path long, prediction double, impurity double, stats array<double>, gain double, "
        "feature int, threshold double")
SPLIT = ("tree int, path long, stats array<double>, pure boolean, gain double, feature int, bin int, "
         "n_left double")
#: Nodes at and below ``path``, breadth first; cut and gain of those that split, stats of the leaves.
PIECE = "task int, tree int, path long, n_nodes int, feature binary, cut binary, gain binary, stats binary"


def fits(est: RandomForestRegressor) -> bool:
    """Bins and bag counts are kept in a byte each."""
    return est.getMaxBins() <= 256 and not est.isSet("weightCol")


def subset_size(strategy: str, width: int, trees: int) -> int:
    """Features drawn for a node, as MLlib reads the strategy of a regression forest."""
    s = {"auto": "all" if trees == 1 else "onethird"}.get(strategy, strategy)
    if s == "all":
        return width
    if s in ("onethird", "sqrt", "log2"):
        return max(1, math.ceil({"onethird": width / 3, "sqrt": math.sqrt(width), "log2": math.log2(width)}[s]))
    n = int(s) if s.isdigit() else math.ceil(float(s) * width)
    return max(1, min(n, width))


# ---------------------------------------------------------------- bins and bags

def thresholds(values: np.ndarray, counts: np.ndarray, n_bins: int) -> np.ndarray:
    """Thresholds of a feature between its distinct values in order: all of them if they fit the
    bins, else those nearest to equal shares of the rows (as MLlib places them, a value a threshold at most)."""
    between = (values[:-1] + values[1:]) / 2
    if len(between) < n_bins:
        return between
    found, target, share, seen = [], counts.sum() / n_bins, counts.sum() / n_bins, 0
    for i, n in enumerate(counts[:-1].tolist()):
        seen += n
        if abs(seen - target) < abs(seen + counts[i + 1] - target):
            found.append(between[i])
            target += share
    return np.array(found)


def feature_thresholds(rows: DataFrame, width: int, n_rows: int, n_bins: int, seed: int) -> dict[int, np.ndarray]:
    """Thresholds of every feature that varies, from as many rows as MLlib takes."""
    share = max(n_bins * n_bins, ROWS_FOR_BINS) / n_rows
    some = rows if share >= 1 else rows.sample(False, share, seed)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in dense(b.column("x"), width):
                found = [np.unique(x[:, f], return_counts=True) for f in range(width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(width, dtype=np.int32)), pa.array([v for v, _ in found], pa.list_(pa.float64())),
                     pa.array([c for _, c in found], pa.list_(pa.int64()))], ["feature", "v", "n"])
        give_back()

    def of_feature(key, t):
        v, at = np.unique(t["v"].combine_chunks().flatten().to_numpy(), return_inverse=True)
        n = np.bincount(at, t["n"].combine_chunks().flatten().to_numpy()).astype(np.int64)
        return pa.table({"feature": pa.array([key[0].as_py()], pa.int32()),
                         "found": pa.array([thresholds(v, n, n_bins)], pa.list_(pa.float64()))})

    parts = some.mapInArrow(counted, "feature int, v array<double>, n array<long>")
    got = parts.groupBy("feature").applyInArrow(of_feature, "feature int, found array<double>")
    return {r.feature: np.array(r.found) for r in got.collect() if r.found}


def dense(vectors: pa.StructArray | pa.ListArray, width: int) -> Iterator[np.ndarray]:
    """A column of MLlib's vectors, or of arrays, as matrices (of ``DENSE_ROWS`` rows at most)."""
    if vectors.null_count:
        raise ValueError("features must not be null")
    if not pa.types.is_struct(vectors.type):
        if (pc.list_value_length(vectors).to_numpy(zero_copy_only=False) != width).any():
            raise ValueError(f"a row has not {width} features as others have")
        yield vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        return
    for start in range(0, len(vectors), DENSE_ROWS):
        kind, size, at, values = vectors.slice(start, DENSE_ROWS).flatten()
        is_dense = kind.to_numpy() == 1
        x, n = np.zeros((len(kind), width)), pc.list_value_length(values).to_numpy()
        if (np.where(is_dense, n, size.fill_null(0).to_numpy()) != width).any():
            raise ValueError(f"a row has not {width} features as others have")
        some = np.flatnonzero(~is_dense)
        x[np.repeat(some, n[some]), at.flatten().to_numpy()] = values.filter(pa.array(~is_dense)).flatten().to_numpy()
        x[is_dense] = values.filter(pa.array(is_dense)).flatten().to_numpy().reshape(-1, width)
        yield x


def give_back() -> None:
    """Memory that a reused worker has freed goes back to the system; its allocators would keep it beside the heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def in_bins(x: np.ndarray, cuts: dict[int, np.ndarray]) -> np.ndarray:
    """The bin of every value; NaN lies above all."""
    bins = np.zeros(x.shape, np.uint8)
    for f, c in cuts.items():
        bins[:, f] = np.searchsorted(c, x[:, f])
    return bins


def binned(rows: DataFrame, width: int, cuts: dict[int, np.ndarray], est: RandomForestRegressor) -> DataFrame:
    """Rows with a byte for the bin of each feature and one for the count in each tree's bag, drawn by
    partition and order of the rows, as MLlib does."""
    trees, rate, again, seed = est.getNumTrees(), est.getSubsamplingRate(), est.getBootstrap(), est.getSeed()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rng, row = np.random.default_rng([seed & (2 ** 63 - 1), part]), part << 33
        for b in batches:
            at = 0
            for x in dense(b.column("x"), width):
                n = len(x)
                if np.isnan(x).any():
                    raise ValueError("trees need every feature, got NaN")
                bag = (np.minimum(rng.poisson(rate, (n, trees)), 255) if again
                       else rng.random((n, trees)) < rate).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), b.column("y").slice(at, n),
                     pa.array([r.tobytes() for r in in_bins(x, cuts)], pa.binary()),
                     pa.array([r.tobytes() for r in bag], pa.binary())], ["row", "y", "bins", "bag"])
                row, at = row + n, at + n
        give_back()

    return rows.mapInArrow(work, POINT)


def _bytes(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)


# ---------------------------------------------------------------- search for a split

def histogram(bins, w, wy, drawn, n_bins) -> np.ndarray:
    """Weight and weighted label of one node's rows by bin and drawn feature."""
    k, hist = len(drawn), np.zeros((2, len(drawn) * n_bins))
    for i in range(0, len(bins), 4096):
        cell = (np.take(bins[i:i + 4096], drawn, axis=1).astype(np.intp) * k + np.arange(k)).ravel()
        for h, v in zip(hist, (w, wy)):
            h += np.bincount(cell, np.repeat(v[i:i + 4096], k), k * n_bins)
    return hist.reshape(2, n_bins, k)


def best_splits(hist, min_rows: int):
    """For each node (third axis) the greatest drop of squared error (0: no split), its place among the drawn
    features, its bin and the weight left of it."""
    _, n_bins, n, k = hist.shape
    total, whole = hist.sum(axis=1)[:, :, :1]
    left, below, best, last = (np.zeros((n, k)) for _ in range(4))
    with np.errstate(divide="ignore", invalid="ignore"):
        for b in range(n_bins - 1):
            left += hist[0, b]
            below += hist[1, b]
            score = _score(left, below, total, whole)
            score *= (left >= min_rows) & (left <= total - min_rows)
            np.copyto(last, b, where=score > best)
            np.fmax(best, score, out=best)
        gain = np.where(best > 0, best - whole * whole / total, 0.0)
    f, each = gain.argmax(axis=1), np.arange(n)
    cut = last[each, f].astype(int)
    n_left = [hist[0, :b + 1, j, i].sum() for j, (i, b) in enumerate(zip(f, cut))]
    return gain[each, f], f, cut, np.array(n_left)


def _score(left, below, total, whole):
    """What a split leaves of the squared error, but for a constant of the node."""
    right, rest = total - left, whole - below
    return below * below / left + rest * rest / right


@cache
def exchanges(n: int) -> list[tuple[int, int]]:
    """Places to compare, one pair after the other, to put ``n`` (a power of two) values in order."""
    found, p = [], 1
    while p < n:
        q = p
        while q >= 1:
            found += [(i + j, i + j + q) for j in range(q % p, n - q, 2 * q) for i in range(min(q, n - j - q))
                      if (i + j) // (2 * p) == (i + j + q) // (2 * p)]
            q //= 2
        p *= 2
    return found


def splits_of_few(bins, w, wy, start, size, drawn, min_rows: int):
    """Gain, place among the drawn features and bin of the best split of nodes of few rows (from ``start`` on,
    ``size`` of them): the rows are put in order of each drawn feature's bins, all nodes and
    features at once, and each place between two bins is tried."""
    n, k = drawn.shape
    m = 1 << (int(size.max()) - 1).bit_length()
    real = np.arange(m)[:, None] < size
    row = start + np.where(real, np.arange(m)[:, None], 0)  # A place without a row stands for the first, with no weight.
    flat, sets = bins.ravel(), m <= 8
    # A key is the bin and, in the low byte, the row's place or, of up to 8 rows, the bit of its place.
    mark = (np.where(real, 1 << np.arange(m)[:, None], 0) if sets else np.tile(np.arange(m)[:, None], n)).astype(np.uint16)
    keys = [((flat.take((r * bins.shape[1])[:, None] + drawn).astype(np.uint16) << 8) | i[:, None]).ravel()
            for r, i in zip(row, mark)]
    spare = np.empty_like(keys[0])
    for i, j in exchanges(m):
        np.minimum(keys[i], keys[j], out=spare)
        np.maximum(keys[i], keys[j], out=keys[j])
        keys[i], spare = spare, keys[i]
    weight, label = (np.where(real, v[row], 0.0).T for v in (w, wy))
    total, whole = weight.sum(axis=1), label.sum(axis=1)
    best, last, gone = np.zeros(n * k), np.zeros(n * k), np.zeros(n * k, np.uint16)
    with np.errstate(divide="ignore", invalid="ignore"):
        if sets:
            left, below = np.zeros((n, 1)), np.zeros((n, 1))
            for i in range(m):
                left, below = (np.hstack([t, t + v[:, i:i + 1]]) for t, v in ((left, weight), (below, label)))
            each_set = _score(left, below, total[:, None], whole[:, None])
            each_set = (each_set * ((left >= min_rows) & (left <= total[:, None] - min_rows))).ravel()
            node = np.repeat(np.arange(n) << m, k)
        else:
            left, below, node = np.zeros(n * k), np.zeros(n * k), np.repeat(np.arange(n) * m, k)
            weight, label, of_all = weight.ravel(), label.ravel(), (np.repeat(total, k), np.repeat(whole, k))
        for i in range(m - 1):
            if sets:
                gone |= keys[i] & 255
                score = each_set.take(node + gone)
            else:
                at = node + (keys[i] & 255)
                left += weight.take(at)
                below += label.take(at)
                score = _score(left, below, *of_all)
                if min_rows > 1:
                    score *= (left >= min_rows) & (left <= of_all[0] - min_rows)
            score *= (keys[i] ^ keys[i + 1]) > 255  # Between two bins, the high bytes of the keys differ.
            np.copyto(last, i, where=score > best)
            np.fmax(best, score, out=best)
        gain = np.where(best.reshape(n, k) > 0, best.reshape(n, k) - (whole * whole / total)[:, None], 0.0)
    f, each = gain.argmax(axis=1), np.arange(n)
    i = each * k + f
    cut = np.stack(keys)[last[i].astype(int), i] >> 8
    return gain[each, f], f, cut.astype(int)


def splits_of_two(bins, w, y, start, drawn, min_rows: int):
    """The same of nodes of two rows: every feature that parts them does so alike."""
    n, k = drawn.shape
    one, other = bins[start], bins[start + 1]
    place = np.arange(n)[:, None] * bins.shape[1] + drawn
    f = (one != other).ravel().take(place).argmax(axis=1)
    at = (np.arange(n), drawn[np.arange(n), f])
    a, b, v, u = one[at], other[at], w[start], w[start + 1]
    gain = np.where((a != b) & (np.minimum(v, u) >= min_rows), v * u / (v + u) * (y[start] - y[start + 1]) ** 2, 0.0)
    return gain, f, np.minimum(a, b).astype(int)


def drawn_features(rng: np.random.Generator, nodes: int, width: int, k: int) -> np.ndarray:
    if k == width:
        return np.tile(np.arange(width), (nodes, 1))
    # Random numbers from 0 to 1, in the order of their bytes, with the feature in the last bits: the k smallest.
    bits = np.uint64((1 << (width - 1).bit_length()) - 1)
    keys = rng.random((nodes, width)).view(np.uint64) & ~bits | np.arange(width, dtype=np.uint64)
    return np.sort((np.partition(keys, k - 1, axis=1)[:, :k] & bits).astype(np.uint32), axis=1).astype(np.int64)


def enough(gain, stats) -> bool:
    """Whether a drop of squared error is more than what rounding makes of none."""
    w, s, ss = stats
    return gain > 1e-12 * np.maximum(ss - s * s / w, 0)


# ---------------------------------------------------------------- large nodes: over the cluster

class Top:
    """The upper part of each tree: splits found so far, and the nodes at its ends."""

    def __init__(self, trees: int):
        self.splits: list[dict[int, tuple[int, int]]] = [{} for _ in range(trees)]

    def ends(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """The end node to which each row comes."""
        splits, path, here = self.splits[tree], np.ones(len(bins), np.int64), np.arange(len(bins))
        while len(here) and splits:
            at, where = np.unique(path[here], return_inverse=True)
            known = np.array([int(p) in splits for p in at])
            f, b = np.array([splits.get(int(p), (0, 0)) for p in at]).T
            here, where = here[known[where]], where[known[where]]
            path[here] = 2 * path[here] + (bins[here, f[where]] > b[where])
        return path


def _by_end(rows: np.ndarray, end: np.ndarray, paths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The rows at each of ``paths`` (in order) that has any, with its place among them."""
    order = np.argsort(end, kind="stable")
    rows, end = rows[order], end[order]
    first, last = np.searchsorted(end, paths), np.searchsorted(end, paths, side="right")
    for j in np.flatnonzero(last > first):
        yield j, rows[first[j]:last[j]]


def level(points: DataFrame, top: Top, nodes: list[tuple[int, int]], width: int, k: int, n_bins: int,
          seed: int, min_rows: int, center: float) -> list:
    """Figures and best split of each of ``nodes`` (tree, path): histograms by partition, added up by node."""
    by_tree: dict[int, list[int]] = {}
    for t, p in nodes:
        by_tree.setdefault(t, []).append(p)
    by_tree = {t: sorted(p) for t, p in by_tree.items()}

    def drawn(t: int, p: int) -> np.ndarray:
        return drawn_features(np.random.default_rng([seed, t, p]), 1, width, k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = TaskContext.get().partitionId(), {}
        draws = {t: np.concatenate([drawn(t, p) for p in paths]) for t, paths in by_tree.items()}
        for b in batches:
            bins, bag = _bytes(b.column("bins"), b.num_rows), _bytes(b.column("bag"), b.num_rows)
            y = b.column("y").to_numpy()
            for t, paths in by_tree.items():
                here = np.flatnonzero(bag[:, t])
                end = top.ends(t, bins[here])
                if t not in sums:
                    n = len(paths)
                    sums[t] = np.zeros((2, n_bins, n, k)), np.zeros((3, n)), np.full(n, np.inf), np.full(n, -np.inf)
                h, s, lo, hi = sums[t]
                for j, r in _by_end(here, end, paths):
                    w, v = bag[r, t].astype(float), y[r]
                    h[:, :, j] += histogram(bins[r], w, w * (v - center), draws[t][j], n_bins)
                    s[:, j] += w.sum(), (w * v).sum(), (w * v * v).sum()
                    lo[j], hi[j] = min(lo[j], v.min()), max(hi[j], v.max())
        for t, (h, s, lo, hi) in sums.items():
            for j in np.flatnonzero(s[0]):
                yield pa.RecordBatch.from_pylist([{
                    "tree": t, "path": by_tree[t][j], "part": part, "hist": h[:, :, j].tobytes(),
                    "stats": s[:, j].tolist(), "lo": lo[j], "hi": hi[j]}], schema)
        give_back()

    def whole(key, t):
        t = t.sort_values("part")
        hist = sum(np.frombuffer(h) for h in t["hist"]).reshape(2, n_bins, 1, k)
        stats = np.sum(np.stack(t["stats"].to_list()), axis=0)
        gain, f, b, left = (v[0] for v in best_splits(hist, min_rows))
        feature = int(drawn(int(key[0]), int(key[1]))[0, f])
        return pd.DataFrame({"tree": [key[0]], "path": [key[1]], "stats": [stats.tolist()],
                             "pure": [t["lo"].min() == t["hi"].max()], "gain": [gain], "feature": [feature],
                             "bin": [int(b)], "n_left": [left]})

    schema = pa.schema([("tree", pa.int32()), ("path", pa.int64()), ("part", pa.int32()), ("hist", pa.binary()),
                        ("stats", pa.list_(pa.float64())), ("lo", pa.float64()), ("hi", pa.float64())])
    parts = points.mapInArrow(partial, "tree int, path long, part int, hist binary, stats array<double>, "
                                       "lo double, hi double")
    return parts.groupBy("tree", "path").applyInPandas(whole, SPLIT).collect()


# ---------------------------------------------------------------- small nodes: each in one group

def grow(tree: int, root: int, bins, w, y, k: int, depth: int, min_rows: int, seed: int, within=None) -> dict:
    """The nodes of the tree below ``root``, breadth first: figures, gain, feature (-1: a leaf) and bin.

    ``within``: what each line, standing for several rows with the mean label ``y``, has of the squared error itself;
    labels are then taken less the mean of all rows."""
    rng = np.random.default_rng([seed, tree, root])
    width, n_bins = bins.shape[1], int(bins.max()) + 1 if bins.size else 1
    center = y.mean()
    node, n, found = np.zeros(len(y), np.int64), 1, []
    for d in range(root.bit_length() - 1, depth + 1):
        order = np.argsort(node, kind="stable")
        bins, w, y, node = bins[order], w[order], y[order], node[order]
        within = None if within is None else within[order]
        start = np.searchsorted(node, np.arange(n + 1))
        size, wy = np.diff(start), w * (y - center)
        stats = np.stack([np.bincount(node, v, n) for v in (w, w * y, w * y * y if within is None else w * y * y + within)])
        spread = np.minimum.reduceat(y, start[:-1]) < np.maximum.reduceat(y, start[:-1])
        gain, feature, cut = np.zeros(n), np.full(n, -1), np.zeros(n, int)
        some = np.flatnonzero(spread & (stats[0] >= 2 * min_rows) & (d < depth))
        for most, part in _by_size(some, size, k):
            drawn = drawn_features(rng, len(part), width, k)
            if most == 2:
                g, f, b = splits_of_two(bins, w, y, start[part], drawn, min_rows)
            elif most <= FEW_ROWS:
                g, f, b = splits_of_few(bins, w, wy, start[part], size[part], drawn, min_rows)
            else:
                hist = [histogram(bins[i:j], w[i:j], wy[i:j], r, n_bins)
                        for i, j, r in zip(start[part], start[part + 1], drawn)]
                g, f, b, _ = best_splits(np.stack(hist, axis=2), min_rows)
            ok = enough(g, stats[:, part])
            if within is not None:  # Sums of equal labels differ by rounding from cell to cell.
                ok &= g > 1e-13 * stats[2, part]
            gain[part[ok]], cut[part[ok]] = g[ok], b[ok]
            feature[part[ok]] = drawn[np.flatnonzero(ok), f[ok]]
        found.append((stats, gain, feature, cut))
        split = feature >= 0
        if not split.any():
            break
        rank = np.cumsum(split) - 1
        keep = split[node]
        bins, w, y, node = bins[keep], w[keep], y[keep], node[keep]
        within = None if within is None else within[keep]
        node = 2 * rank[node] + (bins[np.arange(len(node)), feature[node]] > cut[node])
        n = 2 * int(split.sum())
    return dict(zip(("stats", "gain", "feature", "cut"), (np.concatenate(v, axis=-1) for v in zip(*found))))


def _by_size(nodes: np.ndarray, size: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """The nodes in runs of about one size, as many at once as the search has room for; the most rows of a run."""
    least = 1
    while len(nodes):
        most = 2 * least if least < FEW_ROWS else int(size[nodes].max())
        run = nodes[(size[nodes] > least) & (size[nodes] <= most)] if least > 1 else nodes[size[nodes] <= most]
        nodes, least = nodes[size[nodes] > most], most
        step = max(1, (IN_ORDER_AT_ONCE if most <= FEW_ROWS else HISTOGRAMS_AT_ONCE) // k)
        for i in range(0, len(run), step):
            yield most, run[i:i + step]


def piece(tree: int, path: int, stats, gain, feature, cut) -> dict:
    """Nodes at and below ``path``, breadth first, as a row of ``PIECE``."""
    split = feature >= 0
    return {"tree": tree, "path": path, "n_nodes": len(feature), "feature": feature.astype("<i4").tobytes(),
            "cut": cut[split].astype(np.uint8).tobytes(), "gain": gain[split].astype("<f8").tobytes(),
            "stats": stats.T[~split].astype("<f8").tobytes()}


def unpacked(p: dict):
    """Feature, cut and left child (the right one follows it) of each node of a piece, and the stats of the leaves;
    the j-th node that splits has the children 2j + 1 and 2j + 2."""
    feature = np.frombuffer(p["feature"], "<i4")
    split = feature >= 0
    cut, child = np.zeros(len(feature), np.int64), np.zeros(len(feature), np.int64)
    cut[split] = np.frombuffer(p["cut"], np.uint8)
    child[split] = 2 * np.arange(split.sum()) + 1
    return feature, cut, child, np.frombuffer(p["stats"], "<f8").reshape(-1, 3)


def means(stats: np.ndarray) -> np.ndarray:
    """MLlib's prediction of no rows is 0."""
    return np.divide(stats[:, 1], stats[:, 0], out=np.zeros(len(stats)), where=stats[:, 0] > 0)


def walked(p: dict, bins: np.ndarray) -> np.ndarray:
    """Predictions of a piece for rows that come to its root."""
    feature, cut, child, stats = unpacked(p)
    at, here = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        here = here[feature[at[here]] >= 0]
        if not len(here):
            break
        i = at[here]
        at[here] = child[i] + (bins[here, feature[i]] > cut[i])
    leaf = np.cumsum(feature < 0) - 1
    return means(stats)[leaf[at]]


def piece_nodes(p: dict, cuts: dict[int, np.ndarray]) -> pd.DataFrame:
    """The nodes of a piece as rows of ``NODE``; figures of a node that splits are those of its leaves."""
    feature, cut, child, leaves = unpacked(p)
    split = feature >= 0
    path, stats, gain = np.full(len(feature), p["path"], np.int64), np.zeros((len(feature), 3)), np.zeros(len(feature))
    stats[~split], gain[split] = leaves, np.frombuffer(p["gain"], "<f8")
    for i in np.flatnonzero(split):
        path[child[i]], path[child[i] + 1] = 2 * path[i], 2 * path[i] + 1
    for i in np.flatnonzero(split)[::-1]:
        stats[i] = stats[child[i]] + stats[child[i] + 1]
    return node_rows(p["tree"], path, stats.T, gain, feature, cut, cuts)


def node_rows(tree: int, path, stats, gain, feature, cut, cuts: dict[int, np.ndarray]) -> pd.DataFrame:
    """Nodes as rows of ``NODE``; a leaf has feature -1."""
    w, mean = np.maximum(stats[0], 1), means(stats.T)
    return pd.DataFrame({
        "tree": np.full(len(path), tree, np.int32), "path": path, "prediction": mean,
        "impurity": np.maximum(stats[2] / w - mean * mean, 0), "stats": list(stats.T), "gain": gain / w,
        "feature": feature.astype(np.int32),
        "threshold": [cuts[f][b] if f >= 0 else math.nan for f, b in zip(feature.tolist(), cut.tolist())]})


#: Rows that a task needs, in order of ``row``: the first one, their number, and what is told of them.
CHUNK = "task int, row long, n int, data binary"


def tasks_of(small: list[dict[int, float]], rows: int, least: int, width: int) -> list[dict[int, list[int]]]:
    """The small nodes (path and bagged rows, by tree) dealt to tasks, trees one after the other, each with its
    nodes' paths by tree: at least so many tasks, and as many as keep the bins of a task's rows below ``TASK_BYTES``."""
    total = sum(n for nodes in small for n in nodes.values())
    fits = TASK_BYTES // max(width, 1)
    most = total / least if rows <= fits else min(total / least, fits)
    tasks, n = [], math.inf
    for tree, nodes in enumerate(small):
        for path in sorted(nodes):
            if n + nodes[path] > most and n:
                tasks.append({})
                n = 0
            tasks[-1].setdefault(tree, []).append(path)
            n += nodes[path]
    return tasks


def dealt(rows: DataFrame, top: Top, tasks: list[dict[int, list[int]]], told: tuple[str, int], bagged: bool) -> DataFrame:
    """Rows by the tasks that need them, many in a row of ``CHUNK``: a row goes to a task once, whichever of its
    trees need it.  Bins, then the column ``told`` (name, bytes of a value), then the counts in the bags of its trees."""
    by_tree: dict[int, list[tuple[int, int]]] = {}
    for i, task in enumerate(tasks):
        for tree, paths in task.items():
            by_tree.setdefault(tree, []).extend((p, i) for p in paths)
    by_tree = {t: np.array(sorted(x)).T for t, x in by_tree.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, row = [], 0, TaskContext.get().partitionId() << 33
        for b in batches:
            held.append([_bytes(b.column("bins"), b.num_rows), _values(b.column(told[0]), told[1]),
                         *([_bytes(b.column("bag"), b.num_rows)] if bagged else [])])
            n += b.num_rows
            if n * held[0][0].shape[1] >= DEALT_BYTES:
                yield from out(row, *[np.concatenate(v) for v in zip(*held)])
                held, n, row = [], 0, row + n
        if n:
            yield from out(row, *[np.concatenate(v) for v in zip(*held)])
        held.clear()
        give_back()

    def out(row: int, bins, values, bag=None) -> Iterator[pa.RecordBatch]:
        needed, codec = np.zeros((len(tasks), len(bins)), bool), pa.Codec("zstd", compression_level=3)
        for t, (paths, at) in by_tree.items():
            here = np.arange(len(bins)) if bag is None else np.flatnonzero(bag[:, t])
            end = top.ends(t, bins[here])
            place = np.minimum(np.searchsorted(paths, end), len(paths) - 1)
            mine = paths[place] == end
            needed[at[place[mine]], here[mine]] = True
        for i, task in enumerate(tasks):
            r = np.flatnonzero(needed[i])
            if len(r):
                data = [bins[r].T, values[r], *([] if bag is None else [bag[r][:, list(task)].T])]
                data = codec.compress(b"".join(np.ascontiguousarray(v).tobytes() for v in data), asbytes=True)
                yield pa.RecordBatch.from_pylist([{"task": i, "row": row + int(r[0]), "n": len(r), "data": data}], chunk)

    chunk = pa.schema([("task", pa.int32()), ("row", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])
    return rows.mapInArrow(work, CHUNK)


def _values(column: pa.Array, size: int) -> np.ndarray:
    """The bytes of numbers, or of texts of one size, a row for each."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return _bytes(column, len(column))
    return np.ascontiguousarray(column.to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, size)


def gathered(chunks: list[tuple[int, bytes]], width: int, size: int, trees: int = 0) -> list[np.ndarray]:
    """Bins, values and counts (a line for each tree) of the rows in chunks (their number and data)."""
    total, codec = sum(n for n, _ in chunks), pa.Codec("zstd")
    bins, values, bag = (np.empty(s, np.uint8) for s in ((total, width), (total, size), (trees, total)))
    at = 0
    for n, data in chunks:
        data = np.frombuffer(codec.decompress(data, n * (width + size + trees)), np.uint8)
        bins[at:at + n] = data[:n * width].reshape(width, n).T
        values[at:at + n] = data[n * width:n * (width + size)].reshape(n, size)
        bag[:, at:at + n] = data[n * (width + size):].reshape(trees, n)
        at += n
    return [bins, values, bag]


def finished(points: DataFrame, top: Top, tasks: list[dict[int, list[int]]], width: int, k: int, depth: int,
             min_rows: int, seed: int) -> DataFrame:
    """A piece for each small node, grown in the task to which it is dealt."""
    def grown(key, t):
        i, t = key[0].as_py(), t.sort_by("row")
        bins, y, bag = gathered([*zip(t["n"].to_pylist(), t["data"].to_pylist())], width, 8, len(tasks[i]))
        del t
        y, found = y.view("<f8").ravel(), []
        for (tree, paths), w in zip(tasks[i].items(), bag):
            here = np.flatnonzero(w)
            for j, r in _by_end(here, top.ends(tree, bins[here]), paths):
                got = grow(tree, paths[j], bins[r], w[r].astype(float), y[r], k, depth, min_rows, seed)
                found.append(piece(tree, paths[j], **got) | {"task": i})
        del bins, y, bag
        give_back()
        return pa.Table.from_pylist(found, PIECES)

    # A number given is not changed by adaptive execution, which would join tasks by the size of their rows; so
    # large that few of them meet.
    chunks = dealt(points, top, tasks, ("y", 8), True).repartition(4 * len(tasks), "task")
    return chunks.groupBy("task").applyInArrow(grown, PIECE)


PIECES = pa.schema([("task", pa.int32()), ("tree", pa.int32()), ("path", pa.int64()), ("n_nodes", pa.int32()),
                    *[(c, pa.binary()) for c in ("feature", "cut", "gain", "stats")]])
NODES = pa.schema([("tree", pa.int32()), ("path", pa.int64()), ("prediction", pa.float64()),
                   ("impurity", pa.float64()), ("stats", pa.list_(pa.float64())), ("gain", pa.float64()),
                   ("feature", pa.int32()), ("threshold", pa.float64())])


# ---------------------------------------------------------------- the model

class StoredForest(RandomForestRegressionModel):
    """MLlib's model, of which the driver holds the uppermost splits alone: rows are scored in the groups of the
    pieces.  MLlib's own object is made when something else is asked of it."""

    def __init__(self, spark: SparkSession, bare: RandomForestRegressionModel, path: str, top: Top,
                 tasks: list[dict[int, list[int]]], upper: list[tuple], cuts: dict[int, np.ndarray], width: int):
        self.path, self.top, self.tasks, self.upper, self.cuts, self.width = path, top, tasks, upper, cuts, width
        self.spark, self._loaded = spark, bare
        super().__init__(bare._java_obj)
        self._loaded = None

    def loaded(self) -> RandomForestRegressionModel:
        if self._loaded is None:
            self._loaded = self._load()
        return self._loaded

    @property
    def _java_obj(self):
        return self.loaded()._java_obj

    @_java_obj.setter
    def _java_obj(self, value):
        """What is loaded comes from ``path`` alone."""

    def __del__(self):
        """Java's object, if there is one, goes with ``_loaded``."""

    def copy(self, extra=None):
        that = Params.copy(self, extra)
        that._loaded = None
        return that

    @property
    def trees(self) -> list:
        return self.loaded().trees

    @property
    def numFeatures(self) -> int:
        return self.width

    @property
    def getNumTrees(self) -> int:
        return len(self.top.splits)

    @property
    def totalNumNodes(self) -> int:
        """Nodes of all trees."""
        return int(self.pieces().agg(F.sum("n_nodes")).first()[0]) + len(self.upper)

    def pieces(self) -> DataFrame:
        return self.spark.read.schema(PIECE).parquet(f"{self.path}/pieces")

    def _load(self) -> RandomForestRegressionModel:
        """MLlib's model with these nodes: the saved form of a forest of bare roots with the estimator's
        parameters, and the node table in place of its own."""
        cuts = self.cuts

        def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for p in b.to_pylist():
                    yield from pa.Table.from_pandas(piece_nodes(p, cuts), NODES, preserve_index=False).to_batches()

        nodes = self.pieces().mapInArrow(table, NODE)
        if self.upper:
            nodes = nodes.unionByName(self.spark.createDataFrame(self.upper, NODE))
        return as_model(nodes, f"{self.path}/model")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if dataset.isStreaming:
            return super()._transform(dataset)
        key, bins, out = (f"_{self.uid}_{c}" for c in ("key", "bins", "mean"))
        keyed = dataset.withColumn(bins, self._bins(F.col(self.getFeaturesCol())))
        keyed = keyed.withColumn(key, F.unhex(F.md5(bins)))
        found = self._means(keyed.groupBy(key).agg(F.first(bins).alias("bins")).withColumnRenamed(key, "key"))
        found = found.select(F.col("key").alias(key), F.col("mean").alias(out))
        return keyed.drop(bins).join(found, key, "left").drop(key).withColumnRenamed(out, self.getPredictionCol())

    def _bins(self, x: Column) -> Column:
        cuts, width = self.cuts, self.width

        @F.arrow_udf("binary")
        def bins(x: pa.Array) -> pa.Array:
            return pa.array([r.tobytes() for m in dense(x, width) for r in in_bins(m, cuts)], pa.binary())

        return bins(x)

    def _means(self, rows: DataFrame) -> DataFrame:
        """(key, mean) of distinct rows (key, bins): rows and the pieces to which they come meet by task; the
        predictions of the trees are added in their order."""
        width, trees, top = self.width, self.getNumTrees, self.top

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    c = b.slice(i, 1).to_pylist()[0]
                    bins, keys, _ = gathered([(c["n"], c["data"])], width, 16)
                    keys = pa.array([r.tobytes() for r in keys], pa.binary())
                    by_tree: dict[int, dict] = {}
                    for p in c["pieces"]:
                        by_tree.setdefault(p["tree"], {})[p["path"]] = p
                    for tree, pieces in by_tree.items():
                        paths = sorted(pieces)
                        for j, r in _by_end(np.arange(len(bins)), top.ends(tree, bins), paths):
                            yield pa.RecordBatch.from_arrays(
                                [keys.take(pa.array(r)), pa.array(np.full(len(r), tree, np.int32)),
                                 pa.array(walked(pieces[paths[j]], bins[r]))], ["key", "tree", "p"])
            give_back()

        # A row meets all pieces of a task at once; the pieces of a task are few enough to be sent to its rows.
        pieces = self.pieces().groupBy("task").agg(
            F.collect_list(F.struct("tree", "path", "feature", "cut", "stats")).alias("pieces"))
        each = dealt(rows, top, self.tasks, ("key", 16), False).join(pieces, "task").select("n", "data", "pieces").mapInArrow(
            walk, "key binary, tree int, p double")
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("tree", "p"))), lambda s: s["p"])
        return each.groupBy("key").agg((F.aggregate(in_order, F.lit(0.0), lambda a, p: a + p) / trees).alias("mean"))


def bare_model(spark: SparkSession, est: RandomForestRegressor, width: int) -> RandomForestRegressionModel:
    """A model of bare roots with the estimator's parameters."""
    rows = [(0.0, SparseVector(width, {}))] * 2
    return est.fit(spark.createDataFrame(rows, [est.getLabelCol(), est.getFeaturesCol()]).coalesce(1))


def as_model(nodes: DataFrame, path: str) -> RandomForestRegressionModel:
    """The model saved at ``path`` with these nodes in place of its own."""
    split = F.col("feature") >= 0
    numbered = nodes.select("*", split.alias("split"), (F.row_number().over(
        Window.partitionBy("tree").orderBy(F.substring(F.bin("path"), 2, 64))) - 1).alias("id")).persist(
            StorageLevel.MEMORY_AND_DISK)
    right = numbered.where(F.col("path") % 2 == 1).select(
        "tree", F.floor(F.col("path") / 2).alias("path"), F.col("id").alias("right"))
    none = F.lit(-1)
    data = numbered.join(right, ["tree", "path"], "left").select(F.col("tree").alias("treeID"), F.struct(
        F.col("id"), "prediction", "impurity", F.col("stats").alias("impurityStats"),
        F.col("stats")[0].cast("long").alias("rawCount"),
        F.when(F.col("split"), F.col("gain")).otherwise(-1.0).alias("gain"),
        F.when(F.col("split"), F.col("id") + 1).otherwise(none).alias("leftChild"),
        F.when(F.col("split"), F.col("right")).otherwise(none).alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"),
                 F.when(F.col("split"), F.array("threshold")).otherwise(F.array().cast("array<double>"))
                 .alias("leftCategoriesOrThreshold"), none.alias("numCategories")).alias("split")).alias("nodeData"))
    data.write.mode("overwrite").parquet(f"{path}/data")
    numbered.unpersist()
    return RandomForestRegressionModel.load(path)


def labelled(df: DataFrame, est: RandomForestRegressor) -> DataFrame:
    """Label and features as y and x; a row without a label is an error."""
    label = F.col(est.getLabelCol())
    y = F.when(label.isNull() | F.isnan(label), F.raise_error(F.lit("labels must not be null or NaN"))).otherwise(label)
    return df.select(y.cast("double").alias("y"), F.col(est.getFeaturesCol()).alias("x"))


def fit_deep(df: DataFrame, est: RandomForestRegressor, whole_node: int | None = None) -> StoredForest:
    """``est`` fitted on ``df`` (its label and features columns)."""
    spark, rows = df.sparkSession, labelled(df, est)
    size, first = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).first(), rows.select("x").first()
    if size.n == 0:
        raise ValueError("a forest needs at least one row")
    if first.x is None:
        raise ValueError("features must not be null")
    trees, width, depth = est.getNumTrees(), first.x.size, est.getMaxDepth()
    seed, min_rows = est.getSeed() & (2 ** 63 - 1), est.getMinInstancesPerNode()
    k = subset_size(est.getFeatureSubsetStrategy(), width, trees)
    cuts = feature_thresholds(rows, width, size.n, est.getMaxBins(), seed)
    n_bins = max((len(c) for c in cuts.values()), default=0) + 1
    points = binned(rows, width, cuts, est).persist(StorageLevel.MEMORY_AND_DISK)
    if whole_node is None:
        whole_node = min(WHOLE_NODE, max(LEAST_WHOLE, WHOLE_BYTES // max(width, 1)))
    try:
        path, bare = scratch_path(spark, "deep_forest"), bare_model(spark, est, width)
        bare.write().save(f"{path}/model")
        top, small, done = Top(trees), [{} for _ in range(trees)], []
        at_once = max(1, (est.getMaxMemoryInMB() << 20) // (16 * k * n_bins))
        todo = [(t, 1) for t in range(trees)]
        while todo:
            found = []
            for i in range(0, len(todo), at_once):
                found += level(points, top, todo[i:i + at_once], width, k, n_bins, seed, min_rows, size.mean)
            seen = {(r.tree, r.path) for r in found}
            # A tree whose bag is empty: MLlib's prediction of no rows.
            done += [(t, p, 0.0, 0.0, [0.0] * 3, 0.0, -1, math.nan) for t, p in todo if (t, p) not in seen]
            todo = []
            for r in sorted(found, key=lambda r: (r.tree, r.path)):
                stats = np.array(r.stats)
                w, s, ss = stats
                split = not r.pure and r.path.bit_length() - 1 < depth and enough(r.gain, stats)
                done.append((r.tree, r.path, s / w, max(ss / w - (s / w) ** 2, 0.0), r.stats, r.gain / w,
                             r.feature if split else -1, float(cuts[r.feature][r.bin]) if split else math.nan))
                if split:
                    top.splits[r.tree][r.path] = (r.feature, r.bin)
                    for child, n in ((2 * r.path, r.n_left), (2 * r.path + 1, w - r.n_left)):
                        if n > whole_node:
                            todo.append((r.tree, child))
                        else:
                            small[r.tree][child] = n
        plain = [tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in done]
        tasks = tasks_of(small, size.n, 2 * spark.sparkContext.defaultParallelism, width)
        pieces = finished(points, top, tasks, width, k, depth, min_rows, seed) if tasks else None
        leaves = [(t, p, stats) for t, p, _, _, stats, _, feature, _ in plain if feature < 0]
        if leaves:
            # Ends that are no small nodes: pieces of a node each, in a task beside the others.
            tasks.append({})
            for t, p, _ in sorted(leaves):
                tasks[-1].setdefault(t, []).append(p)
            leaves = spark.createDataFrame([tuple((piece(t, p, np.array(stats)[:, None], np.zeros(1), np.array([-1]), np.zeros(1))
                                                   | {"task": len(tasks) - 1})[c] for c in PIECES.names)
                                            for t, p, stats in leaves], PIECE)
            pieces = leaves if pieces is None else pieces.unionByName(leaves)
        pieces.write.parquet(f"{path}/pieces", compression="zstd")
        return StoredForest(spark, bare, path, top, tasks, [r for r in plain if r[6] >= 0], cuts, width)
    finally:
        points.unpersist()
