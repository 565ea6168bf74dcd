"""Shallow regression forests on few features: one pass over the rows, whatever the depth.

MLlib walks every row through every tree once a level.  Where the bins of all features have few combinations
(*cells*), weight, label and squared label of the bagged rows in each cell are all that any split of a tree
depends on.  A partition adds them up by tree; its table is as large as the cells, however many rows it has.
The tree then grows on the cells, in a task of its own.  Bins, bags, drawn features, gain and stopping rules
are those of ``deep_forest``, hence MLlib's, and so is the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.operators import deep_forest as deep
from grove.session import scratch_path

#: Combinations of bins at most, and those of all trees together, which a task holds.
MAX_CELLS, MAX_SUMS = 1 << 16, 1 << 21
#: Rows of a partition that are bagged at once.
ROWS_AT_ONCE = 1 << 16
TABLE = "tree int, part int, sums binary"


def may_fit(est: RandomForestRegressor, width: int) -> bool:
    return deep.fits(est) and 2 ** width <= MAX_CELLS


def tables(rows: DataFrame, width: int, cuts: dict[int, np.ndarray], shape: list[int], center: float,
           est: RandomForestRegressor) -> DataFrame:
    """Weight, label and squared label (labels less ``center``) by tree and cell, a table for each partition; the
    bags are drawn by partition and order of the rows."""
    trees, rate, again, seed = est.getNumTrees(), est.getSubsamplingRate(), est.getBootstrap(), est.getSeed()
    cells = math.prod(shape)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = TaskContext.get().partitionId(), np.zeros((trees, 3, cells))
        rng, held, n = np.random.default_rng([seed & (2 ** 63 - 1), part]), [], 0

        def add(cell: np.ndarray, y: np.ndarray) -> None:
            for s in sums:
                w = (np.minimum(rng.poisson(rate, len(y)), 255) if again else rng.random(len(y)) < rate).astype(float)
                wy = w * y
                for to, v in zip(s, (w, wy, wy * y)):
                    to += np.bincount(cell, v, cells)

        for b in batches:
            y, at = b.column("y").to_numpy() - center, 0
            for x in deep.dense(b.column("x"), width):
                if np.isnan(x).any():
                    raise ValueError("trees need every feature, got NaN")
                held.append((np.ravel_multi_index(tuple(deep.in_bins(x, cuts).T.astype(np.intp)), shape), y[at:at + len(x)]))
                at, n = at + len(x), n + len(x)
            while n >= ROWS_AT_ONCE:
                cell, y = (np.concatenate(v) for v in zip(*held))
                add(cell[:ROWS_AT_ONCE], y[:ROWS_AT_ONCE])
                held, n = [(cell[ROWS_AT_ONCE:], y[ROWS_AT_ONCE:])], n - ROWS_AT_ONCE
        if n:
            add(*(np.concatenate(v) for v in zip(*held)))
        codec = pa.Codec("zstd", compression_level=1)
        for t, s in enumerate(sums):
            if s[0].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([part], pa.int32()),
                     pa.array([codec.compress(s.tobytes(), asbytes=True)], pa.binary())], ["tree", "part", "sums"])

    return rows.mapInArrow(work, TABLE)


def grown_on(sums: np.ndarray, shape: list[int], tree: int, k: int, est_depth: int, min_rows: int, seed: int,
             center: float) -> dict:
    """The piece of a whole tree from its cells."""
    here = np.flatnonzero(sums[0])
    w, s, ss = sums[:, here]
    bins = np.stack(np.unravel_index(here, shape), axis=1).astype(np.uint8)
    got = deep.grow(tree, 1, bins, w, s / w, k, est_depth, min_rows, seed, within=ss - s * s / w)
    w, s, ss = got["stats"]
    got["stats"] = np.stack([w, s + w * center, ss + 2 * center * s + w * center * center])
    return deep.piece(tree, 1, **got) | {"task": 0}


def fit_cells(df: DataFrame, est: RandomForestRegressor) -> RandomForestRegressionModel | None:
    """``est`` fitted on ``df`` (its label and features columns); None where there are too many cells."""
    spark, rows = df.sparkSession, deep.labelled(df, est)
    first = rows.select("x").first()
    if first is None or first.x is None or not may_fit(est, first.x.size):
        return None
    # Few numbers a row reach Python sooner as an array than as a vector.
    rows = rows.withColumn("x", vector_to_array("x"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).first()
    trees, width, depth, min_rows = est.getNumTrees(), first.x.size, est.getMaxDepth(), est.getMinInstancesPerNode()
    seed, center = est.getSeed() & (2 ** 63 - 1), size.mean
    cuts = deep.feature_thresholds(rows, width, size.n, est.getMaxBins(), seed)
    shape = [len(cuts.get(f, ())) + 1 for f in range(width)]
    if math.prod(shape) > MAX_CELLS or trees * math.prod(shape) > MAX_SUMS:
        return None
    k = deep.subset_size(est.getFeatureSubsetStrategy(), width, trees)

    def grown(key, t):
        t, codec, sums = t.sort_by("part"), pa.Codec("zstd"), np.zeros((3, math.prod(shape)))
        for data in t["sums"]:
            sums += np.frombuffer(codec.decompress(data.as_py(), sums.nbytes)).reshape(sums.shape)
        return pa.Table.from_pylist([grown_on(sums, shape, key[0].as_py(), k, depth, min_rows, seed, center)], deep.PIECES)

    found = tables(rows, width, cuts, shape, center, est).groupBy("tree").applyInArrow(grown, deep.PIECE).collect()
    found = {r.tree: r.asDict() for r in found}
    none = dict(stats=np.zeros((3, 1)), gain=np.zeros(1), feature=np.array([-1]), cut=np.zeros(1))  # of an empty bag
    nodes = pd.concat([deep.piece_nodes(found[t] if t in found else deep.piece(t, 1, **none), cuts) for t in range(trees)])
    path = scratch_path(spark, "cell_forest")
    deep.bare_model(spark, est, width).write().save(path)
    return deep.as_model(spark.createDataFrame(pa.Table.from_pandas(nodes, deep.NODES, preserve_index=False)), path)
