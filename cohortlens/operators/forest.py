"""Random forests whose trees grow in tasks and stay in files.

A forest without a bound on its depth is about as large as its table times its trees.
Spark's keeps it in the driver and sends it to every executor; here a task grows a few
trees from the binned rows and writes them, and rows meet the trees, to be scored or
explained, a group of trees and a part of the rows at a time.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, scratch_path, ship_package
from . import boosting as bo

#: Bins of a feature, trees that a task grows, most cells of a table that a task holds as
#: bytes, cells of the histograms made at a time, groups of trees that meet rows.
BINS, GROW_TREES, MOST_CELLS, HIST_CELLS, GROUPS = 32, 5, 1 << 28, 1 << 21, 16
#: Rows that a group of trees meets at a time, scored or explained.
SCORE_ROWS, EXPLAIN_ROWS = 1 << 18, 1 << 13


@dataclass(frozen=True)
class Settings:
    """Spark's parameters of a forest, by its names."""

    numTrees: int = 200
    maxDepth: int = 30
    minInstancesPerNode: int = 5
    featureSubsetStrategy: str = "auto"
    seed: int = 42

    def columns(self, width: int) -> int:
        """Features drawn for a node."""
        kind = self.featureSubsetStrategy
        if kind == "auto":
            kind = "sqrt" if self.numTrees > 1 else "all"
        share = {"sqrt": math.sqrt(width), "log2": math.log2(max(width, 1)), "onethird": width / 3, "all": width}[kind]
        return min(width, max(1, math.ceil(share)))

    def most_nodes(self, rows: int) -> int:
        """Nodes that the trees can have together."""
        return self.numTrees * 2 * rows // max(1, self.minInstancesPerNode)


# --- one tree ---------------------------------------------------------------------


def grow_tree(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, s: Settings, number: int) -> dict[str, np.ndarray]:
    """A tree by weighted Gini impurity on a Poisson sample of the rows, level by level,
    as flat arrays: feature, bin (rows with a bin <= it go left), left (-1 at a leaf, the
    right child follows), value (share of label 1), cover (weight), gain."""
    rng = np.random.default_rng((s.seed, number))
    times = rng.poisson(1.0, len(y)) if s.numTrees > 1 else np.ones(len(y), np.int64)
    rows = np.flatnonzero(times)
    if len(rows) == 0:  # an empty sample
        rows, times = np.arange(len(y)), np.ones(len(y), np.int64)
    sums = np.stack([weight * times, weight * times * (y > 0), times])
    take = s.columns(bins.shape[1])
    levels, sizes, first, depth = [], np.array([len(rows)]), 0, 0
    while len(sizes):
        starts = np.cumsum(sizes) - sizes
        total = np.add.reduceat(sums[:, rows], starts, axis=1)
        n = len(sizes)
        level = {
            "feature": np.zeros(n, np.int32), "bin": np.zeros(n, np.uint8), "left": np.full(n, -1, np.int32),
            "value": total[1] / np.maximum(total[0], 1e-300), "cover": total[0], "gain": np.zeros(n),
        }
        levels.append(level)
        could = (total[2] >= 2 * s.minInstancesPerNode) & (total[1] > 0) & (total[1] < total[0])
        if depth < s.maxDepth:
            for chunk in _chunks(np.flatnonzero(could), sizes, take):
                mine = rows[_ranges(starts[chunk], sizes[chunk])]
                drawn = np.sort(np.argsort(rng.random((len(chunk), bins.shape[1])), axis=1)[:, :take], axis=1)
                _split(level, chunk, bins, mine, sizes[chunk], sums, total[:, chunk], drawn, s)
        split = np.flatnonzero(level["gain"] > 0)
        level["left"][split] = first + n + 2 * np.arange(len(split))
        mine = rows[_ranges(starts[split], sizes[split])]
        of = np.repeat(np.arange(len(split)), sizes[split])
        right = bins[mine, level["feature"][split][of]] > level["bin"][split][of]
        order = np.argsort(2 * of + right, kind="stable")
        rows, sizes = mine[order], np.bincount(2 * of + right, minlength=2 * len(split))
        first, depth = first + n, depth + 1
    return _pruned(levels)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of some slices, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _chunks(nodes: np.ndarray, sizes: np.ndarray, take: int) -> Iterator[np.ndarray]:
    """Nodes whose histograms and rows are held at a time."""
    cost = np.cumsum(np.maximum(sizes[nodes], BINS) * take) // HIST_CELLS
    for part in np.split(nodes, np.flatnonzero(np.diff(cost)) + 1):
        if len(part):
            yield part


def _split(level, nodes, bins, rows, sizes, sums, total, drawn, s: Settings) -> None:
    """The best cut of each node over its drawn features, into ``level``."""
    n, take = drawn.shape
    of = np.repeat(np.arange(n), sizes)
    spot = ((of * take)[:, None] + np.arange(take)) * BINS + bins[rows[:, None], drawn[of]]
    left = [
        np.bincount(spot.ravel(), np.repeat(v[rows], take), n * take * BINS).reshape(n, take, BINS).cumsum(axis=2)[:, :, :-1]
        for v in sums
    ]
    right = [t[:, None, None] - v for t, v in zip(total, left)]
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = sum((v[1] ** 2 + (v[0] - v[1]) ** 2) / v[0] for v in (left, right))
    before = (total[1] ** 2 + (total[0] - total[1]) ** 2) / total[0]
    least = s.minInstancesPerNode - 0.5
    gain = np.where((left[2] > least) & (right[2] > least), pure - before[:, None, None], -np.inf)
    gain = np.nan_to_num(gain, nan=-np.inf, posinf=-np.inf).reshape(n, -1)
    best = gain.argmax(axis=1)
    most = gain[np.arange(n), best]
    found = most > 1e-9 * total[0]  # below that it is rounding
    column, cut = np.divmod(best, BINS - 1)
    level["feature"][nodes[found]] = drawn[np.arange(n), column][found]
    level["bin"][nodes[found]] = cut[found]
    level["gain"][nodes[found]] = most[found]


def _pruned(levels: list[dict]) -> dict[str, np.ndarray]:
    """One set of arrays; two leaves that predict the same label are merged, as Spark does."""
    tree = {k: np.concatenate([level[k] for level in levels]) for k in levels[0]}
    left, positive = tree["left"], tree["value"] > 0.5
    ends = np.cumsum([len(level["left"]) for level in levels])
    for end, level in zip(ends[::-1], levels[::-1]):
        inner = np.arange(end - len(level["left"]), end)
        inner = inner[left[inner] >= 0]
        one, two = left[inner], left[inner] + 1
        same = (left[one] < 0) & (left[two] < 0) & (positive[one] == positive[two])
        left[inner[same]] = -1
    kept = np.zeros(len(left), bool)
    kept[0] = True
    for end, level in zip(ends, levels):
        inner = np.arange(end - len(level["left"]), end)
        inner = inner[kept[inner] & (left[inner] >= 0)]
        kept[left[inner]] = kept[left[inner] + 1] = True
    places = np.cumsum(kept) - 1
    tree["left"] = np.where(left >= 0, places[np.maximum(left, 0)], -1).astype(np.int32)
    tree["gain"] = np.where(left >= 0, tree["gain"], 0.0)
    return {k: v[kept] for k, v in tree.items()}


# --- fitting ----------------------------------------------------------------------

_KINDS = {"feature": np.int32, "bin": np.uint8, "left": np.int32, "value": np.float64, "cover": np.float64}
_TREE = "tree bigint, base double, gains array<double>, " + ", ".join(f"{k} binary" for k in _KINDS)


def _grow_group(s: Settings, width: int):
    def grow(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = list(bo._blocks(batches))
        bins, y, keys = (np.concatenate([b[k] for b in blocks]) for k in ("bins", "y", "keys"))
        weight = np.concatenate([b["sides"]["_weight"] for b in blocks])
        # Rows that share key and label are alike: any order of blocks gives the same trees.
        order = np.lexsort((weight, y, keys))
        bins, y, weight = bins[order], y[order], weight[order]
        for number in range(key[0].as_py() * GROW_TREES, min(s.numTrees, (key[0].as_py() + 1) * GROW_TREES)):
            tree = grow_tree(bins, y, weight, s, number)
            gains = np.bincount(tree["feature"], tree["gain"], width)
            cells = {k: pa.array([tree[k].astype(kind).tobytes()], pa.binary()) for k, kind in _KINDS.items()}
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([number], pa.int64()), "base": pa.array([float(tree["value"][0])]),
                "gains": pa.array([gains.tolist()], pa.list_(pa.float64())), **cells,
            })

    return grow


def fits(rows: int, width: int) -> bool:
    """Whether a task can hold the table."""
    return rows * max(1, width) <= MOST_CELLS


def fit(data: DataFrame, label: str, weight: str, settings: Settings, column: str = "features") -> Forest:
    """The forest of a table that ``fits``, on rows of the label 0 or 1 weighted by ``weight``."""
    spark = data.sparkSession
    ship_package(spark)
    cuts = bo.feature_cuts(data, column, BINS)
    x = vector_to_array(F.col(column))
    slim = data.select(
        x.alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(x).alias("key"),
        F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("_weight"),
    )
    blocks = materialize(slim.mapInPandas(bo._to_blocks(0, ["_weight"], cuts), bo._BLOCK), "forest-blocks")
    groups = -(-settings.numTrees // GROW_TREES)
    dealt = blocks.withColumn("_group", _each(groups)).repartition(groups, "_group")
    names = ["block", "n", "bins", "y", "keys", "sides", "margins"]
    grown = dealt.select("_group", *names).groupBy("_group").applyInArrow(_grow_group(settings, len(cuts)), _TREE)
    path = scratch_path(spark, "forest")
    grown.write.parquet(path)
    return Forest(path=path, trees=settings.numTrees, cuts=json.dumps([c.tolist() for c in cuts]), featuresCol=column)


# --- the model --------------------------------------------------------------------


def _tree_of(row: dict) -> dict:
    return {k: np.frombuffer(row[k], kind) for k, kind in _KINDS.items()}


def leaf_values(bins: np.ndarray, tree: dict) -> np.ndarray:
    return tree["value"][bo.descend(bins, tree["feature"], tree["bin"], tree["left"])][:, None]


def _each(n: int) -> Column:
    """A copy of the row for each of 0 .. n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


_ROWS = "block string, n bigint, ids binary, bins binary"


def _row_blocks(cuts: list[np.ndarray]):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for start in range(0, len(pdf), bo.BLOCK_ROWS):
                some = pdf.iloc[start : start + bo.BLOCK_ROWS]
                x = np.stack(some["x"].to_numpy())
                bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1).astype(np.uint8)
                ids = some["_row"].to_numpy(np.int64)
                yield pd.DataFrame([(f"{part:08d}-{made:08d}", len(some), ids.tobytes(), bins.tobytes())],
                                   columns=["block", "n", "ids", "bins"])
                made += 1

    return task


def _meet(of: Callable[[np.ndarray, dict], np.ndarray]):
    """Sums of ``of`` over a group's trees, in their order, for each block of a part."""

    def task(key: tuple, trees: pa.Table, blocks: pa.Table) -> pa.Table:
        grown = [_tree_of(row) for row in trees.sort_by("tree").to_pylist()]
        found: dict = {"block": [], "_group": [], "ids": [], "sums": []}
        for row in blocks.to_pylist():
            bins = np.frombuffer(row["bins"], np.uint8).reshape(row["n"], -1)
            total = sum(of(bins, tree) for tree in grown)
            for name, value in zip(found, (row["block"], key[0].as_py(), row["ids"], np.asarray(total, np.float64).tobytes())):
                found[name].append(value)
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(found.items(), kinds)})

    return task


def _add_up(key: tuple, parts: pa.Table) -> pa.Table:
    parts = parts.sort_by("_group").to_pydict()
    ids = np.frombuffer(parts["ids"][0], np.int64)
    total = sum(np.frombuffer(v) for v in parts["sums"])
    width = len(total) // max(1, len(ids))
    sums = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * width, pa.int32()), pa.array(total))
    return pa.table({"_row": pa.array(ids), "_sums": sums})


class Forest(Model, MLReadable, MLWritable):
    """Trees in a Parquet folder; transform gives probability and prediction.  It writes
    ``dataset`` once, so it takes tables, not streams."""

    path = Param(Params._dummy(), "path", "folder of the trees", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    cuts = Param(Params._dummy(), "cuts", "cuts of the features as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, path=None, trees=None, cuts=None, featuresCol="features"):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def getNumTrees(self) -> int:
        return self.getOrDefault(self.trees)

    def frame(self, spark) -> DataFrame:
        """A row per tree."""
        return spark.read.schema(_TREE).parquet(self.getOrDefault(self.path))

    def base(self, spark) -> float:
        """The forest's output averaged over the training weights."""
        rows = self.frame(spark).select("tree", "base").collect()  # a number per tree
        return math.fsum(r["base"] for r in rows) / len(rows)

    @property
    def featureImportances(self) -> np.ndarray:
        """Shares of the impurity taken away, each tree counting alike, adding up to 1."""
        from pyspark.sql import SparkSession

        rows = self.frame(SparkSession.active()).select("tree", "gains").orderBy("tree").collect()  # trees x features
        total = sum(g / g.sum() if g.sum() > 0 else g for g in (np.array(r["gains"]) for r in rows))
        return total / total.sum() if total.sum() > 0 else total

    def with_sums(self, df: DataFrame, of: Callable[[np.ndarray, dict], np.ndarray], at_once: int) -> DataFrame:
        """``df`` with ``_sums``: ``of`` (bins of some rows, a tree) added up over the trees."""
        spark = df.sparkSession
        ship_package(spark)
        rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "forest-rows")
        parts = max(1, -(-rows.count() // at_once))
        cuts = [np.array(c) for c in json.loads(self.getOrDefault(self.cuts))]
        groups = min(GROUPS, self.getNumTrees)
        slim = rows.select("_row", vector_to_array(F.col(self.getOrDefault(self.featuresCol))).alias("x"))
        blocks = slim.mapInPandas(_row_blocks(cuts), _ROWS).withColumns({
            "_part": F.pmod(F.xxhash64("block"), F.lit(parts)),
            "_group": _each(groups),
        })
        trees = self.frame(spark).drop("gains", "base").withColumns({
            "_group": F.col("tree") % groups,
            "_part": _each(parts),
        })
        keys, tasks = ["_group", "_part"], 2 * groups * parts
        one, two = (t.repartition(tasks, *keys).groupBy(*keys) for t in (trees, blocks))
        met = one.cogroup(two).applyInArrow(_meet(of), "block string, _group long, ids binary, sums binary")
        found = met.groupBy("block").applyInArrow(_add_up, "_row long, _sums array<double>")
        # The files of the sums are small, their rows are not: no side is broadcast.
        return rows.join(found.hint("shuffle_hash"), "_row").drop("_row")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = F.col("_sums")[0] / self.getNumTrees
        return self.with_sums(dataset, leaf_values, SCORE_ROWS).withColumns({
            "rawPrediction": array_to_vector(F.array(self.getNumTrees - F.col("_sums")[0], F.col("_sums")[0])),
            "probability": array_to_vector(F.array(1 - p, p)),
            "prediction": (p > 0.5).cast("double"),
        }).drop("_sums")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    """Parameters and, beside them, the trees."""

    def __init__(self, instance: Forest):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.frame(self.sparkSession).write.parquet(f"{path.rstrip('/')}/trees")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Forest:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model._set(path=f"{path.rstrip('/')}/trees")
