"""Additive contributions of features to each row's score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.bands import direction
from ..functions.numeric import let
from ..session import scratch_path, ship_package
from . import forest
from .boosting import BoostedTrees


def contributions(
    model, df: DataFrame, background: DataFrame, row_id: str, column: str = "features"
) -> DataFrame:
    """(row_id, x, contributions, base) for every row of ``df``.

    Linear models: w (x - mean of the background), in log-odds.  Trees: exact
    path-dependent contributions; forests in probability, boosted trees in margin.
    ``base`` plus the sum of the contributions is the model's output.
    """
    if isinstance(model, LogisticRegressionModel):
        mean = background.agg(Summarizer.mean(F.col(column)).alias("_m"))
        return linear_contributions(
            df, model.coefficients.toArray().tolist(), model.intercept, mean, row_id, column
        )
    if isinstance(model, (RandomForestClassificationModel, GBTClassificationModel, BoostedTrees)):
        return tree_contributions(model, df, row_id, column)
    if isinstance(model, forest.Forest):
        rows = df.select(row_id, F.col(column).alias(model.getOrDefault(model.featuresCol)), vector_to_array(column).alias("x"))
        n = model.getNumTrees
        return model.with_sums(rows, _forest_contributions, forest.EXPLAIN_ROWS).select(
            row_id, "x", F.transform("_sums", lambda v: v / n).alias("contributions"),
            F.lit(model.base(df.sparkSession)).alias("base"),
        )
    raise TypeError(f"no contributions for {type(model).__name__}")


def linear_contributions(
    df: DataFrame,
    weights: list[float],
    intercept: float,
    background_mean: DataFrame,
    row_id: str,
    column: str = "features",
) -> DataFrame:
    """``background_mean`` is one row with a vector."""
    side = background_mean.select(vector_to_array(F.col(background_mean.columns[0])).alias("_mean"))
    weight_row = df.sparkSession.createDataFrame([(weights,)], "_w array<double>")
    side = side.join(F.broadcast(weight_row), F.lit(True))  # one row
    dot = F.aggregate(
        F.zip_with("_w", "_mean", lambda w, m: w * m), F.lit(0.0), lambda acc, v: acc + v
    )
    side = side.withColumn("_base", dot + intercept)
    rows = df.select(row_id, vector_to_array(column).alias("x")).join(
        F.broadcast(side), F.lit(True)  # one row
    )
    centered = F.zip_with("x", "_mean", lambda v, m: v - m)
    return rows.select(
        row_id,
        "x",
        F.zip_with("_w", centered, lambda w, v: w * v).alias("contributions"),
        F.col("_base").alias("base"),
    )


# --- trees --------------------------------------------------------------------


def flat_trees(model) -> list[dict]:
    """Every tree as flat arrays: feature, threshold (x <= threshold goes left), left and
    right (-1 at a leaf), value, cover (training weight).  As large as the model; Spark's
    own models are read from their saved form, all nodes in one job."""
    if isinstance(model, BoostedTrees):
        return [{**t, "right": [n + 1 if n >= 0 else -1 for n in t["left"]]} for t in model.flat()]
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    forest = isinstance(model, RandomForestClassificationModel)
    weights = [1.0 / model.getNumTrees] * model.getNumTrees if forest else list(model.treeWeights)
    trees: list[dict] = [
        {"feature": [], "threshold": [], "left": [], "right": [], "value": [], "cover": []} for _ in weights
    ]
    for row in rows:
        tree, stats = trees[row["treeID"]], row["impurityStats"]
        split = row["split"]
        if split["numCategories"] not in (-1, None):
            raise TypeError("categorical splits are not supported")
        cuts = split["leftCategoriesOrThreshold"]
        tree["feature"].append(max(split["featureIndex"], 0))
        tree["threshold"].append(cuts[0] if cuts else 0.0)
        tree["left"].append(row["leftChild"])
        tree["right"].append(row["rightChild"])
        tree["cover"].append(sum(stats) if forest else stats[0])
        value = stats[1] / sum(stats) if forest else row["prediction"]
        tree["value"].append(weights[row["treeID"]] * value)
    return trees


def expected_value(trees: list[dict]) -> float:
    """The trees' output averaged over the training weights."""
    total = 0.0
    for tree in trees:
        waiting = [(0, 1.0)]
        while waiting:
            node, share = waiting.pop()
            if tree["left"][node] < 0:
                total += share * tree["value"][node]
            else:
                for child in (tree["left"][node], tree["right"][node]):
                    waiting.append((child, share * tree["cover"][child] / tree["cover"][node]))
    return total


def path_contributions(x: np.ndarray, trees: list[dict]) -> np.ndarray:
    """Shapley values of sums of trees, rows vectorized, a few operations per node.

    On the way to a leaf a feature counts 1 or 0 where it is known (the row follows the
    path or not) and the training share where it is not.  The weighted sum over all
    subsets of known features is the integral over t in (0, 1) of the product of
    known x t + share x (1 - t), which Gauss's rule with half as many points as features
    gives exactly.  Products are carried down the tree, so leaves share their prefixes;
    sums over the leaves below are carried up, and an edge's feature is divided out there.
    """
    out = np.zeros((x.shape[1], len(x)))
    for tree in trees:
        depth = _depth(tree)
        if depth == 0:
            continue
        points, weights = np.polynomial.legendre.leggauss(depth // 2 + 1)
        points, weights = ((points + 1) / 2)[:, None], (weights / 2)[:, None]
        _walk(x, tree, 0, np.ones((len(points), len(x))), {}, points, weights, out)
    return out.T


def _depth(tree: dict) -> int:
    deepest, waiting = 0, [(0, 0)]
    while waiting:
        node, level = waiting.pop()
        deepest = max(deepest, level)
        if tree["left"][node] >= 0:
            waiting += [(tree["left"][node], level + 1), (tree["right"][node], level + 1)]
    return deepest


def _walk(x, tree, node, product, known, points, weights, out) -> np.ndarray:
    """Sum over the leaves below ``node`` of value x product, per point and row.
    ``known``: per feature on the way (follows, share)."""
    left, right = tree["left"][node], tree["right"][node]
    if left < 0:
        return tree["value"][node] * product
    feature, total = tree["feature"][node], None
    goes_left = x[:, feature] <= tree["threshold"][node]
    before = known.get(feature)
    follows, share = before or (1.0, 1.0)
    old = follows * points + share * (1 - points) if before else 1.0
    for child, way in ((left, goes_left), (right, ~goes_left)):
        now = (follows * way, share * tree["cover"][child] / tree["cover"][node])
        factor = now[0] * points + now[1] * (1 - points)
        below = _walk(x, tree, child, product * (factor / old), {**known, feature: now}, points, weights, out)
        out[feature] += (now[0] - now[1]) * (weights * (below / factor)).sum(axis=0)
        total = below if total is None else total + below
    if before:  # the feature's edge above counted the same leaves with its own share
        out[feature] -= (follows - share) * (weights * (total / old)).sum(axis=0)
    return total


#: Rows explained at a time: bounds what a batch holds per level of a tree.
EXPLAIN_ROWS = 1024


def _forest_contributions(bins: np.ndarray, tree: dict) -> np.ndarray:
    """``path_contributions`` of one tree whose cuts are bins."""
    left = tree["left"].tolist()
    flat = {
        "feature": tree["feature"].tolist(), "threshold": tree["bin"].tolist(), "left": left,
        "right": [n + 1 for n in left], "value": tree["value"].tolist(), "cover": tree["cover"].tolist(),
    }
    return np.vstack([
        path_contributions(bins[start : start + EXPLAIN_ROWS], [flat]) for start in range(0, len(bins), EXPLAIN_ROWS)
    ])


def tree_contributions(model, df: DataFrame, row_id: str, column: str = "features") -> DataFrame:
    ship_package(df.sparkSession)
    trees = flat_trees(model)
    base = expected_value(trees)
    kind = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), EXPLAIN_ROWS):
                pdf = whole.iloc[start : start + EXPLAIN_ROWS].copy()
                pdf["contributions"] = list(path_contributions(np.stack(pdf["x"].to_numpy()), trees))
                pdf["base"] = base
                yield pdf

    return df.select(row_id, vector_to_array(column).alias("x")).mapInPandas(
        run, f"{row_id} {kind}, x array<double>, contributions array<double>, base double"
    )


# --- summaries ----------------------------------------------------------------


def _names_row(spark, names: list[str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(names,)], "_names array<string>"))


def global_importance(table: DataFrame, names: list[str], top_n: int | None = 20) -> DataFrame:
    """Mean |contribution| and mean contribution per feature, largest first.
    Vectors are summed in place; only the single result row is exploded."""
    metrics = Summarizer.metrics("mean", "normL1", "count")
    one = table.select(array_to_vector("contributions").alias("_v")).agg(
        metrics.summary(F.col("_v")).alias("s")
    )
    total = vector_to_array("s.normL1")
    rows = one.join(_names_row(table.sparkSession, names), F.lit(True)).select(
        F.col("s.count").alias("_n"),
        F.posexplode(
            F.arrays_zip(
                F.col("_names").alias("name"),
                total.alias("total"),
                vector_to_array("s.mean").alias("mean"),
            )
        ).alias("feature_id", "e"),
    )
    out = rows.select(
        "feature_id",
        F.col("e.name").alias("feature"),
        (F.col("e.total") / F.col("_n")).alias("mean_abs_shap"),
        F.col("e.mean").alias("mean_shap"),
    )
    return out if top_n is None else out.orderBy(F.desc("mean_abs_shap"), "feature_id").limit(top_n)


def local_explanations(
    table: DataFrame, names: list[str], row_id: str, top_n: int = 10
) -> DataFrame:
    """Per row the base, the output and the ``top_n`` features by |contribution|
    as array<struct<feature, value, shap, direction>>."""
    joined = table.join(_names_row(table.sparkSession, names), F.lit(True))
    # Cells are made of the features that can be among the top only: of a wide vector
    # a few, and all that are as large as the last of them.
    sizes = F.transform("contributions", lambda c: F.abs(c))
    least = F.get(F.sort_array(sizes, asc=False), F.least(F.lit(top_n), F.size(sizes)) - 1)
    places = let(
        least,
        lambda t: F.filter(
            F.transform("contributions", lambda c, i: F.when(F.abs(c) >= t, i)), lambda i: i.isNotNull()
        ),
    )

    def cell(i: Column) -> Column:
        c = F.get("contributions", i)
        return F.struct(
            (-F.abs(c)).alias("order"),
            F.get("_names", i).alias("feature"),
            F.get("x", i).alias("value"),
            c.alias("shap"),
            direction(c).alias("direction"),
        )

    cells = F.transform(places, cell)
    top = F.transform(
        F.slice(F.array_sort(cells), 1, top_n),
        lambda s: F.struct(s["feature"], s["value"], s["shap"], s["direction"]),
    )
    total = F.aggregate("contributions", F.lit(0.0), lambda acc, v: acc + v)
    return joined.select(
        row_id,
        "base",
        (F.col("base") + total).alias("prediction"),
        top.alias("top_features"),
    )


def explanation_rows(explained: DataFrame, row_id: str) -> DataFrame:
    return explained.select(
        row_id, "base", "prediction", F.posexplode("top_features").alias("position", "f")
    ).select(row_id, "base", "prediction", "position", "f.*")


def explanation_shape(explained: DataFrame, row_id: str) -> DataFrame:
    """Raising and lowering features among the top, and each one's share of the
    largest |contribution|."""
    tops = F.col("top_features")
    sizes = F.transform(tops, lambda f: F.abs(f["shap"]))
    largest = F.greatest(F.array_max(sizes), F.lit(1e-9))
    return explained.select(
        row_id,
        F.size(F.filter(tops, lambda f: f["shap"] > 0)).alias("n_raising"),
        F.size(F.filter(tops, lambda f: f["shap"] <= 0)).alias("n_lowering"),
        let(largest, lambda m: F.transform(sizes, lambda v: v / m)).alias("shares"),
    )


def largest_total(table: DataFrame, row_id: str, k: int = 3) -> DataFrame:
    """Rows with the largest summed contribution."""
    total = F.aggregate("contributions", F.lit(0.0), lambda acc, v: acc + v)
    return table.select(row_id, total.alias("total")).orderBy(F.desc("total"), row_id).limit(k)
