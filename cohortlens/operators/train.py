"""Class weights, estimators, search, cross-validation, oversampling."""

from __future__ import annotations

import random
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from . import boosting as bo, forest, linear
from .evaluate import binary_metrics, fold_summary
from .ranking import hash_rank, stratified_folds

MODEL_NAMES = ["logistic_regression", "random_forest", "gbt_depthwise", "gbt_leafcapped"]

# The searched settings, in Spark's parameter names.  Depth 30 is
# Spark's limit and stands for "unlimited".
PARAM_GRIDS: dict[str, dict[str, list]] = {
    "logistic_regression": {
        "C": [0.001, 0.01, 0.1, 0.5, 1.0, 5.0, 10.0],
        "penalty": ["l1", "l2"],
    },
    "random_forest": {
        "numTrees": [100, 200, 400],
        "maxDepth": [5, 10, 20, 30],
        "minInstancesPerNode": [1, 2, 5],
        "featureSubsetStrategy": ["sqrt", "log2"],
    },
    "gbt_depthwise": {
        "rounds": [100, 200, 400],
        "depth": [3, 5, 7, 10],
        "rate": [0.01, 0.05, 0.1, 0.2],
        "row_share": [0.6, 0.8, 1.0],
        "column_share": [0.6, 0.8, 1.0],
        "min_hessian": [1, 3, 5],
        "min_gain": [0.0, 0.1, 0.3],
    },
    "gbt_leafcapped": {
        "rounds": [100, 200, 400],
        "depth": [3, 5, 10, None],
        "rate": [0.01, 0.05, 0.1, 0.2],
        "leaves": [15, 31, 63],
        "row_share": [0.6, 0.8, 1.0],
        "column_share": [0.6, 0.8, 1.0],
        "min_rows": [5, 10, 20],
    },
}

# The boosted presets.  One grows level by level to depth 6; the other
# grows the best leaf next up to 31 leaves and stops after 50 rounds without gain.
BOOSTED = {
    "gbt_depthwise": {"rounds": 200, "rate": 0.1, "depth": 6, "leaves": None, "l2": 1.0, "min_hessian": 1.0, "min_rows": 1},
    "gbt_leafcapped": {"rounds": 200, "rate": 0.1, "depth": None, "leaves": 31, "l2": 0.0, "min_hessian": 1e-3, "min_rows": 20},
}
PATIENCE = 50

WEIGHT = "_weight"


def class_weight_table(df: DataFrame, label: str) -> DataFrame:
    """n / (2 n_c) per class and the negative/positive ratio."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = sizes.agg(
        F.sum("n_class").alias("_n"),
        F.sum(F.when(F.col(label) == 1, F.col("n_class"))).alias("_pos"),
        F.sum(F.when(F.col(label) == 0, F.col("n_class"))).alias("_neg"),
    )
    return sizes.join(F.broadcast(total), F.lit(True)).select(  # one row
        label,
        "n_class",
        (F.col("_n") / (2 * F.col("n_class"))).alias("weight"),
        F.coalesce(F.try_divide(F.col("_neg"), F.col("_pos")), F.lit(1.0)).alias("pos_ratio"),
    )


def class_weights(df: DataFrame, label: str, out: str = WEIGHT) -> DataFrame:
    table = class_weight_table(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(table), label)  # one row per class


def linear_model(
    weighted: DataFrame,
    label: str,
    C: float = 1.0,
    l1: bool = False,
    column: str = "features",
    max_iter: int = 1000,
):
    """Penalized logistic regression on a weighted table.  Spark averages the loss
    over the weights, hence the penalty 1 / (C x sum of weights)."""
    total = weighted.agg(F.sum(WEIGHT)).first()[0]
    return LogisticRegression(
        featuresCol=column,
        labelCol=label,
        weightCol=WEIGHT,
        regParam=1.0 / (C * total),
        elasticNetParam=1.0 if l1 else 0.0,
        standardization=False,
        maxIter=max_iter,
    ).fit(weighted)


def estimator(
    name: str,
    label: str,
    params: dict | None = None,
    total_weight: float = 1.0,
    column: str = "features",
    seed: int = 42,
):
    """An unfitted classifier with the preset's defaults and ``params`` on top."""
    common = {"featuresCol": column, "labelCol": label, "weightCol": WEIGHT}
    given = dict(params or {})
    if name == "logistic_regression":
        C, penalty = given.pop("C", 1.0), given.pop("penalty", "l2")
        settings = {
            "regParam": 1.0 / (C * total_weight),
            "elasticNetParam": 1.0 if penalty == "l1" else 0.0,
            "standardization": False,
            "maxIter": 1000,
        }
        return LogisticRegression(**common, **{**settings, **given})
    if name == "random_forest":
        settings = {
            "numTrees": 200, "minInstancesPerNode": 5, "maxDepth": 30, "seed": seed,
            "cacheNodeIds": True, "maxMemoryInMB": FOREST_MB,
        }
        return RandomForestClassifier(**common, **{**settings, **given})
    raise ValueError(f"unknown model {name!r}")


#: Cells of a forest's partition, at least (while there are cores for more) and at most,
#: and the memory for a step's histograms.
FOREST_CELLS, FOREST_MB = (1 << 17, 1 << 24), 1024


def even_rows(data: DataFrame, width: int) -> DataFrame:
    """``data``, of ``width`` numbers a row, in few even partitions."""
    cells = data.count() * max(1, width)
    least, most = FOREST_CELLS
    cores = data.sparkSession.sparkContext.defaultParallelism
    return data.repartition(max(-(-cells // most), min(cores, -(-cells // least)), 1))


def forest_rows(data: DataFrame, column: str) -> DataFrame:
    """``data`` in few even partitions.  In every step of a forest each partition makes a
    histogram per open node, whatever its rows, so the work grows with the partitions."""
    width = data.select(F.size(vector_to_array(F.col(column)))).first()
    return even_rows(data, width[0] if width else 1)


#: Nodes of a forest, at most, that Spark's own may hold in the driver.
FOREST_NODES = 1 << 15


def _large_forest(data: DataFrame, params: dict, column: str, seed: int) -> forest.Settings | None:
    """Settings of a forest that is grown in tasks and kept in files: one that may have more
    than ``FOREST_NODES`` nodes and has only settings known there."""
    if set(params) - set(forest.Settings.__dataclass_fields__):
        return None
    settings = forest.Settings(**{"seed": seed, **params})
    rows, width = data.count(), data.select(F.size(vector_to_array(F.col(column)))).first()
    large = settings.most_nodes(rows) > FOREST_NODES
    return settings if large and forest.fits(rows, width[0]) else None


def boosted_settings(name: str, params: dict | None = None, held: bool = False, seed: int = 42) -> bo.Settings:
    """The preset with ``params`` on top; the leaf-capped one stops early on held rows."""
    stop = {"patience": PATIENCE} if held and name == "gbt_leafcapped" else {}
    return bo.Settings(**{**BOOSTED[name], **stop, "seed": seed, **(params or {})})


def class_sizes(df: DataFrame, label: str, by: list[str] | None = None) -> dict:
    """Rows per (``by`` values, label): a few numbers."""
    rows = df.groupBy(*(by or []), label).count().collect()
    return {tuple(r[:-1]): r["count"] for r in rows}


def positive_weight(sizes: dict[int, int]) -> float:
    """Negatives per positive, the weight of a positive row in boosting."""
    return sizes.get(0, 0) / sizes[1] if sizes.get(1) else 1.0


def balanced_weight(sizes: dict[int, int], label: Column) -> Column:
    """n / (2 n_c) of the row's class."""
    n = sum(sizes.values())
    return F.when(label == 1, n / (2 * max(1, sizes.get(1, 0)))).otherwise(n / (2 * max(1, sizes.get(0, 0))))


def train_model(
    name: str,
    train: DataFrame,
    label: str,
    val: DataFrame | None = None,
    params: dict | None = None,
    column: str = "features",
    use_smote: bool = False,
    row_id: str | None = None,
    seed: int = 42,
):
    """Fit one preset with balanced class weights.  The leaf-capped boosted trees
    stop early when validation rows are given."""
    if use_smote:
        train = smote(train, label, row_id or "row_id", column, seed=seed)
    if name in BOOSTED:
        ids = [row_id] if row_id else []
        ratio = positive_weight({k[0]: n for k, n in class_sizes(train, label).items()})
        data = train.select(*ids, label, column).withColumns(
            {WEIGHT: F.when(F.col(label) == 1, ratio).otherwise(1.0), "_held": F.lit(0)}
        )
        held = val is not None
        if held:
            rest = val.select(*ids, label, column).withColumns({WEIGHT: F.lit(0.0), "_held": F.lit(1)})
            data = data.unionByName(rest)
        settings = boosted_settings(name, params, held, seed)
        fit = bo.Fit(settings, WEIGHT, "_held" if settings.patience else None)
        return bo.fit_many([data], label, ids or None, [fit], column)[0]
    data = class_weights(train.select(label, column), label)
    if name == "random_forest":
        if large := _large_forest(data, params or {}, column, seed):
            return forest.fit(data, label, WEIGHT, large, column)
        data = forest_rows(data, column)
    total = train.count() if name == "logistic_regression" else 1.0
    return estimator(name, label, params, float(total), column, seed).fit(data)


def score(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus y_prob."""
    return model.transform(df).select(
        *keep, vector_to_array("probability")[1].alias("y_prob")
    )


# --- search -----------------------------------------------------------------


def grid_size(grid: dict[str, list]) -> int:
    size = 1
    for values in grid.values():
        size *= len(values)
    return size


def draw_settings(grid: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """``min(n, grid size)`` distinct grid points."""
    size = grid_size(grid)
    chosen = random.Random(seed).sample(range(size), min(n, size))
    out = []
    for index in chosen:
        point = {}
        for key, values in grid.items():
            index, at = divmod(index, len(values))
            point[key] = values[at]
        out.append(point)
    return out


def tune(
    name: str,
    train: DataFrame,
    label: str,
    ids: list[str],
    n_iter: int = 30,
    folds: int = 5,
    metric: str = "roc_auc",
    column: str = "features",
    grid: dict | None = None,
    parallelism: int = 4,
    seed: int = 42,
) -> tuple[dict, float]:
    """Random search with stratified folds; returns settings and mean score.  All
    settings and folds are fitted together and scored in one pass."""
    grid = grid or PARAM_GRIDS.get(name)
    if grid is None:
        return {}, 0.0
    slim = stratified_folds(train.select(*ids, label), label, ids, folds, seed)
    data = train.select(*ids, label, column).join(slim.select(*ids, "fold"), ids).persist()
    try:
        settings = draw_settings(grid, n_iter, seed)
        models = fold_models(name, data, label, ids, folds, settings, column, parallelism, seed)
        keys = [(i, fold) for i in range(len(settings)) for fold in range(folds)]
        scored = materialize(_score_folds(data, label, column, dict(zip(keys, models))), "search")
        found = {
            (r["setting"], r["fold"]): r[metric]
            for r in binary_metrics(scored, ["setting", "fold"], label, digits=None).collect()
        }
    finally:
        data.unpersist()
    scores = [sum(found.get((i, f), 0.0) for f in range(folds)) / folds for i in range(len(settings))]
    best = max(range(len(scores)), key=lambda i: scores[i])
    return settings[best], round(float(scores[best]), 4)


def fold_models(
    name: str,
    data: DataFrame,
    label: str,
    ids: list[str],
    folds: int,
    settings: list[dict],
    column: str = "features",
    parallelism: int = 4,
    seed: int = 42,
) -> list:
    """Models per setting and fold (fold fastest), each fitted on all rows but those of
    its ``fold``.  Boosted trees and linear models share passes over the table; forests
    are fitted side by side."""
    sizes = class_sizes(data, label, ["fold"])
    own = []
    for fold in range(folds):
        rest: dict[int, int] = {}
        for (f, y), n in sizes.items():
            if f != fold:
                rest[y] = rest.get(y, 0) + n
        own.append(rest)
    tasks = [(point, fold) for point in settings for fold in range(folds)]
    outside = [F.col("fold") != fold for fold in range(folds)]
    if name in BOOSTED:
        weighted = data.withColumns({
            f"_w{k}": F.when(outside[k], F.when(F.col(label) == 1, positive_weight(own[k])).otherwise(1.0)).otherwise(0.0)
            for k in range(folds)
        })
        fits = [bo.Fit(boosted_settings(name, point, seed=seed), f"_w{k}") for point, k in tasks]
        return bo.fit_many([weighted], label, ids, fits, column)
    width = data.select(F.size(vector_to_array(F.col(column)))).first()
    if name == "logistic_regression" and width and width[0] <= linear.WIDEST:
        weighted = data.withColumns({
            f"_w{k}": F.when(outside[k], balanced_weight(own[k], F.col(label))).otherwise(0.0) for k in range(folds)
        })
        fits = [
            linear.LinearFit(f"_w{k}", point.get("C", 1.0), point.get("penalty", "l2") == "l1") for point, k in tasks
        ]
        with linear.SharedRows(weighted, label, [f"_w{k}" for k in range(folds)], column) as rows:
            return rows.fit(fits)

    def fit(task: tuple[dict, int]):
        point, k = task
        return train_model(name, data.where(outside[k]), label, params=point, column=column, seed=seed)

    with ThreadPool(parallelism) as pool:
        return pool.map(fit, tasks)


def _score_folds(data: DataFrame, label: str, column: str, models: dict[tuple[int, int], object]) -> DataFrame:
    """(setting, fold, label, y_prob): every row under the models that did not see it."""
    plain = {k: m for k, m in models.items() if isinstance(m, (np.ndarray, bo.BoostedTrees))}
    if len(plain) < len(models):
        parts = None
        for (i, fold), model in models.items():
            part = score(model, data.where(F.col("fold") == fold), [label, "fold"])
            part = part.withColumn("setting", F.lit(i))
            parts = part if parts is None else parts.unionByName(part)
        return parts
    margins = {
        k: (m[:-1], m[-1]) if isinstance(m, np.ndarray) else bo.margin_of(m.flat()) for k, m in plain.items()
    }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                for (i, k), model in margins.items():
                    if k != fold:
                        continue
                    if isinstance(model, tuple):
                        z = np.stack(part["x"].to_numpy()) @ model[0] + model[1]
                    else:
                        z = model(part["x"]).to_numpy()
                    yield pd.DataFrame(
                        {"setting": i, "fold": fold, label: part[label].to_numpy(), "y_prob": 1 / (1 + np.exp(-z))}
                    )

    kind = data.schema[label].dataType.simpleString()
    slim = data.select("fold", label, vector_to_array(F.col(column)).alias("x"))
    return slim.mapInPandas(run, f"setting int, fold int, {label} {kind}, y_prob double")


def cross_validate(
    name: str,
    df: DataFrame,
    label: str,
    ids: list[str],
    folds: int = 5,
    column: str = "features",
    params: dict | None = None,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Metrics per fold and their summary, default settings, each row scored by the
    model that did not see it."""
    assigned = stratified_folds(df.select(*ids, label), label, ids, folds, seed)
    data = df.select(*ids, label, column).join(assigned.select(*ids, "fold"), ids).persist()
    try:
        models = fold_models(name, data, label, ids, folds, [params or {}], column, seed=seed)
        scored = materialize(
            _score_folds(data, label, column, {(0, fold): m for fold, m in enumerate(models)}), "folds"
        )
    finally:
        data.unpersist()
    per_fold = binary_metrics(scored, ["fold"], label, "y_prob", digits=None)
    per_fold = per_fold.withColumn("model", F.lit(name))
    return per_fold, fold_summary(per_fold, ["model"])


def feature_importance(model, names: list[str], spark) -> DataFrame:
    """(feature, importance) from the weights or the impurity gains."""
    values = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
    n = min(len(names), values.size)
    rows = [(names[i], float(values[i])) for i in range(n)]
    return spark.createDataFrame(rows, "feature string, importance double")


# --- oversampling -------------------------------------------------------------

#: Rows of a bucket, about, and tables of buckets in which neighbours are sought.
SMOTE_BUCKET, SMOTE_TABLES = 256, 6


def smote(
    df: DataFrame,
    label: str,
    row_id: str,
    column: str = "features",
    neighbors: int = 5,
    skip_ratio: float = 0.4,
    seed: int = 42,
) -> DataFrame:
    """Add minority points up to parity, each on the line between a minority row
    and one of its nearest minority rows.  A minority of ``skip_ratio`` of the
    majority or more is left alone.

    Neighbours are approximate at any size: in each of ``SMOTE_TABLES`` tables a row
    falls in the bucket of its signs along random directions from the mean, a bucket
    above ``SMOTE_BUCKET`` rows is split by a hash of the row, and the nearest of all
    its buckets' rows count.  Directions, splits, partners and fractions follow from
    the seed and the row's id, so a retry gives the same points.  A row alone in
    all its buckets is repeated as it is.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # two classes
    if len(sizes) < 2:
        return df.select(row_id, label, column)
    minority = min(sizes, key=sizes.get)
    n_min, n_max = sizes[minority], max(sizes.values())
    base = df.select(row_id, label, column)
    if n_min / n_max >= skip_ratio or n_min < 2:
        return base
    every, extra = divmod(n_max - n_min, n_min)
    minor = df.where(F.col(label) == minority)
    mean = minor.select(Summarizer.mean(F.col(column)).alias("m")).first().m.toArray()
    bits = max(0, (-(-n_min // SMOTE_BUCKET) - 1).bit_length())
    directions = np.random.default_rng(seed).normal(size=(len(mean), SMOTE_TABLES, bits))
    points = minor.select(row_id, vector_to_array(column).alias("_x"))
    kind = df.schema[row_id].dataType.simpleString()

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sides = np.tensordot(np.stack(pdf["_x"].to_numpy()) - mean, directions, 1) > 0
            place = (sides * (1 << np.arange(bits))).sum(axis=2) + (np.arange(SMOTE_TABLES) << bits)
            yield pdf.assign(_places=list(place.astype(np.int64)))

    placed = points.mapInPandas(codes, f"{row_id} {kind}, _x array<double>, _places array<bigint>").select(
        row_id, "_x", F.explode("_places").alias("_place")
    )
    full = placed.groupBy("_place").agg(F.ceil(F.count(F.lit(1)) / (2 * SMOTE_BUCKET)).alias("_parts"))
    part = F.pmod(F.xxhash64(row_id, "_place", F.lit(seed)), F.col("_parts"))
    near_kind = f"{row_id} {kind}, _other {kind}, _d double, _y array<double>"

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        return _nearest_rows(pdf, row_id, neighbors)

    near = (
        placed.join(full, "_place").withColumn("_part", part)
        .groupBy("_place", "_part").applyInPandas(nearest, near_kind)
        .groupBy(row_id, "_other").agg(F.min("_d").alias("_d"), F.first("_y").alias("_y"))
    )
    order = Window.partitionBy(row_id).orderBy("_d", "_other")
    partners = (
        near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= neighbors)
        .groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_y"))), lambda p: p["_y"]).alias("_near"))
    )
    copies = hash_rank(points, [], [row_id], seed).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.lit(every) + (F.col("rank") <= extra).cast("int")))
        if every
        else F.explode(F.when(F.col("rank") <= extra, F.array(F.lit(1))))
    )
    drawn = F.xxhash64(row_id, "_copy", F.lit(seed))
    partner = F.element_at("_near", (F.pmod(drawn, F.size("_near")) + 1).cast("int"))
    fraction = F.pmod(F.shiftrightunsigned(F.xxhash64(drawn), 11), F.lit(1 << 53)) / float(1 << 53)
    new = (
        copies.join(partners, row_id, "left")
        .withColumn("_y", F.coalesce(partner, F.col("_x")))
        .withColumn("_f", fraction)
        .select(
            row_id, F.lit(minority).cast(df.schema[label].dataType).alias(label),
            array_to_vector(F.zip_with("_x", "_y", lambda x, y: x + F.col("_f") * (y - x))).alias(column),
        )
    )
    return base.unionByName(new)


def _nearest_rows(pdf: pd.DataFrame, row_id: str, k: int) -> pd.DataFrame:
    """The k nearest other rows of each row of one bucket part."""
    pdf = pdf.sort_values(row_id, kind="stable")
    ids, x = pdf[row_id].to_numpy(), np.stack(pdf["_x"].to_numpy())
    square = (x * x).sum(axis=1)
    distance = np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(distance, np.inf)
    k = min(k, len(x) - 1)
    near = np.argsort(distance, axis=1, kind="stable")[:, :k]
    one, two = np.repeat(np.arange(len(x)), k), near.ravel()
    return pd.DataFrame({row_id: ids[one], "_other": ids[two], "_d": distance[one, two], "_y": list(x[two])})
