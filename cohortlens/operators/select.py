"""Feature selection: fitted on training rows, returned as column indices."""

from __future__ import annotations

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import linear
from .features import name_vector, vector_names
from .train import WEIGHT, class_weights, linear_model


def feature_moments(df: DataFrame, keys: list[str], column: str = "features") -> DataFrame:
    """(keys, feature_id, n, mean, variance): one pass, vectors summed in place;
    sparse zeros count.  Only the few result rows are exploded."""
    metrics = Summarizer.metrics("count", "mean", "variance")
    rows = df.groupBy(*keys).agg(metrics.summary(F.col(column)).alias("s"))
    rows = rows.select(
        *keys,
        F.col("s.count").alias("n"),
        F.posexplode(
            F.arrays_zip(
                vector_to_array("s.mean").alias("mean"),
                vector_to_array("s.variance").alias("variance"),
            )
        ).alias("feature_id", "m"),
    )
    return rows.select(*keys, "feature_id", "n", "m.mean", "m.variance")


def variances(df: DataFrame, column: str = "features") -> DataFrame:
    """Population variance per feature."""
    moments = feature_moments(df, [], column)
    n = F.col("n").cast("double")
    return moments.select("feature_id", (F.col("variance") * (n - 1) / n).alias("variance"))


def variance_selection(df: DataFrame, threshold: float = 0.0, column: str = "features") -> list[int]:
    kept = variances(df, column).where(F.col("variance") > threshold)
    return sorted(r[0] for r in kept.select("feature_id").collect())  # at most one per feature


def anova_f(df: DataFrame, label: str, column: str = "features") -> DataFrame:
    """One-way F per feature from each class's count, mean and variance."""
    per_class = feature_moments(df, [label], column)
    n, mean, var = F.col("n").cast("double"), F.col("mean"), F.col("variance")
    sums = per_class.groupBy("feature_id").agg(
        F.sum(n).alias("_n"),
        F.count(F.lit(1)).alias("_k"),
        F.sum(n * mean).alias("_s"),
        F.sum(n * mean * mean).alias("_q"),
        F.sum(F.when(n > 1, var * (n - 1)).otherwise(0.0)).alias("_within"),
    )
    between = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_k") - 1)
    within = F.col("_within") / (F.col("_n") - F.col("_k"))
    return sums.select("feature_id", F.try_divide(between, within).alias("score"))


def chi_square(df: DataFrame, label: str, column: str = "features") -> DataFrame:
    """Chi-square of each feature's class sums against the class shares; values are
    taken as frequencies and must not be negative."""
    per_class = feature_moments(df, [label], column)
    n = F.col("n").cast("double")
    observed = per_class.select("feature_id", n.alias("n"), (F.col("mean") * n).alias("_o"))
    totals = observed.groupBy("feature_id").agg(F.sum("_o").alias("_sum"), F.sum("n").alias("_n"))
    expected = F.col("_sum") * F.col("n") / F.col("_n")
    joined = observed.join(totals, "feature_id").withColumn("_e", expected)
    term = F.try_divide((F.col("_o") - F.col("_e")) * (F.col("_o") - F.col("_e")), F.col("_e"))
    return joined.groupBy("feature_id").agg(F.sum(term).alias("score"))


def mutual_information(
    df: DataFrame, label: str, column: str = "features", bins: int = 10
) -> DataFrame:
    """Mutual information with the label over ``bins`` equal-width bins."""
    metrics = Summarizer.metrics("min", "max")
    limits = df.agg(metrics.summary(F.col(column)).alias("s")).select(
        vector_to_array("s.min").alias("_lo"), vector_to_array("s.max").alias("_hi")
    )
    cells = df.select(label, vector_to_array(column).alias("_x")).join(
        F.broadcast(limits), F.lit(True)  # one row
    )
    cells = cells.select(
        label, F.posexplode(F.arrays_zip("_x", "_lo", "_hi")).alias("feature_id", "c")
    )
    width = F.col("c._hi") - F.col("c._lo")
    bin_no = F.when(width == 0, 0).otherwise(
        F.least(F.floor(F.try_divide(F.col("c._x") - F.col("c._lo"), width) * bins), F.lit(bins - 1))
    )
    # Combined before the shuffle: features x bins x classes rows leave a task.
    joint = cells.groupBy("feature_id", bin_no.cast("int").alias("bin"), label).agg(
        F.count(F.lit(1)).alias("n")
    )
    joint = materialize(joint, "joint")  # features x bins x classes rows, read four times
    by_bin = joint.groupBy("feature_id", "bin").agg(F.sum("n").alias("_nb"))
    by_class = joint.groupBy("feature_id", label).agg(F.sum("n").alias("_nc"))
    total = joint.groupBy("feature_id").agg(F.sum("n").alias("_n"))
    table = (
        joint.join(by_bin, ["feature_id", "bin"])
        .join(by_class, ["feature_id", label])
        .join(total, "feature_id")
    )
    share = F.col("n") / F.col("_n")
    gain = share * F.ln(F.col("n") * F.col("_n") / (F.col("_nb") * F.col("_nc")))
    return table.groupBy("feature_id").agg(F.sum(gain).alias("score"))


SCORES = {"f_classif": anova_f, "chi2": chi_square, "mutual_info": mutual_information}


def univariate_selection(
    df: DataFrame, label: str, k: int = 100, score_func: str = "f_classif", column: str = "features"
) -> list[int]:
    """Indices of the ``k`` best-scoring features, in column order."""
    if score_func not in SCORES:
        raise ValueError(f"unknown score function {score_func!r}")
    scores = SCORES[score_func](df, label, column)
    best = scores.orderBy(F.desc_nulls_last("score"), "feature_id").limit(k)
    return sorted(r[0] for r in best.select("feature_id").collect())


def l1_selection(
    df: DataFrame,
    label: str,
    C: float = 1.0,
    column: str = "features",
    fallback: int = 50,
    max_iter: int = 1000,
) -> list[int]:
    """Features with a non-zero L1 weight; none left gives the largest ones of a
    nearly unpenalized fit."""
    weighted = class_weights(df, label)
    if len(vector_names(df, column)) <= linear.WIDEST:
        with linear.SharedRows(weighted, label, [WEIGHT], column) as rows:
            weights = rows.fit([linear.LinearFit(WEIGHT, C, l1=True)], most=max_iter)[0][:-1]
    else:
        model = linear_model(weighted, label, C=C, l1=True, column=column, max_iter=max_iter)
        weights = model.coefficients.toArray()
    kept = [i for i, w in enumerate(weights) if abs(w) > 1e-8]
    if kept:
        return kept
    order = sorted(range(len(weights)), key=lambda i: (-abs(weights[i]), i))
    return order[:fallback]


def rfe_selection(
    df: DataFrame,
    label: str,
    n_features_to_select: int = 50,
    step: float = 0.1,
    column: str = "features",
    max_iter: int = 500,
) -> list[int]:
    """Refit and drop the weakest ``step`` share of all features until ``n`` are left.
    The rows are laid out once; each refit starts from the weights before it."""
    names = vector_names(df, column)
    alive = list(range(len(names)))
    target = min(n_features_to_select, len(alive))
    drop = max(1, int(step * len(alive)))
    weighted = class_weights(df.select(label, column), label)
    if len(names) <= linear.WIDEST:
        start = None
        with linear.SharedRows(weighted, label, [WEIGHT], column) as rows:
            while len(alive) > target:
                fit = linear.LinearFit(WEIGHT, features=alive, start=start)
                start = rows.fit([fit], most=max_iter)[0]
                ranked = sorted(alive, key=lambda f: (abs(start[f]), f))
                gone = set(ranked[: min(drop, len(alive) - target)])
                alive = [f for f in alive if f not in gone]
        return alive
    weighted = weighted.persist()
    try:
        while len(alive) > target:
            part = apply_selection(weighted, alive, column, names)
            model = linear_model(part, label, column=column, max_iter=max_iter)
            weights = model.coefficients.toArray()
            ranked = sorted(range(len(alive)), key=lambda i: (abs(weights[i]), i))
            gone = set(ranked[: min(drop, len(alive) - target)])
            alive = [f for i, f in enumerate(alive) if i not in gone]
    finally:
        weighted.unpersist()
    return alive


def contribution_selection(
    df: DataFrame,
    label: str,
    top_k: int = 50,
    column: str = "features",
    model=None,
    model_name: str = "logistic_regression",
) -> list[int]:
    """Features with the largest mean absolute contribution, in column order.  The
    model is fitted here when none is given."""
    from .explain import contributions, global_importance
    from .train import train_model

    model = model or train_model(model_name, df, label, column=column)
    table = contributions(model, df.withColumn("_row", F.lit(0)), df, "_row", column)
    names = vector_names(df, column)
    best = global_importance(table, names, top_k).select("feature_id")
    return sorted(r[0] for r in best.collect())


def apply_selection(
    df: DataFrame, indices: list[int], column: str = "features", names: list[str] | None = None
) -> DataFrame:
    """Slice the vector; names travel with it."""
    names = names or vector_names(df, column)
    sliced = VectorSlicer(inputCol=column, outputCol="_sliced", indices=indices).transform(
        name_vector(df, column, names)
    )
    out = sliced.drop(column).withColumnRenamed("_sliced", column)
    return name_vector(out, column, [names[i] for i in indices])


METHODS = {
    "variance": lambda df, label, column, **kw: variance_selection(df, column=column, **kw),
    "univariate": lambda df, label, column, **kw: univariate_selection(df, label, column=column, **kw),
    "l1": lambda df, label, column, **kw: l1_selection(df, label, column=column, **kw),
    "rfe": lambda df, label, column, **kw: rfe_selection(df, label, column=column, **kw),
    "shap": lambda df, label, column, **kw: contribution_selection(df, label, column=column, **kw),
}


def select_features(
    train: DataFrame, label: str, method: str = "univariate", column: str = "features", **kwargs
) -> dict:
    """Indices, names and sizes before and after."""
    if method not in METHODS:
        raise ValueError(f"unknown selection method {method!r}")
    names = vector_names(train, column)
    indices = METHODS[method](train, label, column, **kwargs)
    return {
        "method": method,
        "indices": indices,
        "names": [names[i] for i in indices],
        "n_before": len(names),
        "n_after": len(indices),
    }
