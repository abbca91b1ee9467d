"""Metrics on scored rows.  ``keys`` (model, feature set, fold, ...) may be empty
or hold a few values with billions of rows each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import ratio, round_even
from .ranking import join_groups, label_totals, rank_sums

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
THRESHOLDS = range(10, 91)  # hundredths


def confusion_counts(
    df: DataFrame, keys: list[str], label: str = "y_true", predicted: str = "y_pred"
) -> DataFrame:
    def count(y: int, p: int, name: str):
        hit = (F.col(label) == y) & (F.col(predicted) == p)
        return F.sum(F.when(hit, 1).otherwise(0)).alias(name)

    return df.groupBy(*keys).agg(
        count(1, 1, "tp"), count(0, 1, "fp"), count(1, 0, "fn"), count(0, 0, "tn")
    )


def confusion_rates(counts: DataFrame) -> DataFrame:
    """Rates from tp, fp, fn, tn; an empty denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "fpr": ratio(fp, fp + tn),
            "fnr": ratio(fn, fn + tp),
            "selection_rate": ratio(tp + fp, tp + fp + fn + tn),
        }
    )


def binary_metrics(
    df: DataFrame,
    keys: list[str],
    label: str = "y_true",
    score: str = "y_prob",
    threshold: float = 0.5,
    digits: int | None = 4,
) -> DataFrame:
    """Accuracy, precision, recall, F1 at the threshold, exact ROC-AUC and average
    precision, and the confusion counts.  One class only: both areas are 0."""
    totals = label_totals(df, keys, score, label)
    above, below = F.col("score") >= threshold, F.col("score") < threshold
    counts = totals.groupBy(*keys).agg(
        *[
            F.sum(F.when(side, F.col(kind)).otherwise(0)).alias(name)
            for name, side, kind in (
                ("tp", above, "ones"), ("fp", above, "zeros"), ("fn", below, "ones"), ("tn", below, "zeros")
            )
        ]
    )
    joined = join_groups(confusion_rates(counts), rank_sums(totals, keys), keys)
    value = lambda c: round_even(F.col(c), digits) if digits is not None else F.col(c)
    return joined.select(*keys, *[value(m).alias(m) for m in METRICS], "tp", "fp", "fn", "tn")


def roc_points(
    df: DataFrame,
    keys: list[str],
    label: str = "y_true",
    score: str = "y_prob",
    drop_collinear: bool = True,
    lone_ends: bool = True,
) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score plus the origin (infinite
    threshold).  Points inside a straight stretch are dropped: those whose step is
    followed by an equal step.  One class only: the diagonal's two ends, or without
    ``lone_ends`` every point, with NaN for a share of none.  Unknown (null) labels count
    as no row; their scores stay thresholds, null while nothing known is above."""
    totals = label_totals(df, keys, score, label)
    # Going down the scores, the step after a point is the next lower score's.
    following = _next_lower(totals, keys) if drop_collinear else totals
    if drop_collinear:
        turn = (F.col("_next.pos") != F.col("pos")) | (F.col("_next.neg") != F.col("neg"))
        unknown, next_unknown = F.col("rows") == 0, F.col("_next.pos") + F.col("_next.neg") == 0
        following = following.where(F.col("_next").isNull() | next_unknown | (~unknown & turn))
    tp, fp = _from_the_top("pos"), _from_the_top("neg")
    points = _of_curve(following, lone_ends).select(
        *keys,
        F.col("score").alias("threshold"),
        _share(fp, "total_neg", tp + fp).alias("fpr"),
        _share(tp, "total_pos", tp + fp).alias("tpr"),
    )
    lone = [(0.0, 0.0), (1.0, 1.0)] if lone_ends else [(0.0, 0.0)]
    return points.unionByName(_end_points(totals, keys, "fpr", "tpr", [(0.0, 0.0)], lone))


def pr_points(
    df: DataFrame,
    keys: list[str],
    label: str = "y_true",
    score: str = "y_prob",
    lone_ends: bool = True,
) -> DataFrame:
    """(threshold, precision, recall) for every distinct score plus (1, 0).  One class only:
    (0, 1) and (1, 0), or without ``lone_ends`` every point as in ``roc_points``."""
    totals = label_totals(df, keys, score, label)
    tp, fp = _from_the_top("pos"), _from_the_top("neg")
    points = _of_curve(totals, lone_ends).select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide(tp, tp + fp).alias("precision"),
        _share(tp, "total_pos", tp + fp).alias("recall"),
    )
    lone = [(0.0, 1.0), (1.0, 0.0)] if lone_ends else [(1.0, 0.0)]
    return points.unionByName(_end_points(totals, keys, "precision", "recall", [(1.0, 0.0)], lone))


def _from_the_top(kind: str) -> Column:
    """Rows of a class at or above a score."""
    return F.col(f"total_{kind}") - F.col(f"cum_{kind}") + F.col(kind)


def _of_curve(totals: DataFrame, lone_ends: bool) -> DataFrame:
    both = (F.col("total_pos") > 0) & (F.col("total_neg") > 0)
    return totals.where(both) if lone_ends else totals


def _share(part: Column, total: str, seen: Column) -> Column:
    """``part`` of a class's rows: NaN if there are none, null while nothing is ``seen``."""
    share = F.when(F.col(total) == 0, float("nan")).otherwise(F.try_divide(part, F.col(total)))
    return F.when(seen > 0, share)


def _end_points(totals, keys, x, y, usual, one_class) -> DataFrame:
    """Fixed points per key: ``usual`` when both classes occur, else ``one_class``."""
    kinds = totals.groupBy(*keys).agg(
        ((F.max("total_pos") > 0) & (F.max("total_neg") > 0)).alias("_both")
    )
    pack = lambda pts: F.array(
        *[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pts]
    )
    chosen = F.when(F.col("_both"), pack(usual)).otherwise(pack(one_class))
    return kinds.select(*keys, F.explode(chosen).alias("p")).select(
        *keys, F.lit(float("inf")).alias("threshold"), F.col("p.x").alias(x), F.col("p.y").alias(y)
    )


def _next_lower(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Attach ``_next``: pos and neg at the next lower score, across buckets too."""
    step = F.struct("pos", "neg")
    edge = totals.groupBy(*keys, "_bucket").agg(F.max_by(step, "score").alias("_top"))
    group = [F.col(k) for k in keys] or [F.lit(0)]
    along = Window.partitionBy(*group).orderBy("_bucket")  # one row per bucket
    edge = edge.select(*keys, "_bucket", F.lag("_top").over(along).alias("_below"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy("score")
    return join_groups(totals, edge, [*keys, "_bucket"]).withColumn(
        "_next", F.coalesce(F.lag(step).over(inner), F.col("_below"))
    )


def threshold_scores(
    df: DataFrame,
    keys: list[str],
    label: str = "y_true",
    score: str = "y_prob",
    metric: str = "f1",
) -> DataFrame:
    """The metric at each threshold 0.10, 0.11, ..., 0.90, one pass over the rows:
    scores are binned by how many thresholds they reach, then 81 bins are summed."""
    if metric not in ("f1", "youden"):
        raise ValueError(f"unknown metric {metric!r}")
    p = F.col(score).cast("double")
    guess = F.floor(p * 100)
    guess = F.when(p >= (guess + 1) / 100, guess + 1).when(p < guess / 100, guess - 1).otherwise(guess)
    low, high = THRESHOLDS[0], THRESHOLDS[-1]
    place = F.least(F.greatest(guess, F.lit(low - 1)), F.lit(high)).cast("int")
    pos = (F.col(label) == 1).cast("long")
    binned = df.groupBy(*keys, place.alias("bin")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")
    )
    zero = F.lit(0).cast("long")
    grid = binned.select(*keys).distinct().select(
        *keys,
        F.explode(F.sequence(F.lit(low - 1), F.lit(high))).alias("bin"),
        zero.alias("pos"),
        zero.alias("neg"),
    )
    full = binned.unionByName(grid).groupBy(*keys, "bin").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    group = [F.col(k) for k in keys] or [F.lit(0)]
    down = Window.partitionBy(*group).orderBy(F.desc("bin"))  # 82 rows per key
    whole = Window.partitionBy(*group)
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    counts = full.select(
        *keys,
        "bin",
        tp.alias("tp"),
        fp.alias("fp"),
        (F.sum("pos").over(whole) - tp).alias("fn"),
        (F.sum("neg").over(whole) - fp).alias("tn"),
    ).where(F.col("bin") >= low)
    rates = confusion_rates(counts)
    specificity = ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    value = F.col("f1") if metric == "f1" else F.col("recall") + specificity - 1
    return rates.select(*keys, (F.col("bin") / 100).alias("threshold"), value.alias("value"))


def best_threshold(
    df: DataFrame,
    keys: list[str],
    label: str = "y_true",
    score: str = "y_prob",
    metric: str = "f1",
) -> DataFrame:
    """Lowest threshold with the highest score; nothing above 0 gives (0.5, 0)."""
    grid = threshold_scores(df, keys, label, score, metric)
    best = grid.groupBy(*keys).agg(
        F.max_by(F.struct("threshold", "value"), F.struct("value", -F.col("threshold"))).alias("b")
    )
    found = F.col("b.value") > 0
    return best.select(
        *keys,
        F.when(found, round_even(F.col("b.threshold"), 2)).otherwise(0.5).alias("threshold"),
        F.when(found, round_even(F.col("b.value"), 4)).otherwise(0.0).alias("value"),
    )


# --- over result tables -----------------------------------------------------


def best_row(
    results: DataFrame, by: list[str], metric: str = "roc_auc", order: str = "seq"
) -> DataFrame:
    """The row with the highest metric per ``by`` (or overall); the first wins ties."""
    best = results.groupBy(*by).agg(
        F.max_by(F.struct(*results.columns), F.struct(metric, -F.col(order))).alias("b")
    )
    return best.select("b.*")


def metric_pivot(
    results: DataFrame, feature_sets: list[str], metric: str = "roc_auc", missing: float | None = None
) -> DataFrame:
    """Model by feature set, mean of the metric."""
    wide = results.groupBy("model").pivot("feature_type", feature_sets).agg(F.avg(metric))
    return wide if missing is None else wide.fillna(missing)


def fold_summary(folds: DataFrame, keys: list[str], digits: int | None = 4) -> DataFrame:
    """Mean and sample deviation over folds of F1, ROC-AUC and PR-AUC."""
    value = lambda c: round_even(c, digits) if digits is not None else c
    stats = []
    for m in ("f1", "roc_auc", "pr_auc"):
        stats.append(value(F.avg(m)).alias(f"{m}_mean"))
        stats.append(value(F.stddev_samp(m)).alias(f"{m}_std"))
    return folds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds"), *stats)


def filter_results(
    results: DataFrame, models: list[str] | None = None, feature_sets: list[str] | None = None
) -> DataFrame:
    out = results
    if models:
        out = out.where(F.col("model").isin(models))
    if feature_sets:
        out = out.where(F.col("feature_type").isin(feature_sets))
    return out.orderBy(F.desc("roc_auc"))


def top_importance(importance: DataFrame, n: int = 30) -> DataFrame:
    """Top rows of (feature, importance) by absolute value."""
    size = F.abs("importance")
    return importance.withColumn("abs_importance", size).orderBy(
        F.desc("abs_importance"), "feature"
    ).limit(n)
