"""Exact ranks, running totals, seeded samples and splits over few, huge groups.

A window over (label) or (topic) would put all rows of a label in one task.
Everything here ranks in two levels instead: an order-preserving bucket, totals
per bucket (a small table that is prefix-summed), and a window inside the bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import ratio
from ..session import materialize

INF = float("inf")


def bucket_count(df: DataFrame) -> int:
    """Buckets grow with the cluster's shuffle partitions, which follow the data."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a table with its own totals: a null key is a group like any other."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(other[f"_of_{k}"])
    return left.join(other, same, how).drop(*[f"_of_{k}" for k in keys])


def value_buckets(df: DataFrame, value: str, out: str = "_bucket", cuts: list | None = None):
    """Order-preserving bucket of ``value``.  The cut points are literals, so
    every use of the plan, and every retry, buckets a row alike."""
    if cuts is None:
        n = bucket_count(df)
        probs = [i / n for i in range(1, n)]
        cuts = df.select(F.col(value).cast("double").alias(value)).approxQuantile(
            value, probs, 1 / (4 * n)
        )
    splits = [-INF, *sorted({c for c in cuts if abs(c) != INF}), INF]
    if len(splits) == 2:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(
        splits=splits, inputCol=value, outputCol=out, handleInvalid="keep"
    ).transform(df)


def bucketed_totals(
    df: DataFrame, keys: list[str], value: str, measures: list[str]
) -> DataFrame:
    """``running_totals`` with the order-preserving ``_bucket`` of each value."""
    merged = materialize(
        df.groupBy(*keys, value).agg(*[F.sum(m).alias(m) for m in measures]), "values"
    )
    merged = value_buckets(merged, value)
    per_bucket = merged.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(m) for m in measures])
    group = [F.col(k) for k in keys] or [F.lit(0)]
    along = Window.partitionBy(*group).orderBy("_bucket")
    whole = Window.partitionBy(*group)
    offsets = per_bucket.select(
        *keys,
        "_bucket",
        *[(F.sum(m).over(along) - F.col(m)).alias(f"_before_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures],
    )
    inner = Window.partitionBy(*keys, "_bucket").orderBy(value)
    return join_groups(merged, offsets, [*keys, "_bucket"]).select(
        *keys,
        value,
        "_bucket",
        *measures,
        *[(F.col(f"_before_{m}") + F.sum(m).over(inner)).alias(f"cum_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def running_totals(
    df: DataFrame, keys: list[str], value: str, measures: list[str]
) -> DataFrame:
    """One row per (keys, distinct value) with each measure's sum ``m``, the
    running sum up to and including the value ``cum_m`` and the total ``total_m``.

    Equal values are merged and written before anything is ordered: the input is
    evaluated once, and a value shared by a third of the rows is one row here.
    """
    return bucketed_totals(df, keys, value, measures).drop("_bucket")


def label_totals(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Running positives, negatives and rows by ascending score, the score's
    ``_bucket``, and how many rows have the label 1 (``ones``) or 0 (``zeros``).  A row
    without a label is none of these; its score stays."""
    y = F.col(label).cast("long")
    pos, neg = (F.coalesce(c, F.lit(0).cast("long")) for c in (y, 1 - y))
    known = [F.coalesce((F.col(label) == y).cast("long"), F.lit(0)) for y in (1, 0)]
    slim = df.select(
        *keys, F.col(score).cast("double").alias("score"), pos.alias("pos"), neg.alias("neg"),
        known[0].alias("ones"), known[1].alias("zeros"),
    )
    out = bucketed_totals(slim, keys, "score", ["pos", "neg", "ones", "zeros"])
    return out.withColumn("rows", F.col("pos") + F.col("neg")).withColumn(
        "cum_rows", F.col("cum_pos") + F.col("cum_neg")
    )


def average_ranks(df: DataFrame, keys: list[str], value: str, measure: str = "rows") -> DataFrame:
    """Rank shared by equal values: the mean of the positions they occupy."""
    counted = df.select(*keys, F.col(value).cast("double").alias(value)).withColumn(
        measure, F.lit(1).cast("long")
    )
    out = running_totals(counted, keys, value, [measure])
    rank = F.col(f"cum_{measure}") - (F.col(measure) - 1) / 2
    return out.select(*keys, value, F.col(measure), rank.alias("avg_rank"))


def rank_sums(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: class sizes, rank sum of the positives, U, area under the ROC
    curve, average precision and the tie term sum(t^3 - t)."""
    rank = F.col("cum_rows") - (F.col("rows") - 1) / 2
    # At or above a score, counted from the top.
    pos_above = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
    rows_above = pos_above + F.col("total_neg") - F.col("cum_neg") + F.col("neg")
    t = F.col("rows").cast("double")
    out = totals.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * rank).alias("rank_sum_pos"),
        F.sum(F.try_divide(F.col("pos") * pos_above, rows_above)).alias("_precision_mass"),
        F.sum(t * t * t - t).alias("tie_term"),
    )
    n1, n0 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    u = F.col("rank_sum_pos") - n1 * (n1 + 1) / 2
    both = (n1 > 0) & (n0 > 0)
    return out.select(
        *keys,
        "n_pos",
        "n_neg",
        "rank_sum_pos",
        "tie_term",
        u.alias("u_statistic"),
        F.when(both, ratio(u, n1 * n0)).otherwise(0.0).alias("roc_auc"),
        F.when(both, ratio(F.col("_precision_mass"), n1)).otherwise(0.0).alias("pr_auc"),
    )


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5) -> DataFrame:
    """Exact linearly interpolated quantile per key, without collecting a group."""
    counted = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias(value), F.lit(1).cast("long").alias("rows")
    )
    cum = running_totals(counted, keys, value, ["rows"])
    place = F.lit(q) * (F.col("total_rows") - 1)
    lower, upper = F.floor(place), F.ceil(place)
    start = F.col("cum_rows") - F.col("rows")  # 0-based first position of the value
    holds = lambda p: (p >= start) & (p < F.col("cum_rows"))
    out = cum.groupBy(*keys).agg(
        F.max(F.when(holds(lower), F.col(value))).alias("_lo"),
        F.max(F.when(holds(upper), F.col(value))).alias("_hi"),
        F.max(place - lower).alias("_part"),
    )
    return out.select(
        *keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("quantile")
    )


# --- seeded order -----------------------------------------------------------

#: Least bits of a hash bucket; more on clusters with more shuffle partitions.
HASH_BITS = 12


def hash_bits(df: DataFrame) -> int:
    """Buckets of a sixteenth of a shuffle partition, for each class.  The bits
    only say where ranks are counted; the ranks are the same for any number."""
    return max(HASH_BITS, (16 * bucket_count(df) - 1).bit_length())


def seeded_hash(ids: list[str], seed: int) -> Column:
    return F.xxhash64(*[F.col(c) for c in ids], F.lit(seed))


def hash_rank(df: DataFrame, keys: list[str], ids: list[str], seed: int) -> DataFrame:
    """1-based ``rank`` within ``keys`` in a seeded random order of ``ids``.

    The hash is uniform, so its leading bits are equal-sized buckets.
    """
    hashed = df.withColumn("_hash", seeded_hash(ids, seed)).withColumn(
        "_bucket", F.shiftright("_hash", 64 - hash_bits(df))
    )
    group = [F.col(k) for k in keys] or [F.lit(0)]
    along = Window.partitionBy(*group).orderBy("_bucket")
    sizes = hashed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(
        *keys, "_bucket", (F.sum("_n").over(along) - F.col("_n")).alias("_before")
    )
    inner = Window.partitionBy(*keys, "_bucket").orderBy("_hash", *ids)
    return (
        join_groups(hashed, sizes, [*keys, "_bucket"])
        .withColumn("rank", F.col("_before") + F.row_number().over(inner))
        .drop("_hash", "_bucket", "_before")
    )


def sample_exact(df: DataFrame, ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows; the same seed gives the same rows.

    Only hash buckets that can hold a chosen row are shuffled: counts over the
    buckets (16 per shuffle partition at most, hence the broadcast) tell which.
    """
    hashed = df.withColumn("_hash", seeded_hash(ids, seed)).withColumn(
        "_bucket", F.shiftright("_hash", 64 - hash_bits(df))
    )
    along = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_bucket", (F.sum("_n").over(along) - F.col("_n")).alias("_before"))
    near = hashed.join(F.broadcast(sizes.where(F.col("_before") < n)), "_bucket")
    inner = Window.partitionBy("_bucket").orderBy("_hash", *ids)
    return (
        near.withColumn("_rank", F.col("_before") + F.row_number().over(inner))
        .where(F.col("_rank") <= n)
        .drop("_hash", "_bucket", "_before", "_rank")
    )


def _allocate(sizes: DataFrame, label: str, take: Column, pool: str, out: str) -> DataFrame:
    """Share ``take`` rows among the classes in proportion to ``pool``: floors
    first, then one more for the largest remainders.  ``sizes`` has one row per
    class."""
    everything = Window.partitionBy(F.lit(0))
    quota = F.col(pool) * take / F.sum(pool).over(everything)
    step = sizes.withColumn("_quota", quota).withColumn("_base", F.floor("_quota"))
    by_rest = everything.orderBy((F.col("_quota") - F.col("_base")).desc(), label)
    spare = take - F.sum("_base").over(everything)
    step = step.withColumn("_spare", spare).withColumn("_pos", F.row_number().over(by_rest))
    return step.withColumn(
        out, F.col("_base") + (F.col("_pos") <= F.col("_spare")).cast("long")
    ).drop("_quota", "_base", "_spare", "_pos")


def split_sizes(
    df: DataFrame, label: str, test_size: float = 0.2, val_size: float = 0.1
) -> DataFrame:
    """Rows of each class in test and validation."""
    everything = Window.partitionBy(F.lit(0))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = F.sum("n_class").over(everything)
    sizes = sizes.withColumn("_test", F.ceil(F.lit(test_size) * total))
    sizes = _allocate(sizes, label, F.col("_test"), "n_class", "n_test")
    sizes = sizes.withColumn("_rest", F.col("n_class") - F.col("n_test"))
    val_share = val_size / (1 - test_size)
    rest = F.sum("_rest").over(everything)
    sizes = sizes.withColumn("_val", F.ceil(F.lit(val_share) * rest))
    sizes = _allocate(sizes, label, F.col("_val"), "_rest", "n_val")
    return sizes.select(label, "n_class", "n_test", "n_val")


def stratified_split(
    df: DataFrame,
    label: str,
    ids: list[str],
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` in {train, val, test}; class shares and sizes are exact.

    Pass a slim table (ids and label); wide feature rows join the result later.
    """
    ranked = hash_rank(df, [label], ids, seed)
    # One row per class.
    sizes = F.broadcast(split_sizes(df, label, test_size, val_size))
    split = (
        F.when(F.col("rank") <= F.col("n_test"), "test")
        .when(F.col("rank") <= F.col("n_test") + F.col("n_val"), "val")
        .otherwise("train")
    )
    return (
        join_groups(ranked, sizes, [label])
        .withColumn("split", split)
        .drop("rank", "n_class", "n_test", "n_val")
    )


def stratified_folds(
    df: DataFrame, label: str, ids: list[str], k: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold`` in 0..k-1; per class the fold sizes differ by at most one."""
    ranked = hash_rank(df, [label], ids, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")
