"""Neighbours in an ordered group, exact when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage

# A group up to this size is sorted by one task; larger groups are split.
HOT_GROUP_ROWS = 5_000_000


def neighbours(
    df: DataFrame,
    key: str,
    order: list,
    carry: list[str],
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Add ``seq`` (1-based), ``is_last``, ``prev`` and ``next`` (structs of
    ``carry``) per ``key`` in the given order, which must be total.

    Ordinary groups take one window: one shuffle on ``key``.  Groups above
    ``hot_rows`` are range-partitioned by (key, order), so a group of any size
    spreads over many tasks, and the links across block borders come from a table
    with one row per (key, block).
    """
    order = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    # At most rows/hot_rows keys pass: safe to broadcast.
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = hot.select(F.col(key).alias("_hot"))
    if hot.isEmpty():
        return _within_group(df, key, order, carry)
    is_hot = F.col(key).eqNullSafe(F.col("_hot"))
    usual = df.join(F.broadcast(hot), is_hot, "left_anti")
    large = df.join(F.broadcast(hot), is_hot, "left_semi")
    return _within_group(usual, key, order, carry).unionByName(
        _across_blocks(large, key, order, carry)
    )


def _pack(carry: list[str]):
    return F.struct(*carry)


def _within_group(df: DataFrame, key: str, order: list, carry: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.select(
        "*",
        F.row_number().over(w).cast("long").alias("seq"),
        F.lag(_pack(carry)).over(w).alias("prev"),
        F.lead(_pack(carry)).over(w).alias("next"),
    ).withColumn("is_last", F.col("next").isNull())


def _across_blocks(df: DataFrame, key: str, order: list, carry: list[str]) -> DataFrame:
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds come from a sample, so two runs may differ: fix the block ids
    # in checkpointed data before they are used twice.
    placed = cut_lineage(
        df.repartitionByRange(blocks, F.col(key), *order).withColumn(
            "_block", F.spark_partition_id()
        )
    )
    w = Window.partitionBy(key, "_block").orderBy(*order)
    inside = placed.select(
        "*",
        F.row_number().over(w).cast("long").alias("_pos"),
        F.lag(_pack(carry)).over(w).alias("_prev"),
        F.lead(_pack(carry)).over(w).alias("_next"),
    )
    size = F.count(F.lit(1)).over(Window.partitionBy(key, "_block"))
    edges = (
        inside.withColumn("_size", size)
        .groupBy(F.col(key).alias("_k"), F.col("_block").alias("_b"))
        .agg(
            F.first("_size").alias("_size"),
            F.max(F.when(F.col("_pos") == 1, _pack(carry))).alias("_first"),
            F.max(F.when(F.col("_pos") == F.col("_size"), _pack(carry))).alias("_last"),
        )
    )
    along = Window.partitionBy("_k").orderBy("_b")  # one row per block of the key
    edges = edges.select(
        "_k",
        "_b",
        (F.sum("_size").over(along) - F.col("_size")).alias("_before"),
        F.lag("_last").over(along).alias("_edge_prev"),
        F.lead("_first").over(along).alias("_edge_next"),
    )
    link = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))
    out = inside.join(edges, link)
    return out.select(
        *df.columns,
        (F.col("_pos") + F.col("_before")).alias("seq"),
        F.coalesce("_prev", "_edge_prev").alias("prev"),
        F.coalesce("_next", "_edge_next").alias("next"),
    ).withColumn("is_last", F.col("next").isNull())
