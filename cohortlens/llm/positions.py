"""Gapless positions of rows in an order, without one task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import sized_broadcast

#: Rows of one partition that ``monotonically_increasing_id`` can number.
_SHIFT = 33

AT = "_at"


def coded(column: Column) -> Column:
    """A value as text that no other value gives: ``-`` for null, else its UTF-8
    byte count, a colon and the value.  Codes can be joined without a separator."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def in_order(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Write ``rows`` in ranges of ``order`` (nulls first) with ``_at``, a number that
    ascends in that order and has no gaps inside a range.

    The last sort key is the row's place in the input, so rows that are equal in
    ``order``, be they a third of the table, are dealt to many ranges.  The rows are
    written first, because finding the ranges reads them once more.
    """
    keys = [*order, "_salt"]
    salted = materialize(rows, name).withColumn("_salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    return materialize(ranged.withColumn(AT, F.monotonically_increasing_id()), name)


def range_of(at: Column) -> Column:
    return F.shiftright(at, _SHIFT)


def numbered(placed: DataFrame, group: str, out: str, size: str) -> DataFrame:
    """``placed`` (from ``in_order``, with ``group`` first in the order and not null)
    plus the position in the group from 0 and the group's number of rows.

    A group's rows lie side by side in ranges; one count per range and group, summed
    up over the ranges before, is all that is exchanged.  These counts are as many as
    ranges and groups together; they are broadcast while few.
    """
    runs = materialize(
        placed.groupBy(F.col(group).alias("_group"), range_of(F.col(AT)).alias("_range")).agg(
            F.count(F.lit(1)).alias("_n"), F.min(AT).alias("_first")
        ),
        "runs",
    )
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "_group",
        "_range",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias(size),
    )
    starts = sized_broadcast(materialize(starts, "starts"))
    same = (F.col(group) == F.col("_group")) & (range_of(F.col(AT)) == F.col("_range"))
    return (
        placed.join(starts, same)
        .withColumn(out, F.col(AT) + F.col("_shift"))
        .drop("_group", "_range", "_shift")
    )
