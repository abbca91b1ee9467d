"""Rendezvous hashing of records over weighted shards (Thaler and Ravishankar 1998,
weights after Schindelhauer and Schomaker 2005).

A record goes to the shard whose draw for it is best: with ``u`` uniform in (0, 1)
from a hash of the record's key and the shard's number, the draw is -weight / ln u.
The draws of the old shards do not change when a shard is added, so a record either
stays or moves to the new shard, and a shard gets records in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .positions import coded, in_order, numbered

#: Hexadecimal digits of the hash that make a draw: 52 bits, exact in a double.
_DIGITS = 13


def key_text(*columns: str) -> Column:
    """A stable text of the key columns; null is a value of its own."""
    return F.concat(*[coded(F.col(c)) for c in columns])


def _draws(key: Column, weights: Sequence[float]) -> Column:
    """(draw, -shard) for every shard, in order of shards."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    table = F.array(*[F.lit(float(w)) for w in weights])

    def draw(weight: Column, shard: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit("/"), shard.cast("string"))), 1, _DIGITS)
        uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
        return F.struct((-weight / F.log(uniform)).alias("draw"), (-shard).alias("shard"))

    return F.transform(table, draw)


def shard_columns(
    key: Column, weights: Sequence[float], added: Sequence[float] = ()
) -> tuple[Column, Column]:
    """The record's shard among ``weights`` and, with ``added`` shards behind them,
    its shard among all.  Equal draws go to the smaller number.  Expressions only."""
    draws = _draws(key, [*weights, *added])
    both = F.transform(
        F.array(draws),
        lambda d: F.struct(
            (-F.array_max(F.slice(d, 1, len(weights)))["shard"]).alias("shard"),
            (-F.array_max(d)["shard"]).alias("grown"),
        ),
    )[0]
    return both["shard"], both["grown"]


def assign_shards(
    rows: DataFrame,
    key: list[str],
    weights: Sequence[float],
    added: Sequence[float] = (),
) -> DataFrame:
    """``rows`` with shard, grown_shard (with the ``added`` shards) and slot, the
    gapless position in the shard from 0 by key.

    Any column may be null; null is a key of its own, so rows without a key share a
    shard.  Repeated rows share it too and get neighbouring slots, in no fixed order.
    An empty table stays empty.  Columns of ``rows`` named shard, grown_shard or slot
    are replaced; any other name may occur.

    The shard is an expression over the key: no row moves for it.  The slots are
    numbered in ranges of (shard, key), so neither a large shard nor a key that a third
    of the rows have meets in one task; only rows handed in are shuffled, so hand in
    narrow ones and join, where texts are large.
    """
    made = ("shard", "grown_shard", "slot")
    shard, grown = shard_columns(key_text(*key), weights, added)
    packed = rows.select(
        shard.alias("_shard"),
        grown.alias("_grown"),
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)],
        F.struct(*rows.columns).alias("_row"),
    )
    placed = in_order(packed, ["_shard", *[f"_key{i}" for i in range(len(key))]], "shards")
    slots = numbered(placed, "_shard", "_slot", "_size")
    return slots.select(
        *[F.col("_row")[c].alias(c) for c in rows.columns if c.lower() not in made],
        F.col("_shard").cast("int").alias("shard"),
        F.col("_grown").cast("int").alias("grown_shard"),
        F.col("_slot").alias("slot"),
    )


def write_shards(
    rows: DataFrame, path: str, key: list[str], weights: Sequence[float], file_rows: int = 1_000_000
) -> None:
    """Write ``rows`` as one folder ``shard=N`` per shard.  A shard is cut into files
    of about ``file_rows`` rows by a hash of the row, so a large one has many writers.
    A column named shard is replaced."""
    shard, _ = shard_columns(key_text(*key), weights)
    kept = [c for c in rows.columns if c.lower() != "shard"]
    out = rows.select(*kept, shard.cast("int").alias("shard"))
    parts = max(1, -(-rows.count() // (file_rows * len(weights))))
    cut = F.pmod(F.monotonically_increasing_id(), F.lit(parts))
    out.withColumn("_cut", cut).repartition("shard", "_cut").drop("_cut").write.partitionBy("shard").parquet(path)
