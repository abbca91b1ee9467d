"""Helpers the operators share: batches, keys, sized broadcasts, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize

#: Rows of an Arrow batch.  A batch holds whole texts, so few rows keep a worker's
#: memory bounded by the longest texts.
BATCH_ROWS = 64

#: Rows that a broadcast may hold; larger sides are joined by a shuffle.
BROADCAST_ROWS = 500_000

#: White space of the word and line rules.
SPACE = " \t\n\x0b\f\r"


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batch size to ``BATCH_ROWS``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def without(docs: DataFrame, made: tuple[str, ...]) -> DataFrame:
    """``docs`` without columns that an operator makes itself: its own ones win."""
    return docs.select(*[c for c in docs.columns if c.lower() not in made])


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return ["" if text is None else text for text in batch.column(name).to_pylist()]


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when ``df`` (already written) has few rows; beyond
    that the hint is left out and the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def two_hashes(column: Column) -> tuple[Column, Column]:
    """A 128-bit fingerprint of a string as two longs."""
    return F.xxhash64(column), F.xxhash64(F.lit(11), column)


class Hashes(dict):
    """64-bit hashes of byte words, remembered; emptied by ``trim`` when large."""

    LIMIT = 400_000
    made: list[Hashes] = []  # by this worker's modules, one each

    def __init__(self) -> None:
        super().__init__()
        self.made.append(self)

    @classmethod
    def forget(cls) -> None:
        for hashes in cls.made:
            hashes.clear()

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped_rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Runs of equal ``key`` in a partition that is sorted by it."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        start = 0
        for end in range(1, len(keys) + 1):
            if end < len(keys) and keys[end] == keys[start]:
                continue
            if held and keys[start] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = keys[start]
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield current, pa.Table.from_batches(held)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected edges (a, b), as rows (id, component).

    ``component`` is the smallest id reachable.  Rounds of "small star, large star"
    (Kiveris et al. 2014): every round links the neighbours of a vertex to its
    smallest neighbour, so long chains fold up in logarithmically many rounds, and
    a vertex with many neighbours is only ever aggregated by its minimum.  Each
    round is written to the shared folder; only a count reaches the driver.
    """
    both = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    )
    current = materialize(both.distinct(), name)
    while True:
        # Large star: of all neighbours, those above the vertex go to the minimum.
        ways = current.select(F.col("hi").alias("v"), F.col("lo").alias("n")).unionAll(
            current.select(F.col("lo").alias("v"), F.col("hi").alias("n"))
        )
        least = ways.groupBy("v").agg(F.least(F.min("n"), F.col("v")).alias("m"))
        large = (
            current.join(least, current["lo"] == least["v"])
            .select(F.col("hi"), F.col("m").alias("lo"))
            .where("hi <> lo")
            .unionAll(least.where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")))
            .distinct()
        )
        large = materialize(large, name)
        # Small star: the smaller neighbours of a vertex go to their minimum.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"),
                    F.col("m").alias("lo"))
            .distinct()
        )
        after = materialize(small, name)
        # Done when every vertex has one parent and no parent has a parent.
        parents = after.groupBy("hi").agg(F.count(F.lit(1)).alias("n"))
        chained = after.join(after.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi")
        if parents.where("n > 1").isEmpty() and chained.isEmpty():
            return after.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(
                after.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
            )
        current = after
