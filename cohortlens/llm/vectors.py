"""Vectors in blocks of rows, and query blocks against row blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import sized_broadcast

#: Rows of a block of vectors and of a block of queries.
BLOCK_ROWS, QUERY_ROWS = 8192, 1024

#: Query blocks that may be broadcast; each has at most QUERY_ROWS vectors.
BROADCAST_BLOCKS = 16

HIT = "query_id bigint, vec_id bigint, score {kind}"


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components."""
    big = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)
    )


def as_arrow_rows(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """The vectors of a batch as a matrix; short ones are padded with zeros."""
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(flat) == dim * len(lengths):
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def dimension(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first().d


def blocks(df: DataFrame, dim: int, rows: int, name: str, extra: Callable | None = None, fields: str = "") -> DataFrame:
    """Write (vec_id, v) as rows of (ids, data) of up to ``rows`` vectors, in the
    order in which a partition holds them.  ``extra`` adds columns (``fields``)
    made from a block's ids and matrix.  Blocks are counted out per partition, so a
    task holds one block at a time."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    schema = "ids binary, data binary" + (", " + fields if fields else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def block(i: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            row = {"ids": i.astype("<i8").tobytes(), "data": np.ascontiguousarray(m, "<f8").tobytes()}
            if extra:
                row |= extra(i, m)
            return pa.RecordBatch.from_pylist([row])

        held = 0
        for batch in batches:
            ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False))
            parts.append(as_arrow_rows(batch, "v", dim))
            held += len(ids[-1])
            if held >= rows:
                i, m = np.concatenate(ids), np.concatenate(parts)
                while len(i) >= rows:
                    yield block(i[:rows], m[:rows])
                    i, m = i[rows:], m[rows:]
                ids, parts, held = [i], [m], len(i)
        if held:
            yield block(np.concatenate(ids), np.concatenate(parts))

    return materialize(df.select("vec_id", "v").mapInArrow(run, schema), name)


def against(queries: DataFrame, rows: DataFrame, search: Callable, kind: str) -> DataFrame:
    """Hits of every query block with every row block, as rows (query_id, vec_id, score).

    ``search(query row, block row)`` gives three arrays.  While the query blocks are
    few (a checked count) they are broadcast; beyond that a copy of each row block
    is sent to each query block, cut over tasks by a second key.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    q = queries.select(F.struct(*queries.columns).alias("q"))
    r = rows.select(F.struct(*rows.columns).alias("r"))
    count = queries.count()
    if count <= BROADCAST_BLOCKS:
        paired = r.withColumn("k", F.lit(0)).join(F.broadcast(q.withColumn("k", F.lit(0))), "k")
    else:
        numbered = materialize(q.withColumn("at", F.monotonically_increasing_id()), "query-blocks")
        order = numbered.select("at", (F.row_number().over(Window.orderBy("at")) - 1).alias("k"))
        salts = 16
        numbered = numbered.join(sized_broadcast(order), "at").withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        )
        copies = r.withColumn("salt", F.pmod(F.xxhash64("r.ids"), F.lit(salts)).cast("int")).withColumn(
            "k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        )
        paired = copies.join(numbered.drop("at"), ["k", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                query_id, vec_id, score = search(pair["q"], pair["r"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score)],
                    names=["query_id", "vec_id", "score"],
                )

    return paired.select("q", "r").mapInArrow(run, HIT.format(kind=kind))


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def row_ids(row: dict) -> np.ndarray:
    return np.frombuffer(row["ids"], "<i8")


def row_data(row: dict, dim: int) -> np.ndarray:
    return np.frombuffer(row["data"], "<f8").reshape(len(row["ids"]) // 8, dim)


def one_row_per_id(df: DataFrame) -> DataFrame:
    """Queries: of rows that repeat an id, the one with the largest vector."""
    return df.groupBy("vec_id").agg(F.max("v").alias("v"))
