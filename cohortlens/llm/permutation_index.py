"""Approximate nearest neighbours by permutations of pivots (Amato et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from . import vectors

#: Pivots (vectors of smallest hash: a bounded sample) and how many of the nearest
#: represent a vector.
PIVOTS, NEAREST = 512, 128

#: Share of a block that is compared by its vectors after ranking by footrule, and
#: the least number of candidates of a block.
SHARE, LEAST = 0.12, 512


def nearest_pivots(matrix: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The m nearest pivots of each row, nearest first, ties to the earlier pivot."""
    return np.argsort(-(matrix @ pivots.T), axis=1, kind="stable")[:, :m]


def inverted(order: np.ndarray, pivots: int) -> dict:
    """Posting lists of a block: for each pivot the rows that have it and its rank."""
    n, m = order.shape
    flat = order.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    return {
        "starts": np.concatenate([[0], np.bincount(flat, minlength=pivots).cumsum()]).astype("<i4").tobytes(),
        "posted": (by_pivot // m).astype("<u2").tobytes(),
        "ranks": (by_pivot % m).astype("u1").tobytes(),
    }


def opened(row: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """A block's posting lists: for each pivot its rows and the rank they give it, in
    the types that numpy indexes with."""
    starts = np.frombuffer(row["starts"], "<i4")
    posted = np.frombuffer(row["posted"], "<u2").astype(np.intp)
    ranks = np.frombuffer(row["ranks"], "u1").astype(np.int16)
    return [(posted[a:b], ranks[a:b]) for a, b in zip(starts[:-1], starts[1:])]


def candidates(order: np.ndarray, postings: list, lengths: np.ndarray, m: int, take: int) -> np.ndarray:
    """Rows of a block with the least footrule distance to a query's permutation.

    A pivot that a row does not have counts as displaced by m; the distance is then
    m * m less what the shared pivots save.  Permutations know directions only, and an
    inner product grows with the length too: what is saved counts by the row's length
    (among rows of one length the order is that of the distance).  Ties go to the
    earlier row; the rows come in no order.
    """
    n = len(lengths)
    if take >= n:
        return np.arange(n)
    saved = np.zeros(n, np.int16)
    # What a row saves at each rank apart from the query's.
    worth = (m - np.abs(np.arange(-m, m))).astype(np.int16)
    for rank, pivot in enumerate(order):
        rows, ranks = postings[pivot]
        saved[rows] += worth[m - rank :].take(ranks)
    key = saved * lengths
    least = np.partition(key, n - take)[n - take]
    above, equal = np.flatnonzero(key > least), np.flatnonzero(key == least)
    return np.concatenate([above, equal[: take - len(above)]])


def distinct_vectors(every: DataFrame, k: int) -> DataFrame:
    """(v, ids): each vector once with its k + 1 smallest ids, ascending, an id as
    often as it repeats but k times at most.

    Rows of a vector are counted by id and cut to k + 1 ids within each task, before
    they meet, so one vector that many rows share does not load a task.
    """
    counted = every.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    by_id = Window.partitionBy("v").orderBy("vec_id")
    first = counted.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1)
    ids = F.sort_array(F.flatten(F.collect_list(F.array_repeat("vec_id", F.least("n", F.lit(k)).cast("int")))))
    return materialize(first.groupBy("v").agg(ids.alias("ids")), "distinct-vectors")


def indexed_blocks(distinct: DataFrame, dim: int, pivots: np.ndarray, m: int) -> DataFrame:
    """Write (v, ids) as rows of about ``BLOCK_ROWS`` vectors with their posting lists;
    ``members`` says where each vector's ids start."""
    distinct.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    least = vectors.BLOCK_ROWS

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = [batch.column("ids") for batch in held]
        ends = np.concatenate([np.array([0])] + [np.diff(x.offsets.to_numpy()) for x in ids]).cumsum()
        matrix = np.concatenate([vectors.as_arrow_rows(batch, "v", dim) for batch in held])
        return pa.RecordBatch.from_pylist([{
            "ids": np.concatenate([x.flatten().to_numpy() for x in ids]).astype("<i8").tobytes(),
            "members": ends.astype("<i4").tobytes(),
            "data": np.ascontiguousarray(matrix, "<f8").tobytes(),
            **inverted(nearest_pivots(matrix, pivots, m), len(pivots)),
        }])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= least:
                yield block(held)
                held = []
        if held:
            yield block(held)

    schema = "ids binary, members binary, data binary, starts binary, posted binary, ranks binary"
    return materialize(distinct.mapInArrow(run, schema), "index")


def search(
    df: DataFrame, is_query: Column, k: int = 20, pivots: int = PIVOTS, nearest: int = NEAREST,
    share: float = SHARE,
) -> DataFrame:
    """The k nearest rows found for each query, by inner product in double precision.

    ``df`` has vec_id and embedding.  Vectors that are null, zero or hold null or
    non-finite components, and rows without an id, take no part; short vectors are
    padded with zeros; an id that repeats is one query and several candidates; a
    query's own id is no candidate.  Fewer than k candidates give fewer rows.

    Every vector is indexed, equal ones once: they share their k + 1 smallest ids (an
    id as often as it repeats, k times at most), more than a list of k can use.  So
    copies do not take the places of other candidates.  The index is cut into blocks
    of distinct vectors, each with its own posting lists, so a pivot that a third of
    all vectors share costs each block at most its own rows.

    ``share`` of a block is reranked, and ``LEAST`` vectors at least: a block of no
    more than that is compared as a whole.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = df.where(F.col("vec_id").isNotNull() & vectors.usable(F.col("embedding"))).where(
        F.exists("embedding", lambda x: x != 0)
    )
    every = good.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks"))
    dim = vectors.dimension(every)
    zeros = F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))
    every = every.withColumn("v", F.concat("v", zeros))
    distinct = distinct_vectors(every, k)
    sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    chosen = np.array([r.v for r in sample]).reshape(len(sample), dim)
    m = min(nearest, len(chosen))

    def permutation(_ids: np.ndarray, matrix: np.ndarray) -> dict:
        return {"order": nearest_pivots(matrix, chosen, m).astype("<u2").tobytes()}

    rows = indexed_blocks(distinct, dim, chosen, m)
    asked = vectors.one_row_per_id(every.where("asks"))
    queries = vectors.blocks(asked, dim, vectors.QUERY_ROWS, "queries", permutation, "order binary")

    def look(q: dict, r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        members, starts = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["members"], "<i4")
        data = np.frombuffer(r["data"], "<f8").reshape(len(starts) - 1, dim)
        asking, wanted = vectors.row_ids(q), vectors.row_data(q, dim)
        postings = opened(r)
        orders = np.frombuffer(q["order"], "<u2").reshape(len(asking), m)
        take = max(LEAST, int(np.ceil(share * len(data))))
        part = data / np.abs(data).max()  # so that no square is beyond a double
        lengths = np.sqrt((part * part).sum(1))
        found = []
        for own, vector, order in zip(asking, wanted, orders):
            near = candidates(order, postings, lengths, m, take)
            # The smallest id other than the query's own; vectors without one go.
            first, last = members[starts[near]], members[starts[near + 1] - 1]
            near, first = near[(first != own) | (last != own)], first[(first != own) | (last != own)]
            for at in np.flatnonzero(first == own):
                mine = members[starts[near[at]] : starts[near[at] + 1]]
                first[at] = mine[mine != own][0]
            # A sum along each row, so equal vectors get equal scores.
            score = (data[near] * vector).sum(1)
            top = np.lexsort((first, -score))[:k]
            ids = [members[starts[i] : starts[i + 1]] for i in near[top]]
            score = np.repeat(score[top], [len(x) for x in ids])
            ids = np.concatenate([np.empty(0, np.int64), *ids])
            ids, score = ids[ids != own], score[ids != own]
            top = np.lexsort((ids, -score))[:k]
            found.append((np.full(len(top), own), ids[top], score[top]))
        return tuple(np.concatenate(x) for x in zip(*found))

    return vectors.best(vectors.against(queries, rows, look, "double"), k)
