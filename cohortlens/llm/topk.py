"""Exact inner-product search over vectors in descending length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import vectors

#: Vectors (of smallest hash) from which the rotation is taken.  Any rotation gives
#: right bounds; a fitting one prunes more.
ROTATION_ROWS = 4096

#: Rotated dimensions after which a pair's bound is tested.
STEPS = (16, 32, 48)

#: Queries of a block that are bounded together.
TOGETHER = 64


def search(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k highest integer inner products of each query with all other rows.

    Each component x becomes floor(scale * x).  Vectors that are null or hold null
    or non-finite components, and rows without an id, take no part; short and empty
    vectors are padded with zeros; an id that repeats is one query and several
    candidates.  Exact while squared lengths stay below 2^53.

    Rows are dealt out by descending length, ids breaking ties, and each task cuts
    its range into blocks.  A query's first threshold is its k-th best among the
    longest rows.  In a block, rows too short to reach it are never touched
    (Cauchy-Schwarz); for the rest partial products over rotated dimensions plus the
    product of the residual lengths bound the whole, and only pairs whose bound
    reaches the threshold get an exact score.
    """
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    good = df.where(F.col("vec_id").isNotNull() & vectors.usable(F.col("embedding")))
    every = good.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks"))
    dim = vectors.dimension(every)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    lengths = every.withColumn("square", square)

    def stacked(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), dim))
        for i, r in enumerate(rows):
            out[i, : len(r.v)] = r.v
        return out

    sample = stacked(every.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(ROTATION_ROWS).collect())
    rotation = np.linalg.svd(sample.T @ sample)[0] if dim else np.zeros((0, 0))
    longest = lengths.orderBy(F.desc("square"), "vec_id", "v").limit(ROTATION_ROWS).collect()
    seed_ids, seed = np.array([r.vec_id for r in longest], np.int64), stacked(longest)

    def threshold(ids: np.ndarray, matrix: np.ndarray) -> dict:
        scores = matrix @ seed.T
        scores[ids[:, None] == seed_ids] = -np.inf
        full = np.full((len(ids), k), -np.inf)
        full[:, : scores.shape[1]] = -np.sort(-scores, axis=1)[:, :k]
        return {"least": full[:, k - 1].astype("<f8").tobytes()}

    ordered = lengths.repartitionByRange(F.desc("square"), "vec_id").sortWithinPartitions(F.desc("square"), "vec_id")
    rows = vectors.blocks(ordered, dim, vectors.BLOCK_ROWS, "by-length")
    asked = vectors.one_row_per_id(every.where("asks"))
    queries = vectors.blocks(asked, dim, vectors.QUERY_ROWS, "queries", threshold, "least binary")
    steps = [s for s in STEPS if s < dim] + [dim]

    def look(q: dict, r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, data = vectors.row_ids(r), vectors.row_data(r, dim)
        asking, wanted = vectors.row_ids(q), vectors.row_data(q, dim)
        least = np.frombuffer(q["least"], "<f8")
        long, length = np.sqrt((data * data).sum(1)), np.sqrt((wanted * wanted).sum(1))
        turned, asked_turned = data @ rotation, wanted @ rotation
        rests = [np.sqrt((x[:, t:] ** 2).sum(1)) for t in steps for x in (asked_turned, turned)]
        found = []
        for low in range(0, len(asking), TOGETHER):
            chunk = slice(low, low + TOGETHER)
            slack = 1e-9 * (1 + length[chunk] * long[0])
            goal = least[chunk] - slack
            # Rows come in descending length: keep those that some query can need.
            needed = (goal / np.maximum(length[chunk], 1e-300)).min()
            reach = int(np.searchsorted(-long, -needed, "right"))
            sums = asked_turned[chunk, : steps[0]] @ turned[:reach, : steps[0]].T
            one, other = np.nonzero(sums + rests[0][chunk, None] * rests[1][:reach] >= goal[:, None])
            partial = sums[one, other]
            for at in range(1, len(steps)):
                dims = slice(steps[at - 1], steps[at])
                partial = partial + np.einsum("ij,ij->i", asked_turned[chunk, dims][one], turned[other, dims])
                kept = partial + rests[2 * at][chunk][one] * rests[2 * at + 1][other] >= goal[one]
                one, other, partial = one[kept], other[kept], partial[kept]
            asked = asking[chunk]
            apart = asked[one] != ids[other]
            one, other = one[apart], other[apart]
            score = np.einsum("ij,ij->i", wanted[chunk][one], data[other]).astype(np.int64)
            order = np.lexsort((ids[other], -score, one))
            one, other, score = one[order], other[order], score[order]
            top = np.arange(len(one)) - np.searchsorted(one, one) < k
            found.append((asked[one[top]], ids[other[top]], score[top]))
        return tuple(np.concatenate(x) for x in zip(*found))

    return vectors.best(vectors.against(queries, rows, look, "bigint"), k)
