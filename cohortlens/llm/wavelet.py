"""Token ids as one wavelet matrix per shard (Claude, Navarro and Ordonez 2015)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .common import sized_broadcast, small_batches, texts_of
from .tokens import encoder

#: Tokens after which a shard is closed, at the end of a document.
SHARD_TOKENS = 1 << 19

#: Bits between two entries of a plane's rank directory.
BLOCK_BITS = 512

SHARD = (
    "part int, seq int, n_tokens bigint, zeros array<bigint>, planes array<binary>, "
    "ranks array<binary>, doc_ids array<bigint>, lengths array<bigint>"
)


class WaveletMatrix:
    """Bit planes from the highest bit down; each plane is followed by a stable
    partition of the sequence into zeros and ones.

    ``access``, ``rank`` (occurrences before a position), ``count`` (in a range)
    and ``select`` (position of the k-th occurrence) touch one word and one rank
    block per plane; ``decode`` gives the whole sequence.
    """

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (ids & (1 << level)).astype(bool)
            packed = np.zeros(-(-len(ids) // BLOCK_BITS) * (BLOCK_BITS // 8), np.uint8)
            packed[: (len(ids) + 7) // 8] = np.packbits(bit)
            ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(1)
            before = np.zeros(len(ones) + 1, "<u4")
            np.cumsum(ones, out=before[1:])
            planes.append(packed[: (len(ids) + 7) // 8].tobytes())
            ranks.append(before.tobytes())
            zeros.append(int(len(ids) - before[-1]))
            ids = np.concatenate([ids[~bit], ids[bit]])
        return cls(len(ids), zeros, planes, ranks)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK_BITS
        start = block * BLOCK_BITS
        bits = np.unpackbits(self.planes[level][start >> 3 : (i + 7) >> 3])
        return int(self.ranks[level][block]) + int(bits[: i - start].sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _interval(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the occurrences within [low, high) lie below the last plane."""
        bits = len(self.zeros)
        if token < 0 or token >> bits:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, low), self._ones(level, high)
            bit = token >> (bits - 1 - level) & 1
            low, high = (zeros + a, zeros + b) if bit else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        low, high = self._interval(token, low, self.n if high is None else high)
        return high - low

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of one kind in a plane."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        start = block * BLOCK_BITS
        bits = np.unpackbits(self.planes[level][start >> 3 : (start + BLOCK_BITS) >> 3])
        bits = bits[: self.n - start]
        return start + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        low, high = self._interval(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids: undo the partitions from the lowest plane up."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for up, level in enumerate(range(len(self.zeros) - 1, -1, -1)):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            above = np.empty(self.n, kind)
            above[~bit] = values[: self.zeros[level]]
            above[bit] = values[self.zeros[level] :] | kind(1 << up)
            values = above
        return values.astype("<u4")


def _shards(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        docs: list[int | None] = []

        def shard() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), "<u4"))
            row = {
                "part": part, "seq": seq, "n_tokens": matrix.n, "zeros": matrix.zeros,
                "planes": [p.tobytes() for p in matrix.planes],
                "ranks": [r.tobytes() for r in matrix.ranks],
                "doc_ids": docs, "lengths": [len(x) // 4 for x in ids],
            }
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        held = 0
        for batch in batches:
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder(path).encode(texts_of(batch))):
                ids.append(found + end)
                docs.append(doc)
                held += len(ids[-1]) // 4
                if held >= SHARD_TOKENS:
                    yield shard()
                    ids, docs, held, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    return run


_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()),
    ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
])


def write_shards(docs: DataFrame, tokenizer: str, target: str, end_id: int = 0) -> None:
    """Write the ids of ``docs`` (doc_id, text) as wavelet matrices under ``target``.

    Documents go in ascending doc_id, rows of one id in the order of their text's
    hash, a null id first; a null text is empty; extra columns are ignored.  Texts
    are dealt out by ranges of doc_id, each task reads its range in order and
    closes a shard every ``SHARD_TOKENS``, so memory does not depend on how large a
    range is.  Every shard is one compressed Parquet file of one row.
    """
    small_batches(docs.sparkSession)
    tie = F.xxhash64("text").alias("tie")
    ranged = (
        docs.select("doc_id", "text", tie)
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    (
        ranged.mapInArrow(_shards(tokenizer, end_id), SHARD)
        .write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(target)
    )


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            matrix = WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"])
            raw = matrix.decode().tobytes()
            ends = np.cumsum(row["lengths"])
            starts = ends - np.array(row["lengths"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["base"]),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(starts, ends)], pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )


def read_shards(source: str, spark: SparkSession) -> DataFrame:
    """Read shards back: doc_id, start (ids of all documents before it), n_tokens,
    ids (little-endian unsigned 32-bit)."""
    shards = spark.read.schema(SHARD).parquet(source)
    # Starts: sums of tasks, then of the shards within a task.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("own"))
        .join(parts, "part")
        .select("part", "seq", (F.col("own") + F.col("before")).alias("base"))
    )
    return shards.join(sized_broadcast(bases), ["part", "seq"]).mapInArrow(
        _spans, "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    )


def token_directory(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read them back."""
    target = scratch_path(docs.sparkSession, "wavelet")
    write_shards(docs, tokenizer, target, end_id)
    return read_shards(target, docs.sparkSession)
