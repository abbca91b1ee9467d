"""Cost-balanced packing of documents into sequences."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts_of
from .tokens import encoder

#: Tokens that are packed together: bounds a task's memory.
BUFFER_TOKENS = 1 << 21

#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 256

PIECE = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
    "`offset` bigint, ids binary"
)


def balanced(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place documents of these lengths: (document, start, length, sequence, offset).

    Whole sequences are cut off first.  The rest go in descending length, each to
    the sequence of lowest cost that still has room; there are as many sequences as
    their tokens need.  A piece that no sequence has room for is cut to fill the one
    with most room, and what is over goes on as a shorter piece, so less than one
    sequence of padding is left in all.  Ties go to the earlier document and sequence.
    """
    placed, rest, sequence = [], [], 0
    for doc, length in enumerate(lengths):
        full = length // capacity
        for k in range(full):
            placed.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
        if length > full * capacity:
            rest.append((-(length - full * capacity), doc, full * capacity))
    total = -sum(x[0] for x in rest)
    count = -(-total // capacity)
    heapq.heapify(rest)
    used = [0] * count
    # By room left: a heap of (cost, sequence); `best` has each heap's lowest cost.
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    best = np.full(capacity + 1, np.inf)
    by_room[capacity] = [(0.0, sequence + k) for k in range(count)]
    if count:
        best[capacity] = 0.0
    while rest:
        negative, doc, start = heapq.heappop(rest)
        length = -negative
        room = length + int(best[length:].argmin())
        if best[room] == np.inf:
            room = int(np.flatnonzero(best < np.inf)[-1])
            heapq.heappush(rest, (-(length - room), doc, start + room))
            length = room
        cost, target = heapq.heappop(by_room[room])
        best[room] = by_room[room][0][0] if by_room[room] else np.inf
        slot = target - sequence
        placed.append((doc, start, length, target, used[slot]))
        used[slot] += length
        left = capacity - used[slot]
        if left:
            heapq.heappush(by_room[left], (cost + LINEAR * length + QUADRATIC * length * length, target))
            best[left] = by_room[left][0][0]
    return placed


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, words: int | None = None
) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, start, length, doc_tokens, sequence_id, offset
    and its ids (little-endian unsigned 32-bit).  A document is its ids and
    ``end_id``, so a null or empty text has one token.  Repeated rows are packed
    apart; a null doc_id stays null; extra columns are ignored.

    A task packs its own rows in buffers of ``BUFFER_TOKENS``: no shuffle, memory
    bounded by the buffer and one document, and padding of less than one sequence
    per buffer.  sequence_id holds the task in its upper bits.  A worker remembers the
    ids of ``words`` words at most (None: the encoder's own limit).
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        names: list[int | None] = []
        ids: list[bytes] = []

        def packed() -> pa.RecordBatch:
            placed = balanced([len(x) // 4 for x in ids], capacity)
            doc, start, length, sequence, offset = zip(*placed)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([names[d] for d in doc], pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([len(ids[d]) // 4 for d in doc], pa.int64()),
                    pa.array([first + s for s in sequence], pa.int64()),
                    pa.array(offset, pa.int64()),
                    pa.array([ids[d][4 * a : 4 * (a + n)] for d, a, n in zip(doc, start, length)], pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        held = 0
        for batch in batches:
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer, words).encode(texts_of(batch))):
                names.append(doc)
                ids.append(found + end)
                held += len(ids[-1]) // 4
                if held >= BUFFER_TOKENS:
                    out = packed()
                    yield out
                    first += max(out.column("sequence_id").to_pylist()) - first + 1
                    names, ids, held = [], [], 0
        if ids:
            yield packed()

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)
