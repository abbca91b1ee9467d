"""Windows that occur more than once: the exchange behind the substring operators.

A *text* here is one distinct text, identified by two 64-bit hashes (t, u); copies
share it.  Work goes in three steps.

1. Every window has an anchor that depends on the window's content alone, so equal
   windows have equal anchors.  Anchors are few per text; those that occur once
   are dropped by an aggregate that combines within tasks.
2. Texts that hold shared anchors are written once, dealt out in batches by hash.
3. Per batch the fingerprints of all windows with a shared anchor are sent, without
   repeats, to buckets by a second hash; a bucket sorts what all batches sent and
   compares neighbours; each batch gets one bit per fingerprint back.

A bucket holds a bounded share of the fingerprints and at most one of each batch,
so a passage that a third of all texts repeat is no hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import mix, sized_broadcast, small_batches, texts_of, two_hashes

#: Bytes of text in a batch and fingerprints in a bucket, about.
BATCH_BYTES, BUCKET_WINDOWS = 1 << 20, 1 << 20

ANCHORS = "key bigint, t bigint, u bigint, low int, high int, twice boolean"
SENT = "bucket int, batch int, prints binary, ranks binary"
ANSWERS = "batch int, bucket int, mask binary"
SPANS = "t bigint, u bigint, starts array<int>, ends array<int>"


@dataclass(frozen=True)
class Rule:
    """How a text is cut in symbols and windows.

    ``anchors(texts)`` gives four arrays: anchor keys, the text that each is in, and
    the first and last window start that it stands for.  ``windows(texts)`` gives,
    for each text, the fingerprint of the window at every start.  ``length`` is the
    symbols of a window.  With ``ordered`` a window counts as repeated when a text
    of smaller rank has it; otherwise when it occurs anywhere else, the same text
    included.
    """

    length: int
    ordered: bool
    anchors: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    windows: Callable[[list[str]], list[np.ndarray]]


def _anchor_rows(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _pieces(whole)):
            key, owner, low, high = rule.anchors(texts_of(batch))
            order = np.lexsort((key, owner))
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
            twice = np.zeros(len(key), bool)
            twice[order] = same[1:] | same[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)),
                    pa.array(batch.column("t").to_numpy()[owner]),
                    pa.array(batch.column("u").to_numpy()[owner]),
                    pa.array(low.astype(np.int32)),
                    pa.array(high.astype(np.int32)),
                    pa.array(twice),
                ],
                names=["key", "t", "u", "low", "high", "twice"],
            )

    return run


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of text; a longer text is a slice of its own."""
    start = held = 0
    for i, text in enumerate(batch.column("text")):
        size = text.as_buffer().size if text.is_valid else 0
        if i > start and held + size > BATCH_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def _marked(size: int, low: list[int], high: list[int]) -> np.ndarray:
    """Which of ``size`` starts lie in one of the ranges."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, np.asarray(low, np.int64), 1)
    np.add.at(steps, np.asarray(high, np.int64) + 1, -1)
    return steps[:size].cumsum() > 0


class _Batch:
    """The candidate windows of one batch, in an order that only its rows decide."""

    def __init__(self, rule: Rule, table: pa.Table, buckets: int) -> None:
        rows = sorted(table.to_pylist(), key=lambda r: (r["rank"], r["t"], r["u"]))
        self.rows = rows
        prints, where, which = [], [], []
        for i, (row, own) in enumerate(zip(rows, rule.windows([r["text"] for r in rows]))):
            at = np.flatnonzero(_marked(len(own), row["low"], row["high"]))
            prints.append(own[at])
            where.append(at.astype(np.int64))
            which.append(np.full(len(at), i, np.int64))
        self.prints, self.where, self.which = map(np.concatenate, (prints, where, which))
        # First occurrence of each print; rows are in ascending rank.
        self.distinct, self.first, self.place, count = np.unique(
            self.prints, return_index=True, return_inverse=True, return_counts=True
        )
        self.more = count > 1
        self.ranks = np.array([r["rank"] for r in rows], np.int64)
        self.bucket = (mix(self.distinct ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(self.bucket, kind="stable")
        self.starts = np.searchsorted(self.bucket[self.order], np.arange(buckets + 1))


def _send(rule: Rule, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        batch = _Batch(rule, table, buckets)
        out: dict[str, list] = {"bucket": [], "batch": [], "prints": [], "ranks": []}
        side = batch.ranks[batch.which[batch.first]] if rule.ordered else batch.more.astype(np.int8)
        for b in np.flatnonzero(np.diff(batch.starts)):
            part = batch.order[batch.starts[b] : batch.starts[b + 1]]
            out["bucket"].append(int(b))
            out["batch"].append(key[0].as_py())
            out["prints"].append(batch.distinct[part].tobytes())
            out["ranks"].append(side[part].tobytes())
        return pa.table(
            [pa.array(out["bucket"], pa.int32()), pa.array(out["batch"], pa.int32()),
             pa.array(out["prints"], pa.binary()), pa.array(out["ranks"], pa.binary())],
            names=list(out),
        )

    return run


def _compare(rule: Rule):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        batches, sent = table.column("batch").to_pylist(), table.column("prints").to_pylist()
        prints = np.frombuffer(b"".join(sent), np.uint64)
        side = np.frombuffer(b"".join(table.column("ranks").to_pylist()), np.int64 if rule.ordered else np.int8)
        order = np.argsort(prints, kind="stable")
        ranked = prints[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = new.cumsum() - 1
        firsts = np.flatnonzero(new)
        hit = np.empty(len(prints), bool)
        if rule.ordered:
            hit[order] = side[order] > np.minimum.reduceat(side[order], firsts)[group]
        else:
            count = np.diff(np.append(firsts, len(ranked)))
            hit[order] = ((count > 1) | (np.maximum.reduceat(side[order], firsts) > 0))[group]
        ends = np.cumsum([len(s) // 8 for s in sent])
        masks = [np.packbits(m).tobytes() for m in np.split(hit, ends[:-1])]
        return pa.table(
            [pa.array(batches, pa.int32()), pa.array([key[0].as_py()] * len(batches), pa.int32()), pa.array(masks, pa.binary())],
            names=["batch", "bucket", "mask"],
        )

    return run


def _receive(rule: Rule, buckets: int):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = _Batch(rule, table, buckets)
        hit = np.zeros(len(batch.distinct), bool)
        for row in answers.to_pylist():
            part = batch.order[batch.starts[row["bucket"]] : batch.starts[row["bucket"] + 1]]
            hit[part] = np.unpackbits(np.frombuffer(row["mask"], np.uint8), count=len(part)).astype(bool)
        gone = hit[batch.place]
        if rule.ordered and len(gone):
            # Also those whose first holder in this batch has a smaller rank.
            gone |= batch.ranks[batch.which] > batch.ranks[batch.which[batch.first]][batch.place]
        out: dict[str, list] = {"t": [], "u": [], "starts": [], "ends": []}
        bounds = np.searchsorted(batch.which, np.arange(len(batch.rows) + 1))
        for i, row in enumerate(batch.rows):
            part = slice(bounds[i], bounds[i + 1])
            at = batch.where[part][gone[part]]
            if not len(at):
                continue
            cut = np.flatnonzero(np.diff(at) > rule.length) + 1
            out["t"].append(row["t"])
            out["u"].append(row["u"])
            out["starts"].append(at[np.concatenate([[0], cut])].tolist())
            out["ends"].append((at[np.concatenate([cut - 1, [len(at) - 1]])] + rule.length).tolist())
        return pa.table(
            [pa.array(out["t"], pa.int64()), pa.array(out["u"], pa.int64()),
             pa.array(out["starts"], pa.list_(pa.int32())), pa.array(out["ends"], pa.list_(pa.int32()))],
            names=list(out),
        )

    return run


def with_identity(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), t and u (hashes of the text, null as empty) and
    rank (the doc_id, null below all)."""
    t, u = two_hashes(F.coalesce("text", F.lit("")))
    rank = F.coalesce("doc_id", F.lit(-(1 << 63)))
    return docs.select(F.struct(*docs.columns).alias("row"), t.alias("t"), u.alias("u"), rank.alias("rank"))


def copies(docs: DataFrame) -> DataFrame:
    """t, u, least (smallest rank), of texts that several rows have."""
    return materialize(
        with_identity(docs.select("doc_id", "text")).groupBy("t", "u")
        .agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "copies",
    )


def finish(docs: DataFrame, spans: DataFrame, done: Callable, schema) -> DataFrame:
    """Each row of ``docs`` with starts and ends (null without repeats) and least
    (null without copies), given to ``done`` in Arrow batches: the row's columns by
    name, and the batch."""
    joined = (
        with_identity(docs)
        .join(sized_broadcast(spans, 200_000), ["t", "u"], "left")
        .join(sized_broadcast(copies(docs)), ["t", "u"], "left")
        .select("row", "rank", "starts", "ends", "least")
    )
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield done(dict(zip(names, batch.column("row").flatten())), batch)

    return joined.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, rule: Rule) -> DataFrame:
    """t, u, starts, ends: the merged spans of symbols that repeated windows cover,
    for every distinct text that has one.  Copies of one text are not repeats here."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = with_identity(docs.select("doc_id", "text")).select(
        "t", "u", "rank", F.coalesce("row.text", F.lit("")).alias("text")
    )
    anchors = materialize(rows.select("t", "u", "text").mapInArrow(_anchor_rows(rule), ANCHORS), "anchors")
    alone = (F.col("t0") == F.col("t1")) & ~F.col("again")
    shared = (
        anchors.groupBy("key")
        .agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("twice").alias("again"))
        .where(~alone).select("key")
    )
    # Written first: the join then has two plain sides, of which hot keys can be split.
    shared = sized_broadcast(materialize(shared, "shared"))
    ranges = materialize(
        anchors.join(shared, "key").select("t", "u", "low", "high").distinct()
        .groupBy("t", "u").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")),
        "ranges",
    )
    texts = materialize(
        rows.join(sized_broadcast(ranges, 200_000), ["t", "u"])
        .groupBy("t", "u").agg(F.min("rank").alias("rank"), F.first("text").alias("text"),
                               F.first("low").alias("low"), F.first("high").alias("high")),
        "texts",
    )
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    batches = 1 + size // BATCH_BYTES
    buckets = 1 + size // BUCKET_WINDOWS
    dealt = texts.withColumn("batch", F.pmod(F.col("u"), F.lit(batches)).cast("int"))
    sent = dealt.groupBy("batch").applyInArrow(_send(rule, buckets), SENT)
    answers = sent.groupBy("bucket").applyInArrow(_compare(rule), ANSWERS)
    return materialize(
        dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_receive(rule, buckets), SPANS), "spans"
    )
