"""Quality scores from boosted trees over document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import small_batches, texts_of, without

#: Labelled rows that a fit may use: those of smallest hash.  This bounds the fit,
#: which runs in the driver; scoring reads every row.
TRAIN_ROWS = 20_000

#: Bytes whose share of the text is a feature.
_SIGNS = b"!|%$&*#@.,:;?-_/()[]{}<>=\"'"

FEATURES = (
    ["bytes", "words", "lines", "word_mean", "word_sd", "word_max", "line_mean", "line_max",
     "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "upper", "digit", "space",
     "newline", "beyond_ascii", "control", "sign", "entropy", "packed"]
    + [f"sign_{c}" for c in _SIGNS]
)


def statistics(text: str) -> list[float]:
    """The features of one whole text; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / n
    words = raw.split()
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    line_lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    seen = Counter(words)
    m = max(1, len(words))
    present = share[share > 0]
    letters = share[65:91].sum() + share[97:123].sum()
    return [
        float(n), float(len(words)), float(len(lines)),
        lengths.mean(), lengths.std(), float(lengths.max()),
        line_lengths.mean(), float(line_lengths.max()),
        len(seen) / m, max(seen.values(), default=0) / m,
        len(set(zip(words, words[1:]))) / m, len(set(lines)) / len(lines),
        share[65:91].sum(), share[48:58].sum(), share[32], share[10], share[128:].sum(),
        share[:32].sum() - share[10], 1 - letters - share[48:58].sum() - share[128:].sum() - share[32] - share[10],
        float(-(present * np.log2(present)).sum()), len(zlib.compress(raw, 1)) / n,
        *(share[c] for c in _SIGNS),
    ]


class HistogramTrees:
    """Binary log-loss boosting of trees of one depth over binned features.

    The trees are three flat arrays (split feature, split value, leaf value), so a
    batch is scored by ``depth`` gathers over rows x trees.
    """

    def __init__(self, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0) -> None:
        self.rounds, self.depth, self.bins, self.rate, self.l2 = rounds, depth, bins, rate, l2
        self.base = 0.0
        nodes = (1 << depth) - 1
        self.feature = np.zeros((0, nodes), np.int32)
        self.value = np.zeros((0, nodes))
        self.leaf = np.zeros((0, 1 << depth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> HistogramTrees:
        """Without rows the score is 0.5; with one class only, the share of ones
        with one row of each class added."""
        ones = float(y.sum())
        self.base = float(np.log((ones + 1) / (len(y) - ones + 1)))
        if not 0 < ones < len(y):
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
        margin = np.full(len(y), self.base)
        features, values, leaves = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            feature = np.zeros((1 << self.depth) - 1, np.int32)
            value = np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                best = np.zeros(width)
                for f, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    slot = node * self.bins + binned[f]
                    size = width * self.bins
                    gl = np.bincount(slot, g, size).reshape(width, -1).cumsum(1)
                    hl = np.bincount(slot, h, size).reshape(width, -1).cumsum(1)
                    ga, ha = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (ga - gl) ** 2 / (ha - hl + self.l2) - ga**2 / (ha + self.l2)
                    gain[:, len(cut):] = 0
                    gain[(hl < 1) | (ha - hl < 1)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best + 1e-12
                    best[better] = top[better]
                    feature[first : first + width][better] = f
                    value[first : first + width][better] = cut[at[better]]
                chosen = first + node
                right = x[np.arange(len(y)), feature[chosen]] > value[chosen]
                node = 2 * node + right
            sums = np.bincount(node, g, 1 << self.depth)
            weights = np.bincount(node, h, 1 << self.depth)
            leaf = -self.rate * sums / (weights + self.l2)
            margin += leaf[node]
            features.append(feature)
            values.append(value)
            leaves.append(leaf)
        self.feature, self.value, self.leaf = map(np.stack, (features, values, leaves))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for level in range(self.depth):
            at = (1 << level) - 1 + node
            node = 2 * node + (x[rows, self.feature[trees, at]] > self.value[trees, at])
        margin = self.base + self.leaf[trees, node].sum(1)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> HistogramTrees:
    """Fit on at most ``rows`` labelled documents that are not held out.

    Labels that are null or not 0/1, and ids without a document, are left out; an
    empty sample gives the constant score.  Of labels that repeat an id the largest
    counts.  At most ``rows`` feature vectors reach the driver.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(text) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))],
                names=["doc_id", "y", "x"],
            )

    found = sorted(
        joined.mapInArrow(run, "doc_id bigint, y int, x array<double>").collect(), key=lambda r: (r.doc_id, r.x)
    )
    x = np.array([r.x for r in found]).reshape(len(found), len(FEATURES))
    return HistogramTrees().fit(x, np.array([r.y for r in found], float))


def score(docs: DataFrame, model: HistogramTrees, name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row, from its whole text only.

    A null text is an empty one.  Nothing is shuffled.  A column ``name`` is replaced.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, (name.lower(),))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(text) for text in texts_of(batch)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(run, schema)
