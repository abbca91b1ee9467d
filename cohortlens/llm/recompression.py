"""Repeated passages of words, found by recompression (Jez 2015)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from . import repeats
from .common import Hashes, mix, without

#: Rounds of naming.  A round shortens prose by about a quarter.  With more of them a window
#: holds so few whole symbols that neighbouring windows no longer share the least.
ROUNDS = 5

#: Neighbouring symbols that make an anchor.  Windows that do not hold so many of
#: the last round use those of an earlier round; words are the earliest.
NEIGHBOURS = 3

_HASHES = Hashes()
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word names of all texts with a separator after each, and the texts' bounds."""
    names = [_HASHES.of(words_of(text)) for text in texts]
    sizes = np.array([len(x) for x in names], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    out = np.empty(int(sizes.sum()) + len(texts), np.uint64)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = np.concatenate(names) if names else np.zeros(0, np.uint64)
    out[ends] = mix(np.arange(len(texts), dtype=np.uint64) + _STEP)
    return out, ends - sizes, ends


class Level:
    """Symbols in order: name, first and last word (exclusive) of what a symbol's
    extent depends on, and whether it separates texts.

    A symbol whose dependence lies within a window is in every copy of that window,
    at the same place: both follow from the window's words alone.
    """

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> None:
        self.name, self.low, self.high, self.bound = name, low, high, bound

    def _before(self) -> np.ndarray:
        """First word of the symbol before each one; of the first, none."""
        return np.concatenate([[-1], self.low[:-1]])

    def _after(self) -> np.ndarray:
        return np.concatenate([self.high[1:], [self.high[-1] + 1]])

    def runs(self) -> Level:
        """Each maximal run of one symbol becomes a symbol named by it and its length."""
        n = len(self.name)
        new = np.ones(n, bool)
        new[1:] = self.name[1:] != self.name[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        length = (last - first + 1).astype(np.uint64)
        name = np.where(length > 1, mix(self.name[first] * _ODD + length), self.name[first])
        low, high = self._before()[first], self._after()[last]
        return Level(name, low, high, self.bound[first])

    def pairs(self, turn: int) -> Level:
        """A name's bit puts it left or right; each left symbol before a right one
        becomes one symbol.  Pairs cannot overlap, so names decide them alone."""
        n = len(self.name)
        right = (mix(self.name ^ np.uint64((turn + 1) << 56)) & np.uint64(1)).astype(bool)
        starts = np.zeros(n, bool)
        starts[:-1] = ~right[:-1] & right[1:] & ~self.bound[:-1] & ~self.bound[1:]
        seconds = np.zeros(n, bool)
        seconds[1:] = starts[:-1]
        name = self.name.copy()
        at = np.flatnonzero(starts)
        name[at] = mix(self.name[at] * _ODD + self.name[at + 1] * _STEP)
        low = np.where(right, self._before(), self.low)
        high = np.where(right, self.high, self._after())
        kept = ~seconds
        return Level(name[kept], low[kept], high[kept], self.bound[kept])


def levels(names: np.ndarray, ends: np.ndarray) -> list[Level]:
    at = np.arange(len(names))
    bound = np.zeros(len(names), bool)
    bound[ends] = True
    found = [Level(names, at, at + 1, bound)]
    # Runs are named in the first round; in later ones equal neighbours stay apart,
    # as looking for runs would make every symbol depend on both of its neighbours.
    found.append(found[0].runs().pairs(0))
    for turn in range(1, ROUNDS):
        found.append(found[-1].pairs(turn))
    return found


def _starts(starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows and the text of each."""
    counts = np.maximum(ends - starts - length + 1, 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[owner] + inside, owner


def _least_of(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of the least value from ``first`` to ``last`` of each range, the first one of
    equal ones: minima of spans of powers of two, of which two cover a range."""
    bits = np.uint64(max(24, len(values).bit_length()))
    spans = (values >> bits << bits) | np.arange(len(values), dtype=np.uint64)
    out = np.empty(len(first), np.uint64)
    size, width = 1, last - first + 1
    while True:
        now = np.flatnonzero((width >= size) & (width < 2 * size))
        out[now] = np.minimum(spans[first[now]], spans[last[now] - size + 1])
        if not (width >= 2 * size).any():
            return (out & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        spans = np.minimum(spans[:-size], spans[size:])
        size *= 2


def anchors(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window, of NEIGHBOURS symbols in a row those of least name, of the highest
    level at which some depend on its words only, and the runs of windows with the same
    ones.  Windows that overlap mostly share the least, so anchors are few."""
    names, starts, ends = _joined(texts)
    at, owner = _starts(starts, ends, length)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    key = np.zeros(len(at), np.uint64)
    chosen = np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    found = levels(names, ends)
    more = min(NEIGHBOURS, length) - 1
    for level in range(len(found) - 1, -1, -1):
        symbols = found[level]
        first = np.searchsorted(symbols.low, at[todo], "left")
        last = np.searchsorted(symbols.high, at[todo] + length, "right") - 1 - more
        fits = last >= first
        done, first, last = todo[fits], first[fits], last[fits]
        if len(done):
            size = len(symbols.name) - more
            name = np.full(size, level, np.uint64)
            for k in range(more + 1):
                name = mix(name * _ODD + symbols.name[k : k + size])
            least = _least_of(name, first, last)
            key[done] = name[least]
            chosen[done] = least * len(found) + level
        todo = todo[~fits]
        if not len(todo):
            break
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return key[first], owner[first], at[first] - starts[owner[first]], at[last] - starts[owner[first]]


def windows(texts: list[str], length: int) -> list[np.ndarray]:
    """Fingerprints of the windows of each text, doubled up from its words."""
    names, starts, ends = _joined(texts)
    total, size = mix(names), 1
    out, covered = None, 0
    while True:
        if length & size:
            if out is None:
                out = total.copy()
            else:
                moved = np.zeros_like(total)
                moved[: len(total) - covered] = total[covered:]
                out = mix(out * _STEP + moved)
            covered += size
        if 2 * size > length:
            break
        moved = np.zeros_like(total)
        moved[: len(total) - size] = total[size:]
        total = mix(total * _ODD + moved)
        size *= 2
    counts = np.maximum(ends - starts - length + 1, 0)
    return [out[a : a + n] for a, n in zip(starts, counts)]


def rule(length: int) -> repeats.Rule:
    return repeats.Rule(length, True, lambda texts: anchors(texts, length), lambda texts: windows(texts, length))


def remove_repeated_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove each word that a window of ``length`` words covers which also starts in
    a document of smaller doc_id; windows are judged on the input.

    Returns the columns of ``docs`` with the kept words, joined by one space, as
    ``text``, and n_words, n_removed.  A null text has no words and becomes empty.
    A null doc_id counts as smaller than all others; rows of one doc_id never remove
    each other's words.  Extra columns are kept, but for those named n_words or
    n_removed, which are replaced.

    Names of runs and pairs are 64-bit fingerprints of what they stand for: the same
    everywhere without a shuffle per round.  Shared symbols of high levels find the
    windows that may repeat; those are then compared by fingerprints of all their
    words (``repeats``).
    """
    docs = without(docs, ("n_words", "n_removed"))
    schema = T.StructType([
        *docs.schema.fields,
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    ])

    def done(row: dict[str, pa.Array], batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, gone = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("rank", "starts", "ends", "least")]
        for text, rank, starts, ends, least in zip(row["text"].to_pylist(), *columns):
            words = words_of(text or "")
            counts.append(len(words))
            if least is not None and least < rank and len(words) >= length:
                words = []
            elif starts:
                edges = [0, *(x for pair in zip(starts, ends) for x in pair), len(words)]
                words = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
            gone.append(counts[-1] - len(words))
            texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        out = row | {"text": pa.array(texts, pa.string())}
        return pa.RecordBatch.from_arrays(
            [*out.values(), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=schema.names
        )

    return repeats.finish(docs, repeats.repeated_spans(docs, rule(length)), done, schema)
