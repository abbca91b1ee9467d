"""Repeated byte strings from sorted names of suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from . import repeats
from .common import mix, without

#: Bytes of the prefixes by which suffixes are sampled: a power of three.
SAMPLE = 81

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _A)


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Names of triples of names."""
    out = a * _A
    out += b * _B
    out += c * _C
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def prefix_names(raw: np.ndarray, length: int) -> np.ndarray:
    """A name for the ``length`` bytes from each position: names of triples of bytes,
    then of triples of names, until two overlapping names cover the length."""
    names, size = _BYTES[raw], 1
    while 3 * size <= length:
        n = len(names) - 2 * size
        names = _triple(names[:n], names[size : size + n], names[2 * size :])
        size *= 3
    if size == length:
        return names
    # Three names, the outer ones at the ends, cover any length below 3 * size.
    n = len(names) - (length - size)
    middle = (length - size) // 2
    return _triple(names[:n], names[middle : middle + n], names[length - size :])


def _raw(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [text.encode("utf-8", "surrogatepass") for text in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(parts), np.uint8), ends - sizes, ends


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from minima of whole blocks."""
    n = len(values)
    size = -(-n // width) * width
    padded = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the suffixes that start in a window, with SAMPLE bytes left in it, the one
    of least name: a cover that two equal windows always share at one offset."""
    raw, starts, ends = _raw(texts)
    none = np.zeros(0, np.int64)
    sample = min(SAMPLE, length)
    counts = np.maximum(ends - starts - length + 1, 0)
    if not counts.any():
        return none.view(np.uint64), none, none, none
    names = prefix_names(raw, sample)
    low_bits = np.uint64(max(1, int(len(names)).bit_length()))
    packed = (names >> low_bits << low_bits) | np.arange(len(names), dtype=np.uint64)
    chosen = (_least(packed, length - sample + 1) & ((np.uint64(1) << low_bits) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(starts)), counts)
    at = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    chosen = chosen[at]
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    own = owner[first]
    return names[chosen[first]], own, at[first] - starts[own], at[last] - starts[own]


def windows(texts: list[str], length: int) -> list[np.ndarray]:
    """The names of the windows at every byte of each text."""
    raw, starts, ends = _raw(texts)
    names = prefix_names(raw, length) if len(raw) >= length else np.zeros(0, np.uint64)
    counts = np.maximum(ends - starts - length + 1, 0)
    return [names[a : a + n] for a, n in zip(starts, counts)]


def rule(length: int) -> repeats.Rule:
    return repeats.Rule(length, False, lambda texts: anchors(texts, length), lambda texts: windows(texts, length))


def remove_repeated_strings(docs: DataFrame, length: int = 400) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts
    anywhere else, the same document included; strings are judged on the input.

    Returns the columns of ``docs`` and n_bytes, n_removed, n_spans (maximal removed
    runs) and kept (the remaining bytes); ``text`` is their text without characters
    that a border cut.  Both copies of a repeat go.  Repeated rows are repeats of
    each other, whatever their doc_id.  A null text is empty.  Extra columns are kept,
    but for those with the names of the new ones, which are replaced.

    Names stand for prefixes: triples of bytes, then triples of names, as in the
    difference-cover sort, but as 64-bit fingerprints, which need no sort per level.
    Sampled suffixes whose names are shared decide where strings may repeat; the
    names of all strings there are sorted and neighbours compared (``repeats``).
    """
    more = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType())]
    docs = without(docs, tuple(n for n, _ in more))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in more)])

    def done(row: dict[str, pa.Array], batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, sizes, spans = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("starts", "ends", "least")]
        for text, starts, ends, least in zip(row["text"].to_pylist(), *columns):
            raw = (text or "").encode("utf-8", "surrogatepass")
            sizes.append(len(raw))
            if least is not None and len(raw) >= length:
                starts, ends = [0], [len(raw)]
            edges = [0, *(x for pair in zip(starts or (), ends or ()) for x in pair), len(raw)]
            kept.append(b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2])]))
            spans.append(len(starts or ()))
        out = row | {"text": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())}
        counts = (sizes, [a - len(b) for a, b in zip(sizes, kept)], spans)
        return pa.RecordBatch.from_arrays(
            [*out.values(), *(pa.array(c, pa.int64()) for c in counts), pa.array(kept, pa.binary())], names=schema.names
        )

    return repeats.finish(docs, repeats.repeated_spans(docs, rule(length)), done, schema)
