"""Byte-level BPE with a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches, texts_of

#: Characters above which a text is cut before encoding.
PART_CHARS = 1 << 15

#: Places where no match of the split pattern continues: before white space that
#: follows a letter or digit, and between an ASCII letter and an ASCII digit.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=\s)|(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])")


#: White space that is cut out of long texts: the library's pattern fails on very long
#: runs.  A run is one match, but for its last character where something follows.
LONG_RUN = regex.compile(r"\p{White_Space}{4096,}")


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Cut a long text at the first safe border after every ``size`` characters;
    a stretch without a border stays whole."""
    parts, start = [], 0
    while len(text) - start > size:
        border = SAFE.search(text, start + size)
        if border is None or border.start() == len(text):
            break
        parts.append(text[start : border.start()])
        start = border.start()
    parts.append(text[start:])
    return parts


class RankFile:
    """Encoder and raw-byte decoder over one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {rank: piece for piece, rank in ranks.items()}

    def encode(self, text: str) -> list[int]:
        if len(text) <= PART_CHARS:
            return self.encoding.encode_ordinary(text)
        ids, start = [], 0
        for run in LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self._parts(text[start : run.start()])
            ids += self.encoding._encode_single_piece(text[run.start() : end])
            start = end
        return ids + self._parts(text[start:])

    def _parts(self, text: str) -> list[int]:
        return [i for part in safe_parts(text) for i in self.encoding.encode_ordinary(part)]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, also where they are not whole characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


_FILES: dict[tuple[str, str], RankFile] = {}


def rank_file(path: str, pattern: str) -> RankFile:
    if (path, pattern) not in _FILES:
        _FILES[path, pattern] = RankFile(path, pattern)
    return _FILES[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary) of every row of ``docs``.

    A null text is empty and has no ids.  Rows stay where they are: nothing is
    shuffled.  Repeated rows are encoded apart; extra columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_file(path, pattern)
        for batch in batches:
            ids = [codec.encode(text) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([codec.decode(x) for x in ids], pa.binary()),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_type(docs)}, ids array<int>, decoded binary")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of rows with ``ids``; null ids give null."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_file(path, pattern)
        for batch in batches:
            raw = [None if x is None else codec.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_type(encoded)}, decoded binary")


def _type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()
