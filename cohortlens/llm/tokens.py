"""Encoding with a ``tokenizers`` file, word by word through a bounded cache."""

from __future__ import annotations

import struct

import numpy as np

from .common import Hashes


class _Runs(Exception):
    """A text has white space other than single spaces and line ends."""


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable
    Latin-1 ones stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_CHARACTERS = _byte_characters()


class _Packs(dict):
    """Formats of n little-endian ids."""

    def __missing__(self, n: int) -> str:
        found = self[n] = f"<{n}I"
        return found


_PACKS = _Packs()


class _Words(dict):
    """Ids of parts that follow a space, or that start with a line end."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer
        self.one_match = tokenizer.model.tokenize
        self.line_end = self.ids("\n")
        self.ends = {c: self.ids(c) for c in ".,"}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        line = part[:1] == "\n"
        word = part[1:] if line else part
        end = self.ends.get(word[-1:])
        if end and not line and word[:-1].isalpha():
            found = self[word[:-1]] + end
        elif word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            raw = word if word.isascii() else word.encode().decode("latin-1").translate(_CHARACTERS)
            tokens = self.one_match(raw if line else "\u0120" + raw)
            found = struct.pack(_PACKS[len(tokens)], *[token.id for token in tokens])
            if line:
                found = self.line_end + found
        elif word.split() == [word]:
            found = self.line_end + self.ids(word) if line else self.ids(" " + word)
        else:
            raise _Runs
        self[part] = found
        return found


class CachedEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    The split pattern of byte-level BPE never matches across the border between a
    non-space and a following space or line end, nor beyond a single line end, so a
    text is cut there and each part encoded apart.  Most parts are frequent words,
    whose ids are remembered.  A new word of letters (and a full stop or comma after
    letters) is one match, which goes to the library's BPE model directly; other
    parts take the library's whole way.  Texts with runs of white space are cut only
    where a part ends in something else.  The memory is emptied when it holds ``limit``
    parts (some 200 bytes each), which bounds a worker at any input size.
    """

    LIMIT = 1_000_000

    def __init__(self, path: str, limit: int | None = None) -> None:
        import os

        self.limit = limit or self.LIMIT

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.words = _Words(tokenizer)

    def _joined(self, text: str) -> bytes:
        """The slow way, for texts with runs of white space."""
        parts: list[str] = []
        for i, piece in enumerate(text.split(" ")):
            part = piece if i == 0 else " " + piece
            if parts and parts[-1] and parts[-1][-1].isspace():
                parts[-1] += part
            else:
                parts.append(part)
        return b"".join(map(self.words.ids, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > self.limit:
            self.words.clear()
        look = self.words.__getitem__
        out = []
        for text in texts:
            head, *rest = text.replace("\n", " \n").split(" ")
            try:
                if head and head.split() != [head]:
                    raise _Runs
                out.append((self.words.ids(head) if head else b"") + b"".join(map(look, rest)))
            except _Runs:
                out.append(self._joined(text))
        return out


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str, limit: int | None = None) -> CachedEncoder:
    """One encoder per worker and file; the last ``limit`` asked for counts.  Hashes that
    the worker remembers from an earlier stage are given up for a new one."""
    if path not in _ENCODERS:
        Hashes.forget()
        _ENCODERS[path] = CachedEncoder(path, limit)
    _ENCODERS[path].limit = limit or CachedEncoder.LIMIT
    return _ENCODERS[path]
