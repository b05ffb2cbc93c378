"""Exact and fast use of the public tokenizers: independent chunks of a text are encoded once and remembered."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np


class Remembered(dict):
    """What ``encode`` gives for a chunk, kept for ``limit`` to twice as many chunks: those of the last generation too."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, chunk: str):
        value = self.old.get(chunk)
        if value is None:
            tail = chunk[-1:]
            # a tokenizer parts letters from punctuation, so the word before a stop is looked up by itself; not where
            # composing or lower-casing leaves a combining mark, which would go with the stop
            body = chunk[:-1].lstrip(" \n") if tail in (".", ",") else ""
            value = self[chunk[:-1]] + self[tail] if body.isalpha() and unicodedata.normalize("NFC", body).lower().isalpha() else self.encode(chunk)
        self[chunk] = value
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.old = self.copy()
            self.clear()


class ChunkEncoder:
    """Token ids or counts of whole texts, equal to the library's for the whole text.

    A text is cut where the tokenizer itself always cuts: before each run of spaces and line feeds that follows
    another character. Where a text has any other white space, a byte-level tokenizer could join it with such a
    run, so the library gets that text whole. ``drops_space``: the tokenizer discards white space and case (word
    BPE), so chunks are what stands between spaces and line feeds, in lower case where lower case is beyond doubt
    (Latin-1 without special strings). ``remember`` bounds the chunks kept."""

    _RUNS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
    _OTHER_SPACE = re.compile(r"[^\S \n]")

    def __init__(self, path: str, drops_space: bool, remember: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.drops_space = Tokenizer.from_file(path), drops_space
        self.known_counts = Remembered(lambda t: len(self._whole(t)), remember)
        self.known_ids = Remembered(lambda t: np.asarray(self._whole(t), "<u4").tobytes(), remember)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _chunks(self, text: str) -> list[str]:
        if not self.drops_space:
            return [text] if self._OTHER_SPACE.search(text) else self._RUNS.findall(text)
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        self.known_counts.trim()
        return [sum(map(self.known_counts.__getitem__, c)) if len(c := self._chunks(t)) > 1 else len(self._whole(t)) for t in texts]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        self.known_ids.trim()
        return [b"".join(map(self.known_ids.__getitem__, c)) if len(c := self._chunks(t)) > 1 else np.asarray(self._whole(t), "<u4").tobytes() for t in texts]


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}
REMEMBER = 600_000  # chunks: about 100 MB a worker, twice that with the last generation


def encoder(path: str, drops_space: bool, remember: int = REMEMBER) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary."""
    key = (path, drops_space)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(path, drops_space)
    _encoders[key].known_ids.limit = _encoders[key].known_counts.limit = remember
    return _encoders[key]
