"""Helpers shared by the training-data operators: stage tables, word hashing, cached tokenizers."""

from __future__ import annotations

import uuid
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loanpanel.session import ensure_checkpoint_dir

_U = np.uint64
_R = 0x9E3779B97F4A7C15          # odd multiplier of the polynomial hashes
_R_INV = pow(_R, -1, 1 << 64)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, and
    every executor sees the files."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: no name of its own can clash with an inner one or be read as a path."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty, lone surrogates are kept as they are."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Powers:
    """Grows the tables of powers of the hash multiplier as longer inputs come."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = _powers(size, _R), _powers(size, _R_INV)
        return self.up[:n], self.down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span: equal content has an equal hash, wherever it stands."""
    up, down = powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values.astype(_U) * up[:len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_spans(data: bytes, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of bytes marked in ``word_byte`` (256 booleans)."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = word_byte[np.frombuffer(data, np.uint8)]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: words [^\x20\x09-\x0D]+ ; in UTF-8 every byte of a longer character is a word byte
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: words [0-9a-z and every character from U+0080 on], after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def word_hashes(data: bytes, word_byte: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, byte starts, byte ends)."""
    starts, ends = word_spans(data, word_byte)
    if not len(starts):
        return np.empty(0, _U), starts, ends
    raw = np.frombuffer(data, np.uint8).astype(_U) + _U(1)
    return span_hashes(raw, starts, ends, powers), starts, ends


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class CachedTokenizer:
    """A public tokenizer over pieces cut where its pre-tokenizer always cuts, with a bounded cache.

    A piece ends before a blank that follows a non-blank character; both public vocabularies in use
    start a new pre-token there, so the ids of the pieces, joined, are the ids of the whole text.
    Texts holding a special token's string are encoded whole. ``limit`` bounds the cached pieces; frequent ones come early and stay.
    """

    def __init__(self, path: str, keeps_blanks: bool, limit: int = 600_000) -> None:
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.keeps, self.limit = Tokenizer.from_file(path), keeps_blanks, limit
        self.unsafe = re.compile(r"\s " if keeps_blanks else r"(?!)")
        self.cut = re.compile(r"(?<=\S)(?= )")
        self.cache: dict[str, bytes] = {}
        self.model = self.tok.model
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"             # characters that no normalizer changes but in case
        self.simple = re.compile(f"( ?)([{letters}]+)([.,!*$%&#]*)")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]       # byte-level vocabularies' signs
        hidden = [b for b in range(256) if b not in set(shown)]
        self.signs = {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}

    def _whole(self, piece: str) -> bytes:
        return np.asarray(self.tok.encode(piece, add_special_tokens=False).ids, np.uint16).tobytes()

    def _cached(self, piece: str, make) -> bytes:
        ids = self.cache.get(piece)
        if ids is None:
            ids = make(piece)
            if len(self.cache) < self.limit:
                self.cache[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of letters, with a blank before them or not: one pre-token, so the model alone is asked."""
        signs = self.signs
        shown = word.replace(" ", signs[32]) if word.isascii() else "".join([signs[b] for b in word.encode()])
        return array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece: letters and the signs behind them are pre-tokens of their own, and so is a
        single line break between other characters; any other piece is encoded whole."""
        if m := self.simple.fullmatch(piece):
            word = m[1] + m[2] if self.keeps else m[2].lower()
            return self._cached(word, self._word) + (self._cached(m[3], self._whole) if m[3] else b"")
        head, line, tail = piece.partition("\n")
        if self.keeps and line and head and tail and not head[-1].isspace() and not tail[0].isspace():
            return self._cached(head, self._piece) + self._cached(line, self._whole) + self._cached(tail, self._piece)
        return self._whole(piece)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as uint16 where the vocabulary allows it (both public ones do)."""
        if not text:
            return np.empty(0, np.uint16)
        if "<|" in text:
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, np.uint16)
        if not self.keeps:
            pieces = text.replace("\n", " ").split(" ")
        elif self.unsafe.search(text):
            pieces = self.cut.split(text)
        else:
            pieces = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.cut.split(text)
        known, cached, make = self.cache.get, self._cached, self._piece
        return np.frombuffer(b"".join([known(p) or cached(p, make) for p in pieces]), np.uint16)


@lru_cache(maxsize=2)
def shared_tokenizer(path: str, keeps_blanks: bool, limit: int = 600_000) -> CachedTokenizer:
    """One tokenizer for all tasks that a Python worker runs, so the pieces it knows are kept."""
    return CachedTokenizer(path, keeps_blanks, limit)
