"""Cutting texts at single blanks and remembering what each piece encodes to.

The pre-tokenizer's pattern never lets a token reach over a blank that a character
other than white space follows, so a text may be cut before each such blank, and
equal pieces encode alike wherever they stand.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np

# White space under any reading of it, or the end, after a blank: no cut there.
_JOINED = re.compile(r" (?=[\s\x1c-\x1f\x85]|\Z)")


def cut(text: str) -> list[str]:
    """The text's pieces; each but the first lost the blank before it."""
    pieces = text.split(" ")
    if _JOINED.search(text) is None:
        return pieces
    out = [pieces[0]]
    for p in pieces[1:]:
        if not p or p[0].isspace() or p[0] == "\x85":
            out[-1] = f"{out[-1]} {p}"
        else:
            out.append(p)
    return out


class Remembered(dict):
    """key -> make(key), kept in two generations of at most ``size`` keys each."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceEncoder:
    """Ids of whole texts from an encoder of pre-tokens.

    split: piece -> pre-tokens, encode: pre-token -> ids; spell: letters -> the form
    that split gives them.
    """

    def __init__(self, split, encode, n_ids: int, spell=str, size: int = 700_000):
        self.dtype = np.dtype(np.uint16 if n_ids <= 1 << 16 else np.uint32)
        self.split, self.encode, self.spell = split, encode, spell
        self.token = Remembered(self._token, size // 8)
        self.first = Remembered(self._first, size // 8)
        self.inner = Remembered(self._inner, size)

    def _token(self, token: str) -> bytes:
        return array(self.dtype.char, self.encode(token)).tobytes()

    def _first(self, piece: str) -> bytes:
        return b"".join(map(self.token.__getitem__, self.split(piece)))

    def _inner(self, piece: str) -> bytes:
        """The ids of a piece that had a blank before it."""
        if piece.isalpha():  # one pre-token
            return self._token(self.spell(f" {piece}"))
        # Letters end where punctuation begins, and a line break between characters other
        # than white space stands alone, so these pieces fall into smaller ones.
        if piece[-1:] in (".", ",") and piece[-2:-1].isalpha():
            return self.inner[piece[:-1]] + self.first[piece[-1]]
        before, line, after = piece.partition("\n")
        if line and before and after and not before[-1].isspace() and not after[0].isspace():
            return self.inner[before] + self.first[line] + self.first[after]
        return self._first(f" {piece}")

    def __call__(self, text: str) -> np.ndarray:
        pieces = cut(text)
        joined = b"".join(chain([self.first[pieces[0]]], map(self.inner.__getitem__, pieces[1:])))
        return np.frombuffer(joined, dtype=self.dtype)
