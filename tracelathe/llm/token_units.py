"""Byte-pair tokenizers over units that they never merge across.

Both JSON vocabularies split text at white space, and where letters meet other signs (but for
apostrophes), before any merge: whatever the tokenizer makes of a text is what it makes of the
units, one after the other.  Units repeat a lot, so each distinct one is encoded once per worker.
That holds for texts of ASCII and Latin letters; a text with anything else (other scripts and kinds of
white space, marks that compose, what may be a special token) goes to the tokenizer in pieces cut
before blanks, or whole if it holds rare white space.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from tracelathe.llm.byte_units import Slice, UnitTable
from tracelathe.llm.common import UnitCache

UNIT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space, or what some library takes for it, beyond blank, tab and line ends.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
#: In Latin-1: printable ASCII, tab, line ends and letters.
USUAL = bytes(b for b in range(256) if 32 <= b < 127 or b in b"\t\n\r" or b >= 0xC0 and b not in b"\xd7\xf7")
_LOADED: dict = {}


def tokenizer(path: str):
    """The tokenizer of a worker process, loaded once."""
    if path not in _LOADED:
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def is_usual(text: str) -> bool:
    """Whether a text holds nothing but ``USUAL`` signs, nor what begins a special token."""
    if "<|" in text:
        return False
    try:
        return not text.encode("latin-1").translate(None, USUAL)
    except UnicodeEncodeError:
        return False


def units(text: str) -> list[str]:
    return [text] if RARE_SPACE.search(text) else UNIT.findall(text)


class Encoder:
    """Ids of slices of texts, by units; one per worker and tokenizer."""

    def __init__(self, path: str, cut: Callable, table: np.ndarray | None = None):
        t = tokenizer(path)
        solve = lambda strings: [e.ids for e in t.encode_batch_fast(strings, add_special_tokens=False)]
        self.cut, self.lower = cut, table
        self.units, self.strings = UnitTable(solve, limit=800_000), UnitCache(solve, 100_000)

    def _usual(self, texts: list[str]) -> tuple[list[bool], list[str]]:
        usual = [is_usual(t) for t in texts]
        return usual, [t if u else "" for t, u in zip(texts, usual)]

    def _unusual(self, text: str) -> list[int]:
        parts = units(text)
        known = self.strings.ready(parts)
        return [i for p in parts for i in known[p]]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) and the borders of the texts among them."""
        usual, plain = self._usual(texts)
        part = Slice(plain, table=self.lower)
        at, ends = self.cut(part)
        flat, borders = self.units.expand(self.units.lookup(part, at, ends))
        borders = borders[part.per_text(at)]
        if all(usual):
            return flat, borders
        rows = [flat[a:b] if u else np.array(self._unusual(t), np.int32) for t, u, a, b in zip(texts, usual, borders, borders[1:])]
        return np.concatenate(rows), np.cumsum([0, *map(len, rows)])

    def counts(self, texts: list[str]) -> np.ndarray:
        usual, plain = self._usual(texts)
        part = Slice(plain, table=self.lower)
        at, ends = self.cut(part)
        running = np.concatenate([[0], np.cumsum(self.units.sizes(self.units.lookup(part, at, ends)))])
        out = np.diff(running[part.per_text(at)])
        for k, u in enumerate(usual):
            if not u:
                out[k] = len(self._unusual(texts[k]))
        return out


def encoder(path: str, cut: Callable, table: np.ndarray | None = None) -> Encoder:
    key = (path, cut.__name__)
    if key not in _LOADED:
        _LOADED[key] = Encoder(path, cut, table)
    return _LOADED[key]
