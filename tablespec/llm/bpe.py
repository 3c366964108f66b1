"""Byte-level BPE ids for Arrow text columns, with a cache of split words.

Each text is split into the pieces that the tokenizer's pattern gives, and every
distinct piece is encoded once by the public tokenizer itself, keyed by its
characters. Texts of plainly classified characters are split by an equal pattern
of ranges; others by the tokenizer's own splitter. A special token's string in a
text is that token, as the tokenizer has it.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

from tablespec.llm import words

# fixed values: ranges of code points whose classes are the same in all Unicode versions in use, and white space in them
_PLAIN = ((0, 0x0530), (0x2000, 0x2100))
_WHITE = "\t-\r \x85\xa0 -     "
CACHE_PIECES = 500_000
LONG_TEXT = 1 << 20


def plain_ranges(kind: str) -> str:
    """The plain characters of a Unicode class, as ranges of a pattern."""
    held = [c for a, b in _PLAIN for c in range(a, b) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for c, before in zip(held, [-2, *held]) if c != before + 1]
    ends = [c for c, after in zip(held, [*held[1:], -2]) if c + 1 != after]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


def plain_pattern() -> re.Pattern:
    """The tokenizer's pattern for plain characters: contractions, letters, numbers, others, white space."""
    letter, number = plain_ranges("L"), plain_ranges("N")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{_WHITE}{letter}{number}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself if it prints, else the next from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Slots(dict):
    """Pieces by their text; a new one goes through the tokenizer's merges, and its number is kept."""

    def __init__(self, tokenizer, special: bool):
        self.tokenize, self.characters = tokenizer.model.tokenize, byte_characters()
        self.whole = {t.content: [i] for i, t in tokenizer.get_added_tokens_decoder().items() if special}
        self.ids, self.begin, self.length = array("I"), array("q"), array("q")

    def merge(self, piece: str) -> list[int]:
        return self.whole.get(piece) or [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.characters))]

    def __missing__(self, piece: str) -> int:
        got = self.merge(piece)
        slot = self[piece] = len(self.begin)
        self.begin.append(len(self.ids))
        self.length.append(len(got))
        self.ids.extend(got)
        return slot


class ByteBpe:
    """ids(column) yields, for row ranges of the column, the ids and their row offsets.

    Unless special, the strings of special tokens are plain text."""

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.special = re.compile("|".join(f"({re.escape(t)})" for t in strings)) if strings else None
        self.odd = re.compile("[^" + "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in _PLAIN) + "]")
        self.pattern = plain_pattern()
        self.slots = self._empty()

    def _empty(self) -> _Slots:
        return _Slots(self.tokenizer, self.special is not None)

    def encode(self, text: str) -> list[int]:
        """The ids of a short text, which are not kept."""
        return [i for some in self.pieces(text) for p in some for i in self.slots.merge(p)]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in lists of bounded size."""
        if self.special and self.special.search(text):
            for part in filter(None, self.special.split(text)):
                yield from [[part]] if self.special.fullmatch(part) else self.pieces(part)
        elif self.odd.search(text):
            yield [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        elif len(text) <= LONG_TEXT:
            yield self.pattern.findall(text)
        else:
            found = (m.group() for m in self.pattern.finditer(text))
            while some := list(islice(found, LONG_TEXT)):
                yield some

    def ids(self, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Yields (first row, last row + 1, ids of all rows, offsets of the rows in them)."""
        _, off = words.buffers(col)
        for lo, hi in words.row_slices(off):
            if len(self.slots) > CACHE_PIECES:
                self.slots = self._empty()
            get, found, rows = self.slots.__getitem__, [], np.zeros(hi - lo + 1, np.int64)
            for r, text in enumerate(col.slice(lo, hi - lo).to_pylist()):
                for some in self.pieces(text or ""):
                    found.append(np.fromiter(map(get, some), np.int64, len(some)))
                    rows[r + 1] += len(some)
            slots = np.concatenate(found) if found else np.zeros(0, np.int64)
            # copies, as the stores grow and views would forbid that
            begin, length, store = np.array(self.slots.begin), np.array(self.slots.length), self.slots.ids
            sizes = length[slots]
            before = np.concatenate([[0], np.cumsum(sizes)])
            take = np.repeat(begin[slots] - before[:-1], sizes) + np.arange(before[-1])
            yield lo, hi, np.frombuffer(store, np.uint32)[take] if len(store) else np.zeros(0, np.uint32), before[np.cumsum(rows)]
