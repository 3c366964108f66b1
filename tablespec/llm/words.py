"""Vectorised word splitting and hashing of Arrow text columns.

Words are maximal runs of bytes other than space and 0x09-0x0D (all ASCII, so
the rule is the same for UTF-8 bytes and for code points). Null texts are empty.

A hash is a polynomial over the numbers modulo 2**61 - 1 whose coefficients are the length
and seven (optionally A-Z lower-cased) UTF-8 bytes each, at a point that is the key; runs
beyond LONG_RUN bytes take BLAKE2b with the key. A window's hash is such a polynomial of
its words' at a second point. Two different runs have equal hashes at no more than as many
keys as the polynomial's degree, so for a key drawn at random (``fresh_key``) after the texts
were written no structure of a text makes runs collide: a pair does with probability 2**-57
at most. Operators that compare texts by hashes draw a key for each run. KEY is fixed and
public, so that models agree between runs; whoever knows it can write runs that collide, which
there share a count or a weight. Equal runs have equal hashes under one key on every machine.
"""

from __future__ import annotations

import functools
import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
LONG_RUN = 64

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES < 91), _BYTES + 32, _BYTES).astype(np.uint8)
PRIME = (1 << 61) - 1
KEY = int.from_bytes(hashlib.blake2b(b"words", digest_size=8).digest(), "little") % PRIME
BLOCK = 7  # bytes of a coefficient

#: keeps the first n bytes of eight
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_K = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
               0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def fresh_key() -> int:
    """A key that nobody knew when the texts were written; draw it on the driver, once for all that compares hashes."""
    return secrets.randbelow(PRIME - 1) + 1


@functools.lru_cache(maxsize=64)
def second_key(key: int) -> int:
    """The point of windows' polynomials that goes with a key."""
    return int.from_bytes(hashlib.blake2b(b"windows", digest_size=16, key=key.to_bytes(8, "little")).digest(), "little") % PRIME


def times(a: np.ndarray, k: int) -> np.ndarray:
    """a * k modulo PRIME for a below 2**61, up to a multiple of it; the result is below 2**62."""
    a1, a0 = a >> np.uint64(31), a & np.uint64((1 << 31) - 1)
    k1, k0 = np.uint64(k >> 31), np.uint64(k & (1 << 31) - 1)
    middle = a1 * k0 + a0 * k1
    return reduced(a1 * k1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * k0)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, where 2**61 - 1 itself may stay."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(61))


def settled(x: np.ndarray) -> np.ndarray:
    """The one number below PRIME for x below 2**64, mixed by a bijection of 64 bits."""
    x = reduced(reduced(x))
    return mix(np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x))


@dataclass
class Chunk:
    """Rows lo..hi of a batch: their bytes, byte offsets, words and word hashes under a key."""

    lo: int
    hi: int
    data: np.ndarray
    off: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    woff: np.ndarray
    hashes: np.ndarray
    key: int = KEY

    def counts(self) -> np.ndarray:
        return np.diff(self.woff)

    def owner(self) -> np.ndarray:
        """The row (counted from lo) of each word."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts())

    def word(self, i: int) -> str:
        return bytes(self.data[self.starts[i] : self.ends[i]]).decode("utf-8", "replace")


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, key: int = KEY) -> np.ndarray:
    """Hash of data[starts[i]:ends[i]]; runs may overlap."""
    bytes_ = np.zeros(len(data) + 8, np.uint8)
    bytes_[: len(data)] = _LOWER[data] if lower else data
    eight = np.ndarray((len(data) + 1,), "<u8", bytes_, strides=(1,))  # the eight bytes from each place on
    n = ends - starts
    out = n.astype(np.uint64)
    for k in range(0, min(int(n.max(initial=0)), LONG_RUN), BLOCK):
        at = np.flatnonzero(n > k) if k else slice(None)
        out[at] = reduced(times(out[at], key) + (eight[starts[at] + k] & _FIRST[np.minimum(n[at] - k, BLOCK)]))
    out = settled(out)
    secret = key.to_bytes(8, "little")
    for r in np.flatnonzero(n > LONG_RUN).tolist():
        out[r] = int.from_bytes(hashlib.blake2b(bytes_[starts[r] : ends[r]], digest_size=8, key=secret).digest(), "little")
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is empty."""
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off if len(off) else np.zeros(1, np.int64)


def row_slices(off: np.ndarray, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about max_bytes; a longer row is alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def split_words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each row."""
    ok = ~separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
    if len(data):
        before[1:] = ~ok[:-1]
        after[:-1] = ~ok[1:]
    starts = np.flatnonzero(ok & (before | edge[:-1]))
    ends = np.flatnonzero(ok & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def without_marks(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with spaces for typographic marks: U+2000-203F, Latin-1's marks and U+3000-3011."""
    out = data.copy()
    if len(data) < 3:
        return out
    a, b, c = data[:-2], data[1:-1], data[2:]
    three = np.flatnonzero((a == 0xE2) & (b == 0x80) | (a == 0xE3) & (b == 0x80) & (c < 0x92))
    two = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] >= 0xA0) & ~np.isin(data[1:], [0xAA, 0xB5, 0xBA]))
    for at, size in ((three, 3), (two, 2)):
        for k in range(size):
            out[at + k] = 0x20
    return out


def chunks(col: pa.Array, lower: bool = True, max_bytes: int = CHUNK_BYTES, separators: np.ndarray = _SEP, marks: bool = True, key: int = KEY) -> Iterator[Chunk]:
    """Chunks of rows with their words; without marks, typographic marks part words too."""
    data, off = buffers(col)
    for lo, hi in row_slices(off, max_bytes):
        part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        part = part if marks else without_marks(part)
        starts, ends, woff = split_words(part, o, separators)
        yield Chunk(lo, hi, part, o, starts, ends, woff, hash_runs(part, starts, ends, lower, key), key)


def windows(hashes: np.ndarray, woff: np.ndarray, k: int, key: int = KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside a row, the first word of each, and its row."""
    n, counts = len(hashes) - k + 1, np.diff(woff)
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    keep = np.flatnonzero(owner[:n] == owner[k - 1 : k - 1 + n])
    return join_hashes([hashes[j : j + n] for j in range(k)], key)[keep], keep, owner[keep]


def join_hashes(parts: list[np.ndarray], key: int = KEY) -> np.ndarray:
    """Hashes of the sequences that take one hash of each part."""
    point, h = second_key(key), np.full(len(parts[0]), len(parts), np.uint64)
    for x in parts:
        h = reduced(times(reduced(h), point) + reduced(x))
    return settled(h)
