"""Vectorised word handling over Arrow string columns.

Every function works on one flat UTF-8 buffer plus document offsets, so the
cost per word is a few numpy instructions and no Python object is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of op1/op4: everything but ASCII controls, punctuation and upper case (after lower-casing A-Z).
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of op6/op10: maximal runs without ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Chunks of this many text bytes are worked on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20


def _table(member) -> np.ndarray:
    return np.array([member(b) for b in range(256)], dtype=bool)


IS_ALNUM = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
IS_SPACE_WORD = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

#: Odd multiplier of the byte polynomial and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row stands alone."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Word spans of the documents in one chunk."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, member: np.ndarray, lower: bool = False, cuts: np.ndarray | None = None):
        """cuts: a 256 x 256 table of byte pairs between which a word ends and another begins."""
        self.data = LOWER[data] if lower else data
        self.offs = offs
        inside = member[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offs[:-1][offs[:-1] < len(data)]
        first[edges] = inside[edges]
        if cuts is not None and len(data):
            cut = cuts[self.data[:-1], self.data[1:]]
            first[1:] |= cut
            last[:-1] |= cut
        ends = offs[1:][offs[1:] > 0] - 1
        last[ends] = inside[ends]
        self.inside = inside
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: The first word of each document; one more entry than documents.
        self.first = np.searchsorted(self.start, offs)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes (polynomial modulo 2**64, then mixed)."""
        if not len(self):
            return np.zeros(0, np.uint64)
        powers, inverse = _power_tables(len(self.data) + 1)
        with np.errstate(over="ignore"):
            prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * inverse[: len(self.data)], out=prefix[1:])
            return mix((prefix[self.end] - prefix[self.start]) * powers[self.end - 1])

    def values(self) -> pa.Array:
        """The words themselves as one Arrow binary array."""
        lengths = self.end - self.start
        offs = np.zeros(len(self) + 1, np.int64)
        np.cumsum(lengths, out=offs[1:])
        body = np.ascontiguousarray(self.data[self.inside])
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offs), pa.py_buffer(body)])


def windows(hashes: np.ndarray, size: int, multiplier: int) -> np.ndarray:
    """Rabin-Karp hashes (modulo 2**64, mixed) of all `size` consecutive words.

    Built by doubling: the hash of 2n words is that of the first n times
    multiplier**n plus that of the next n.
    """
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        block, span = hashes, 1
        for bit in bin(size)[3:]:
            block = block[:-span] * np.uint64(pow(multiplier, span, 1 << 64)) + block[span:]
            span *= 2
            if bit == "1":
                block = block[:-1] * np.uint64(multiplier) + hashes[span:]
                span += 1
        return mix(block)
