"""Vectorised word hashing of whole Arrow string columns with numpy: no Python code runs per word.

A column's texts lie end to end in one byte buffer. A prefix sum of byte values times powers of an odd base, modulo
2^64, gives the polynomial hash of any byte range in O(1); a finaliser then mixes it with the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
#: Text bytes handled at a time; numpy's temporaries take about 60 times as much.
SLICE_BYTES = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

WORD = np.ones(256, bool)
WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: ASCII letters and digits, and all bytes of other characters.
ALNUM = np.array([chr(i).isalnum() or i >= 128 for i in range(128)] + [True] * 128)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply and shift rounds), a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, SLICE_BYTES + 65536), base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text, one row at least."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("")


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of bytes that are inside, none across texts; offsets: where texts begin and end."""
    edge = np.zeros(len(inside) + 1, np.int8)
    if len(inside) > 1:
        edge[1:-1] = inside[1:].view(np.int8) - inside[:-1].view(np.int8)
    begin, stop = edge == 1, edge == -1
    if len(inside):
        begin[0], stop[-1] = inside[0], inside[-1]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(inside))]
        both = inner[inside[inner] & inside[inner - 1]]
        begin[both] = stop[both] = True
    return np.flatnonzero(begin), np.flatnonzero(stop)


def lowered(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the Latin-1 capitals in lower case; no length changes."""
    out = _LOWER[raw]
    if len(out) > 1:
        out[1:][(out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)] += 32
    return out


class Words:
    """The words of a slice of texts.

    hash: uint64 a word; row: its text's index; start, end: byte offsets in the text; count: words of each text;
    first: index of each text's first word.
    """

    def __init__(self, texts: pa.Array, kind: np.ndarray = WORD, lower: bool | str = True):
        n = len(texts)
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        base = int(offsets[0])
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[base : int(offsets[-1])] if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets = offsets - base
        raw = lowered(self.bytes) if lower == "latin" else _LOWER[self.bytes] if lower else self.bytes
        self.start, self.end = runs(kind[raw], offsets)
        power, inverse = _power(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, U)
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
        self._sums, self._inverse = sums, inverse
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(U))
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]])

    def spans(self, first: np.ndarray, last: np.ndarray, salt: int) -> np.ndarray:
        """Hash of the words from first to before last, for any spans (1 word or more), in constant time each."""
        power, inverse = _power(len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, U)
        np.cumsum(mix(self.hash ^ U(salt)) * power[: len(self.hash)], out=sums[1:])
        return mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(U))

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the first k bytes, and index, of each word with more than k bytes."""
        at = np.flatnonzero(self.end - self.start > k)
        start = self.start[at]
        return mix((self._sums[start + k] - self._sums[start]) * self._inverse[start] + U((k << 32) + 1)), at

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of each window of k words."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        h = np.full(n, U(k))
        for j in range(k):
            h = h * U(0xD6E8FEB86659FD93) + self.hash[j : j + n]
            if j % 2:
                h ^= h >> U(32)
        inside = self.row[:n] == self.row[k - 1 :]
        return mix(h)[inside], self.row[:n][inside]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows of k words, and for texts of 1 to k-1 words the whole sequence as one; grouped by text, in its order."""
        parts = [self.windows(k)]
        for c in range(1, k):
            rows = np.flatnonzero(self.count == c)
            if len(rows):
                h = np.full(len(rows), U(c))
                for j in range(c):
                    h = h * U(0xD6E8FEB86659FD93) + self.hash[self.first[rows] + j]
                    if j % 2:
                        h ^= h >> U(32)
                parts.append((mix(h ^ U(c)), rows))
        h, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(row, kind="stable")
        return h[order], row[order]


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted by text, then hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]
