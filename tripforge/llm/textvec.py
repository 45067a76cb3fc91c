"""Words, hashes and shingles of whole Arrow batches of text, vectorised over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 2 << 20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of the public splitmix64 generator)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _STEP), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 8 * _STEP:
            _powers[base] = have
    return have[:n]


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The offsets (one more than rows) and bytes of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    n, (_, offs, data) = len(col), col.buffers()
    at = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20, rows: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most `rows` rows and about `most` bytes of text
    each, but at least a row."""
    for batch in batches:
        offs, data = flat(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
            j = min(j, i + rows)
            yield batch.slice(i, j - i), offs[i : j + 1] - offs[i], data[offs[i] : offs[j]]
            i = j


def byte_table(separators: list[tuple[int, int]]) -> np.ndarray:
    """Maps separator bytes to 0 and A-Z to a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    for a, b in separators:
        t[a : b + 1] = 0
    return t


#: Words are runs of digits, ASCII letters and everything from U+0080 on.
ALNUM = byte_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


class Words:
    """The words of a batch: start, end (byte offsets), doc (row number), first (word
    number of each row's first word, one more than rows) and a 64-bit hash each."""

    def __init__(self, offs: np.ndarray, data: np.ndarray, lut: np.ndarray = ALNUM, separator: np.ndarray | None = None):
        b = self.bytes = lut[data]
        w = b != 0 if separator is None else ~separator[data]
        lo = offs[:-1][offs[:-1] < offs[1:]]
        edge = np.empty(len(w), bool)
        edge[:1] = True
        np.logical_not(w[:-1], out=edge[1:])
        edge[lo] = True
        self.start = np.flatnonzero(edge & w)
        edge[:-1] = ~w[1:]
        edge[-1:] = True
        edge[lo[1:] - 1] = True
        self.end = np.flatnonzero(edge & w) + 1
        self.first = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        self.hash = span_hashes(b, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The word number and the hash of every run of n words within a row."""
        k = len(self) - n + 1
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[:k] == self.doc[n - 1 :])
        return at, run_hashes(self.hash, at, n)


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(b) + 1, U)
    np.multiply(b.astype(U) + U(1), powers(_BASE, len(b)), out=total[1:])
    np.add.accumulate(total, out=total)
    return mix((total[end] - total[start]) * powers(_INVERSE, len(b) + 1)[start])


def run_hashes(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = h[at].copy()
    for i in range(1, n):
        out *= U(0xD6E8FEB86659FD93)
        out += h[at + i]
    return mix(out + U(n))


def word_list(text: str) -> list[bytes]:
    """The words of one text, by the same rule."""
    return [x for x in ALNUM[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes().split(b"\0") if x]
