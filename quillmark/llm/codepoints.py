"""Whole Arrow text columns as numpy code-point arrays: words, hashes and windows without per-row string calls."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

N_CODES = 0x110000
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_Q = np.uint64(0xD6E8FEB86659FD93)


def to_array(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.cast(pa.large_string())


def code_points(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows as uint32, row offsets); a null row counts as empty."""
    a = to_array(column)
    if len(a) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, offs, data = a.buffers()
    off = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = memoryview(data)[off[0] : off[-1]] if data is not None else memoryview(b"")
    off = off - off[0]
    text = str(raw, "utf-8")
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(cps) == len(raw):
        return cps, off
    starts = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])
    return cps, before[off]


def pieces(batch: pa.RecordBatch, column: int = 1, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each, one row at least: arrays stay small however long texts are."""
    a = to_array(batch.column(column))
    if not len(a):
        return
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    start = 0
    while start < len(a):
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def to_strings(cps: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.LargeStringArray:
    """The inverse of ``code_points``; rows where ``valid`` is false become null."""
    size = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(size)])[off].astype(np.int64)
    body = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(body), mask)


@lru_cache(None)
def category_table(first: str, exact: tuple[str, ...] = ()) -> np.ndarray:
    """Boolean table over all code points: general category starts with a letter of ``first`` or is in ``exact``."""
    cat = unicodedata.category
    return np.fromiter(((c := cat(chr(i)))[0] in first or c in exact for i in range(N_CODES)), bool, N_CODES)


def word_table() -> np.ndarray:
    """Letters, marks and decimal digits."""
    return category_table("LM", ("Nd",))


def spans(is_in: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values, cut at row borders."""
    n = len(is_in)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = is_in.copy()
    start[1:] &= ~is_in[:-1]
    border = off[1:-1]
    border = border[(border > 0) & (border < n)]
    start[border] = is_in[border]
    s = np.flatnonzero(start)
    stop = is_in.copy()
    stop[:-1] &= ~is_in[1:]
    stop[border - 1] = is_in[border - 1]
    return s, np.flatnonzero(stop) + 1


def rows_of(at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row of each position."""
    return np.searchsorted(off, at, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(32)
def _powers(base: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inv):
        p = np.full(room, np.uint64(b))
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _room(n: int) -> int:
    return 1 << max(10, int(n).bit_length())


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _P) -> np.ndarray:
    """Polynomial (Karp-Rabin) hashes of values[start:end], all in one prefix sum modulo 2**64."""
    power, inverse = _powers(int(base), _room(len(values) + 1))
    pre = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], dtype=np.uint64, out=pre[1:])
    return mix((pre[end] - pre[start]) * inverse[start] + (end - start).astype(np.uint64))


class Words:
    """The words of a batch of lower-cased texts: starts, ends, row of each word and its 64-bit hash."""

    def __init__(self, column: pa.Array | pa.ChunkedArray) -> None:
        self.cps, self.off = code_points(column)
        self.start, self.end = spans(word_table()[self.cps], self.off)
        self.row = rows_of(self.start, self.off)
        self.first = np.searchsorted(self.row, np.arange(len(self.off)))
        self.hash = range_hash(mix(self.cps), self.start, self.end)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of n words within one row."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[: len(self.row) - n + 1] == self.row[n - 1 :])
        return at, range_hash(self.hash, at, at + n, _Q)

    def text(self, i: int) -> str:
        return self.cps[self.start[i] : self.end[i]].tobytes().decode("utf-32-le")
