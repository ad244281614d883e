"""Whole-batch text kernels over Arrow string columns.

Everything works on the byte buffer of many documents at once, so cost per document is a few
vectorised passes and there is no Python loop over characters or tokens. A *token* is a maximal
run of ASCII letters and digits or of bytes above 0x7F (letters of other scripts), after lower
casing. A null text behaves like an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` over a task's batches; what the task freed then goes back to the system, as a worker lives on between tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return task


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_INV = U64(_inverse(int(_BASE)))
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_MULT = np.random.default_rng(7).integers(1, 1 << 63, 512, dtype=np.uint64) * U64(2) + U64(1)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

_powers = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """One large_string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.large_string()), "")


def spans(array: pa.LargeStringArray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges holding about `most` bytes each (one row at least), so that temporaries stay small."""
    ends = offsets(array)[1:]
    lo, n = 0, len(array)
    start = offsets(array)[0]
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, start + most, side="right")))
        yield lo, hi
        start, lo = ends[hi - 1], hi


def offsets(array: pa.LargeStringArray) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]


def raw(array: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows in a row, and the n + 1 places where rows begin."""
    at = offsets(array)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


@dataclass
class Tokens:
    """Tokens of several documents: where they are in `data`, their document, their 64-bit hash."""

    data: np.ndarray
    row_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each document's first token, with one more at the end


def tokenize(array: pa.LargeStringArray) -> Tokens:
    data, at = raw(pc.utf8_lower(array))
    n = len(array)
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = _WORD[data]
    edge = np.diff(word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a token never runs over the border between two documents
    inner = at[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    if len(inner) and len(start):
        cut = inner[(word[inner] == 1) & (word[inner + 1] == 1)]
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    doc = np.searchsorted(at, start, side="right") - 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    h = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * GOLDEN)
    first = np.searchsorted(doc, np.arange(n + 1))
    return Tokens(data, at, start, end, doc, h, first)


def ngram_hashes(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of k tokens; a document of fewer tokens gives its whole run."""
    n = len(t.hash)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    last = t.first[1:][t.doc]
    i = np.arange(n)
    keep = (i + k <= last) | (i == t.first[t.doc])
    i, last = i[keep], last[keep]
    s = np.zeros(len(i), np.uint64)
    for j in range(k):
        p = i + j
        s += np.where(p < last, t.hash[np.minimum(p, n - 1)], U64(0)) * _MULT[j]
    return t.doc[i], mix64(s)


def document_hashes(t: Tokens, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's token sequence."""
    n = len(t.hash)
    up, down = powers(n + 1)
    out = []
    for salt in (U64(0), GOLDEN):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((mix64(t.hash + salt) if salt else t.hash) * up[:n], out=total[1:])
        a, b = t.first[:-1], t.first[1:]
        out.append(mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * GOLDEN + salt))
    return out[0][:docs], out[1][:docs]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def fold(array: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts in lower case, each run of other characters than letters and digits (of any script) one space.

    Each row that has any ends in one space. Returns the code points and the n + 1 places where rows begin.
    """
    data, at = raw(pc.utf8_lower(array))
    if not len(array):
        return np.empty(0, np.uint32), at
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    end = np.zeros(len(points) + len(array), bool)
    whole = np.full(len(end), 32, np.uint32)
    row = np.repeat(np.arange(len(array)), np.diff(at))
    whole[np.arange(len(points)) + row] = np.where(_letters()[points], points, 32)
    end[at[1:] + np.arange(len(array))] = True
    begin = np.concatenate([[True], end[:-1]])
    space = whole == 32
    after_space = np.concatenate([[True], space[:-1]])
    keep = ~(space & (after_space | begin))
    kept = np.concatenate([[0], np.cumsum(keep)])
    return whole[keep], kept[np.concatenate([[0], at[1:] + np.arange(1, len(array) + 1)])]


def low_bytes(points: np.ndarray) -> np.ndarray:
    """One byte a code point, the same for the same one; ASCII as it is."""
    return (points ^ (points >> np.uint32(7)) * np.uint32(29)).astype(np.uint8)
