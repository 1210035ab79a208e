"""Words, windows and their hashes over whole Arrow batches, with numpy.

A batch of texts is one array of UTF-8 bytes with row offsets. Words, lines and
windows are found and hashed for all rows at once; nothing loops over words.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_2 = 0xC2B2AE3D27D4EB4F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def process_cache(key: str, make: Callable):
    """One value per Python worker process. Functions of this package travel by
    value, so their own module globals are new in every task."""
    holder = sys.modules.setdefault("_glyphmill_worker", types.ModuleType("_glyphmill_worker"))
    if not hasattr(holder, key):
        setattr(holder, key, make())
    return getattr(holder, key)


def leave_only(*keys: str) -> None:
    """Drop what this worker keeps under keys that begin otherwise. Workers outlive
    a stage, and what one has loaded must not take memory from the next."""
    holder = sys.modules.get("_glyphmill_worker")
    for name in [n for n in (vars(holder) if holder else ()) if not n.startswith(("__", *keys))]:
        delattr(holder, name)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""

    def table(b: int, size: int) -> np.ndarray:
        out = np.full(size + 1, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def make(size: int):
        return table(base, size), table(pow(base, -1, 2**64), size)

    size = 1 << max(20, int(n).bit_length())
    if size > 1 << 22:  # one very long text: not kept
        return make(n)
    return process_cache(f"powers_{base}_{size}", lambda: make(size))


def blob(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and row offsets; a null counts as the empty text."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about ``limit`` bytes of text; a longer text is a
    piece of its own, so memory follows the longest text and not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


@dataclass(frozen=True)
class Words:
    """The words of a batch, in order: where each begins and ends in ``data``.
    ``first[r]`` to ``first[r + 1]`` are the words of row r."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_row)

    def hashes(self, base: int = BASE) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, base)


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``inside`` (a table of 256) holds; no run
    crosses a row."""
    keep = inside[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    begins[edge] = keep[edge]
    ends = keep.copy()
    ends[:-1] &= ~keep[1:]
    ends[edge - 1] = keep[edge - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of each span of bytes: equal spans have equal hashes anywhere."""
    up, down = _powers(base, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * U(BASE_2))


def window_hashes(words: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """Hash of the ``length`` word hashes from each position on; positions whose
    window passes the end get none. Rows are not looked at."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    n = len(words) - length + 1
    return mix((total[length:] - total[:-length]) * down[:n])


def fits(first: np.ndarray, length: int) -> np.ndarray:
    """Positions whose window of ``length`` words stays inside its row."""
    n = int(first[-1])
    row_end = np.repeat(first[1:], np.diff(first))
    return np.flatnonzero(np.arange(n) + length <= row_end)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's range, empty rows included."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def covered(starts: np.ndarray, length, n: int) -> np.ndarray:
    """Which of n positions lie in a span of ``length`` from any of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def binary_column(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """``data`` cut at ``bounds`` (in items) as a binary column."""
    raw = np.ascontiguousarray(data)
    at = (np.asarray(bounds) * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])
