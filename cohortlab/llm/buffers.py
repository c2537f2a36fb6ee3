"""Texts as numpy arrays: whole Arrow batches at once instead of one Python object a character.

All hashes here are computed modulo 2**64 (or 2**32) with numpy's wrapping
unsigned integers, so they are the same on every machine and in every run.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

T = TypeVar("T")

#: Bytes of text handled at once; the temporary arrays take about 60 times as much.
CHUNK_BYTES = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)

_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """What tasks of one worker process share, made when it is first asked for. Only the last one is kept."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]  # type: ignore[return-value]


def forget() -> None:
    """Drop what other tasks of this worker process have kept: it would stand in memory beside the tables of this one."""
    if _kept:
        _kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), starts


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes (a longer row stands alone) and ``most`` rows each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows, rows if most is None else first + most)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        pair = []
        for b in (base, inverse):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        _powers[size] = (pair[0], pair[1])
    up, down = _powers[size]
    return up[:n], down[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * base**position over [i, j)."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    # scrambled bytes, or else small byte values would leave structure in the low bits
    np.cumsum(_BYTES[data] * up[:-1], out=out[1:])
    return out


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [start, end), the same wherever they stand; lengths are mixed in."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _PRIME)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes without ASCII white space; runs end with their row."""
    return runs(~_SPACE[data], offsets)


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are members; runs end with their row."""
    size = len(member)
    inside = np.concatenate(([False], member, [False]))
    # a row border inside a run cuts it
    change = inside[1:] != inside[:-1]
    starts = np.flatnonzero(change & inside[1:])
    ends = np.flatnonzero(change & inside[:-1])
    cut = offsets[1:-1] - offsets[0]
    cut = np.unique(cut[(cut > 0) & (cut < size)])
    cut = cut[inside[cut] & inside[cut + 1]] if len(cut) else cut
    if len(cut):
        starts = np.sort(np.concatenate((starts, cut)))
        ends = np.sort(np.concatenate((ends, cut)))
    row = np.searchsorted(offsets - offsets[0], starts, "right") - 1
    return starts, ends, row
