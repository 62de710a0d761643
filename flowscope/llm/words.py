"""Word tables of Arrow text columns, built with numpy over whole batches.

A text's words are runs of bytes that are no separators, after A-Z are lower-cased. A word's 64-bit code is a
polynomial hash of its bytes, so the code is the same in every process and every batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2_000_000
_P = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _table(separators: set[int]) -> np.ndarray:
    return np.array([i not in separators for i in range(256)])


#: Words of everything but blanks (0x20, 0x09-0x0D).
NOT_BLANK = _table({0x20, *range(0x09, 0x0E)})
#: Words of letters and digits: no byte of 00-2F, 3A-60, 7B-7F (asked after lower-casing).
ALNUM = _table({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit codes."""
    h = h ^ (h >> np.uint64(32))
    h = h * _ODD
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _P, np.uint64), np.full(n + 1, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, int(n).bit_length())
    return _powers(size)


def runs(codes: np.ndarray, n: int) -> np.ndarray:
    """The code of every ``n`` consecutive items of ``codes``."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    up, down = powers(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(codes) - n + 1] + np.uint64(n))


@dataclass
class Words:
    """Words of the texts ``first`` .. ``first + texts - 1`` of a batch; ``lower`` holds the lower-cased bytes."""

    first: int
    texts: int
    data: np.ndarray
    lower: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    text: np.ndarray
    bounds: np.ndarray

    def prefix_codes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words longer than ``size`` bytes, and codes of their first ``size`` bytes."""
        at = np.flatnonzero(self.ends - self.starts > size)
        up, down = powers(len(self.lower))
        s = self.starts[at]
        total = np.zeros(len(at), np.uint64)
        for k in range(size):
            total += (self.lower[s + k].astype(np.uint64) + np.uint64(1)) * up[k]
        return at, mix(total + np.uint64(1000 + size))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offs


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole texts in groups of about ``size`` bytes: number of the first text, bytes, offsets."""
    data, offs = buffers(column)
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, side="right")) - 1)
        b = min(b, n)
        yield a, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_tables(column: pa.Array, kind: np.ndarray, size: int = CHUNK) -> Iterator[Words]:
    for first, data, offs in chunks(column, size):
        n = len(data)
        lower = LOWER[data]
        inside = kind[lower]
        head = offs[:-1][offs[:-1] < n]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[head] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[head[head > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        up, down = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        codes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        bounds = np.searchsorted(starts, offs)
        text = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
        yield Words(first, len(offs) - 1, data, lower, offs, starts, ends, codes, text, bounds)
