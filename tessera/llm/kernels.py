"""Vectorised byte kernels that the operators on texts share.

All of them work on Arrow string arrays without making a Python object per
word. A batch is cut into blocks of whole documents of about BLOCK bytes, so
the working memory stays bounded; a single longer document is a block alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_MIX1, _MIX2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on unsigned 64-bit values."""
    h = h ^ (h >> _U(33))
    h = h * _MIX1
    h = h ^ (h >> _U(33))
    h = h * _MIX2
    return h ^ (h >> _U(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1]


#: What drops a worker's caches. A worker serves all stages of a session, and caches of one must not add to the memory of the next.
CACHES: list[Callable[[], None]] = []


class Block(NamedTuple):
    """Documents first..last-1 of a batch: their bytes, and where each begins and ends."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[Block]:
    """The texts of a string column (null: empty) as blocks of bytes."""
    if CACHES:
        while CACHES:
            CACHES.pop()()
        pa.default_memory_pool().release_unused()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield Block(at, upto, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at])
        at = upto


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, broken at document bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and x09 to x0D."""
    return runs(~_BLANKS[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the lines between line feeds; an empty text has one empty line."""
    cuts = np.flatnonzero(data == 10)
    at = np.concatenate([offsets[:-1], cuts + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), owners(cuts, offsets)])
    order = np.lexsort((at, doc))
    starts, doc = at[order], doc[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.ones(len(doc), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    ends[last] = offsets[1:][doc[last]]
    return starts, ends, doc


def owners(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The document that each byte position lies in."""
    return np.searchsorted(offsets, positions, side="right") - 1


class Hasher:
    """64-bit hashes of any byte ranges of one block, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        powers, self._inverse = _powers_to(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * powers[: len(data)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _MIX2)


#: Each byte's 8 bits, a byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of consecutive groups of n (1 or more) 64-bit values: the bits that more than half of a group have.

    Eight bits are counted in one addition, a byte each; so a group is added up in parts of 255.
    """
    if not len(n):
        return np.zeros(0, dtype=np.uint64)
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    at = np.repeat(np.cumsum(n) - n, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    bytes_, out = hashes.view(np.uint8).reshape(-1, 8), np.empty((len(n), 8), dtype=np.uint8)
    for k in range(8):
        ones = np.add.reduceat(_LANES[bytes_[:, k]], at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
        out[:, k] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64)[:, 0]


def sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by ascending group number, as int64."""
    return np.bincount(groups, weights=values, minlength=n).astype(np.int64) if len(values) else np.zeros(n, dtype=np.int64)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, dtype=bool)
    ordered = keys[order]
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.empty(len(keys), dtype=bool)
    out[order] = same[:-1] | same[1:]
    return out


def earlier(keys: np.ndarray) -> np.ndarray:
    """Which keys equal one that stands before them."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), dtype=bool)
    ordered = keys[order]
    same[1:] = ordered[1:] == ordered[:-1]
    out = np.empty(len(keys), dtype=bool)
    out[order] = same
    return out
