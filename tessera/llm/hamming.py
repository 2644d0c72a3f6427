"""Links between 64-bit values that share a cell, without writing out all pairs of a cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LARGE = 48


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, further := root[root]):
            root = further
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def _alike(x: np.ndarray, y: np.ndarray, ratio: float) -> np.ndarray:
    return np.minimum(x, y) >= ratio * np.maximum(x, y) - 1e-9


def _search(values: np.ndarray, radius: int, sizes: np.ndarray | None = None, ratio: float = 0.0) -> np.ndarray:
    """As roots, for one large cell: a breadth-first search compares only with what isn't reached yet."""
    root, rest = np.arange(len(values)), np.arange(len(values))
    while len(rest):
        top, rest = rest[0], rest[1:]
        frontier = np.array([top])
        while len(frontier) and len(rest):
            step = max(1, 2_000_000 // len(rest))
            near = np.bitwise_count(values[frontier[:step], None] ^ values[None, rest]) <= radius
            if sizes is not None:
                near &= _alike(sizes[frontier[:step], None], sizes[None, rest], ratio)
            near = near.any(axis=0)
            root[rest[near]] = top
            frontier, rest = np.concatenate([frontier[step:], rest[near]]), rest[~near]
    return root


def forest(cells: np.ndarray, values: np.ndarray, radius: int, bound=None, sizes: np.ndarray | None = None, ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, root) that span the components of each cell; cells ascend. bound: a cheaper lower bound of the distance. With sizes, the smaller of two linked sizes is ratio times the larger or more."""
    n = len(cells)
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if n else np.zeros(0, dtype=np.int64)
    lengths = np.diff(np.append(starts, n))
    root = np.arange(n)
    for s, k in zip(starts[lengths > LARGE], lengths[lengths > LARGE], strict=True):
        root[s : s + k] = s + _search(values[s : s + k], radius, None if sizes is None else sizes[s : s + k], ratio)
    length = np.repeat(lengths, lengths)
    at = np.flatnonzero((length > 1) & (length <= LARGE))
    end = np.repeat(starts + lengths, lengths)[at]
    a, b = [], []
    for shift in range(1, LARGE):
        keep = at + shift < end
        at, end = at[keep], end[keep]
        if not len(at):
            break
        x, y = values[at], values[at + shift]
        near = np.flatnonzero(bound(x, y) <= radius) if bound else np.arange(len(at))
        near = near[np.bitwise_count(x[near] ^ y[near]) <= radius]
        if sizes is not None:
            near = near[_alike(sizes[at[near]], sizes[at[near] + shift], ratio)]
        a.append(at[near])
        b.append(at[near] + shift)
    if a:
        few = roots(n, np.concatenate(a), np.concatenate(b))
        root = np.where((length > 1) & (length <= LARGE), few, root)
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def cell_links(rows: DataFrame, radius: int, bound=None, ratio: float = 0.0) -> DataFrame:
    """rows: (cell long, id long, value long), and size long where ratio is given. Edges (a, b) of ids that span, in each cell, the values linked at radius or fewer bits.

    A cell stays in one task, but only as 24 bytes a row (32 with sizes), and yields fewer
    edges than it has rows, however many pairs it holds.
    """

    names = ["cell", "id", "value", *(["size"] if ratio else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(part: np.ndarray) -> pa.RecordBatch:
            i, j = forest(part[0], part[2].view(np.uint64), radius, bound, part[3] if ratio else None, ratio)
            return pa.RecordBatch.from_arrays([pa.array(part[1][i]), pa.array(part[1][j])], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in range(len(names))]))
            if sum(x.shape[1] for x in held) < 100_000:
                continue
            part = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(part[0], part[0][-1]))
            held = [part[:, cut:]]
            if cut:
                yield out(np.ascontiguousarray(part[:, :cut]))
        if held and held[0].shape[1]:
            yield out(np.ascontiguousarray(np.concatenate(held, axis=1)))

    return rows.select(*names).repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")
