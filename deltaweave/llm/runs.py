"""Streaming over sorted Arrow batches by runs of equal keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal (non-null) integer ``keys``; a run that spans batches comes in one piece.

    Each yielded table holds one or more complete runs. The caller's runs are bounded by construction.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        cols = [np.asarray(batch.column(k)) for k in keys]
        same = np.logical_and.reduce([c == c[-1] for c in cols])
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # start of the last run in this batch
        if last == 0:
            first = [np.asarray(held[0].column(k))[0] for k in keys]
            if len(held) > 1 and any(f != c[0] for f, c in zip([h for h in (np.asarray(held[-2].column(k))[-1] for k in keys)], cols, strict=True)):
                yield pa.Table.from_batches(held[:-1])
                held = [batch]
            del first
            continue
        head = batch.slice(0, last)
        yield pa.Table.from_batches([*held[:-1], head])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys in a table."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.chunk(0) if arr.num_chunks else pa.array([], type=arr.type)
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(arr), -1) if len(arr) else flat.reshape(0, 0)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest (pairs of positions below n) of the links a[i]-b[i]."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out
