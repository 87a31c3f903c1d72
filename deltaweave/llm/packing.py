"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

Every document is cut into full windows and a remainder, and remainders into pieces of at most a third of a window, since
small parts balance better. Pieces are gathered, in groups of bounded size, and each group is divided over k = ceil(tokens / window) windows: every piece begins as a partial k-way partition, the two
partial partitions with the widest spread are merged largest against smallest, and the difference is kept, until one
partition is left. If a window exceeds the capacity, k rises by one and the group is divided again.

No shuffle is needed: groups never span partitions, and a partition is a stream of groups, so memory is bounded by the
group and one document. Padding is at most about one window per group or partition.

Defined cases: a null text is empty (only the end id); repeated doc_ids are separate documents; a null doc_id stays null;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import default_vocabulary, encode_documents

WINDOW = 1024
#: Pieces divided together; bounds the time and memory of one differencing.
GROUP = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0..k-1) of each item by k-way differencing."""
    n = len(sizes)
    if k == 1 or n <= 1:
        return np.zeros(n, dtype=np.int64)
    vectors: list[np.ndarray | None] = [None] * n
    children: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    zero_down = np.arange(k)

    def vector(i: int) -> np.ndarray:  # descending
        if i < n and vectors[i] is None:
            v = np.zeros(k, dtype=np.int64)
            v[0] = sizes[i]
            return v
        return vectors[i]

    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = vector(a) + vector(b)[::-1]  # largest against smallest
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        vectors[a] = vectors[b] = None
        vectors.append(total)
        children.append((a, b, order, k - 1 - order))
        heapq.heappush(heap, (-int(total[0]), len(vectors) - 1))
    slots: dict[int, np.ndarray] = {len(vectors) - 1: zero_down}
    out = np.zeros(n, dtype=np.int64)
    for j in range(len(children) - 1, -1, -1):
        a, b, at_a, at_b = children[j]
        window = slots.pop(n + j)
        for child, at in ((a, at_a), (b, at_b)):
            mine = np.empty(k, dtype=np.int64)
            mine[at] = window
            if child < n:
                out[child] = mine[0]
            else:
                slots[child] = mine
    return out


def divide(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of near-equal totals, none over ``capacity``: their number rises until all fit."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, weights=sizes, minlength=k).max() <= capacity:
            return window, k
        k += 1


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, group: int = GROUP, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it comes from in its document, and its sequence and offset there.

    ``with_ids`` adds the piece's ids (little-endian unsigned 32 bit). Sequence ids are unique and depend only on the
    partition and its order, so a lost task gives the same ones again.
    """
    vocabulary = vocabulary or default_vocabulary()
    kinds = [(f.split()[0], pa.int64()) for f in PIECES.split(", ")] + [("ids", pa.binary())] * with_ids

    third = max(1, window // 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        rest: list[tuple] = []

        def piece(doc_id, ids, start, n, at, seq, offset) -> tuple:
            return (doc_id, start, n, zlib.crc32(ids), at, seq, offset) + ((ids,) if with_ids else ())

        def settle() -> None:
            nonlocal sequence
            windows, k = divide(np.asarray([len(r[1]) // 4 for r in rest], dtype=np.int64), window)
            filled = [0] * k
            used = {w: i for i, w in enumerate(sorted(set(windows.tolist())))}
            for (doc_id, ids, start, total), w in zip(rest, windows.tolist(), strict=True):
                n = len(ids) // 4
                out.append(piece(doc_id, ids, start, n, total, sequence + used[w], filled[w]))
                filled[w] += n
            sequence += len(used)
            rest.clear()

        def flush() -> pa.RecordBatch:
            cols = zip(*out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, (_, kind) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])
            out.clear()
            return batch

        for batch in slices(batches):
            encoded = encode_documents(vocabulary, batch.column("text").to_pylist(), end_id)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                total = len(ids) // 4
                full = total // window * window
                for start in range(0, full, window):
                    out.append(piece(doc_id, ids[4 * start : 4 * (start + window)], start, window, total, sequence, 0))
                    sequence += 1
                for start in range(full, total, third):
                    rest.append((doc_id, ids[4 * start : 4 * (start + third)], start, total))
                if len(rest) >= group:
                    settle()
                if len(out) >= (1_000 if with_ids else 20_000):
                    yield flush()
        if rest:
            settle()
        if out:
            yield flush()

    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
