"""Bit strings as struct(data binary, nbits int): the value is the first ``nbits`` bits of ``data``, the rest are zero.

Spark has no operators on binaries of any length, so these are Arrow-batched pandas UDFs on arbitrary-precision integers;
they run only where a program uses bit strings.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "data binary, nbits int"


def _read(data: bytes, n: int) -> int:
    return int.from_bytes(data, "big") >> (8 * len(data) - n) if n else 0


def _pack(value: int, n: int) -> tuple[bytes, int]:
    size = (n + 7) // 8
    return (value << (8 * size - n)).to_bytes(size, "big") if n else b"", n


def _lift(fn: Callable) -> Callable[..., Column]:
    """fn gets (value, bits) for each bit string, then plain integers."""

    def over(bit_cols: list[Column], ints: list[Column]) -> Column:
        k = len(bit_cols)

        @F.pandas_udf(SCHEMA)
        def run(*cols: pd.Series) -> pd.DataFrame:
            out = []
            for row in zip(*cols, strict=True):
                if any(x is None or x != x for x in row):
                    out.append((None, None))
                    continue
                pairs = [(_read(bytes(row[2 * i]), int(row[2 * i + 1])), int(row[2 * i + 1])) for i in range(k)]
                out.append(_pack(*fn(*pairs, *(int(x) for x in row[2 * k :]))))
            return pd.DataFrame(out, columns=["data", "nbits"])

        return run(*(x for b in bit_cols for x in (b["data"], b["nbits"])), *(c.cast("long") for c in ints))

    return over


def _short(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int, int]:
    """Both values cut to the shorter length."""
    n = min(a[1], b[1])
    return a[0] >> (a[1] - n), b[0] >> (b[1] - n), n


def _both(op: Callable[[int, int], int]) -> Callable:
    def run(a, b):
        x, y, n = _short(a, b)
        return op(x, y), n

    return run


def _rotate(a: tuple[int, int], k: int) -> tuple[int, int]:
    v, n = a
    if not n:
        return a
    k %= n
    return ((v << k) | (v >> (n - k))) & ((1 << n) - 1), n


def _sliced(a: tuple[int, int], lo: int, hi: int, step: int) -> tuple[int, int]:
    chosen = format(a[0], f"0{a[1]}b")[lo:hi:step] if a[1] else ""
    return int(chosen or "0", 2), len(chosen)


def bit_and(a: Column, b: Column) -> Column:
    return _lift(_both(lambda x, y: x & y))([a, b], [])


def bit_or(a: Column, b: Column) -> Column:
    return _lift(_both(lambda x, y: x | y))([a, b], [])


def bit_xor(a: Column, b: Column) -> Column:
    return _lift(_both(lambda x, y: x ^ y))([a, b], [])


def bit_not(a: Column) -> Column:
    return _lift(lambda a: (a[0] ^ ((1 << a[1]) - 1), a[1]))([a], [])


def bit_concat(a: Column, b: Column) -> Column:
    return _lift(lambda a, b: ((a[0] << b[1]) | b[0], a[1] + b[1]))([a, b], [])


def bit_shl(a: Column, n: Column) -> Column:
    """Appends zero bits, so the value grows."""
    return _lift(lambda a, k: (a[0] << k, a[1] + k))([a], [n])


def bit_shr(a: Column, n: Column) -> Column:
    """Drops leading bits, so the value shrinks."""
    return _lift(lambda a, k: (a[0] & ((1 << max(0, a[1] - k)) - 1), max(0, a[1] - k)))([a], [n])


def bit_rotl(a: Column, n: Column) -> Column:
    return _lift(_rotate)([a], [n])


def bit_rotr(a: Column, n: Column) -> Column:
    return _lift(lambda a, k: _rotate(a, -k))([a], [n])


def bit_slice(a: Column, lo: Column, hi: Column, step: Column) -> Column:
    return _lift(_sliced)([a], [lo, hi, step])
