"""Aggregate primitives over (value, weight)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang.types import F64, I64, INTEGER, NUMERIC, Type, spark_type

BYTES = Type("bytes")
#: Fixed names: primitive -> (kind, argument type, result type).
PRIMITIVES: dict[str, tuple[str, Type | None, Type]] = {
    "std.agg_sum_i64": ("sum", I64, I64),
    "std.agg_sum_integer": ("sum", INTEGER, INTEGER),
    "std.agg_sum_numeric": ("sum", NUMERIC, NUMERIC),
    "std.agg_sum_f64": ("sum", F64, F64),
    "std.agg_count": ("count", None, INTEGER),
    "std.agg_avg_integer": ("avg", INTEGER, INTEGER),
    **{f"std.agg_{k}_{t.name}": (k, t, t) for k in ("min", "max") for t in (I64, INTEGER, NUMERIC, F64)},
    "std.agg_xor_bytes": ("xor", BYTES, BYTES),
}


@dataclass
class Aggregate:
    """One primitive over ``argument`` (None for count). ``type`` is its result type, None to keep Spark's."""

    kind: str
    argument: Column | None = None
    type: Type | None = None

    @property
    def needs_values(self) -> bool:
        return self.kind in ("min", "max")

    @property
    def may_be_missing(self) -> bool:
        return self.kind in ("min", "max", "avg", "xor")


def agg_sum(c: Column | str, type: Type | None = None) -> Aggregate:
    return Aggregate("sum", F.col(c) if isinstance(c, str) else c, type)


def agg_count() -> Aggregate:
    return Aggregate("count")


def agg_avg(c: Column | str) -> Aggregate:
    """floor(sum / count), as integers."""
    return Aggregate("avg", F.col(c) if isinstance(c, str) else c)


def agg_min(c: Column | str) -> Aggregate:
    return Aggregate("min", F.col(c) if isinstance(c, str) else c)


def agg_max(c: Column | str) -> Aggregate:
    return Aggregate("max", F.col(c) if isinstance(c, str) else c)


def agg_xor(c: Column | str) -> Aggregate:
    return Aggregate("xor", F.col(c) if isinstance(c, str) else c)


def _exact(x: Column, t: Type | None) -> Column:
    """Machine integers are summed as decimals, which do not overflow where bigint would raise."""
    return x.cast("decimal(38,0)") if t is not None and t.name == "i64" else x


def merged(a: Aggregate, x: Column | None, w: Column, unit: bool) -> Column:
    """The Spark aggregate of a primitive."""
    if a.kind == "count":
        return F.sum(w) if not unit else F.count(F.lit(1))
    if a.kind == "sum":
        v = _exact(x, a.type)
        return F.sum(v if unit else v * w)
    if a.kind == "avg":
        v = x.cast("decimal(38,0)")
        total = F.sum(v if unit else v * w)
        n = F.sum(F.when(x.isNotNull(), w))
        return F.when(n != 0, _floor_div(total, n))
    if a.kind in ("min", "max"):
        v = x if unit else F.when(w > 0, x)
        if a.type is not None and a.type.name == "f64":
            v = F.when(~F.isnan(v), v)
        return F.min(v) if a.kind == "min" else F.max(v)
    raise ValueError(a.kind)  # xor is computed by words, see ZSet.aggregate


def _floor_div(total: Column, n: Column) -> Column:
    """floor(total / n) without rounding: the remainder decides."""
    n = n.cast("decimal(38,0)")
    r = total % n
    down = F.when((r != 0) & ((r < 0) != (n < 0)), 1).otherwise(0)
    return ((total - r) / n).cast("decimal(38,0)") - down


#: Hex digits of a value that one bigint XORs.
WORD_DIGITS = 15


def xor_words(df: DataFrame, keys: list[str], x: Column, w: Column) -> DataFrame:
    """keys and ``__xor``: byte-wise XOR of the values of odd weight, empty if there are none.

    Values of different lengths, whatever their weights, leave no result. Values are cut into words that fit a bigint, which
    are XOR-ed by (keys, place): a partial aggregate, no lists.
    """
    known = df.select(*keys, F.hex(x).alias("__h"), (F.pmod(w, F.lit(2)) == 1).alias("__odd")).where(F.col("__h").isNotNull())
    places = F.sequence(F.lit(0), F.greatest(F.floor((F.length("__h") - 1) / WORD_DIGITS), F.lit(0)).cast("int"))
    words = known.select(*keys, F.length("__h").alias("__l"), "__h", "__odd", F.explode(places).alias("__at"))
    word = F.conv(F.rpad(F.substring("__h", F.col("__at") * WORD_DIGITS + 1, F.lit(WORD_DIGITS)), WORD_DIGITS, "0"), 16, 10).cast("long")
    words = words.select(*keys, "__l", "__at", "__odd", F.when(F.col("__odd"), word).otherwise(0).alias("__v"))
    each = words.groupBy(*keys, "__at").agg(F.bit_xor("__v").alias("__v"), F.min("__l").alias("__lo"), F.max("__l").alias("__hi"), F.max("__odd").alias("__odd"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__at", F.lpad(F.hex("__v"), WORD_DIGITS, "0").alias("t")))), lambda e: e["t"]), "")
    out = each.groupBy(*keys).agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.max("__odd").alias("__odd"), text.alias("__t"))
    value = F.when(F.col("__odd"), F.unhex(F.substring("__t", F.lit(1), F.col("__hi")))).otherwise(F.unhex(F.lit("")))
    return out.where("__lo = __hi").select(*keys, value.alias("__xor"))


def finish(a: Aggregate, c: Column) -> Column:
    """Cast a primitive's result to its type."""
    if a.type is None:
        return c
    return c.cast(spark_type(a.type))
