"""Queries over the function library, the numeric primitives and the remaining operators, each with the same query in SQL.

A query is a table of its expressions: output column, expression over the row ``r``, its type, and the same in SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.aggregates import agg_count, agg_max, agg_min, agg_sum
from .operators import replay
from .operators.zset import W
from .plans.circuit import Plan, run
from .queries import _DAYS, CLOSURE, _log, _tree, cents, query, table

S, B = 'string("UTF-8")', 'enum("false","true")'
Cases = dict[str, tuple[str, str, str]]


def plain(df: DataFrame) -> DataFrame:
    """Integers of 38 digits as bigint, numerics in millionths, bytes in hexadecimal."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            out[f.name] = (F.col(f.name) * 1_000_000 if f.dataType.scale else F.col(f.name)).cast("long")
        elif isinstance(f.dataType, T.BinaryType):
            out[f.name] = F.hex(f.name)
    return df.withColumns(out) if out else df


def program(fields: dict[str, str], cases: Cases) -> str:
    row = "struct(" + ", ".join(f'"{k}": {v}' for k, v in fields.items()) + ")"
    out = "struct(" + ", ".join(f'"{k}": {c[1]}' for k, c in cases.items()) + ")"
    body = ", ".join(f'"{k}": {c[0]}' for k, c in cases.items())
    return f'src := source("t")\nsrc :: stream({row})\nf :: function(({row}) -> {out})\nf := function((r) -> struct({body}))\nout := map(src, f)\n'


def library(name: str, source: str, fields: dict[str, str], cases: Cases, where: str = "", prepare=lambda df: df) -> None:
    """Register a query that maps ``cases`` over a table; ``r.n7`` is the machine integer 7, as literals are integers."""
    numbers = sorted({int(n) for c in cases.values() for n in re.findall(r"\br\.n(\d+)\b", c[0])})
    fields = fields | {f"n{n}": "i64" for n in numbers}
    sql = "SELECT " + ", ".join(f'{c[2]} AS "{k}"' for k, c in cases.items()) + f" FROM {source}" + (f" WHERE {where}" if where else "")

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(run(spark, program(fields, cases), {"t": prepare(spark.read.parquet(f"{sf_dir}/{source}.parquet")).withColumns({f"n{n}": F.lit(n).cast("long") for n in numbers})}, "out"))

    f.__name__ = name
    query(sql)(f)


library(
    "lib_strings",
    "customer",
    {"c_custkey": "i64", "c_name": S, "c_mktsegment": S},
    {
        "k": ("r.c_custkey", "i64", "c_custkey"),
        "trim": ('std.string_trim(" " ++ r.c_name ++ "  ")', S, "c_name"),
        "ltrim": ('std.string_ltrim(" " ++ r.c_name ++ " ")', S, "c_name || ' '"),
        "rtrim": ('std.string_rtrim(" " ++ r.c_name ++ " ")', S, "' ' || c_name"),
        "starts": ('std.string_starts_with(r.c_mktsegment, prefix: "BU")', B, "starts_with(c_mktsegment, 'BU')"),
        "ends": ('std.string_ends_with(r.c_mktsegment, suffix: "E")', B, "ends_with(c_mktsegment, 'E')"),
        "sub1": ("std.string_substring(r.c_name, start: r.n3)", S, "substr(c_name, 4)"),
        "sub2": ("std.string_substring(r.c_name, start: r.n2, length: r.n5)", S, "substr(c_name, 3, 5)"),
        "at": ("std.string_at(r.c_name, r.n1)", S, "substr(c_name, 2, 1)"),
        "last": ("r.c_name[-1]", S, "right(c_name, 1)"),
        "parts": ('std.array_size(std.string_split(r.c_mktsegment, delimiter: "I"))', "integer", "len(string_split(c_mktsegment, 'I'))::BIGINT"),
        "eq": ("std.string_eq(r.c_name, std.string_upper(r.c_name))", B, "c_name = upper(c_name)"),
        "neq": ("std.string_neq(r.c_name, r.c_mktsegment)", B, "c_name <> c_mktsegment"),
        "lt": ('std.string_lt(r.c_mktsegment, "FZ")', B, "c_mktsegment < 'FZ'"),
        "gte": ('std.string_gte(r.c_mktsegment, "HOUSEHOLD")', B, "c_mktsegment >= 'HOUSEHOLD'"),
        "lte": ('std.string_lte(r.c_mktsegment, "HOUSEHOLD")', B, "c_mktsegment <= 'HOUSEHOLD'"),
        "gt": ("std.string_gt(r.c_mktsegment, r.c_name)", B, "c_mktsegment > c_name"),
    },
)

library(
    "slice_steps",
    "customer",
    {"c_custkey": "i64", "c_mktsegment": S},
    {
        "k": ("r.c_custkey", "i64", "c_custkey"),
        "odd": ("r.c_mktsegment[1:9:2]", S, "substr(c_mktsegment, 2, 1) || substr(c_mktsegment, 4, 1) || substr(c_mktsegment, 6, 1) || substr(c_mktsegment, 8, 1)"),
        "back": ("r.c_mktsegment[4:1:-1]", S, "reverse(substr(c_mktsegment, 2, 3))"),
        "skip": ("r.c_mktsegment[5:1:-2]", S, "substr(c_mktsegment, 4, 1) || substr(c_mktsegment, 2, 1)"),
        "past": ("r.c_mktsegment[3:99]", S, "substr(c_mktsegment, 4)"),
        "none": ("r.c_mktsegment[4:2]", S, "''"),
        "sl1": ("std.string_slice(r.c_mktsegment, stop: r.n4)", S, "substr(c_mktsegment, 1, 4)"),
        "sl3": ("std.string_slice(r.c_mktsegment, start: r.n0, stop: r.n5, step: r.n4)", S, "substr(c_mktsegment, 1, 1) || substr(c_mktsegment, 5, 1)"),
    },
)

_PARTS = "string_split(event_type, 'i')"
library(
    "lib_arrays",
    "events",
    {"event_id": "i64", "user_id": "i64", "event_type": S},
    {
        "k": ("r.event_id", "i64", "event_id"),
        "size": ('std.array_size(std.array_append(std.string_split(r.event_type, delimiter: "i"), r.event_type))', "integer", f"(len({_PARTS}) + 1)::BIGINT"),
        "first": ('std.array_at(std.array_prepend(r.event_type, std.string_split(r.event_type, delimiter: "i")), r.n0)', S, "event_type"),
        "has": ("std.array_contains([r.event_id, r.user_id], r.n7)", B, "list_contains([event_id, user_id], 7)"),
        "least": ("std.array_sort([r.event_id, r.user_id, r.n50])[0]", "i64", "least(event_id, user_id, 50)"),
        "reversed": ("std.array_reverse([r.event_id, r.user_id])[0]", "i64", "user_id"),
        "joined": ("std.array_size([r.event_id] ++ [r.user_id, r.user_id])", "integer", "3::BIGINT"),
        "last": ("[r.event_id, r.user_id][-1]", "i64", "user_id"),
        "cut": ("[r.event_id, r.user_id, r.n5, r.n6][1:4:2][1]", "i64", "6::BIGINT"),
        "back": ("[r.event_id, r.user_id, r.n5, r.n6][3:0:-1][0]", "i64", "5::BIGINT"),
        "slice": ("std.array_size(std.array_slice([r.event_id, r.user_id, r.n5], start: r.n1, stop: r.n9))", "integer", "2::BIGINT"),
    },
)

library(
    "lib_maps",
    "events",
    {"event_id": "i64", "user_id": "i64", "event_type": S},
    {
        "k": ("r.event_id", "i64", "event_id"),
        "size": ("std.map_size({a: r.event_id, b: r.user_id})", "integer", "2::BIGINT"),
        "keys": ("std.array_sort(std.map_keys({b: r.event_id, a: r.user_id}))[0]", S, "'a'"),
        "values": ("std.array_sort(std.map_values({a: r.event_id, b: r.user_id}))[1]", "i64", "greatest(event_id, user_id)"),
        "has": ('std.map_has({click: 1}, key: r.event_type)', B, "event_type = 'click'"),
        "get": ('std.map_get({a: r.event_id, b: r.user_id}, key: "b")', "i64", "user_id"),
        "sub": ('{a: r.event_id}["a"]', "i64", "event_id"),
        "without": ('std.map_size(std.map_without({a: 1, b: 2, c: 3}, keys: ["a", "z"]))', "integer", "2::BIGINT"),
        "merged": ('std.map_merge({a: r.event_id, b: r.n1}, {a: r.user_id})["a"]', "i64", "user_id"),
    },
)

library(
    "lib_bytes",
    "customer",
    {"c_custkey": "i64", "b": "bytes"},
    {
        "k": ("r.c_custkey", "i64", "c_custkey"),
        "size": ("std.bytes_size(r.b)", "integer", "octet_length(c_name::BLOB)"),
        "at": ("std.bytes_at(r.b, r.n4)", "i64", "ascii(substr(c_name, 5, 1))::BIGINT"),
        "cut": ("r.b[2:6]", "bytes", "hex(substr(c_name, 3, 4)::BLOB)"),
        "step": ("std.bytes_slice(r.b, start: r.n0, stop: r.n5, step: r.n2)", "bytes", "hex((substr(c_name, 1, 1) || substr(c_name, 3, 1) || substr(c_name, 5, 1))::BLOB)"),
        "back": ("r.b[4:1:-1]", "bytes", "hex(reverse(substr(c_name, 3, 3))::BLOB)"),
        "joined": ("r.b ++ r.b[0:1]", "bytes", "hex((c_name || substr(c_name, 1, 1))::BLOB)"),
        "eq": ("std.bytes_eq(r.b, r.b[0:18])", B, "c_name = substr(c_name, 1, 18)"),
        "neq": ("std.bytes_neq(r.b, r.b ++ r.b)", B, "true"),
        "lt": ("std.bytes_lt(r.b[17:18], r.b[16:17])", B, "substr(c_name, 18, 1) < substr(c_name, 17, 1)"),
        "gte": ("std.bytes_gte(r.b[17:18], r.b[16:17])", B, "substr(c_name, 18, 1) >= substr(c_name, 17, 1)"),
    },
    prepare=lambda df: df.select("c_custkey", F.col("c_name").cast("binary").alias("b")),
)

#: 12 bits with the value 16 * x + 5 for x below 128.
_BITS = "(16 * (c_custkey % 128) + 5)"
library(
    "lib_bits",
    "customer",
    {"c_custkey": "i64", "b": "bits", "n": "integer"},
    {
        "k": ("r.c_custkey", "i64", "c_custkey"),
        "size": ("std.bits_size(r.b)", "integer", "12::BIGINT"),
        "both": ("std.bits_eq(r.b & 0b000000001111, 0b000000000101)", B, "true"),
        "either": ("std.bits_eq(r.b | 0b111111110000, 0b111111110101)", B, "true"),
        "xor": ("std.bits_eq(r.b ^ r.b, 0b000000000000)", B, "true"),
        "not": ("std.bits_eq(~r.b & 0b000000001111, 0b000000001010)", B, "true"),
        "grown": ("std.bits_size(r.b << r.n)", "integer", "(12 + c_custkey % 5)::BIGINT"),
        "shrunk": ("std.bits_size(r.b >> r.n)", "integer", "(12 - c_custkey % 5)::BIGINT"),
        "turned": ("std.bits_eq((r.b <<< r.n) >>> r.n, r.b)", B, "true"),
        "top": ("std.bits_eq(std.bits_at(r.b, r.n1), 0b1)", B, f"{_BITS} >= 1024"),
        "cut": ("std.bits_eq(r.b[8:12], 0b0101)", B, "true"),
        "joined": ("std.bits_size(r.b ++ 0b11)", "integer", "14::BIGINT"),
        "lt": ("std.bits_lt(r.b[0:8], 0b01000000)", B, "c_custkey % 128 < 64"),
    },
    prepare=lambda df: df.select("c_custkey", F.struct(F.unhex(F.lpad(F.hex((F.col("c_custkey") % 128 * 16 + 5) * 16), 4, "0")).alias("data"), F.lit(12).alias("nbits")).alias("b"), (F.col("c_custkey") % 5).cast("decimal(38,0)").alias("n")),
)

_PRICE = "l_extendedprice"
library(
    "lib_floats",
    "lineitem",
    {"l_orderkey": "i64", "l_linenumber": "i64", _PRICE: "f64", "l_discount": "f64"},
    {
        "k": ("r.l_orderkey", "i64", "l_orderkey"),
        "n": ("r.l_linenumber", "i64", "l_linenumber::BIGINT"),
        "sqrt": (f"std.sqrt_f64(r.{_PRICE})", "f64", f"sqrt({_PRICE})"),
        "square": ("std.pow_f64(r.l_discount, 2e0)", "f64", "l_discount * l_discount"),
        "ln": (f"std.round_f64(std.ln_f64(r.{_PRICE}) * 1e6)", "i64", f"round(ln({_PRICE}) * 1e6)::BIGINT"),
        "log": (f"std.round_f64(std.log_f64(r.{_PRICE}, base: 1e1) * 1e6)", "i64", f"round(log10({_PRICE}) * 1e6)::BIGINT"),
        "ceil": (f"std.ceil_f64(r.{_PRICE})", "i64", f"ceil({_PRICE})::BIGINT"),
        "floor": (f"std.floor_f64(-r.{_PRICE})", "i64", f"floor(-{_PRICE})::BIGINT"),
        "round": (f"std.round_f64(r.{_PRICE})", "i64", f"round({_PRICE})::BIGINT"),
        "abs": (f"std.abs_f64(-r.{_PRICE})", "f64", _PRICE),
        "sign": ("std.sign_f64(r.l_discount - 5e-2)", "i64", "sign(l_discount - 0.05::DOUBLE)::BIGINT"),
        "absi": ("std.abs_i64(std.neg_i64(r.l_orderkey))", "i64", "l_orderkey"),
        "inf": ("std.is_infinite(r.l_discount / 0e0)", B, "l_discount > 0"),
        "nan": ("std.is_nan(r.l_discount / 0e0)", B, "l_discount = 0"),
        "finite": (f"std.is_finite(r.{_PRICE})", B, "true"),
        "sum": (f"r.{_PRICE} + r.l_discount", "f64", f"{_PRICE} + l_discount"),
        "dif": (f"r.{_PRICE} - r.l_discount", "f64", f"{_PRICE} - l_discount"),
        "prod": (f"r.{_PRICE} * r.l_discount", "f64", f"{_PRICE} * l_discount"),
        "quot": (f"r.l_discount / r.{_PRICE}", "f64", f"l_discount / {_PRICE}"),
        "neg": (f"-r.{_PRICE}", "f64", f"-{_PRICE}"),
    },
)

library(
    "lib_compare",
    "orders",
    {"o_orderkey": "i64", "o_custkey": "i64", "o_orderstatus": S, "o_totalprice": "f64"},
    {
        "k": ("r.o_orderkey", "i64", "o_orderkey"),
        "eq": ("r.o_custkey % r.n7 = r.n3", B, "o_custkey % 7 = 3"),
        "neq": ("r.o_custkey != r.o_orderkey", B, "o_custkey <> o_orderkey"),
        "lte": ("r.o_totalprice <= 1e5", B, "o_totalprice <= 100000"),
        "gte": ("r.o_totalprice >= 1e5", B, "o_totalprice >= 100000"),
        "text": ('r.o_orderstatus = "F"', B, "o_orderstatus = 'F'"),
        "bool": ('(r.o_orderstatus = "F") = (r.o_totalprice > 1e5)', B, "(o_orderstatus = 'F') = (o_totalprice > 100000)"),
        "unlike": ('(r.o_orderstatus = "F") != (r.o_totalprice > 1e5)', B, "(o_orderstatus = 'F') <> (o_totalprice > 100000)"),
        "logic": ('not (r.o_orderstatus = "F" or r.o_custkey < r.n100) and r.o_totalprice > 5e4', B, "NOT (o_orderstatus = 'F' OR o_custkey < 100) AND o_totalprice > 50000"),
    },
)

_D = "(round(l_extendedprice * 100)::BIGINT)"
library(
    "lib_numerics",
    "lineitem",
    {"l_orderkey": "i64", "l_linenumber": "i64", "d": "numeric", "q": "numeric", "i": "integer"},
    {
        "k": ("r.l_orderkey", "i64", "l_orderkey"),
        "n": ("r.l_linenumber", "i64", "l_linenumber::BIGINT"),
        "sum": ("r.d + r.q", "numeric", f"({_D} * 10000 + l_quantity::BIGINT * 1000000)"),
        "dif": ("r.d - r.q", "numeric", f"({_D} * 10000 - l_quantity::BIGINT * 1000000)"),
        "prod": ("r.d * r.q", "numeric", f"({_D} * l_quantity::BIGINT * 10000)"),
        "quot": ("r.d / 4.0", "numeric", f"({_D} * 2500)"),
        "neg": ("-r.d", "numeric", f"(-{_D} * 10000)"),
        "abs": ("std.abs_numeric(-r.d)", "numeric", f"({_D} * 10000)"),
        "sign": ("std.sign_numeric(r.d - r.d)", "integer", "0::BIGINT"),
        "ceil": ("std.ceil_numeric(r.d)", "integer", f"(({_D} + 99) // 100)::BIGINT"),
        "floor": ("std.floor_numeric(r.d)", "integer", f"({_D} // 100)::BIGINT"),
        "round": ("std.round_numeric(r.d)", "integer", f"(({_D} + 50) // 100)::BIGINT"),
        "gt": ("r.d > 30000.5", B, f"{_D} > 3000050"),
        "eq": ("r.q = 7.0", B, "l_quantity = 7"),
        "isum": ("r.i + r.i * 3", "integer", "(4 * l_orderkey)::BIGINT"),
        "idiv": ("(r.i * 99999999999999999999) / 99999999999999999999 - r.i / 7", "integer", "(l_orderkey - l_orderkey // 7)::BIGINT"),
        "imod": ("-r.i % 7", "integer", "(-l_orderkey % 7)::BIGINT"),
    },
    prepare=lambda df: df.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (cents("l_extendedprice") / F.lit(100).cast("decimal(3,0)")).cast("decimal(38,18)").alias("d"), F.col("l_quantity").cast("decimal(38,18)").alias("q"), F.col("l_orderkey").cast("decimal(38,0)").alias("i")),
)

library(
    "lib_times",
    "events",
    {"event_id": "i64", "us": "i64"},
    {
        "k": ("r.event_id", "i64", "event_id"),
        "date": ("std.date(std.timestamp(r.us))", "date", "ts::DATE"),
        "time": ("std.time(std.timestamp(r.us))", "time", "(epoch_us(ts) % 86400000000)::BIGINT"),
        "same": ("std.date(std.timestamp(r.us)) = std.date(std.timestamp(r.us))", B, "true"),
        "later": ("std.timestamp(r.us) < std.timestamp(r.us + r.n1)", B, "true"),
    },
    prepare=lambda df: df.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")),
)

library(
    "lib_structs",
    "orders",
    {"o_orderkey": "i64", "o_custkey": "i64"},
    {
        "k": ("r.o_orderkey", "i64", "o_orderkey"),
        "set": ('std.struct_get(std.struct_set(r, key: "o_custkey", value: r.o_custkey * r.n2), key: "o_custkey")', "i64", "o_custkey * 2"),
        "nested": ('struct("a": r.o_orderkey, "b": r.o_custkey).b', "i64", "o_custkey"),
        "pair": ('std.array_size([struct("a": r.o_orderkey, "b": r.o_custkey)])', "integer", "1::BIGINT"),
        "list": ("[r.o_orderkey, r.o_custkey][1]", "i64", "o_custkey"),
        "map": ('{x: r.o_orderkey, y: r.o_custkey}["x"]', "i64", "o_orderkey"),
    },
)


# -- numeric primitives and groups of mixed weights

NUMBERS = """
src := source("t")
src :: stream(struct("g": string("UTF-8"), "d": numeric, "f": f64, "i": integer))
nums :: aggregate_function((struct("g": string("UTF-8"), "d": numeric, "f": f64, "i": integer)) -> struct("sd": numeric, "lod": numeric, "hid": numeric, "si": integer, "loi": integer, "hii": integer, "sf": f64, "lof": f64, "hif": f64))
nums := function((r) -> struct("sd": std.agg_sum_numeric(r.d), "lod": std.agg_min_numeric(r.d), "hid": std.agg_max_numeric(r.d), "si": std.agg_sum_integer(r.i), "loi": std.agg_min_integer(r.i), "hii": std.agg_max_integer(r.i),
    "sf": std.agg_sum_f64(r.f), "lof": std.agg_min_f64(r.f), "hif": std.agg_max_f64(r.f)))
out := aggregate(src, nums, by: ["g"])
"""


@query(
    """SELECT o_orderstatus AS g, sum(round(o_totalprice * 100)::BIGINT * 10000)::BIGINT AS sd, min(round(o_totalprice * 100)::BIGINT * 10000) AS lod, max(round(o_totalprice * 100)::BIGINT * 10000) AS hid,
       sum(o_orderkey)::BIGINT AS si, min(o_orderkey) AS loi, max(o_orderkey) AS hii, sum(o_custkey)::DOUBLE AS sf, min(o_custkey)::DOUBLE AS lof, max(o_custkey)::DOUBLE AS hif FROM orders GROUP BY ALL"""
)
def agg_numbers(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(F.col("o_orderstatus").alias("g"), (cents("o_totalprice") / F.lit(100).cast("decimal(3,0)")).cast("decimal(38,18)").alias("d"), F.col("o_custkey").cast("double").alias("f"), F.col("o_orderkey").cast("decimal(38,0)").alias("i"))
    return plain(run(spark, NUMBERS, {"t": rows}, "out"))


@query(
    """SELECT k, sum(w * v)::BIGINT AS s, sum(w)::BIGINT AS n FROM (
         SELECT k, v, sum(w) AS w FROM (SELECT o_custkey AS k, o_orderkey AS v, 1 AS w FROM orders UNION ALL SELECT o_custkey, o_orderkey + o_orderkey % 2, -1 FROM orders) GROUP BY ALL HAVING sum(w) <> 0) GROUP BY k"""
)
def agg_mixed_weights(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    a = o.map({"k": F.col("o_custkey"), "v": F.col("o_orderkey")})
    b = o.map({"k": F.col("o_custkey"), "v": F.col("o_orderkey") + F.col("o_orderkey") % 2})
    return a.plus(b.neg()).aggregate({"s": agg_sum("v"), "n": agg_count()}, ["k"]).rows()


@query(
    """SELECT k, max(v) AS hi, min(v) AS lo FROM (
         SELECT k, v, sum(w) AS w FROM (SELECT o_custkey AS k, o_orderkey AS v, 1 AS w FROM orders UNION ALL SELECT o_custkey, o_orderkey + o_orderkey % 2, -1 FROM orders) GROUP BY ALL HAVING sum(w) > 0) GROUP BY k"""
)
def agg_mixed_extrema(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    a = o.map({"k": F.col("o_custkey"), "v": F.col("o_orderkey")})
    b = o.map({"k": F.col("o_custkey"), "v": F.col("o_orderkey") + F.col("o_orderkey") % 2})
    return a.plus(b.neg()).aggregate({"hi": agg_max("v"), "lo": agg_min("v")}, ["k"]).rows()


# -- the language's rows from one row

UNNEST = """
src := source("t")
src :: stream(struct("event_id": i64, "event_type": string("UTF-8")))
both :: function((struct("event_id": i64, "event_type": string("UTF-8"))) -> array(struct("event_id": i64, "way": string("UTF-8"))))
both := function((r) -> [struct("event_id": r.event_id, "way": std.string_upper(r.event_type)), struct("event_id": r.event_id + r.event_id, "way": r.event_type)])
out := flat_map(src, both)
"""


@query("SELECT event_id, upper(event_type) AS way FROM events UNION ALL SELECT event_id * 2, event_type FROM events")
def lang_flat_map(spark, sf_dir):
    return run(spark, UNNEST, {"t": spark.read.parquet(f"{sf_dir}/events.parquet")}, "out")


# -- recursion over recursion


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS f, c_custkey // 2 AS t FROM customer WHERE c_custkey > 1),
       a(f, t) AS (SELECT f, t FROM e UNION SELECT a.f, e.t FROM e JOIN a ON a.t = e.f),
       k AS (SELECT * FROM a WHERE f - t > t),
       b(f, t) AS (SELECT f, t FROM k UNION SELECT b.f, k.t FROM k JOIN b ON b.t = k.f) SELECT f AS origin, t AS "at" FROM b"""
)
def fixpoint_chain(spark, sf_dir):
    return run(spark, CLOSURE, {"ties": _tree(spark, sf_dir)}, "beyond")


# -- epochs of several inputs

JOINED = """
events := source("events")
events :: stream(struct("user_id": i64, "event_type": string("UTF-8")))
customers := source("customer")
customers :: stream(struct("user_id": i64, "c_nationkey": i64))
both := join(events, customers, on: ["user_id"])
strangers := antijoin(events, customers, on: ["user_id"])
of_day := distinct(project(customers, ["c_nationkey"]))
ranked := order(of_day, by: [["c_nationkey", "desc"]], rank_column: "rank", row_number_column: "row_number")
"""


def _days_of_customers(spark, sf_dir) -> DataFrame:
    """Customer k appears on day k % 20."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("c_nationkey"), (F.col("c_custkey") % 20).cast("long").alias("__e"), F.lit(1).cast("long").alias("__w"))


def _two(spark, sf_dir, name: str) -> DataFrame:
    logs = {"events": _log(spark, sf_dir), "customer": _days_of_customers(spark, sf_dir)}
    return plain(Plan(JOINED).replay(spark, logs, [name])[name].df.withColumnsRenamed({replay.E: "e", W: "w"}))


@query(f"SELECT greatest({_DAYS}, c_custkey % 20) AS e, user_id, event_type, c_nationkey::BIGINT AS c_nationkey, count(*)::BIGINT AS w FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL")
def replay_join(spark, sf_dir):
    return _net(_two(spark, sf_dir, "both"))


@query(
    f"""SELECT e, user_id, event_type, sum(w)::BIGINT AS w FROM (
         SELECT {_DAYS} AS e, user_id, event_type, 1 AS w FROM events
         UNION ALL SELECT greatest({_DAYS}, c_custkey % 20), user_id, event_type, -1 FROM events JOIN customer ON user_id = c_custkey) GROUP BY ALL HAVING sum(w) <> 0"""
)
def replay_antijoin(spark, sf_dir):
    return _net(_two(spark, sf_dir, "strangers"))


@query(
    """WITH d AS (SELECT c_nationkey, min(c_custkey % 20) AS since FROM customer GROUP BY ALL), t AS (SELECT DISTINCT since AS day FROM d),
       s AS (SELECT day, c_nationkey, row_number() OVER (PARTITION BY day ORDER BY c_nationkey DESC) AS r FROM t JOIN d ON since <= day),
       n AS (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM t),
       x AS (SELECT day AS e, c_nationkey, r, 1 AS w FROM s UNION ALL SELECT nxt, c_nationkey, r, -1 FROM s JOIN n USING (day) WHERE nxt IS NOT NULL)
       SELECT e::BIGINT AS e, c_nationkey::BIGINT AS c_nationkey, r::BIGINT AS rank, r::BIGINT AS row_number, sum(w)::BIGINT AS w FROM x GROUP BY ALL HAVING sum(w) <> 0"""
)
def replay_order(spark, sf_dir):
    return _two(spark, sf_dir, "ranked")


def _net(log: DataFrame) -> DataFrame:
    """A log with one row for each change."""
    keys = [c for c in log.columns if c != "w"]
    return log.groupBy(*keys).agg(F.sum("w").alias("w")).where("w <> 0")

