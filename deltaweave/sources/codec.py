"""The JSON-lines wire format as columns: ``[weight, row]`` per line, values as typed text.

Decoding and encoding are native expressions, so files of any size are read and written in parallel.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.errors import ProgramError
from ..lang.types import Type, is_bool, spark_type
from ..operators.zset import W, ZSet

_S = T.StringType()
#: Fixed wire names: the fields of values that are JSON objects.
_OBJECTS = {
    "bytes": ("encoding", "value"),
    "bits": ("encoding", "value"),
    "date": ("days_since_2000",),
    "time": ("hour", "minute", "second", "microsecond"),
    "timestamp": ("epoch_microseconds",),
    "timestamp_with_timezone": ("epoch_microseconds", "offset_seconds", "zone"),
    "interval": ("months", "days", "microseconds"),
    "string_with_encoding": ("encoding", "value"),
    "dynamic": ("type", "value"),
}
_DAYS_TO_2000 = 10957


def wire_type(t: Type) -> T.DataType:
    """What JSON is parsed into before values are typed."""
    if t.name == "optional":
        return wire_type(t.args[0])
    if t.name in _OBJECTS:
        return T.StructType([T.StructField(f, _S) for f in _OBJECTS[t.name]])
    if t.name == "array":
        out = wire_type(t.args[0])
        for _ in range(max(1, len(t.args) - 1)):
            out = T.ArrayType(out)
        return out
    if t.name == "map":
        return T.ArrayType(T.ArrayType(_S))
    if t.name == "struct":
        return T.StructType([T.StructField(n, wire_type(x)) for n, x in t.args])
    return _S


def from_wire(c: Column, t: Type) -> Column:
    """Parsed JSON to a typed value; what cannot be read is null."""
    match t.name:
        case "optional":
            return from_wire(c, t.args[0])
        case "enum":
            ok = c.isin(*t.args)
            return F.when(ok, c == "true") if is_bool(t) else F.when(ok, c)
        case "bytes":
            return F.try_to_binary(c["value"], F.lit("base64"))
        case "bits":
            data = F.try_to_binary(c["value"], F.lit("base64"))
            return F.when(data.isNotNull(), F.struct(data.alias("data"), (F.octet_length(data) * 8).cast("int").alias("nbits")))
        case "date":
            return F.date_add(F.lit("1970-01-01").cast("date"), (c["days_since_2000"].try_cast("int") + _DAYS_TO_2000).cast("int"))
        case "time":
            part = lambda n: c[n].try_cast("long")
            return ((part("hour") * 60 + part("minute")) * 60 + part("second")) * 1_000_000 + part("microsecond")
        case "timestamp":
            return c["epoch_microseconds"].try_cast("long")
        case "timestamp_with_timezone":
            return F.when(c.isNotNull(), F.struct(c["epoch_microseconds"].try_cast("long").alias("us"), F.coalesce(c["offset_seconds"].try_cast("int"), F.lit(0)).alias("offset"), c["zone"].alias("zone")))
        case "interval":
            return F.when(c.isNotNull(), F.struct(*(c[n].try_cast("long").alias(n) for n in ("months", "days", "microseconds"))))
        case "f32" | "f64":
            kind = spark_type(t).simpleString()
            special = {"inf": "Infinity", "-inf": "-Infinity", "nan": "NaN"}
            plain = c
            for k, v in special.items():
                plain = F.when(c == k, F.lit(v)).otherwise(plain)
            return plain.try_cast(kind)
        case "string" | "json":
            return c
        case "string_with_encoding" | "dynamic":
            return F.when(c.isNotNull(), c)
        case "array":
            inner = t.args[0] if len(t.args) <= 2 else Type("array", (t.args[0], *t.args[2:]))
            return F.transform(c, lambda x: from_wire(x, inner))
        case "map":
            k, v = t.args
            value = (lambda x: from_wire(x, v)) if wire_type(v) == _S else (lambda x: from_wire(F.from_json(x, wire_type(v).json()), v))
            return F.map_from_entries(F.transform(c, lambda p: F.struct(from_wire(F.get(p, 0), k).alias("key"), value(F.get(p, 1)).alias("value"))))
        case "struct":
            return F.when(c.isNotNull(), F.struct(*(from_wire(c[n], x).alias(n) for n, x in t.args)))
    return c.try_cast(spark_type(t))


def to_wire(c: Column, t: Type) -> Column:
    """A typed value to what ``to_json`` writes."""
    text = lambda x: x.cast("string")
    match t.name:
        case "optional":
            return to_wire(c, t.args[0])
        case "enum":
            return F.when(c, "true").when(~c, "false") if is_bool(t) else c
        case "bytes":
            return F.when(c.isNotNull(), F.struct(F.lit("base64").alias("encoding"), F.base64(c).alias("value")))
        case "bits":
            return F.when(c.isNotNull(), F.struct(F.lit("base64").alias("encoding"), F.base64(c["data"]).alias("value")))
        case "date":
            return F.when(c.isNotNull(), F.struct(text(F.datediff(c, F.lit("2000-01-01").cast("date"))).alias("days_since_2000")))
        case "time":
            s = F.floor(c / 1_000_000)
            return F.when(c.isNotNull(), F.struct(text(F.floor(s / 3600)).alias("hour"), text(F.floor(s / 60) % 60).alias("minute"), text(s % 60).alias("second"), text(c % 1_000_000).alias("microsecond")))
        case "timestamp":
            return F.when(c.isNotNull(), F.struct(text(c).alias("epoch_microseconds")))
        case "timestamp_with_timezone":
            return F.when(c.isNotNull(), F.struct(text(c["us"]).alias("epoch_microseconds"), text(c["offset"]).alias("offset_seconds"), c["zone"].alias("zone")))
        case "interval":
            return F.when(c.isNotNull(), F.struct(*(text(c[n]).alias(n) for n in ("months", "days", "microseconds"))))
        case "f32" | "f64":
            return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(text(c))
        case "numeric":
            return F.regexp_replace(F.regexp_replace(text(c), r"(\.\d*?)0+$", "$1"), r"\.$", "") if not t.args else text(c)
        case "string" | "json" | "string_with_encoding" | "dynamic":
            return c
        case "array":
            inner = t.args[0] if len(t.args) <= 2 else Type("array", (t.args[0], *t.args[2:]))
            return F.transform(c, lambda x: to_wire(x, inner))
        case "map":
            k, v = t.args
            if wire_type(v) != _S:
                return F.transform(F.map_entries(c), lambda e: F.array(to_wire(e["key"], k), F.to_json(to_wire(e["value"], v))))
            return F.transform(F.map_entries(c), lambda e: F.array(to_wire(e["key"], k), to_wire(e["value"], v)))
        case "struct":
            return F.when(c.isNotNull(), F.struct(*(to_wire(c[n], x).alias(n) for n, x in t.args)))
    return text(c)


def decode(lines: DataFrame, t: Type, line: str = "value") -> DataFrame:
    """Lines of ``[weight, row]`` to the columns of ``t`` and ``__w``; a bad line raises an error that shows it.

    Blank lines are skipped, a carriage return at the end is too, and columns that are not declared are ignored.
    """
    text = F.regexp_replace(F.col(line), r"\r$", "")
    rows = lines.withColumn("__line", text).where(F.trim("__line") != "")
    rows = rows.withColumn("__w", F.get_json_object("__line", "$[0]").try_cast("long")).withColumn("__row", F.from_json(F.get_json_object("__line", "$[1]"), wire_type(t).json()))
    keep = [c for c in lines.columns if c != line]
    values = {n: from_wire(F.col("__row")[n], x) for n, x in t.args}
    wrong = F.col("__w").isNull() | F.col("__row").isNull()
    for n, x in t.args:
        if x.name != "optional":
            wrong = wrong | values[n].isNull()
    bad = F.raise_error(F.concat(F.lit("bad row: "), F.col("__line")))
    rows = rows.select(*keep, F.when(wrong, bad.cast("long")).otherwise(F.col("__w")).alias(W), *(v.alias(n) for n, v in values.items()))
    return rows.select(*keep, *values, W)


def encode(z: ZSet, t: Type, keep: tuple[str, ...] = ()) -> DataFrame:
    """A Z-set to lines of ``[weight, row]`` in the column ``value``."""
    row = F.to_json(F.struct(*(to_wire(F.col(n), x).alias(n) for n, x in t.args)), {"ignoreNullFields": "false"})
    return z.weighted().select(*keep, F.concat(F.lit("["), F.col(W).cast("string"), F.lit(","), row, F.lit("]")).alias("value"))


def header(t: Type) -> str:
    """The first line of an output: the types of its fields."""
    return json.dumps({n: str(x) for n, x in t.args})


def read_jsonl(spark: SparkSession, path: str, t: Type) -> DataFrame:
    if t.name != "struct":
        raise ProgramError("type_conflict", str(t))
    return decode(spark.read.text(path), t)


def read_parquet(spark: SparkSession, path: str, t: Type) -> ZSet:
    """Only the declared columns are scanned."""
    df = spark.read.parquet(path)
    return ZSet.of(df.select(*t.fields, *([W] if W in df.columns else [])), W if W in df.columns else None)
