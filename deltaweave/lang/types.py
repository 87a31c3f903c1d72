"""Types of the language: text form, equality, assignability and their Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import ProgramError

SIGNED = {"i8": 8, "i16": 16, "i32": 32, "i64": 64}
UNSIGNED = {"u8": 8, "u16": 16, "u32": 32, "u64": 64}
SCALARS = {*SIGNED, *UNSIGNED, "integer", "f32", "f64", "numeric", "string_with_encoding", "bytes", "bits", "date", "time", "timestamp", "timestamp_with_timezone", "interval", "json", "dynamic"}
#: Widening steps; widening is their transitive closure.
_STEPS = {"i8": ("i16",), "i16": ("i32",), "i32": ("i64",), "i64": ("integer",), "u8": ("u16", "i16"), "u16": ("u32", "i32"), "u32": ("u64", "i64"), "u64": ("integer",), "integer": ("numeric", "f64"), "f32": ("f64",)}


@dataclass(frozen=True)
class Type:
    name: str
    args: tuple = ()

    def __str__(self) -> str:
        a = self.args
        match self.name:
            case "struct":
                return "struct(" + ", ".join(f'"{n}": {t}' for n, t in sorted(a)) + ")"
            case "enum":
                return "enum(" + ", ".join(f'"{x}"' for x in sorted(a)) + ")"
            case "string":
                return f'string("{a[0]}")'
            case "function" | "aggregate_function":
                return f"{self.name}(({', '.join([*map(str, a[0]), *(f'{chr(34)}{k}{chr(34)}: {t}' for k, t in a[1])])}) -> {a[2]})"
            case "var":
                return a[0]
        return self.name + (f"({', '.join(map(str, a))})" if a else "")

    # Struct fields are not ordered, so types are equal when their texts are.
    def __eq__(self, other: object) -> bool:
        return isinstance(other, Type) and str(self) == str(other)

    def __hash__(self) -> int:
        return hash(str(self))

    @property
    def fields(self) -> dict[str, Type]:
        return dict(self.args) if self.name == "struct" else {}


def scalar(name: str) -> Type:
    return Type(name)


STRING, BOOL, INTEGER, NUMERIC, F64, I64 = Type("string", ("UTF-8",)), Type("enum", ("false", "true")), Type("integer"), Type("numeric"), Type("f64"), Type("i64")


def struct(fields: dict[str, Type]) -> Type:
    return Type("struct", tuple(fields.items()))


def optional(t: Type) -> Type:
    return t if t.name == "optional" else Type("optional", (t,))


def is_bool(t: Type) -> bool:
    return t.name == "enum" and set(t.args) <= {"false", "true"}


def is_integer(t: Type) -> bool:
    return t.name in SIGNED or t.name in UNSIGNED or t.name == "integer"


def widens(a: str, b: str) -> bool:
    seen, todo = set(), [a]
    while todo:
        x = todo.pop()
        if x == b:
            return True
        if x not in seen:
            seen.add(x)
            todo.extend(_STEPS.get(x, ()))
    return False


def assignable(s: Type, t: Type) -> bool:
    """Can a value of ``s`` go where ``t`` is expected?"""
    if s == t or t.name == "dynamic":
        return True
    if t.name == "optional":
        return s.name == "absent" or assignable(s.args[0] if s.name == "optional" else s, t.args[0])
    if s.name == "optional":
        return False
    if s.name == "enum":
        if t.name == "enum":
            return set(s.args) <= set(t.args)
        return t.name == "json" and set(s.args) <= {"false", "true", "null"} and set(s.args) != {"null"}
    if s.name == "numeric" and t.name == "numeric":
        return not t.args
    if s.name in ("bytes", "bits") and t.name == s.name:
        return not t.args
    if not s.args and not t.args and widens(s.name, t.name):
        return True
    if s.name == t.name == "struct":
        sf, tf = s.fields, t.fields
        return sf.keys() == tf.keys() and all(assignable(sf[k], tf[k]) for k in sf)
    if s.name == t.name == "array":
        return (len(t.args) == 1 or s.args[1:] == t.args[1:]) and assignable(s.args[0], t.args[0])
    if s.name == t.name == "map":
        return s.args[0] == t.args[0] and assignable(s.args[1], t.args[1])
    if t.name == "json":
        return s.name in ("string", "f64", "integer") or (s.name == "array" and assignable(s.args[0], t)) or (s.name == "map" and s.args[0] == STRING and assignable(s.args[1], t)) or (s.name == "struct" and all(assignable(x, t) for x in s.fields.values()))
    return False


def common(a: Type, b: Type) -> Type | None:
    """The least type that both are assignable to, if there is one."""
    if assignable(a, b):
        return b
    if assignable(b, a):
        return a
    for name in ("i16", "i32", "i64", "integer", "f64", "numeric"):
        t = Type(name)
        if assignable(a, t) and assignable(b, t):
            return t
    return None


def unify(pattern: Type, actual: Type, bound: dict[str, Type]) -> bool:
    """Match a pattern with type variables; ``bound`` gathers them."""
    if pattern.name == "var":
        return bound.setdefault(pattern.args[0], actual) == actual
    if pattern.name != actual.name:
        return False
    if pattern.name == "array":
        return unify(pattern.args[0], actual.args[0], bound) and (len(pattern.args) == 1 or pattern.args[1:] == actual.args[1:])
    if pattern.name in ("map", "optional"):
        return all(unify(p, a, bound) for p, a in zip(pattern.args, actual.args, strict=True))
    return pattern == actual


def bind(t: Type, bound: dict[str, Type]) -> Type:
    if t.name == "var":
        return bound[t.args[0]]
    if t.name in ("array", "map", "optional"):
        return Type(t.name, tuple(bind(a, bound) if isinstance(a, Type) else a for a in t.args))
    return t


_SPARK = {
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "integer": T.DecimalType(38, 0), "f32": T.FloatType(), "f64": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "date": T.DateType(), "time": T.LongType(), "timestamp": T.LongType(), "json": T.StringType(),
    "enum": T.StringType(),
    "string_with_encoding": T.StructType().add("encoding", "string").add("value", "string"),
    "bits": T.StructType().add("data", "binary").add("nbits", T.IntegerType()),
    "timestamp_with_timezone": T.StructType().add("us", "long").add("offset", T.IntegerType()).add("zone", "string"),
    "interval": T.StructType().add("months", "long").add("days", "long").add("microseconds", "long"),
    "dynamic": T.StructType().add("type", "string").add("value", "string"),
    "absent": T.NullType(),
}


def spark_type(t: Type) -> T.DataType:
    """The column type; integer and numeric are limited to 38 digits."""
    match t.name:
        case "numeric":
            return T.DecimalType(*t.args) if t.args else T.DecimalType(38, 18)
        case "enum" if is_bool(t):
            return T.BooleanType()
        case "optional":
            return spark_type(t.args[0])
        case "array":
            inner = spark_type(t.args[0])
            for _ in t.args[2:]:
                inner = T.ArrayType(inner)
            return T.ArrayType(inner)
        case "map":
            return T.MapType(spark_type(t.args[0]), spark_type(t.args[1]))
        case "struct":
            return T.StructType([T.StructField(n, spark_type(x)) for n, x in t.args])
    if t.name not in _SPARK:
        raise ProgramError("compile_error", f"no column type for {t}")
    return _SPARK[t.name]


def spark_schema(t: Type) -> T.StructType:
    return spark_type(t)
