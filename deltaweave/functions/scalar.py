"""The standard library on columns: operator resolution by operand types and one implementation per family.

Names are ``std.<family>_<type>``; families are resolved by rule, so the catalogue is data and not one function per name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.errors import ProgramError
from ..lang.types import BOOL, F64, I64, INTEGER, NUMERIC, SIGNED, STRING, UNSIGNED, Type, bind, is_bool, is_integer, spark_type, unify
from .values import Val, either, guarded

_WIDE = T.DecimalType(38, 0)
INTERVAL, BYTES, BITS = Type("interval"), Type("bytes"), Type("bits")


def _big(n: int) -> Column:
    return F.lit(str(n)).cast(_WIDE)


def _wrap(x: Column, t: Type) -> Column:
    """An exact decimal result, wrapped into a machine integer."""
    if t.name in SIGNED:
        n = SIGNED[t.name]
        half, whole = _big(2 ** (n - 1)), _big(2**n)
        return (F.pmod((x + half).cast(_WIDE), whole) - half).cast(spark_type(t))
    return F.pmod(x, _big(2 ** UNSIGNED[t.name])).cast(spark_type(t))


def _wrapped_small(x: Column, t: Type) -> Column:
    """A bigint result wrapped into at most 32 bits by shifts (no overflow checks, no decimals)."""
    if t.name in SIGNED:
        s = 64 - SIGNED[t.name]
        return F.shiftright(F.shiftleft(x, s), s).cast(spark_type(t))
    return x.bitwiseAND(2 ** UNSIGNED[t.name] - 1).cast(spark_type(t))


def _arith(op: str, t: Type, a: Column, b: Column) -> Column:
    plain = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y}[op]
    name = t.name
    if name in ("f64", "f32"):
        return plain(a, b)
    if name == "numeric":
        return plain(a, b).cast(spark_type(t))
    if name == "integer":
        return plain(a, b).cast(_WIDE)
    if name == "i64":
        fast = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[op](a, b)
        return F.coalesce(fast, _wrap(plain(a.cast(_WIDE), b.cast(_WIDE)).cast(_WIDE), t))
    if name == "u64" or (name == "u32" and op == "mul"):
        return _wrap(plain(a.cast(_WIDE), b.cast(_WIDE)).cast(_WIDE), t)
    return _wrapped_small(plain(a.cast("long"), b.cast("long")), t)


def _divide(t: Type, a: Val, b: Val) -> Val:
    x, y = a.column, b.column
    if t.name in ("f64", "f32"):
        kind = spark_type(t).simpleString()
        lit = lambda v: F.lit(v).cast(kind)
        by_zero = F.when((x == 0) | F.isnan(x), lit(float("nan"))).when(x > 0, lit(float("inf"))).otherwise(lit(float("-inf")))
        return Val(t, F.when(y == 0, by_zero).otherwise(guarded(y != 0, x / y)), either(a.drop, b.drop))
    zero = y == 0
    if t.name == "numeric":
        out = guarded(~zero, (x / y).cast(spark_type(t)))
    elif t.name in ("integer", "u64"):
        out = guarded(~zero, ((x - x % y) / y).cast(spark_type(t)))  # exact: the remainder is taken first
    else:
        quotient = F.when(y == -1, _arith("sub", t, F.lit(0).cast(spark_type(t)), x)) if t.name in SIGNED else F.when(F.lit(False), x)
        out = guarded(~zero, quotient.otherwise(_int_div(x, y).cast(spark_type(t))))
    return Val(t, out, either(a.drop, b.drop, zero))


def _int_div(x: Column, y: Column) -> Column:
    """Truncating division of bigints; divisors 0 and -1 are the caller's."""
    return F.call_function("div", x.cast("long"), F.when((y == 0) | (y == -1), F.lit(1).cast("long")).otherwise(y.cast("long")))


def _mod(t: Type, a: Val, b: Val) -> Val:
    x, y = a.column, b.column
    safe = F.when((y == 0) | (y == -1), F.lit(1).cast(spark_type(t))).otherwise(y)
    return Val(t, guarded(y != 0, (x % safe).cast(spark_type(t))), either(a.drop, b.drop, y == 0))


def _interval(op: str, a: Val, b: Val) -> Val:
    plain = (lambda x, y: x + y) if op == "add" else (lambda x, y: x - y)
    parts = [plain(a.column[c], b.column[c]).alias(c) for c in ("months", "days", "microseconds")]
    return Val(INTERVAL, F.struct(*parts), either(a.drop, b.drop))


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"eq": lambda x, y: x == y, "neq": lambda x, y: x != y, "lt": lambda x, y: x < y, "gt": lambda x, y: x > y, "lte": lambda x, y: x <= y, "gte": lambda x, y: x >= y}


def _compare(op: str, t: Type, a: Val, b: Val) -> Val:
    x, y = a.column, b.column
    if t.name == "bits":
        x, y = x["data"], y["data"]
    nan = (F.isnan(x) | F.isnan(y)) if t.name in ("f64", "f32") else None
    out = _COMPARE[op](x, y)
    if t.name == "dynamic":  # values of different types are neither equal nor ordered
        same = a.column["type"] == b.column["type"]
        out = (~same | (a.column["value"] != b.column["value"])) if op == "neq" else same & _COMPARE[op](a.column["value"], b.column["value"])
    return Val(BOOL, out, either(a.drop, b.drop, nan))


def _up(x: Column, s: Column) -> Column:
    """x / s rounded up, as a bigint."""
    return F.ceil(x / s).cast("long")


def _places(kind: str, n: Column, lo: Column, hi: Column, step: Column) -> tuple[Column, Column, Column, Column]:
    """(first place, difference, count, no result) of the elements that a slice takes from ``n``.

    Missing bounds are 0 and the length, also where the step is negative; negative ones do not count from the end. Upwards
    a slice takes lo, lo + step, ... below hi. Downwards strings and arrays take every |step|-th element from hi up to
    below lo, last first; bytes take lo, lo - |step|, ... above hi. Bits go upwards only and give whole steps. Places
    outside give no result, but strings and arrays end where they end.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    wide = F.greatest(F.abs(step), one)
    up, down = (step > 0) & (lo < hi), (step < 0) & (lo > hi)
    if kind in ("string", "array"):
        ups, downs = _up(F.greatest(F.least(hi, n) - lo, zero), wide), _up(F.greatest(F.least(lo, n) - hi, zero), wide)
        first = F.when(up, lo).otherwise(hi + (downs - 1) * wide)
        outside = (up & (lo < 0)) | (down & (hi < 0))
    elif kind == "bytes":
        ups, downs = _up(hi - lo, wide), _up(lo - hi, wide)
        first = lo
        outside = (up & ((lo < 0) | (lo + (ups - 1) * wide >= n))) | (down & ((lo >= n) | (lo - (downs - 1) * wide < 0)))
    else:
        ups, downs = F.floor((hi - lo) / wide).cast("long"), zero
        first = lo
        outside = up & ((lo < 0) | (hi > n))
    count = F.when(up, ups).when(down, downs).otherwise(zero)
    return first, F.when(step < 0, -wide).otherwise(wide), count, outside


def slice_value(x: Val, start: Val | None, stop: Val | None, step: Val | None) -> Val:
    t, c = x.type, x.column
    drop = either(x.drop, *(v.drop for v in (start, stop, step) if v is not None))
    kind = t.name
    size = {"string": lambda: F.length(c), "bytes": lambda: F.octet_length(c), "array": lambda: F.size(c), "bits": lambda: c["nbits"]}.get(kind)
    if size is None:
        raise ProgramError("compile_error", f"no_slice {t}")
    n = size().cast("long")
    lo = start.column.cast("long") if start is not None else F.lit(0).cast("long")
    hi = stop.column.cast("long") if stop is not None else n
    by = step.column.cast("long") if step is not None else F.lit(1).cast("long")
    first, by_each, count, outside = _places(kind, n, lo, hi, by)
    drop = either(drop, outside, (by == 0) if step is not None else None)
    out_type = Type("array", t.args[:1]) if kind == "array" else t
    if kind == "bits":
        from .bits import bit_slice

        return Val(t, bit_slice(c, F.when(count > 0, first).otherwise(0), F.when(count > 0, first + count * by_each).otherwise(0), F.greatest(by_each, F.lit(1).cast("long"))), drop)
    if step is None:
        at, n_at = F.when(outside | (count == 0), 0).otherwise(first).cast("int"), F.when(outside, 0).otherwise(count).cast("int")
        return Val(out_type, F.slice(c, at + 1, n_at) if kind == "array" else F.substring(c, at + 1, n_at), drop)
    nth = F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0).cast("long")))
    places = F.transform(F.filter(nth, lambda i: (i < count) & ~outside), lambda i: (first + i * by_each).cast("int"))
    if kind == "array":
        return Val(out_type, F.transform(places, lambda i: F.get(c, i)), drop)
    if kind == "string":
        return Val(out_type, F.array_join(F.transform(places, lambda i: F.substring(c, i + 1, F.lit(1))), ""), drop)
    return Val(out_type, F.unhex(F.array_join(F.transform(places, lambda i: F.hex(F.substring(c, i + 1, F.lit(1)))), "")), drop)


def subscript(x: Val, key: Val) -> Val:
    t = x.type
    if t.name == "struct":
        if key.literal is None or key.type != STRING:
            raise ProgramError("non_literal_key", str(t))
        if key.literal not in t.fields:
            raise ProgramError("missing_field", key.literal)
        return x.get(key.literal)
    drop = either(x.drop, key.drop)
    if t.name == "array":
        if not is_integer(key.type):
            raise ProgramError("type_conflict", f"index {key.type}")
        i, n = key.column.cast("long"), F.size(x.column)
        at = F.when(i < 0, i + n).otherwise(i)
        ok = (at >= 0) & (at < n)
        inner = t.args[0] if len(t.args) <= 2 else Type("array", (t.args[0], *t.args[2:]))
        return Val(inner, F.get(x.column, F.when(ok, at).otherwise(F.lit(-1)).cast("int")), either(drop, ~ok))
    if t.name == "map":
        if key.type != t.args[0]:
            raise ProgramError("type_conflict", f"key {key.type}")
        found = F.map_contains_key(x.column, key.column)
        return Val(t.args[1], F.try_element_at(x.column, key.column), either(drop, ~found))
    if t.name == "string":
        return string_at(x, key)
    raise ProgramError("compile_error", f"no_subscript {t}")


def string_at(x: Val, key: Val) -> Val:
    i, n = key.column.cast("long"), F.length(x.column)
    at = F.when(i < 0, i + n).otherwise(i)
    ok = (at >= 0) & (at < n)
    return Val(STRING, F.substring(x.column, (F.when(ok, at).otherwise(F.lit(0)) + 1).cast("int"), F.lit(1)), either(x.drop, key.drop, ~ok))


# Fixed names: the type suffixes of the arithmetic and comparison families.
_INTS = [*SIGNED, *UNSIGNED]
ARITHMETIC = {
    "add": [*_INTS, "integer", "numeric", "f64", "interval"],
    "sub": [*_INTS, "integer", "numeric", "f64", "interval"],
    "mul": [*_INTS, "integer", "numeric", "f64"],
    "div": [*_INTS, "integer", "numeric", "f64"],
    "mod": [*_INTS, "integer"],
    "neg": [*_INTS, "integer", "f64", "numeric"],
}
COMPARABLE = [*_INTS, "integer", "f64", "f32", "string", "numeric", "boolean", "bytes", "bits", "date", "time", "timestamp", "interval"]


def _suffixed(suffix: str) -> Type:
    return BOOL if suffix == "boolean" else STRING if suffix == "string" else Type(suffix)


Impl = Callable[..., Val]
#: name -> overloads: (positional types, keyword types, implementation)
LIBRARY: dict[str, list[tuple[list[Type], dict[str, Type], Impl]]] = {}


def _add(name: str, pos: list[Type], impl: Impl, **kw: Type) -> None:
    LIBRARY.setdefault(f"std.{name}", []).append((pos, kw, impl))


def _simple(out: Type | Callable[[dict], Type], fn: Callable[..., Column], drop: Callable[..., Column] | None = None) -> Impl:
    """Lift a function of columns; ``drop`` says when it has no result."""

    def run(bound: dict, pos: list[Val], kw: dict[str, Val]) -> Val:
        vals = [*pos, *kw.values()]
        cols = [v.column for v in vals]
        gone = drop(*cols) if drop else None
        value = fn(*cols)
        return Val(out(bound) if callable(out) else out, guarded(~gone, value) if gone is not None else value, either(*(v.drop for v in vals), gone))

    return run


def _register() -> None:
    for op, suffixes in ARITHMETIC.items():
        for s in suffixes:
            t = Type(s)
            if op == "neg":
                impl = lambda _, p, __, t=t: Val(t, -p[0].column if t.name == "f64" else _arith("sub", t, F.lit(0).cast(spark_type(t)), p[0].column), p[0].drop)
                _add(f"neg_{s}", [t], impl)
            elif s == "interval":
                _add(f"{op}_{s}", [t, t], lambda _, p, __, op=op: _interval(op, *p))
            elif op == "div":
                _add(f"div_{s}", [t, t], lambda _, p, __, t=t: _divide(t, *p))
            elif op == "mod":
                _add(f"mod_{s}", [t, t], lambda _, p, __, t=t: _mod(t, *p))
            else:
                _add(f"{op}_{s}", [t, t], lambda _, p, __, t=t, op=op: Val(t, _arith(op, t, p[0].column, p[1].column), either(p[0].drop, p[1].drop)))
    for op in _COMPARE:
        for s in COMPARABLE:
            t = _suffixed(s)
            _add(f"{op}_{s}", [t, t], lambda _, p, __, t=t, op=op: _compare(op, t, *p))
        for s in ("string", "bytes", "bits"):
            t = _suffixed(s)
            _add(f"{s}_{op}", [t, t], lambda _, p, __, t=t, op=op: _compare(op, t, *p))
    _add("not", [BOOL], _simple(BOOL, lambda x: ~x))
    _add("and", [BOOL, BOOL], _simple(BOOL, lambda x, y: x & y))
    _add("or", [BOOL, BOOL], _simple(BOOL, lambda x, y: x | y))

    to_int = lambda c: c.cast(_WIDE)
    _add("string_length", [STRING], _simple(INTEGER, lambda s: to_int(F.length(s))))
    for name, fn in (("upper", F.upper), ("lower", F.lower), ("trim", lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), ("ltrim", lambda s: F.regexp_replace(s, r"^\s+", "")), ("rtrim", lambda s: F.regexp_replace(s, r"\s+$", ""))):
        _add(f"string_{name}", [STRING], _simple(STRING, fn))
    _add("string_starts_with", [STRING], _simple(BOOL, F.startswith), prefix=STRING)
    _add("string_ends_with", [STRING], _simple(BOOL, F.endswith), suffix=STRING)
    _add("string_contains", [STRING], _simple(BOOL, F.contains), sub=STRING)
    _add("string_substring", [STRING], _simple(STRING, lambda s, a: F.substring(s, (a + 1).cast("int"), F.length(s))), start=I64)
    _add("string_substring", [STRING], _simple(STRING, lambda s, a, n: F.substring(s, (a + 1).cast("int"), n.cast("int"))), start=I64, length=I64)
    _add("string_replace", [STRING], _simple(STRING, F.replace), **{"from": STRING, "to": STRING})
    _add("string_split", [STRING], _simple(Type("array", (STRING,)), lambda s, d: F.when(d == "", F.split(s, "")).otherwise(F.split(s, F.concat(F.lit(r"\Q"), F.replace(d, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))))), delimiter=STRING)
    _add("string_at", [STRING, I64], lambda _, p, __: string_at(*p))
    for t, kind in ((STRING, "string"), (BYTES, "bytes"), (BITS, "bits"), (Type("array", (Type("var", ("T",)),)), "array")):
        cut = lambda _, p, kw: slice_value(p[0], kw.get("start"), kw.get("stop"), kw.get("step"))
        _add(f"{kind}_slice", [t], cut, start=I64, stop=I64, step=I64)
        _add(f"{kind}_slice", [t], cut, start=I64, stop=I64)
        _add(f"{kind}_slice", [t], cut, stop=I64)

    arr = Type("array", (Type("var", ("T",)),))
    var, key, val = Type("var", ("T",)), Type("var", ("K",)), Type("var", ("V",))
    mp = Type("map", (key, val))
    same = lambda pattern: lambda bound: bind(pattern, bound)
    _add("concat_string", [STRING, STRING], _simple(STRING, F.concat))
    _add("concat_bytes", [BYTES, BYTES], _simple(BYTES, F.concat))
    _add("concat_array", [arr, arr], _simple(same(arr), F.concat))
    from . import bits

    _add("concat_bits", [BITS, BITS], _simple(BITS, bits.bit_concat))
    _add("bytes_size", [BYTES], _simple(INTEGER, lambda b: to_int(F.octet_length(b))))
    _add("bytes_at", [BYTES, I64], _simple(I64, lambda b, i: F.conv(F.hex(F.substring(b, (i + 1).cast("int"), F.lit(1))), 16, 10).cast("long"), lambda b, i: (i < 0) | (i >= F.octet_length(b))))
    _add("bits_size", [BITS], _simple(INTEGER, lambda b: to_int(b["nbits"])))
    _add("bits_at", [BITS, I64], _simple(BITS, lambda b, i: bits.bit_slice(b, i, i + 1, F.lit(1).cast("long")), lambda b, i: (i < 0) | (i >= b["nbits"])))
    for op in ("and", "or", "xor"):
        _add(f"bits_{op}", [BITS, BITS], _simple(BITS, getattr(bits, f"bit_{op}")))
    _add("bits_not", [BITS], _simple(BITS, bits.bit_not))
    for op in ("shl", "shr", "rotl", "rotr"):
        _add(f"bits_{op}", [BITS, INTEGER], _simple(BITS, getattr(bits, f"bit_{op}"), lambda b, n: n < 0))

    _add("map_size", [mp], _simple(INTEGER, lambda m: to_int(F.size(m))))
    _add("map_keys", [mp], _simple(lambda b: Type("array", (b["K"],)), F.map_keys))
    _add("map_values", [mp], _simple(lambda b: Type("array", (b["V"],)), F.map_values))
    _add("map_has", [mp], _simple(BOOL, F.map_contains_key), key=key)
    _add("map_get", [mp], lambda _, p, kw: subscript(p[0], kw["key"]), key=key)
    _add("map_without", [mp], _simple(same(mp), lambda m, ks: F.map_filter(m, lambda k, _: ~F.array_contains(ks, k))), keys=Type("array", (key,)))
    _add("map_merge", [mp, mp], _simple(same(mp), lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)))

    _add("array_size", [arr], _simple(INTEGER, lambda a: to_int(F.size(a))))
    _add("array_append", [arr, var], _simple(same(arr), lambda a, x: F.concat(a, F.array(x))))
    _add("array_prepend", [var, arr], _simple(same(arr), lambda x, a: F.concat(F.array(x), a)))
    _add("array_contains", [arr, var], _simple(BOOL, F.array_contains))
    _add("array_reverse", [arr], _simple(same(arr), F.reverse))
    _add("array_sort", [arr], _simple(same(arr), F.array_sort))
    _add("array_at", [arr, I64], lambda _, p, __: subscript(*p))

    day = 86_400_000_000
    # Timestamps are raw microseconds; a date is held as a day, a time as microseconds of the day.
    _add("date", [Type("timestamp")], _simple(Type("date"), lambda us: F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / day).cast("int"))))
    _add("time", [Type("timestamp")], _simple(Type("time"), lambda us: F.pmod(us, F.lit(day))))
    _add("timestamp", [I64], _simple(Type("timestamp"), lambda us: us))

    _add("abs_i64", [I64], _simple(I64, lambda x: F.when(x < 0, _arith("sub", I64, F.lit(0).cast("long"), x)).otherwise(x)))
    _add("abs_f64", [F64], _simple(F64, F.abs))
    _add("abs_numeric", [NUMERIC], _simple(NUMERIC, F.abs))
    _add("sign_i64", [I64], _simple(I64, lambda x: F.signum(x.cast("double")).cast("long")))
    _add("sign_f64", [F64], _simple(I64, lambda x: F.signum(x).cast("long"), F.isnan))
    _add("sign_numeric", [NUMERIC], _simple(INTEGER, lambda x: to_int(F.signum(x.cast("double")))))
    _add("sqrt_f64", [F64], _simple(F64, F.sqrt, lambda x: x < 0))
    _add("pow_f64", [F64, F64], _simple(F64, F.pow))
    _add("ln_f64", [F64], _simple(F64, F.log, lambda x: x <= 0))
    _add("log_f64", [F64], _simple(F64, lambda x, b: F.log(x) / F.log(b), lambda x, b: (x <= 0) | (b <= 0) | (b == 1)), base=F64)
    out_of_long = lambda x: F.isnan(x) | (F.abs(x) >= float(2**63))
    half_away = lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5)
    for name, fn in (("ceil", F.ceil), ("floor", F.floor), ("round", half_away)):
        _add(f"{name}_f64", [F64], _simple(I64, lambda x, fn=fn: fn(x).cast("long"), out_of_long))
    for name, fn in (("ceil", F.ceil), ("floor", F.floor), ("round", lambda x: F.round(x, 0))):
        _add(f"{name}_numeric", [NUMERIC], _simple(INTEGER, lambda x, fn=fn: to_int(fn(x))))
    _add("is_nan", [F64], _simple(BOOL, F.isnan))
    _add("is_infinite", [F64], _simple(BOOL, lambda x: F.abs(x) == float("inf")))
    _add("is_finite", [F64], _simple(BOOL, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))))


#: Infix and prefix operators: symbol -> family.
_INFIX = {"+": "add", "-": "sub", "*": "mul", "/": "div", "%": "mod", "=": "eq", "!=": "neq", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}
_LOGIC = {"and": "and", "or": "or", "not": "not"}
_BITWISE = {"&": "bits_and", "|": "bits_or", "^": "bits_xor", "~": "bits_not", "<<": "bits_shl", ">>": "bits_shr", "<<<": "bits_rotl", ">>>": "bits_rotr"}


def resolve(op: str, types: list[Type]) -> str:
    """The library name that an operator stands for with operands of these types."""
    if any(t.name in ("dynamic", "json") for t in types):
        raise ProgramError("fn_lookup_error", f"{op} on {types[0]}")
    if op in _LOGIC:
        return f"std.{op}"
    if op in _BITWISE:
        return f"std.{_BITWISE[op]}"
    first = types[0]
    if op == "++":
        return f"std.concat_{first.name}"
    family = "neg" if op == "-" and len(types) == 1 else _INFIX[op]
    if first.name == "enum":
        if is_bool(first) and all(is_bool(t) for t in types):
            return f"std.{family}_boolean"
        if family in ("eq", "neq") and all(t.name == "enum" for t in types):
            return f"enum.{family}"
    return f"std.{family}_{first.name}"


def call(name: str, pos: list[Val], kw: dict[str, Val]) -> Val:
    """Apply a library function; its overload is chosen by exact types."""
    if name in ("enum.eq", "enum.neq"):
        return _compare(name[5:], STRING, *pos)
    if name not in LIBRARY:
        raise ProgramError("fn_lookup_error", name)
    for patterns, kinds, impl in LIBRARY[name]:
        bound: dict[str, Type] = {}
        if len(patterns) != len(pos) or kinds.keys() != kw.keys():
            continue
        fits = all((is_bool(v.type) and p == BOOL) or unify(p, v.type if v.type.name != "array" or len(p.args) > 1 else Type("array", v.type.args[:1]), bound) for p, v in [*zip(patterns, pos, strict=True), *((kinds[k], kw[k]) for k in kinds)])
        if fits:
            return impl(bound, pos, {k: kw[k] for k in kinds})
    given = ", ".join([*(str(v.type) for v in pos), *(f"{k}: {v.type}" for k, v in kw.items())])
    raise ProgramError("fn_lookup_error", f"{name}({given})")


_register()
