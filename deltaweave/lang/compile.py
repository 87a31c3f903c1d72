"""Functions to columns: expressions are typed, checked and inlined into native Spark columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.aggregates import PRIMITIVES, Aggregate
from ..functions.values import Val, either
from .errors import ProgramError
from .syntax import Function, Program
from .types import BOOL, F64, INTEGER, NUMERIC, STRING, Type, is_bool, spark_type, struct

_OPERATORS = {*scalar._INFIX, *scalar._LOGIC, *scalar._BITWISE, "++"}


@dataclass
class Scope:
    """What an expression may use. ``aggregates`` gathers primitives where they are allowed."""

    program: Program
    names: dict[str, Val]
    calls: tuple[str, ...] = ()
    aggregates: list[tuple[Aggregate, Val]] | None = None
    row: str | None = None
    inside: bool = False
    cache: dict = field(default_factory=dict)


def _bad(kind: str, message: str = "") -> ProgramError:
    return ProgramError("compile_error", f"{kind} {message}".strip())


def literal(kind: str, text: str) -> Val:
    if kind == "int":
        return Val(INTEGER, F.lit(text).cast("decimal(38,0)"))
    if kind == "decimal":
        if "e" in text.lower():
            return Val(F64, F.lit(float(text)))
        return Val(NUMERIC, F.lit(text).cast("decimal(38,18)"))
    if kind == "float":
        return Val(F64, F.lit(float(text)))
    if kind == "string":
        return Val(STRING, F.lit(text), literal=text)
    if kind == "bits":
        n = len(text) - 2
        data = (int(text[2:], 2) << (-n % 8)).to_bytes((n + 7) // 8, "big")
        return Val(Type("bits"), F.struct(F.lit(bytearray(data)).alias("data"), F.lit(n).alias("nbits")))
    return {"true": Val(BOOL, F.lit(True)), "false": Val(BOOL, F.lit(False))}.get(text) or Val(Type("absent"), F.lit(None))


def expression(e: tuple, s: Scope) -> Val:
    form = e[0]
    if form in ("int", "decimal", "float", "bits", "string", "word"):
        return literal(form, e[1])
    if form == "var":
        if e[1] not in s.names:
            raise _bad("unbound_var", e[1])
        if s.aggregates is not None and e[1] == s.row and not s.inside:
            raise _bad("row_outside_aggregate", e[1])
        return s.names[e[1]]
    if form == "get":
        return scalar.subscript(expression(e[1], s), expression(e[2], s))
    if form == "slice":
        return scalar.slice_value(expression(e[1], s), *(expression(x, s) if x is not None else None for x in e[2:5]))
    _, name, args, kwargs = e
    if name in PRIMITIVES:
        return aggregate_call(name, args, kwargs, s)
    if name in ("struct", "map", "array"):
        return construct(name, args, kwargs, s)
    if name in ("std.struct_get", "std.struct_set"):
        return struct_call(name, args, kwargs, s)
    pos = [expression(a, s) for a in args]
    kw = {k: expression(v, s) for k, v in kwargs.items()}
    if name in s.program.functions or name in s.program.types:
        return user_call(name, pos, kw, s)
    if name in _OPERATORS:
        return scalar.call(scalar.resolve(name, [v.type for v in pos]), pos, kw)
    return scalar.call(name, pos, kw)


def aggregate_call(name: str, args: list, kwargs: dict, s: Scope) -> Val:
    if s.aggregates is None or s.inside:
        raise _bad("nested_aggregate" if s.inside else "aggregate_not_allowed", name)
    kind, wants, out = PRIMITIVES[name]
    if kwargs or len(args) != (wants is not None):
        raise _bad("fn_lookup_error", name)
    arg = None
    if wants is not None:
        s.inside = True
        arg = expression(args[0], s)
        s.inside = False
        if arg.type != wants:
            raise _bad("fn_lookup_error", f"{name}({arg.type})")
    value = None
    if arg is not None:
        value = arg.column if arg.drop is None else F.when(~F.coalesce(arg.drop, F.lit(False)), arg.column)
    s.aggregates.append((Aggregate(kind, value, out), arg))
    return Val(out, F.col(f"__agg{len(s.aggregates) - 1}"))


def construct(name: str, args: list, kwargs: dict, s: Scope) -> Val:
    if name == "struct":
        parts = {k: expression(v, s) for k, v in kwargs.items()}
        if args or not parts:
            raise _bad("bad_struct")
        return Val(struct({k: v.type for k, v in parts.items()}), None, either(*(v.drop for v in parts.values())), {k: Val(v.type, v.value, None, v.fields, v.literal) for k, v in parts.items()})
    if name == "array":
        items = [expression(a, s) for a in args]
        if not items:
            raise _bad("empty_array")
        if any(v.type != items[-1].type for v in items):
            raise _bad("type_conflict", "array elements")
        return Val(Type("array", (items[-1].type,)), F.array(*(v.column for v in items)), either(*(v.drop for v in items)))
    parts = {k: expression(v, s) for k, v in kwargs.items()}
    types = {str(v.type) for v in parts.values()}
    if len(types) != 1:
        raise _bad("type_conflict", "map values")
    pairs = [c for k, v in parts.items() for c in (F.lit(k), v.column)]
    return Val(Type("map", (STRING, next(iter(parts.values())).type)), F.create_map(*pairs), either(*(v.drop for v in parts.values())))


def struct_call(name: str, args: list, kwargs: dict, s: Scope) -> Val:
    if len(args) != 1 or set(kwargs) != ({"key"} if name == "std.struct_get" else {"key", "value"}):
        raise _bad("fn_lookup_error", name)
    base, key = expression(args[0], s), expression(kwargs["key"], s)
    if name == "std.struct_get":
        return scalar.subscript(base, key)
    if base.type.name != "struct":
        raise _bad("type_conflict", str(base.type))
    if key.literal is None:
        raise _bad("non_literal_key")
    if key.literal not in base.type.fields:
        raise _bad("missing_field", key.literal)
    value = expression(kwargs["value"], s)
    if value.type != base.type.fields[key.literal]:
        raise _bad("type_conflict", f"{key.literal}: {value.type}")
    fields = {n: base.get(n) for n in base.type.fields} | {key.literal: value}
    return Val(base.type, None, either(base.drop, value.drop), {n: Val(v.type, v.value, None, v.fields) for n, v in fields.items()})


def user_call(name: str, pos: list[Val], kw: dict[str, Val], s: Scope) -> Val:
    if name in s.calls:
        raise _bad("recursive_function", name)
    fn, t = signature(s.program, name)
    if fn is None:
        raise _bad("missing_function", name)
    if t.name != "function":
        raise _bad("aggregate_not_allowed", name)
    types, kinds = t.args[0], dict(t.args[1])
    if extra := set(kw) - set(kinds):
        raise _bad("unexpected_kw_arg", ", ".join(extra))
    if len(pos) != len(types):
        raise _bad("arg_count_mismatch", name)
    if missing := set(kinds) - set(kw):
        raise _bad("missing_kw_arg", ", ".join(missing))
    for v, wanted in [*zip(pos, types, strict=True), *((kw[k], kinds[k]) for k in kinds)]:
        if v.type != wanted:
            raise _bad("arg_type_mismatch", f"{name}: {v.type} for {wanted}")
    names = dict(zip(fn.positional, pos, strict=True)) | {var: kw[key] for key, var in fn.keyword}
    inner = Scope(s.program, names, (*s.calls, name))
    out = expression(fn.body, inner)
    if not same_result(out.type, t.args[2]):
        raise _bad("return_type_mismatch", f"{name}: {out.type} for {t.args[2]}")
    drop = either(out.drop, *(v.drop for v in [*pos, *kw.values()]))  # arguments are evaluated before the call
    return Val(t.args[2], out.value, drop, ordered(out, t.args[2]), out.literal)


def ordered(v: Val, t: Type) -> dict[str, Val] | None:
    """Fields in the declared order."""
    return {n: v.fields[n] for n in t.fields} if v.fields is not None and t.name == "struct" else v.fields


def same_result(got: Type, wanted: Type) -> bool:
    if got == wanted or (is_bool(got) and is_bool(wanted)):
        return True
    if wanted.name == "optional":
        return got.name == "absent" or same_result(got, wanted.args[0])
    if got.name == wanted.name == "struct":
        a, b = got.fields, wanted.fields
        return a.keys() == b.keys() and all(same_result(a[k], b[k]) for k in a)
    if got.name == wanted.name == "array" and len(wanted.args) == 1:
        return same_result(got.args[0], wanted.args[0])
    return False


def signature(p: Program, name: str) -> tuple[Function | None, Type]:
    t = p.types.get(name)
    fn = p.functions.get(name)
    if t is None or t.name not in ("function", "aggregate_function"):
        if fn is None:
            raise _bad("fn_lookup_error", name)
        raise _bad("missing_typespec", name)
    if fn is not None:
        if len(fn.positional) != len(t.args[0]):
            raise _bad("param_count_mismatch", name)
        if {k for k, _ in fn.keyword} != {k for k, _ in t.args[1]}:
            raise _bad("kw_param_mismatch", name)
    return fn, t


def placeholder(t: Type, name: str) -> Val:
    if t.name == "struct":
        return Val(t, None, None, {n: Val(x, F.lit(None).cast(spark_type(x))) for n, x in t.fields.items()})
    return Val(t, F.lit(None).cast(spark_type(t)))


def check_functions(p: Program) -> None:
    """Every function with a body is checked, used or not."""
    for name in p.functions:
        if name.startswith("std."):
            raise _bad("shadows_std", name)
        fn, t = signature(p, name)
        names = dict(zip(fn.positional, (placeholder(x, "") for x in t.args[0]), strict=True)) | {var: placeholder(dict(t.args[1])[key], "") for key, var in fn.keyword}
        if t.name == "aggregate_function":
            aggregate_body(p, name, names)
        else:
            out = expression(fn.body, Scope(p, names, (name,)))
            if not same_result(out.type, t.args[2]):
                raise _bad("return_type_mismatch", f"{name}: {out.type} for {t.args[2]}")


def row_value(t: Type) -> Val:
    """The row of a stream: its fields are the columns."""
    return Val(t, None, None, {n: Val(x, F.col(f"`{n}`")) for n, x in t.fields.items()})


def row_function(p: Program, name: str, row: Type) -> Val:
    """Apply a unary row function to the columns of a stream."""
    if name.startswith("std."):
        raise _bad("fn_lookup_error", name)
    fn, t = signature(p, name)
    if fn is None:
        raise _bad("missing_function", name)
    if t.name != "function":
        raise _bad("fn_lookup_error", name)
    if len(t.args[0]) != 1 or t.args[1]:
        raise _bad("row_fn_arity", name)
    if t.args[0][0] != row:
        raise ProgramError("type_conflict", f"{name} takes {t.args[0][0]}, the stream has {row}")
    return user_call(name, [row_value(row)], {}, Scope(p, {}))


def aggregate_body(p: Program, name: str, names: dict[str, Val]) -> tuple[Val, list[tuple[Aggregate, Val]]]:
    fn, t = signature(p, name)
    scope = Scope(p, names, (name,), [], fn.positional[0] if fn.positional else None)
    out = expression(fn.body, scope)
    if not scope.aggregates:
        raise _bad("no_aggregate_call", name)
    if not same_result(out.type, t.args[2]) or out.type.name != "struct":
        raise _bad("return_type_mismatch", f"{name}: {out.type} for {t.args[2]}")
    return Val(t.args[2], out.value, out.drop, ordered(out, t.args[2])), scope.aggregates


def aggregate_function(p: Program, name: str, row: Type) -> tuple[Type, dict[str, Aggregate], dict[str, Column], Column | None]:
    """(result type, primitives by placeholder, result columns, drop) of an aggregate function over a stream."""
    fn, t = signature(p, name)
    if fn is None:
        raise _bad("missing_function", name)
    if t.name != "aggregate_function":
        raise _bad("fn_lookup_error", name)
    if len(t.args[0]) != 1 or t.args[1]:
        raise _bad("row_fn_arity", name)
    if t.args[0][0] != row:
        raise ProgramError("type_conflict", f"{name} takes {t.args[0][0]}, the stream has {row}")
    out, aggs = aggregate_body(p, name, {fn.positional[0]: row_value(row)})
    return out.type, {f"__agg{i}": a for i, (a, _) in enumerate(aggs)}, {n: v.column for n, v in out.fields.items()}, out.drop
