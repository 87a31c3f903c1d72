"""The scalar library: one program per input type, one column per function."""

import pytest
from programs import snapshot

from deltaweave.functions.scalar import LIBRARY
from deltaweave.lang.errors import ProgramError
from deltaweave.plans.circuit import Plan

S, B = 'string("UTF-8")', 'enum("false","true")'


def evaluate(spark, fields, row, cases):
    """cases: name -> (expression over r, result type)"""
    t = "struct(" + ", ".join(f'"{k}": {v}' for k, v in fields.items()) + ")"
    out = "struct(" + ", ".join(f'"{k}": {c[1]}' for k, c in cases.items()) + ")"
    body = ", ".join(f'"{k}": {c[0]}' for k, c in cases.items())
    src = f'src := source("t")\nsrc :: stream({t})\nf :: function(({t}) -> {out})\nf := function((r) -> struct({body}))\nout := map(src, f)\n'
    (got,) = snapshot(spark, src, {"t": [row]}, "out")
    return dict(next(iter(got))) if got else None


STRINGS = {
    "trim": ("std.string_trim(r.s)", S, "ab.cdé"), "ltrim": ("std.string_ltrim(r.s)", S, "ab.cdé "), "rtrim": ("std.string_rtrim(r.s)", S, "  ab.cdé"), "upper": ("std.string_upper(r.s)", S, "  AB.CDÉ "),
    "starts": ('std.string_starts_with(r.s, prefix: "  a")', B, True), "ends": ('std.string_ends_with(r.s, suffix: "x")', B, False), "has": ('std.string_contains(r.s, sub: ".c")', B, True),
    "sub1": ("std.string_substring(r.s, start: r.n)", S, "cdé "), "sub2": ("std.string_substring(r.s, start: r.n, length: r.n)", S, "cdé "), "at": ("std.string_at(r.s, r.n)", S, "c"),
    "sl1": ("std.string_slice(r.s, stop: r.n)", S, "  ab."), "sl2": ("std.string_slice(r.s, start: r.n, stop: r.m)", S, "cdé"), "step": ("r.s[0:8:2]", S, " a.d"), "down": ("r.s[8:5:-2]", S, "éc"), "none": ("r.s[0:9:-1]", S, ""), "past": ("r.s[6:99]", S, "dé "),
    "eq": ("std.string_eq(r.s, r.s)", B, True), "lt": ('r.s < "zz"', B, True), "len": ("std.string_length(r.s)", "integer", 9), "split": ('std.string_split(r.s, delimiter: ".")', f"array({S})", ("  ab", "cdé ")),
    "esc": (r'std.string_replace(r.s, from: ".", to: "\n")', S, "  ab\ncdé "), "cat": ('r.s ++ "x"', S, "  ab.cdé x"),
}
NUMBERS = {
    "abs": ("std.abs_i64(r.i)", "i64", 7), "sign": ("std.sign_i64(r.i)", "i64", -1), "absf": ("std.abs_f64(r.f)", "f64", 2.5), "signf": ("std.sign_f64(r.f)", "i64", -1), "ceil": ("std.ceil_f64(r.f)", "i64", -2), "floor": ("std.floor_f64(r.f)", "i64", -3),
    "round": ("std.round_f64(r.f)", "i64", -3), "pow": ("std.pow_f64(r.f, 2e0)", "f64", 6.25), "sqrt": ("std.sqrt_f64(4e0)", "f64", 2.0), "ln": ("std.ln_f64(1e0)", "f64", 0.0), "log": ("std.log_f64(8e0, base: 2e0)", "f64", 3.0),
    "nan": ("std.is_nan(r.f / 0e0)", B, False), "inf": ("std.is_infinite(r.f / 0e0)", B, True), "fin": ("std.is_finite(r.f)", B, True), "cn": ("std.ceil_numeric(r.d)", "integer", 2), "fn": ("std.floor_numeric(r.d)", "integer", 1), "rn": ("std.round_numeric(r.d)", "integer", 2),
    "an": ("std.abs_numeric(-r.d)", "numeric", 1.5), "sn": ("std.sign_numeric(r.d)", "integer", 1), "i8": ("r.t + r.t", "i8", -56), "u8": ("r.u - std.add_u8(r.u, r.u)", "u8", 56), "i8m": ("r.t * r.t", "i8", 16), "u64": ("r.w + r.w", "u64", 2**64 - 2), "i32": ("r.x * r.x", "i32", 1),
    "div": ("r.i / r.two", "i64", -3), "mod": ("r.i % r.two", "i64", -1), "big": ("99999999999999999999 * 3 / 2", "integer", 149999999999999999998), "num": ("r.d / 4.0", "numeric", 0.375), "cmp": ("r.d >= 1.50 and not (r.i > r.two)", B, True), "min": ("r.least / r.minus", "i64", -(2**63)),
}
OTHERS = {
    "msize": ("std.map_size(r.m)", "integer", 2), "mhas": ('std.map_has(r.m, key: "a")', B, True), "mget": ('std.map_get(r.m, key: "b")', "i64", 2), "mkeys": ("std.array_sort(std.map_keys(r.m))", f"array({S})", ("a", "b")), "mvals": ("std.array_size(std.map_values(r.m))", "integer", 2),
    "mwo": ('std.map_size(std.map_without(r.m, keys: ["a"]))', "integer", 1), "mmerge": ('std.map_get(std.map_merge(r.m, {a: std.array_at(r.a, std.sign_i64(r.one))}), key: "a")', "i64", 1), "asize": ("std.array_size(r.a ++ r.a)", "integer", 6), "app": ("std.array_append(r.a, r.one)", "array(i64)", (3, 1, 2, 1)),
    "pre": ("std.array_prepend(r.one, r.a)", "array(i64)", (1, 3, 1, 2)), "con": ("std.array_contains(r.a, r.one)", B, True), "rev": ("std.array_reverse(r.a)", "array(i64)", (2, 1, 3)), "sort": ("std.array_sort(r.a)", "array(i64)", (1, 2, 3)), "cut": ("r.a[1:]", "array(i64)", (1, 2)), "cut2": ("r.a[0:3:2]", "array(i64)", (3, 2)), "adown": ("r.a[3:0:-2]", "array(i64)", (2, 3)), "bdown": ("r.b[2:0:-1]", "bytes", b"\x02\xff"), "b2": ("r.b[0:3:2]", "bytes", b"\x01\x02"), "bits2": ("std.bits_eq(0b10110[0:5:2], 0b11)", B, True),
    "last": ("r.a[-1]", "i64", 2), "bsize": ("std.bytes_size(r.b)", "integer", 3), "bat": ("std.bytes_at(r.b, r.one)", "i64", 255), "bsl": ("r.b[1:3]", "bytes", b"\xff\x02"), "bcat": ("std.bytes_size(r.b ++ r.b)", "integer", 6), "beq": ("std.bytes_eq(r.b, r.b)", B, True), "bits": ("std.bits_size(0b1011[1:3])", "integer", 2),
    "xor": ("std.bits_eq(0b1100 ^ 0b1010, 0b0110)", B, True), "rot": ("std.bits_eq(0b1000 <<< 1, 0b0001)", B, True), "rotr": ("std.bits_eq(0b1000 >>> 1, 0b0100)", B, True), "shr": ("std.bits_eq(0b1101 >> 2, 0b01)", B, True), "or": ("std.bits_eq(0b1100 | 0b0011, 0b1111)", B, True),
    "time": ("std.time(std.timestamp(r.us))", "time", 5), "later": ("std.date(std.timestamp(r.us)) = std.date(std.timestamp(r.us))", B, True), "get": ('std.struct_get(struct("z": r.one), key: "z")', "i64", 1),
}


def compare(got, cases):
    for k, c in cases.items():
        v = got[k]
        assert (float(v) if isinstance(c[2], float) else v) == pytest.approx(c[2]) if isinstance(c[2], float) else v == c[2], (k, v, c[2])


def test_strings(spark):
    got = evaluate(spark, {"s": S, "n": "i64", "m": "i64"}, {"s": "  ab.cdé ", "n": 5, "m": 8}, STRINGS)
    compare(got, STRINGS)


def test_numbers(spark):
    fields = {"i": "i64", "two": "i64", "f": "f64", "d": "numeric", "t": "i8", "u": "u8", "w": "u64", "x": "i32", "least": "i64", "minus": "i64"}
    row = {"i": -7, "two": 2, "f": -2.5, "d": "1.5", "t": 100, "u": 200, "w": 2**64 - 1, "x": -(2**31) + 1, "least": -(2**63), "minus": -1}
    compare(evaluate(spark, fields, row, NUMBERS), NUMBERS)


def test_collections_and_bytes(spark):
    fields = {"m": f"map({S}, i64)", "a": "array(i64)", "b": "bytes", "one": "i64", "us": "i64"}
    row = {"m": {"a": 1, "b": 2}, "a": [3, 1, 2], "b": bytearray(b"\x01\xff\x02"), "one": 1, "us": 86_400_000_005}
    compare(evaluate(spark, fields, row, OTHERS), OTHERS)


@pytest.mark.parametrize("expr,kind", [("std.sqrt_f64(r.f)", "f64"), ("std.ln_f64(r.f)", "f64"), ("r.i / (r.i - r.i)", "i64"), ("r.i % (r.i - r.i)", "i64"), ("std.string_at(r.s, r.i)", S), ('r.m["x"]', "i64"), ("r.a[5]", "i64"), ("r.s[-2:]", S), ("r.a[0:1:0]", "array(i64)"), ("r.a[-1:1]", "array(i64)"), ("r.f / 0e0 - r.f / 0e0 < r.f", B)])
def test_no_result_drops_the_row(spark, expr, kind):
    fields = {"f": "f64", "i": "i64", "s": S, "m": f"map({S}, i64)", "a": "array(i64)"}
    assert evaluate(spark, fields, {"f": -1.0, "i": 9, "s": "abc", "m": {"y": 1}, "a": [1]}, {"v": (expr, kind)}) is None


@pytest.mark.parametrize("expr", ["r.i + 1", "r.i + r.f", "r.s + r.s", "not r.i", "r.s & r.s", "std.add_i64(r.i)", "std.string_split(r.s)", "r.i = r.s", "std.nothing(r.i)", "-r.s"])
def test_types_are_never_converted(spark, expr):
    with pytest.raises(ProgramError, match="fn_lookup_error"):
        evaluate(spark, {"i": "i64", "f": "f64", "s": S}, {"i": 1, "f": 1.0, "s": ""}, {"v": (expr, "i64")})


def test_the_catalogue_is_whole():
    names = {n.removeprefix("std.") for n in LIBRARY}
    ints = ["i64", "i32", "i16", "i8", "u64", "u32", "u16", "u8", "integer"]
    want = {f"{op}_{t}" for op in ("add", "sub", "mul", "div", "mod", "neg", "eq", "neq", "lt", "gt", "lte", "gte") for t in ints}
    want |= {f"{op}_{t}" for op in ("add", "sub", "mul", "div", "neg") for t in ("numeric", "f64")} | {"add_interval", "sub_interval", "not", "and", "or"}
    want |= {f"{op}_{t}" for op in ("eq", "neq", "lt", "gt", "lte", "gte") for t in ("f64", "string", "numeric", "boolean", "bytes", "bits", "date", "time", "timestamp", "interval")}
    want |= {f"concat_{t}" for t in ("string", "bytes", "bits", "array")} | {f"{t}_slice" for t in ("string", "bytes", "bits", "array")}
    assert want <= names


def test_intervals_enums_and_optionals(spark):
    src = """src := source("t")
    src :: stream(struct("a": interval, "b": interval, "e": enum("x","y"), "o": optional(i64)))
    f :: function((struct("a": interval, "b": interval, "e": enum("x","y"), "o": optional(i64))) -> struct("s": interval, "lt": enum("false","true"), "same": enum("false","true"), "o": optional(i64)))
    f := function((r) -> struct("s": r.a + r.b, "lt": r.a < r.b, "same": r.e = r.e, "o": r.o))
    out := distinct(map(src, f))
    """
    Plan(src)
    one = {"months": 1, "days": 2, "microseconds": 3}
    (got,) = snapshot(spark, src, {"t": [{"a": one, "b": {"months": 1, "days": 3, "microseconds": 0}, "e": "x", "o": None}] * 2}, "out")
    assert got == {(("lt", True), ("o", None), ("s", (("days", 5), ("microseconds", 3), ("months", 2))), ("same", True)): 1}
