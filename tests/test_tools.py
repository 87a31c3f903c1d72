"""Wire format, command line, continuous evaluation and HTTP."""

import http.client
import json
import threading

import pytest
from pyspark.sql import functions as F

from deltaweave.cli import load, main
from deltaweave.lang.errors import ProgramError
from deltaweave.lang.syntax import parse_type
from deltaweave.operators.zset import W, ZSet
from deltaweave.plans.circuit import Plan
from deltaweave.plans.graph import to_dot
from deltaweave.sources.codec import decode, encode, header
from deltaweave.streaming.engine import Engine
from deltaweave.streaming.http import Service, server

SUMS = """
src := source("t")
src :: stream(struct("k": i64, "v": i64))
f :: aggregate_function((struct("k": i64, "v": i64)) -> struct("s": i64))
f := function((r) -> struct("s": std.agg_sum_i64(r.v)))
out := aggregate(src, f, by: ["k"])
late := delay(src)
"""

VALUES = {
    "i64": "-5", "u64": "18446744073709551615", "integer": "99999999999999999999", "f64": "3.5", "f32": "nan", "numeric": "1.25", 'string("UTF-8")': "é\"x", 'enum("false","true")': "true", 'enum("a","b")': "b",
    "bytes": {"encoding": "base64", "value": "AQID"}, "bits": {"encoding": "base64", "value": "/w=="}, "date": {"days_since_2000": "9705"}, "time": {"hour": "14", "minute": "30", "second": "0", "microsecond": "500000"},
    "timestamp": {"epoch_microseconds": "-7"}, "interval": {"months": "1", "days": "5", "microseconds": "36"}, "timestamp_with_timezone": {"epoch_microseconds": "7", "offset_seconds": "3600", "zone": "x"},
    "array(i64)": ["1", "2"], "array(i64, 2, 2)": [["1", "2"], ["3", "4"]], 'map(string("UTF-8"), i64)': [["a", "10"], ["b", "20"]], "optional(i64)": None, 'struct("a": i64, "d": date)': {"a": "1", "d": {"days_since_2000": "0"}},
    "dynamic": {"type": "i64", "value": "10"}, "string_with_encoding": {"encoding": "latin1", "value": "q"},
}


def test_every_type_survives_the_wire(spark):
    t = parse_type("struct(" + ", ".join(f'"f{i}": {k}' for i, k in enumerate(VALUES)) + ")")
    row = {f"f{i}": v for i, v in enumerate(VALUES.values())}
    lines = spark.createDataFrame([(json.dumps([3, row | {"extra": 1}]) + "\r",), ("",)], "value string")
    (line,) = [r["value"] for r in encode(ZSet.of(decode(lines, t), W), t).collect()]
    assert json.loads(line) == [3, row]
    assert json.loads(header(t))["f0"] == "i64"


@pytest.mark.parametrize("line", ['[1, {"k": "1"}]', '[1, {"k": "x", "v": "1"}]', "nonsense", '["a", {"k": "1", "v": "1"}]'])
def test_bad_lines_are_named(spark, line):
    t = parse_type('struct("k": i64, "v": i64)')
    with pytest.raises(Exception, match="bad row"):
        decode(spark.createDataFrame([(line,)], "value string"), t).collect()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.flow").write_text(SUMS)
    rows = [[1, {"k": "1", "v": "5"}], [1, {"k": "1", "v": "6"}], [-1, {"k": "1", "v": "5"}]]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    assert main(["validate", str(tmp_path / "src")]) == 0
    dest = tmp_path / "out.jsonl"
    assert main(["run", "--unit-epochs", "--input", f"t={tmp_path}/t.jsonl", "--output", f"out={dest}", str(tmp_path / "src")]) == 0
    head, *lines = map(json.loads, dest.read_text().splitlines())
    assert head == {"k": "i64", "s": "i64"}
    at = lambda s, w: [w, {"k": "1", "s": s}]
    assert lines == [at("5", 1), at("5", -1), at("11", 1), at("11", -1), at("6", 1)]
    assert main(["run", "--input", f"t={tmp_path}/t.jsonl", "--output", "out=-", str(tmp_path / "src")]) == 0
    assert capsys.readouterr().out.splitlines()[1:] == ['[1,{"k":"1","s":"6"}]']
    assert main(["run", "--input", "x=y", "--output", "out=-", str(tmp_path / "src")]) == 1
    assert main(["run", "--input", f"t={tmp_path}/t.jsonl", "--output", "no=-", str(tmp_path / "src")]) == 1
    assert main(["validate", str(tmp_path / "none")]) == 1
    assert "aggregate" in to_dot(Plan(load([str(tmp_path / "src")])))


def _bag(df):
    return {tuple(r.asDict()[c] for c in sorted(df.columns) if c != W): r[W] for r in df.collect()}


def test_engine_steps_and_repeats(spark):
    plan = Plan(SUMS)
    e = Engine(spark, plan, ["out", "late"])
    batch = lambda *r: {"t": spark.createDataFrame(list(r), "k bigint, v bigint, __w bigint")}
    assert _bag(e.step(batch((1, 5, 1), (2, 7, 1)))["out"]) == {(1, 5): 1, (2, 7): 1}
    second = e.step(batch((1, 6, 1), (2, 7, -1)))
    assert _bag(second["out"]) == {(1, 5): -1, (1, 11): 1, (2, 7): -1}
    assert _bag(second["late"]) == {(1, 5): 1, (2, 7): 1}
    again = Engine(spark, plan, ["out", "late"], e.folder)
    assert again.last == 1 and _bag(again.step(batch((9, 9, 9)), 1)["out"]) == {(1, 5): -1, (1, 11): 1, (2, 7): -1}


def test_structured_stream(spark, tmp_path):
    folder = tmp_path / "in"
    spark.range(3).select(F.col("id").alias("k"), F.lit(2).cast("long").alias("v")).write.parquet(str(folder))
    plan = Plan(SUMS.replace("late := delay(src)\n", ""))
    seen = []
    e = Engine(spark, plan, ["out"])
    stream = spark.readStream.schema("k bigint, v bigint").parquet(str(folder))
    q = e.follow({"t": stream}, lambda name, d, i: seen.append((name, _bag(d))), availableNow=True)
    q.awaitTermination(120)
    merged = {k: w for _, b in seen for k, w in b.items()}
    assert merged == {(0, 2): 1, (1, 2): 1, (2, 2): 1}


def test_http(spark):
    service = Service(spark, Plan(SUMS), ["out"])
    s = server(service, "127.0.0.1", 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    port = s.server_address[1]

    def ask(method, path, body=None):
        c = http.client.HTTPConnection("127.0.0.1", port, timeout=120)
        c.request(method, path, body)
        return c.getresponse()

    assert ask("GET", "/healthz").read() == b"ok"
    assert ask("POST", "/inputs/none", "").status == 404
    assert ask("GET", "/outputs/none").status == 404
    out = ask("GET", "/outputs/out")
    assert json.loads(out.fp.readline() and out.fp.readline()) == {"k": "i64", "s": "i64"}
    assert ask("POST", "/inputs/t", '[1, {"k": "1", "v": "2"}]\nnonsense').status == 400
    assert ask("POST", "/inputs/t", '[1, {"k": "1", "v": "2"}]\n').status == 204
    out.fp.readline()  # end of chunk
    out.fp.readline()  # chunk size
    assert json.loads(out.fp.readline()) == [1, {"k": "1", "s": "2"}]
    s.shutdown()


def test_unknown_names():
    with pytest.raises(ProgramError, match="no_such_file"):
        load(["/nowhere/at/all"])
