"""Command line: ``validate``, ``run``, ``serve`` and ``graph``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .lang.errors import ProgramError
from .lang.syntax import Program, parse


def load(paths: list[str], suffix: str = ".flow") -> Program:
    """Programs of files and, for folders, of all files below with the suffix; declarations are put together."""
    files: list[Path] = []
    for p in map(Path, paths):
        if p.is_dir():
            files += sorted(p.rglob(f"*{suffix}"))
        elif p.is_file():
            files.append(p)
        else:
            raise ProgramError("no_such_file", str(p))
    if not files:
        raise ProgramError("no_sources", ", ".join(paths))
    return parse("\n".join(f.read_text() for f in files))


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("deltaweave").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def pair(text: str) -> tuple[str, str]:
    name, eq, value = text.partition("=")
    if not (name and eq and value):
        raise ProgramError("bad_argument", f"{text}: NAME=VALUE is wanted")
    return name, value


def run(args: argparse.Namespace) -> None:
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from .operators import replay
    from .operators.zset import W
    from .plans.circuit import Plan
    from .sources.codec import decode, encode, header

    inputs, outputs = dict(map(pair, args.input or [])), dict(map(pair, args.output or []))
    if not outputs:
        raise ProgramError("no_output", "--output NAME=DEST is wanted")
    program = load(args.sources, args.suffix)
    spark = session()
    plan = Plan(program)
    if unknown := [t for t in inputs if t not in plan.sources]:
        raise ProgramError("unknown_input", ", ".join(unknown))
    for o in outputs:
        plan.node(o)
    logs = {}
    for table, t in plan.sources.items():
        if table in inputs:
            lines = spark.read.text(inputs[table]).where(F.trim(F.regexp_replace("value", r"\r$", "")) != "")
            if args.unit_epochs:  # one row a table and epoch, in the order of the file
                lines = lines.withColumn("__i", F.monotonically_increasing_id())
                lines = lines.select("value", (F.row_number().over(Window.orderBy("__i")) - 1).cast("long").alias(replay.E))
            else:
                lines = lines.withColumn(replay.E, F.lit(0).cast("long"))
            logs[table] = decode(lines, t)
        else:
            from .lang.types import spark_schema

            logs[table] = spark.createDataFrame([], spark_schema(t).add(replay.E, "long").add(W, "long"))
    for name, z in plan.replay(spark, logs, list(outputs)).items():
        t = plan.type_of(name)
        lines = encode(z, t, (replay.E,)).orderBy(replay.E, "value").select("value").toLocalIterator()
        dest = outputs[name]
        out = sys.stdout if dest == "-" else open(dest, "w")
        out.write(header(t) + "\n")
        for r in lines:
            out.write(r["value"] + "\n")
        if dest != "-":
            out.close()


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="deltaweave")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("validate", "graph"):
        sub.add_parser(name).add_argument("sources", nargs="+")
    p = sub.add_parser("run")
    p.add_argument("--input", action="append", metavar="TABLE=FILE")
    p.add_argument("--output", action="append", metavar="NAME=DEST")
    p.add_argument("--unit-epochs", action="store_true", help="one row of each table per epoch")
    p.add_argument("sources", nargs="+")
    p = sub.add_parser("serve")
    p.add_argument("--output", action="append", required=True, metavar="NAME")
    p.add_argument("--listen", default="127.0.0.1:8080")
    p.add_argument("sources", nargs="+")
    for p in sub.choices.values():
        p.add_argument("--suffix", default=".flow", help="which files of a folder are programs")
    args = top.parse_args(argv)
    try:
        if args.command == "run":
            run(args)
        else:
            from .plans.circuit import Plan

            program = load(args.sources, args.suffix)
            spark = session()
            plan = Plan(program)
            if args.command == "graph":
                from .plans.graph import to_dot

                print(to_dot(plan))
            elif args.command == "serve":
                from .streaming.http import Service, server

                host, _, port = args.listen.rpartition(":")
                server(Service(spark, plan, args.output), host, int(port)).serve_forever()
    except ProgramError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
