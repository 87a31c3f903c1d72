"""Helpers: run programs over small tables and delta logs given as Python rows."""

from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from deltaweave.lang.types import spark_schema
from deltaweave.plans.circuit import Plan


def frame(spark, plan, table, rows, *extra):
    """rows: dicts of field values (strings are cast); extra: further columns with their types."""
    t = plan.sources[table]
    schema = spark_schema(t)
    names = [*schema.fieldNames(), *(n for n, _ in extra)]
    plain = ", ".join([*(f"`{n}` {schema[n].dataType.simpleString()}" for n in schema.fieldNames()), *(f"`{n}` {k}" for n, k in extra)])
    wide = {n for n in schema.fieldNames() if "decimal" in schema[n].dataType.simpleString()}
    return spark.createDataFrame([tuple(Decimal(r[n]) if n in wide else r[n] for n in names) for r in rows], plain)


def bag(zset):
    """{row as sorted items: weight}"""
    out = Counter()
    for r in zset.norm().df.collect():
        d = r.asDict(recursive=True)
        w = d.pop("__w")
        out[tuple(sorted((k, _plain(v)) for k, v in d.items()))] += w
    return dict(out)


def _plain(v):
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "as_tuple") and v == v.to_integral_value():
        return int(v)
    return v


def rows(*dicts, w=1):
    return {tuple(sorted(d.items())): w for d in dicts}


def snapshot(spark, source, tables, *outputs):
    plan = Plan(source)
    frames = {t: frame(spark, plan, t, r) for t, r in tables.items()}
    got = plan.snapshot(spark, frames, outputs)
    return [bag(got[o]) for o in outputs]


def replayed(spark, source, epochs, output):
    """epochs: list of {table: [(weight, row)]}; returns a bag per epoch."""
    plan = Plan(source)
    logs = {}
    for t in plan.sources:
        changes = [{**r, "__e": e, "__w": w} for e, tables in enumerate(epochs) for w, r in tables.get(t, [])]
        logs[t] = frame(spark, plan, t, changes, ("__e", "bigint"), ("__w", "bigint"))
    z = plan.replay(spark, logs, [output], len(epochs) - 1)[output]
    got = bag(z)
    out = [{} for _ in epochs]
    for row, w in got.items():
        d = dict(row)
        e = d.pop("__e")
        out[e][tuple(sorted(d.items()))] = w
    return out


def ensure_replay_is_snapshot(spark, source, epochs, output):
    """The sum of all changes is the snapshot of the net input."""
    plan = Plan(source)
    frames = {}
    for t in plan.sources:
        changes = [{**r, "__w": w} for tables in epochs for w, r in tables.get(t, [])]
        frames[t] = frame(spark, plan, t, changes, ("__w", "bigint"))
    want = bag(plan.snapshot(spark, frames, [output])[output])
    total = Counter()
    for changes in replayed(spark, source, epochs, output):
        for k, w in changes.items():
            total[k] += w
    assert {k: w for k, w in total.items() if w} == want


__all__ = ["F", "bag", "ensure_replay_is_snapshot", "frame", "replayed", "rows", "snapshot"]
