"""Operators on delta logs: Z-sets with an epoch column, each row a change at its epoch.

Linear operators carry the epoch along. A join is bilinear, so a pair of changes meets at the later of their epochs. ``distinct``
and ``antijoin`` follow running weights by key; aggregates that add up (counts, averages, sums but of doubles) are prefix sums by
group. The others compare states: the log is expanded to the state at every epoch that changes something, the plain operator runs
with the epoch as context, and consecutive results are subtracted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import Aggregate, _exact, _floor_div
from .zset import W, ZSet

E = "__e"


def log_of(df: DataFrame, epoch: str = E, weight: str | None = W) -> ZSet:
    """A table of changes as a delta log."""
    cols = [c for c in df.columns if c not in (epoch, weight)]
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    return ZSet(df.select(F.col(epoch).cast("long").alias(E), *cols, w.alias(W)), cols, False, (E,))


def _plain(z: ZSet, name: str) -> ZSet:
    """The epoch as an ordinary column called ``name``."""
    return ZSet(z.weighted().withColumnRenamed(E, name), [*z.cols, name], False, ())


def join(left: ZSet, right: ZSet, on: Sequence[str]) -> ZSet:
    both = _plain(left, "__e1").join(_plain(right, "__e2"), on)
    cols = [c for c in both.cols if c not in ("__e1", "__e2")]
    return ZSet(both.df.select(F.greatest("__e1", "__e2").alias(E), *cols, W), cols, False, (E,))


def _steps(z: ZSet, cols: Sequence[str], there: Callable[[Column], Column]) -> ZSet:
    """Changes of an indicator of each value's running weight."""
    per = z.weighted().groupBy(E, *cols).agg(F.sum(W).alias(W)).where(F.col(W) != 0)
    before = F.coalesce(F.sum(W).over(Window.partitionBy(*cols).orderBy(E).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = there(before + F.col(W)).cast("long") - there(before).cast("long")
    return ZSet(per.select(E, *cols, step.alias(W)).where(F.col(W) != 0), list(cols), False, (E,))


def distinct(z: ZSet) -> ZSet:
    return _steps(z, z.cols, lambda w: w > 0)


def antijoin(left: ZSet, right: ZSet, on: Sequence[str]) -> ZSet:
    """left minus its join with the keys that are there."""
    left._keys(on)
    right._keys(on)
    if on:
        keys = _steps(right, on, lambda w: w != 0)
    else:
        keys = _steps(right.map({"__one": F.lit(1)}), ["__one"], lambda w: w != 0)
        keys = ZSet(keys.df.select(E, W), [], False, (E,))
    return left.plus(join(left, keys, on).neg().project(left.cols))


def differentiate(z: ZSet) -> ZSet:
    return z.norm()


def delay(z: ZSet) -> ZSet:
    return ZSet(z.weighted().withColumn(E, F.col(E) + 1), z.cols, False, (E,))


def _difference(states: DataFrame, cols: Sequence[str], last: DataFrame, keys: Sequence[str] = ()) -> ZSet:
    """states (E, cols, W) at the epochs of ``last`` (keys, E, next epoch or null) -> changes."""
    on = [*keys, E]
    nxt = last.select(*(F.col(c).alias(f"__l{i}") for i, c in enumerate(on)), "__next")
    cond = None
    for i, c in enumerate(on):
        same = states[c].eqNullSafe(nxt[f"__l{i}"])
        cond = same if cond is None else cond & same
    ends = states.join(nxt, cond).where(F.col("__next").isNotNull()).select(F.col("__next").alias(E), *cols, (-F.col(W)).alias(W))
    return ZSet(states.select(E, *cols, W).unionByName(ends), list(cols), False, (E,)).norm()


def by_epoch(inputs: Sequence[ZSet], op: Callable[..., ZSet]) -> ZSet:
    """Run a plain operator on the states at every epoch that changes an input, and subtract consecutive results."""
    epochs = None
    for z in inputs:
        mine = z.df.select(E).distinct()
        epochs = mine if epochs is None else epochs.union(mine)
    # One row per epoch.
    epochs = epochs.distinct().withColumn("__next", F.lead(E).over(Window.orderBy(E)))
    out = op(*(state_at(z, epochs) for z in inputs))
    return _difference(out.weighted().select(E, *out.cols, W), out.cols, epochs)


def state_at(z: ZSet, epochs: DataFrame) -> ZSet:
    """The running Z-set at each of the epochs, with the epoch as context."""
    at = epochs.select(F.col(E).alias("__at"))
    held = z.weighted().join(at, F.col(E) <= F.col("__at")).groupBy("__at", *z.cols).agg(F.sum(W).alias(W)).where(F.col(W) != 0)
    return ZSet(held.withColumnRenamed("__at", E).select(E, *z.cols, W), z.cols, False, (E,), True)


def _adds_up(z: ZSet, aggs: dict[str, Aggregate]) -> bool:
    """Are all aggregates exact sums over the rows, whatever their order? Sums of doubles are not."""
    if any(a.kind not in ("sum", "count", "avg") for a in aggs.values()):
        return False
    summed = [a.argument for a in aggs.values() if a.kind == "sum"]
    return not any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in z.df.select(*summed).schema)


def _running(z: ZSet, aggs: dict[str, Aggregate], by: Sequence[str], result: dict[str, Column] | None, drop: Column | None) -> ZSet:
    """Aggregates that add up, as prefix sums: what a value adds to its group changes with its running weight, and what its
    values add is summed by group and epoch before it is summed along the epochs."""
    keys = z._keys(by)
    per = z.weighted().groupBy(E, *z.cols).agg(F.sum(W).alias(W)).where(F.col(W) != 0)
    before = F.coalesce(F.sum(W).over(Window.partitionBy(*z.cols).orderBy(E).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("__before", before)
    was, now = F.col("__before"), F.col("__before") + F.col(W)
    live = (now != 0).cast("long") - (was != 0).cast("long")
    adds = {"__n": live}
    for i, a in enumerate(aggs.values()):
        x = a.argument
        if a.kind == "count":
            adds[f"__s{i}"] = F.col(W)
            continue
        v = _exact(x, a.type) if a.kind == "sum" else x.cast("decimal(38,0)")
        adds[f"__s{i}"] = v * now - v * was
        adds[f"__c{i}"] = F.when(x.isNotNull(), live if a.kind == "sum" else F.col(W)).otherwise(0)
    sums = per.select(*keys, *(c.alias(n) for n, c in adds.items())).groupBy(*keys).agg(*(F.sum(n).alias(n) for n in adds))
    along = Window.partitionBy(*by).orderBy(E)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per group and epoch.
    sums = sums.select(*keys, *(F.sum(n).over(so_far).alias(n) for n in adds), F.lead(E).over(along).alias("__next")).where(F.col("__n") != 0)
    made = {}
    for i, a in enumerate(aggs.values()):
        s, c = F.col(f"__s{i}"), F.col(f"__c{i}")
        made[f"__a{i}"] = s if a.kind == "count" else F.when(c != 0, s if a.kind == "sum" else _floor_div(s, c))
    spans = ZSet(sums.select(*keys, "__next", *(c.alias(n) for n, c in made.items())), z.cols, True, (E, "__next"))
    out = spans._reported(spans.df, [*keys, "__next"], by, aggs, result, drop)
    starts = out.df.select(E, *out.cols, F.lit(1).cast("long").alias(W))
    ends = out.df.where(F.col("__next").isNotNull()).select(F.col("__next").alias(E), *out.cols, F.lit(-1).cast("long").alias(W))
    return ZSet(starts.unionByName(ends), out.cols, False, (E,)).norm()


def aggregate(z: ZSet, aggs: dict[str, Aggregate], by: Sequence[str], result: dict[str, Column] | None = None, drop: Column | None = None) -> ZSet:
    """Only the epochs at which a group changes are evaluated for it; sums, counts and averages run on from epoch to epoch."""
    if _adds_up(z, aggs):
        return _running(z, aggs, by, result, drop)
    if not by:
        return by_epoch([z], lambda s: s.aggregate(aggs, by, result, drop))
    z._keys(by)
    touched = z.df.select(*by, E).distinct().withColumn("__next", F.lead(E).over(Window.partitionBy(*by).orderBy(E)))
    at = touched.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by)), F.col(E).alias("__at"))
    cond = F.col(E) <= F.col("__at")
    for i, c in enumerate(by):
        cond = cond & z.df[c].eqNullSafe(at[f"__g{i}"])
    held = z.weighted().join(at, cond).groupBy("__at", *z.cols).agg(F.sum(W).alias(W)).where(F.col(W) != 0)
    state = ZSet(held.withColumnRenamed("__at", E).select(E, *z.cols, W), z.cols, False, (E,), True)
    out = state.aggregate(aggs, by, result, drop)
    return _difference(out.weighted().select(E, *out.cols, W), out.cols, touched, by)
