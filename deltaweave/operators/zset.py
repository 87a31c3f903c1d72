"""Weighted tables (Z-sets) on DataFrames.

A ``ZSet`` is a bag of rows with signed integer weights in the column ``__w``. While every weight is known to be 1 the column
is not there at all (``unit``), so joins, counts and scans are the plain ones. Rows that repeat add up; ``norm`` is the
normal form: one row per value, no zero weights. ``ctx`` names columns that every operator keeps apart (epochs in replay):
they join the keys of joins, groups, windows and set operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import Aggregate, finish, merged, xor_words
from ..lang.errors import ProgramError
from ..plans.staging import stage

W = "__w"


@dataclass
class ZSet:
    df: DataFrame
    cols: list[str]
    unit: bool = True
    ctx: tuple[str, ...] = ()
    #: Is it in normal form?
    net: bool = False

    # -- making
    @staticmethod
    def of(df: DataFrame, weight: str | None = None, ctx: Sequence[str] = ()) -> ZSet:
        """A table as a Z-set; ``weight`` names its weight column, if it has one."""
        cols = [c for c in df.columns if c != weight and c not in ctx]
        if weight:
            return ZSet(df.select(*ctx, *cols, F.col(weight).cast("long").alias(W)), cols, False, tuple(ctx))
        return ZSet(df.select(*ctx, *cols), cols, True, tuple(ctx))

    @staticmethod
    def empty(spark: SparkSession, schema: T.StructType) -> ZSet:
        return ZSet(spark.createDataFrame([], schema), schema.fieldNames(), True)

    @property
    def w(self) -> Column:
        return F.lit(1).cast("long") if self.unit else F.col(W)

    @property
    def extra(self) -> list[str]:
        """Columns besides the data."""
        return [*self.ctx, *([] if self.unit else [W])]

    def _new(self, df: DataFrame, cols: Sequence[str], unit: bool | None = None) -> ZSet:
        return ZSet(df, list(cols), self.unit if unit is None else unit, self.ctx)

    # -- normal form
    def norm(self) -> ZSet:
        """One row per value with its net weight, zeros gone."""
        if self.net:
            return self
        keys = [*self.ctx, *self.cols]
        df = self.df.groupBy(*keys).agg(F.sum(self.w).alias(W)).where(F.col(W) != 0)
        return ZSet(df, self.cols, False, self.ctx, True)

    def rows(self) -> DataFrame:
        """Data columns only, each row as often as its net weight."""
        if self.unit:
            return self.df.select(*self.ctx, *self.cols)
        n = self.norm().df.where(F.col(W) > 0)
        return n.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(W)))).select(*self.ctx, *self.cols)

    def weighted(self) -> DataFrame:
        """Data columns and the weight."""
        return self.df if not self.unit else self.df.withColumn(W, F.lit(1).cast("long"))

    # -- row-wise
    def map(self, columns: dict[str, Column], drop: Column | None = None) -> ZSet:
        df = self.df if drop is None else self.df.where(~F.coalesce(drop, F.lit(False)))
        return self._new(df.select(*self.extra, *(c.alias(n) for n, c in columns.items())), list(columns))

    def filter(self, keep: Column, drop: Column | None = None) -> ZSet:
        keep = keep if drop is None else F.when(F.coalesce(drop, F.lit(False)), F.lit(False)).otherwise(keep)
        return self._new(self.df.where(keep), self.cols)

    def flat_map(self, rows: Column, drop: Column | None = None) -> ZSet:
        """``rows`` is an array of structs, each of which becomes a row of the same weight."""
        df = self.df if drop is None else self.df.where(~F.coalesce(drop, F.lit(False)))
        df = df.select(*self.extra, F.explode(rows).alias("__r"))
        fields = df.schema["__r"].dataType.fieldNames()
        return self._new(df.select(*self.extra, *(F.col("__r").getField(f).alias(f) for f in fields)), fields)

    def project(self, cols: Sequence[str]) -> ZSet:
        missing = [c for c in cols if c not in self.cols]
        if missing:
            raise ProgramError("missing_field", ", ".join(missing))
        return self._new(self.df.select(*self.extra, *cols), cols)

    def neg(self) -> ZSet:
        return self._new(self.df.select(*self.ctx, *self.cols, (-self.w).alias(W)), self.cols, False)

    def plus(self, *others: ZSet) -> ZSet:
        parts = [self, *others]
        if any(set(p.cols) != set(self.cols) for p in parts):
            raise ProgramError("type_conflict", "plus over different columns")
        unit = all(p.unit for p in parts)
        frames = [(p.df if unit else p.weighted()).select(*self.ctx, *self.cols, *([] if unit else [W])) for p in parts]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return self._new(out, self.cols, unit)

    # -- sets
    def distinct(self) -> ZSet:
        """Each value of positive net weight once."""
        keys = [*self.ctx, *self.cols]
        if self.unit:
            return self._new(self.df.groupBy(*keys).agg(F.lit(1).alias("__one")).select(*keys), self.cols, True)
        return self._new(self.norm().df.where(F.col(W) > 0).select(*keys), self.cols, True)

    def _keys(self, on: Sequence[str]) -> list[str]:
        for c in on:
            if c not in self.cols:
                raise ProgramError("missing_field", c)
        return [*self.ctx, *on]

    def join(self, other: ZSet, on: Sequence[str] = ()) -> ZSet:
        """Inner equi-join on columns of the same name; weights multiply. No columns: every pair."""
        other._keys(on)
        self._keys(on)
        rest = [c for c in other.cols if c not in on]
        if clash := [c for c in rest if c in self.cols]:
            raise ProgramError("duplicate_field", ", ".join(clash))
        ctx = tuple(dict.fromkeys([*self.ctx, *other.ctx]))
        shared = [c for c in self.ctx if c in other.ctx]
        keys = [*shared, *on]
        r = other.df.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)), *rest, *(c for c in other.ctx if c not in shared), *([] if other.unit else [F.col(W).alias("__v")]))
        if keys:
            cond = None
            for i, c in enumerate(keys):
                same = self.df[c].eqNullSafe(r[f"__k{i}"]) if _nullable(self.df, c) and _nullable(other.df, c) else self.df[c] == r[f"__k{i}"]
                cond = same if cond is None else cond & same
            df = self.df.join(r, cond)
        else:
            df = self.df.crossJoin(r)
        unit = self.unit and other.unit
        weight = [] if unit else [((F.col(W) if not self.unit else F.lit(1).cast("long")) * (F.col("__v") if not other.unit else F.lit(1).cast("long"))).alias(W)]
        return ZSet(df.select(*ctx, *self.cols, *rest, *weight), [*self.cols, *rest], unit, ctx)

    def _present(self, on: Sequence[str]) -> DataFrame:
        """Keys whose net weight is not zero."""
        keys = self._keys(on)
        if self.unit:
            return self.df.select(*keys)
        if not keys:
            return self.df.agg(F.sum(W).alias(W)).where(F.col(W) != 0).select(F.lit(1).alias("__one"))
        return self.df.groupBy(*keys).agg(F.sum(W).alias(W)).where(F.col(W) != 0).select(*keys)

    def _matching(self, other: ZSet, on: Sequence[str], how: str) -> ZSet:
        keys = self._keys(on)
        r = other._present(on)
        r = r.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys))) if keys else r.select(F.lit(1).alias("__one")).limit(1)
        cond = F.lit(True) if not keys else None
        for i, c in enumerate(keys):
            same = self.df[c].eqNullSafe(r[f"__k{i}"]) if _nullable(self.df, c) and _nullable(r, f"__k{i}") else self.df[c] == r[f"__k{i}"]
            cond = same if cond is None else cond & same
        return self._new(self.df.join(r, cond, how), self.cols)

    def antijoin(self, other: ZSet, on: Sequence[str]) -> ZSet:
        """Rows without a key of non-zero net weight in ``other``; own weights stay."""
        return self._matching(other, on, "left_anti")

    def semijoin(self, other: ZSet, on: Sequence[str]) -> ZSet:
        return self._matching(other, on, "left_semi")

    def minus(self, other: ZSet) -> ZSet:
        """EXCEPT ALL as Z-set difference; weights may be negative."""
        return self.plus(other.neg()).norm()

    def intersect(self, other: ZSet) -> ZSet:
        return self.distinct().semijoin(other, self.cols)

    def subtract(self, other: ZSet) -> ZSet:
        return self.distinct().antijoin(other, self.cols)

    # -- aggregation
    def aggregate(self, aggs: dict[str, Aggregate], by: Sequence[str], result: dict[str, Column] | None = None, drop: Column | None = None) -> ZSet:
        """Group by ``by``; ``aggs`` are named primitives and ``result`` columns over their names (default: the aggregates).

        A group is there while its net multiset is not empty, whatever its weights sum to; with no ``by`` an empty input gives
        no row. A group for which a primitive has nothing to report is left out.
        """
        keys = self._keys(by)
        unit = self.unit
        source = self.df if unit else self.norm().df
        rows = source.select(*keys, *(a.argument.alias(f"__x{i}") for i, a in enumerate(aggs.values()) if a.argument is not None), *([] if unit else [W]))
        args = [c for c in rows.columns if c.startswith("__x")]
        df = rows
        if not unit and any(a.needs_values for a in aggs.values()):
            df = df.groupBy(*keys, *args).agg(F.sum(W).alias(W))  # min and max look at net values; zeros stay, as the group does
        w = F.lit(1).cast("long") if unit else F.col(W)
        made = [merged(a, F.col(f"__x{i}") if a.argument is not None else None, w, unit).alias(f"__a{i}") for i, a in enumerate(aggs.values()) if a.kind != "xor"]
        out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *made)
        if not keys:
            out = out.where(F.col("__n") != 0)
        for i, a in enumerate(aggs.values()):
            if a.kind == "xor":
                x = xor_words(rows, keys, F.col(f"__x{i}"), w).withColumnsRenamed({k: f"__k{j}" for j, k in enumerate(keys)} | {"__xor": f"__a{i}"})
                cond = F.lit(True)
                for j, k in enumerate(keys):
                    cond = cond & out[k].eqNullSafe(x[f"__k{j}"])
                out = out.join(x, cond, "left").drop(*(f"__k{j}" for j in range(len(keys))))
        return self._reported(out, keys, by, aggs, result, drop)

    def _reported(self, out: DataFrame, keys: Sequence[str], by: Sequence[str], aggs: dict[str, Aggregate], result: dict[str, Column] | None, drop: Column | None) -> ZSet:
        """Groups (keys, ``__a0``, ``__a1``, ...) as rows of the result."""
        named = {n: finish(a, F.col(f"__a{i}")) for i, (n, a) in enumerate(aggs.items())}
        for i, a in enumerate(aggs.values()):
            if a.may_be_missing:
                out = out.where(F.col(f"__a{i}").isNotNull())
        out = out.select(*keys, *(c.alias(n) for n, c in named.items()))
        if result is None:
            return self._new(out, [*by, *named], True)
        if drop is not None:
            out = out.where(~F.coalesce(drop, F.lit(False)))
        return self._new(out.select(*keys, *(c.alias(n) for n, c in result.items())), [*by, *result], True)

    # -- order
    def order(self, by: Sequence[tuple[str, str]], rank: str = "rank", row_number: str = "row_number") -> ZSet:
        """Occurrences with SQL RANK over the sort key and a unique row number (ties: all fields in name order).

        Without context the sort is a range partitioning: a partition numbers its rows, offsets are prefix sums over the
        partitions' counts, and the rank of a key is its least row number, so no task sees all rows.
        """
        for c, d in by:
            if c not in self.cols:
                raise ProgramError("missing_field", c)
            if d not in ("asc", "desc"):
                raise ProgramError("compile_error", f"bad_direction {d}")
        if rank == row_number or rank in self.cols or row_number in self.cols:
            raise ProgramError("compile_error", "column_collision")
        rows = self.rows()
        # A -0.0 equals 0.0 and NaN sorts last, as in the language.
        keys = [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in by]
        ties = [F.col(c).asc() for c in sorted(self.cols) if _orderable(rows.schema[c].dataType)]
        wide = "decimal(38,0)"
        if self.ctx:
            part = Window.partitionBy(*self.ctx)
            out = rows.select(*self.ctx, *self.cols, F.rank().over(part.orderBy(*keys)).cast(wide).alias(rank), F.row_number().over(part.orderBy(*keys, *ties)).cast(wide).alias(row_number))
            return self._new(out, [*self.cols, rank, row_number], True)
        placed = rows.repartitionByRange(*keys, *ties).sortWithinPartitions(*keys, *ties)
        placed = stage(placed.select(*self.cols, F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__i")))
        # One row per partition.
        sizes = placed.groupBy("__p").agg(F.count("*").alias("__c")).withColumn("__o", F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
        numbered = placed.join(F.broadcast(sizes.select("__p", F.coalesce("__o", F.lit(0)).alias("__o"))), "__p").withColumn("__rn", F.col("__o") + F.col("__i") + 1)
        sort_cols = [c for c, _ in by]
        least = numbered.groupBy(*sort_cols).agg(F.min("__rn").alias("__rank")).select(*(F.col(c).alias(f"__s{i}") for i, c in enumerate(sort_cols)), "__rank")
        cond = None
        for i, c in enumerate(sort_cols):
            same = numbered[c].eqNullSafe(least[f"__s{i}"])
            cond = same if cond is None else cond & same
        out = numbered.join(least, cond).select(*self.cols, F.col("__rank").cast(wide).alias(rank), F.col("__rn").cast(wide).alias(row_number))
        return self._new(out, [*self.cols, rank, row_number], True)


def _nullable(df: DataFrame, c: str) -> bool:
    return df.schema[c].nullable


def _orderable(t: T.DataType) -> bool:
    return not isinstance(t, (T.MapType, T.VariantType))
