"""Compiled expressions: a value column, its type, and the column that says when its row is dropped.

Absence is only inside ``optional``; anything that cannot be computed (division by zero, a NaN in a comparison, an index out
of range) drops its row. ``drop`` of a compound value is the OR of its parts', since arguments are evaluated eagerly;
value columns are guarded so that a row that will be dropped never raises.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.types import Type


@dataclass
class Val:
    type: Type
    value: Column | None
    drop: Column | None = None
    fields: dict[str, Val] | None = field(default=None)
    #: The literal text, where the expression is one.
    literal: str | None = None

    @property
    def column(self) -> Column:
        if self.value is None:
            return F.struct(*(v.column.alias(n) for n, v in self.fields.items()))
        return self.value

    def get(self, name: str) -> Val:
        if self.fields is not None:
            v = self.fields[name]
            return Val(v.type, v.value, either(self.drop, v.drop), v.fields, v.literal)
        return Val(self.type.fields[name], self.value.getField(name), self.drop)


def either(*drops: Column | None) -> Column | None:
    out = None
    for d in drops:
        if d is not None:
            out = d if out is None else out | d
    return out


def guarded(ok: Column, value: Column) -> Column:
    """``value`` where ``ok``, else null without evaluating it."""
    return F.when(ok, value)
