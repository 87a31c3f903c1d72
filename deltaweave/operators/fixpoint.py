"""Least fixpoints: a semi-naive loop on the driver over staged tables.

Each round evaluates the body over what the last round found (or over everything, if the body joins the relation with
itself), keeps what is new and writes it to the shared folder, so plans stay short and a lost executor costs one round.
Only emptiness reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from ..lang.errors import ProgramError
from ..plans.staging import drop_stage, stage
from .zset import ZSet

MAX_ROUNDS = 10_000
#: Rounds after which the found parts of a relation are rewritten as one table.
COMPACT = 12

Step = Callable[[dict[str, ZSet | None], bool], dict[str, ZSet | None]]


def fixpoint(seeds: dict[str, ZSet | None], step: Step, linear: bool = True, max_rounds: int = MAX_ROUNDS) -> dict[str, ZSet | None]:
    """Relations by name. ``step(bound, first)`` evaluates the body; seeds are seen in the first round only.

    ``linear`` says that each output is a union of terms with one recursive relation each, so that feeding back the new rows
    alone is enough. A relation that stays empty and has no columns is None.
    """
    found: dict[str, list[ZSet]] = {k: [] for k in seeds}
    delta: dict[str, ZSet | None] = {k: s.distinct() if s is not None else None for k, s in seeds.items()}
    for n in range(max_rounds):
        bound = delta if linear else {k: _union([*found[k], *([seeds[k].distinct()] if seeds[k] is not None else [])]) for k in seeds}
        out = step(bound, n == 0)
        delta, some = {}, False
        for k, z in out.items():
            delta[k] = None
            if z is None:
                continue
            new = z.distinct()
            if found[k]:  # one join, on the partitioning that the grouping made
                new = new.antijoin(_union(found[k]), new.cols)
            new = ZSet(stage(new.df), new.cols, True, new.ctx)
            if new.df.isEmpty():
                if found[k]:
                    drop_stage(new.df)
                else:
                    found[k].append(new)  # keeps the columns
                continue
            delta[k], some = new, True
            found[k].append(new)
            if len(found[k]) > COMPACT:
                whole = _union(found[k][:-1])
                merged = ZSet(stage(whole.df), whole.cols, True, whole.ctx)
                for part in found[k][:-1]:
                    drop_stage(part.df)
                found[k] = [merged, new]
        if not some:
            return {k: _union(v) for k, v in found.items()}
    raise ProgramError("fixpoint_error", f"no fixpoint after {max_rounds} rounds")


def _union(parts: list[ZSet]) -> ZSet | None:
    return parts[0].plus(*parts[1:]) if parts else None
