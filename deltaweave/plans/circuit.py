"""Programs to plans: circuits are expanded, nodes shared by content, types inferred, and nodes evaluated as DataFrames.

Two evaluations share the operators: a snapshot (each node its net Z-set, which Catalyst plans end to end) and a replay of a
delta log (each node the log of its changes).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.compile import aggregate_function, check_functions, row_function
from ..lang.errors import ProgramError
from ..lang.syntax import OPERATORS, Call, Circuit, Program, Ref, parse
from ..lang.types import INTEGER, Type, is_bool, spark_schema, spark_type, struct
from ..operators import replay
from ..operators.fixpoint import fixpoint
from ..operators.zset import W, ZSet
from .staging import stage

#: Fixed rule of the language: what a circuit body may not hold.
FORBIDDEN = ("aggregate", "neg", "antijoin", "order")


@dataclass
class Node:
    op: str
    inputs: tuple[int, ...] = ()
    params: tuple = ()


@dataclass
class Graph:
    program: Program
    nodes: list[Node] = field(default_factory=list)
    by_content: dict = field(default_factory=dict)
    names: dict[str, object] = field(default_factory=dict)
    types: dict[int, Type | None] = field(default_factory=dict)

    def add(self, op: str, inputs: Iterable[int] = (), params: tuple = (), shared: bool = True) -> int:
        key = (op, tuple(inputs), params)
        if shared and key in self.by_content:
            return self.by_content[key]
        self.nodes.append(Node(op, key[1], params))
        if shared:
            self.by_content[key] = len(self.nodes) - 1
        return len(self.nodes) - 1


def _error(kind: str, message: str = "") -> ProgramError:
    return ProgramError("compile_error", f"{kind} {message}".strip())


class Lowering:
    """Names to nodes. An instance of a circuit is a dict of node ids."""

    def __init__(self, program: Program) -> None:
        self.p, self.g = program, Graph(program)
        self.open: list[str] = []
        for c in program.circuits.values():
            self.check_body(c)
        for c in program.circuits:
            self.check_calls(c, ())
        for name in program.nodes:
            self.named(name)

    # -- circuits
    def calls(self, rhs: object) -> Iterable[Call]:
        if isinstance(rhs, Call):
            yield rhs
            for a in [*rhs.args, *rhs.kwargs.values()]:
                yield from self.calls(a)
        elif isinstance(rhs, list):
            for a in rhs:
                yield from self.calls(a)

    def check_body(self, c: Circuit) -> None:
        for _, rhs in c.body:
            for call in self.calls(rhs):
                if call.op in FORBIDDEN:
                    raise ProgramError("fixpoint_error", f"forbidden_operator {call.op} in circuit {c.name}")

    def check_calls(self, name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise _error("recursive_circuit_definition", " -> ".join([*path, name]))
        for _, rhs in self.p.circuits[name].body:
            for call in self.calls(rhs):
                if call.op in self.p.circuits:
                    self.check_calls(call.op, (*path, name))

    def has_fixpoint(self, name: str) -> bool:
        return any(call.op == "fixpoint" or (call.op in self.p.circuits and self.has_fixpoint(call.op)) for _, rhs in self.p.circuits[name].body for call in self.calls(rhs))

    def arguments(self, c: Circuit, call: Call, scope: dict | None) -> dict[str, object]:
        keys = [k for k, _ in c.params]
        if call.args:
            raise _error("positional_argument", c.name)
        if missing := [k for k in keys if k not in call.kwargs]:
            raise _error("missing_argument", ", ".join(missing))
        if extra := [k for k in call.kwargs if k not in keys]:
            raise _error("unknown_argument", ", ".join(extra))
        return {k: self.binding(call.kwargs[k], scope) for k in keys}

    def binding(self, a: object, scope: dict | None) -> object:
        """A node id, or a function's name."""
        if isinstance(a, Ref) and a.member is None:
            if scope is not None and a.name in scope:
                return scope[a.name]
            if a.name not in self.p.nodes and (a.name in self.p.functions or a.name in self.p.types or a.name.startswith("std.")):
                return a.name
            if a.name == "empty" and a.name not in self.p.nodes:
                return self.g.add("empty", shared=False)
        return self.value(a, scope)

    def expand(self, c: Circuit, bound: dict[str, object]) -> dict[str, object]:
        scope: dict[str, object] = {internal: bound[key] for key, internal in c.params}
        out: dict[str, object] = {}
        for name, rhs in c.body:
            out[name] = scope[name] = self.definition(rhs, scope)
        return out

    def fix(self, call: Call, scope: dict | None) -> dict[str, object]:
        if len(call.args) != 1 or call.kwargs or not isinstance(call.args[0], Call) or call.args[0].op not in self.p.circuits:
            raise ProgramError("fixpoint_error", "fixpoint takes a circuit call")
        inner = call.args[0]
        c = self.p.circuits[inner.op]
        if self.has_fixpoint(c.name):
            raise ProgramError("fixpoint_error", f"nested_fixpoint in {c.name}")
        bound = self.arguments(c, inner, scope)
        body = {n for n, _ in c.body}
        own = [k for k, _ in c.params if k in body]
        if not own:
            return self.expand(c, bound)
        fix_id = len(self.g.nodes)
        selves = {k: self.g.add("self", (), (fix_id, k)) for k in own}
        out = self.expand(c, bound | selves)
        for k in own:
            if self.g.nodes[out[k]].op != "distinct":
                raise ProgramError("fixpoint_error", f"{k} must be distinct(...)")
        seeds = tuple(bound[k] for k in own)
        whole = self.g.add("fix", (*seeds, *(out[k] for k in own)), (tuple(own), tuple(selves[k] for k in own)), shared=False)
        return {k: self.g.add("fix_out", (whole,), (k,)) for k in own}

    # -- nodes
    def named(self, name: str) -> object:
        if name in self.g.names:
            return self.g.names[name]
        if name not in self.p.nodes:
            raise _error("undefined", name)
        if name in self.open:
            raise _error("cycle_in_graph", " -> ".join([*self.open, name]))
        self.open.append(name)
        out = self.definition(self.p.nodes[name], None, name)
        self.open.pop()
        self.g.names[name] = out
        return out

    def definition(self, rhs: object, scope: dict | None, name: str | None = None) -> object:
        if isinstance(rhs, Call) and rhs.op == "fixpoint":
            return self.fix(rhs, scope)
        if isinstance(rhs, Call) and rhs.op in self.p.circuits:
            c = self.p.circuits[rhs.op]
            return self.expand(c, self.arguments(c, rhs, scope))
        return self.value(rhs, scope, name)

    def value(self, a: object, scope: dict | None, name: str | None = None) -> int:
        if isinstance(a, Ref):
            found = scope[a.name] if scope is not None and a.name in scope else self.named(a.name) if scope is None or a.name in self.p.nodes else None
            if found is None:
                raise _error("undefined", a.name)
            if a.member is not None:
                if not isinstance(found, dict):
                    raise _error("not_an_instance", a.name)
                if a.member not in found:
                    raise _error("undefined", f"{a.name}.{a.member}")
                found = found[a.member]
            if isinstance(found, dict):
                raise _error("instance_is_not_a_stream", a.name)
            if isinstance(found, str):
                raise _error("function_is_not_a_stream", found)
            return found
        if not isinstance(a, Call):
            raise _error("bad_argument", repr(a))
        if a.op not in OPERATORS:
            if a.op in self.p.circuits:
                raise _error("instance_is_not_a_stream", a.op)
            raise _error("undefined", a.op)
        return self.operator(a, scope, name)

    def function(self, a: object, scope: dict | None) -> str:
        if not isinstance(a, Ref) or a.member is not None:
            raise _error("bad_argument", "a function's name is wanted")
        found = scope.get(a.name, a.name) if scope is not None else a.name
        if not isinstance(found, str):
            raise _error("fn_lookup_error", a.name)
        return found

    def operator(self, c: Call, scope: dict | None, name: str | None) -> int:
        op, args, kw = c.op, c.args, c.kwargs

        def want(n: int, *keys: str, optional: tuple[str, ...] = ()) -> None:
            if len(args) != n or not set(keys) <= set(kw) or set(kw) - set(keys) - set(optional):
                raise _error("bad_arguments", op)

        def strings(a: object) -> tuple[str, ...]:
            if not isinstance(a, list) or not all(isinstance(x, str) for x in a):
                raise _error("bad_arguments", f"{op}: a list of strings is wanted")
            return tuple(a)

        if op == "source":
            want(1)
            if name is None or scope is not None:
                raise _error("bad_arguments", "source must be named at top level")
            return self.g.add("source", (), (args[0], name))
        if op == "empty":
            want(0)
            return self.g.add("empty", shared=False)
        if op == "plus":
            if not args or kw:
                raise _error("bad_arguments", op)
            ids = [self.value(a, scope) for a in args]
            return ids[0] if len(ids) == 1 else self.g.add("plus", ids)
        if op in ("delay", "integrate", "differentiate", "distinct", "neg"):
            want(1)
            return self.g.add(op, [self.value(args[0], scope)])
        if op in ("map", "filter", "flat_map"):
            want(2)
            return self.g.add(op, [self.value(args[0], scope)], (self.function(args[1], scope),))
        if op == "project":
            want(2)
            return self.g.add(op, [self.value(args[0], scope)], (strings(args[1]),))
        if op in ("join", "antijoin"):
            want(2, optional=("on",))
            return self.g.add(op, [self.value(a, scope) for a in args], (strings(kw.get("on", [])),))
        if op == "aggregate":
            want(2, optional=("by",))
            return self.g.add(op, [self.value(args[0], scope)], (self.function(args[1], scope), strings(kw.get("by", []))))
        if op == "order":
            want(1, "by", "rank_column", "row_number_column")
            by = kw["by"]
            if not isinstance(by, list) or not by or not all(isinstance(x, list) and len(x) == 2 for x in by):
                raise _error("bad_arguments", "order by")
            return self.g.add(op, [self.value(args[0], scope)], (tuple(strings(x) for x in by), kw["rank_column"], kw["row_number_column"]))
        raise _error("bad_arguments", op)


class Inference:
    """Types of all nodes; recursive relations are inferred until nothing changes."""

    def __init__(self, g: Graph) -> None:
        self.g, self.selves = g, {}
        self.strict = False
        for _ in range(2 + sum(n.op == "self" for n in g.nodes)):
            before = dict(self.selves)
            g.types.clear()
            for i in range(len(g.nodes)):
                self.of(i)
            if self.selves == before:
                break
        self.strict = True
        g.types.clear()
        for i in range(len(g.nodes)):
            self.of(i)

    def of(self, i: int) -> Type | None:
        if i not in self.g.types:
            self.g.types[i] = self.infer(i, self.g.nodes[i])
        return self.g.types[i]

    def fields(self, t: Type | None) -> dict[str, Type] | None:
        if t is None:
            return None
        if t.name != "struct":
            raise ProgramError("type_conflict", f"a struct is wanted, not {t}")
        return t.fields

    def pick(self, fields: dict[str, Type], names: Iterable[str]) -> dict[str, Type]:
        for n in names:
            if n not in fields:
                raise ProgramError("missing_field", n)
        return {n: fields[n] for n in names}

    def infer(self, i: int, n: Node) -> Type | None:
        p = self.g.program
        if n.op == "source":
            t = p.types.get(n.params[1])
            if t is None or t.name != "stream" or t.args[0].name != "struct":
                raise ProgramError("missing_typespec", n.params[1])
            return t.args[0]
        if n.op == "empty":
            return None
        if n.op == "self":
            return self.selves.get(i)
        if n.op == "fix":
            own, ids = n.params
            k = len(own)
            for j, self_id in enumerate(ids):
                t = self.of(n.inputs[k + j]) or self.of(n.inputs[j]) or self.selves.get(self_id)
                seed = self.of(n.inputs[j])
                if t is not None and seed is not None and seed != t:
                    raise ProgramError("type_conflict", f"fixpoint {own[j]}: {seed} and {t}")
                if t is not None:
                    self.selves[self_id] = t
            return None
        if n.op == "fix_out":
            whole = self.g.nodes[n.inputs[0]]
            self.of(n.inputs[0])
            return self.selves.get(whole.params[1][whole.params[0].index(n.params[0])])
        ins = [self.of(x) for x in n.inputs]
        if n.op in ("delay", "integrate", "differentiate", "distinct", "neg"):
            return ins[0]
        if n.op == "plus":
            known = [t for t in ins if t is not None]
            if any(t != known[0] for t in known):
                raise ProgramError("type_conflict", f"plus over {known[0]} and {next(t for t in known if t != known[0])}")
            return known[0] if known else None
        t = ins[0]
        if n.op in ("map", "filter", "flat_map"):
            if t is None:
                sig = p.types.get(n.params[0])
                if sig is None or sig.name != "function":
                    return None
                return (sig.args[0][0] if sig.args[0] else None) if n.op == "filter" else sig.args[2] if n.op == "map" else sig.args[2].args[0]
            out = row_function(p, n.params[0], t).type
            if n.op == "filter":
                if not is_bool(out):
                    raise _error("non_boolean_filter", n.params[0])
                return t
            if n.op == "flat_map":
                if out.name != "array":
                    raise _error("non_array_flat_map", n.params[0])
                out = out.args[0]
            return out
        if n.op == "project":
            f = self.fields(t)
            return None if f is None else struct(self.pick(f, n.params[0]))
        if n.op in ("join", "antijoin"):
            left, right = (self.fields(x) for x in ins)
            if left is None or right is None:
                return t if n.op == "antijoin" else None
            lk, rk = self.pick(left, n.params[0]), self.pick(right, n.params[0])
            for k in lk:
                if lk[k] != rk[k]:
                    raise ProgramError("type_conflict", f"join key {k}: {lk[k]} and {rk[k]}")
            if n.op == "antijoin":
                return t
            if clash := [k for k in right if k in left and k not in lk]:
                raise ProgramError("duplicate_field", ", ".join(clash))
            return struct(left | {k: x for k, x in right.items() if k not in lk})
        if n.op == "aggregate":
            f = self.fields(t)
            if f is None:
                return None
            out = aggregate_function(p, n.params[0], t)[0]
            keys = self.pick(f, n.params[1])
            if clash := [k for k in out.fields if k in keys]:
                raise _error("field_collision", ", ".join(clash))
            return struct(keys | out.fields)
        if n.op == "order":
            f = self.fields(t)
            if f is None:
                return None
            by, rank, row = n.params
            self.pick(f, [k for k, _ in by])
            for _, d in by:
                if d not in ("asc", "desc"):
                    raise _error("bad_direction", d)
            if not isinstance(rank, str) or not isinstance(row, str) or rank == row or rank in f or row in f:
                raise _error("column_collision", f"{rank}, {row}")
            return struct(f | {rank: INTEGER, row: INTEGER})
        raise _error("unknown_operator", n.op)


class Plan:
    """A checked program, ready to be evaluated."""

    def __init__(self, source: str | Program) -> None:
        self.program = parse(source) if isinstance(source, str) else source
        check_functions(self.program)
        self.graph = Lowering(self.program).g
        Inference(self.graph)

    @property
    def sources(self) -> dict[str, Type]:
        """table -> row type"""
        return {n.params[0]: self.program.types[n.params[1]].args[0] for n in self.graph.nodes if n.op == "source"}

    def node(self, name: str) -> int:
        base, _, member = name.partition(".")
        found = self.graph.names.get(base)
        if isinstance(found, dict):
            found = found.get(member)
        elif member:
            found = None
        if not isinstance(found, int):
            raise _error("unknown_output", name)
        return found

    def type_of(self, name: str) -> Type | None:
        return self.graph.types[self.node(name)]

    def snapshot(self, spark: SparkSession, tables: dict[str, DataFrame | ZSet], outputs: Iterable[str]) -> dict[str, ZSet]:
        """The net Z-set of each output. Rows of plain tables have weight 1; nothing is delayed into view."""
        run = Evaluation(self, spark, tables, False)
        return {o: run.output(self.node(o)) for o in outputs}

    def replay(self, spark: SparkSession, logs: dict[str, DataFrame], outputs: Iterable[str], last: int | None = None) -> dict[str, ZSet]:
        """The log of changes of each output from logs with columns ``__e`` (epoch) and ``__w``; epochs after ``last`` are cut."""
        run = Evaluation(self, spark, {k: replay.log_of(v) for k, v in logs.items()}, True)
        out = {o: run.output(self.node(o)).norm() for o in outputs}
        if last is not None:
            out = {k: ZSet(z.df.where(F.col(replay.E) <= last), z.cols, False, z.ctx) for k, z in out.items()}
        return out


class Evaluation:
    def __init__(self, plan: Plan, spark: SparkSession, tables: dict, logs: bool) -> None:
        self.plan, self.g, self.spark, self.tables, self.logs = plan, plan.graph, spark, tables, logs
        self.done: dict[int, ZSet | None] = {}
        self.loops: dict[int, dict[str, ZSet | None]] = {}

    def none(self, i: int) -> ZSet | None:
        """An empty relation of the node's type, if that is known."""
        t = self.g.types[i]
        if t is None:
            return None
        schema = spark_schema(t)
        if self.logs:
            df = self.spark.createDataFrame([], schema).select(F.lit(0).cast("long").alias(replay.E), *schema.fieldNames(), F.lit(1).cast("long").alias(W))
            return ZSet(df, schema.fieldNames(), False, (replay.E,))
        return ZSet.empty(self.spark, schema)

    def output(self, i: int) -> ZSet:
        z = self.of(i)
        if z is None:
            z = self.none(i)
        if z is None:
            raise ProgramError("type_conflict", "an output of unknown type")
        return z

    def of(self, i: int) -> ZSet | None:
        if i not in self.done:
            self.done[i] = self.evaluate(i, self.of, self.logs)
        return self.done[i]

    def evaluate(self, i: int, of, logs: bool) -> ZSet | None:
        n, p = self.g.nodes[i], self.plan.program
        if n.op == "source":
            return self.source(n)
        if n.op in ("empty", "fix"):
            return None
        if n.op == "fix_out":
            return self.fix(n.inputs[0], of, logs)[n.params[0]]
        ins = [of(x) for x in n.inputs]
        if n.op == "plus":
            some = [z for z in ins if z is not None]
            return some[0].plus(*some[1:]) if some else None
        z = ins[0]
        if n.op == "antijoin" and z is not None and ins[1] is None:
            return z
        if any(x is None for x in ins):
            return self.none(i)
        row = self.g.types[n.inputs[0]]
        if n.op == "map":
            v = row_function(p, n.params[0], row)
            fields = {f: v.get(f) for f in v.type.fields}
            return z.map({f: x.column for f, x in fields.items()}, v.drop)
        if n.op == "filter":
            v = row_function(p, n.params[0], row)
            return z.filter(v.column, v.drop)
        if n.op == "flat_map":
            v = row_function(p, n.params[0], row)
            return z.flat_map(v.column, v.drop)
        if n.op == "project":
            return z.project(n.params[0])
        if n.op == "neg":
            return z.neg()
        if n.op == "integrate":
            return z
        if n.op == "delay":
            return replay.delay(z) if logs else self.none(i)
        if n.op == "differentiate":
            return replay.differentiate(z) if logs else z
        if n.op == "distinct":
            return replay.distinct(z) if logs else z.distinct()
        if n.op == "join":
            return replay.join(z, ins[1], n.params[0]) if logs else z.join(ins[1], n.params[0])
        if n.op == "antijoin":
            return replay.antijoin(z, ins[1], n.params[0]) if logs else z.antijoin(ins[1], n.params[0])
        if n.op == "aggregate":
            _, aggs, result, drop = aggregate_function(p, n.params[0], row)
            return replay.aggregate(z, aggs, n.params[1], result, drop) if logs else z.aggregate(aggs, n.params[1], result, drop)
        if n.op == "order":
            if logs:
                return replay.by_epoch([z], lambda s: s.order(*n.params))
            return z.order(*n.params)
        raise _error("unknown_operator", n.op)

    def source(self, n: Node) -> ZSet:
        table, name = n.params
        if table not in self.tables:
            raise _error("unknown_input", table)
        given = self.tables[table]
        z = given if isinstance(given, ZSet) else ZSet.of(given, W if W in given.columns else None)
        fields = self.plan.program.types[name].args[0].fields
        if missing := [f for f in fields if f not in z.cols]:
            raise ProgramError("missing_field", f"{table}: {', '.join(missing)}")
        cast = {f: z.df[f] if z.df.schema[f].dataType == spark_type(t) else z.df[f].cast(spark_type(t)) for f, t in fields.items()}
        return z.map(cast)

    # -- recursion
    def depends(self, i: int, selves: set[int], memo: dict[int, bool]) -> bool:
        if i not in memo:
            memo[i] = i in selves or any(self.depends(x, selves, memo) for x in self.g.nodes[i].inputs)
        return memo[i]

    def fix(self, i: int, of, logs: bool) -> dict[str, ZSet | None]:
        if i not in self.loops:
            n = self.g.nodes[i]
            own, selves = n.params
            k = len(own)
            if logs:
                self.loops[i] = self.fix_logs(n, of)
            else:
                self.loops[i] = self.loop(n, {key: of(n.inputs[j]) for j, key in enumerate(own)}, of, dict(zip(selves, own, strict=True)), n.inputs[k:])
        return self.loops[i]

    def loop(self, n: Node, seeds: dict, of, selves: dict[int, str], bodies: tuple[int, ...]) -> dict[str, ZSet | None]:
        memo: dict[int, bool] = {}
        inside = set(selves)
        recursive = [j for j in self.reach(bodies) if self.depends(j, inside, memo)]
        linear = not any(self.g.nodes[j].op == "join" and sum(self.depends(x, inside, memo) for x in self.g.nodes[j].inputs) > 1 for j in recursive)
        fixed: dict[int, ZSet | None] = {}

        def constant(j: int) -> ZSet | None:
            """A subplan without recursion is written once, not planned again each round; scans stay scans."""
            if j not in fixed:
                z = of(j)
                if z is not None and self.g.nodes[j].op not in ("source", "self", "fix_out"):
                    z = ZSet(stage(z.df), z.cols, z.unit, z.ctx)
                fixed[j] = z
            return fixed[j]

        def step(bound: dict[str, ZSet | None], first: bool) -> dict[str, ZSet | None]:
            here: dict[int, ZSet | None] = {}

            def value(j: int) -> ZSet | None:
                if not self.depends(j, inside, memo):
                    return constant(j)
                if j in selves:
                    return bound[selves[j]]
                if j not in here:
                    node = self.g.nodes[j]
                    if node.op == "plus" and linear and not first:  # terms without recursion gave all they have in the first round
                        some = [z for x in node.inputs if self.depends(x, inside, memo) and (z := value(x)) is not None]
                        here[j] = some[0].plus(*some[1:]) if some else None
                    else:
                        here[j] = self.evaluate(j, value, False)
                return here[j]

            return {key: value(b) if first or self.depends(b, inside, memo) else None for key, b in zip(selves.values(), bodies, strict=True)}

        out = fixpoint(seeds, step, linear)
        ids = {key: j for j, key in selves.items()}
        return {key: z if z is not None else self.none(ids[key]) for key, z in out.items()}

    def reach(self, ids: Iterable[int]) -> set[int]:
        seen: set[int] = set()
        todo = list(ids)
        while todo:
            j = todo.pop()
            if j not in seen:
                seen.add(j)
                todo.extend(self.g.nodes[j].inputs)
        return seen

    def fix_logs(self, n: Node, of) -> dict[str, ZSet | None]:
        """Recursion over logs: the states at every epoch that changes an input run as one loop, epochs kept apart."""
        own, selves = n.params
        k = len(own)
        memo: dict[int, bool] = {}
        inside = set(selves)
        body = self.reach(n.inputs[k:])
        border = {x for j in body if self.depends(j, inside, memo) for x in self.g.nodes[j].inputs if not self.depends(x, inside, memo)}
        border |= {b for b in n.inputs[k:] if not self.depends(b, inside, memo)} | set(n.inputs[:k])
        logs = {j: z for j in border if (z := of(j)) is not None}
        if not logs:
            return {key: self.none(selves[j]) for j, key in enumerate(own)}
        epochs = None
        for z in logs.values():
            mine = z.df.select(replay.E).distinct()
            epochs = mine if epochs is None else epochs.union(mine)
        from pyspark.sql import Window

        epochs = stage(epochs.distinct().withColumn("__next", F.lead(replay.E).over(Window.orderBy(replay.E))))
        states = {}
        for j, z in logs.items():
            s = replay.state_at(z, epochs)
            states[j] = ZSet(stage(s.df), s.cols, False, s.ctx)
        result = self.loop(n, {key: states.get(n.inputs[j]) for j, key in enumerate(own)}, lambda j: states.get(j), dict(zip(selves, own, strict=True)), n.inputs[k:])
        return {key: None if z is None else replay._difference(z.weighted().select(replay.E, *z.cols, W), z.cols, epochs) if z.ctx else z for key, z in result.items()}


def run(spark: SparkSession, source: str, tables: dict[str, DataFrame], output: str) -> DataFrame:
    """One output of a program over tables, as rows."""
    plan = Plan(source)
    return plan.snapshot(spark, tables, [output])[output].rows()
