"""A checked program as a Graphviz digraph."""

from __future__ import annotations

from .circuit import Plan


def to_dot(plan: Plan) -> str:
    names = {i: n for n, i in plan.graph.names.items() if isinstance(i, int)}
    lines = ["digraph circuit {", "  rankdir=LR;", "  node [shape=box];"]
    for i, n in enumerate(plan.graph.nodes):
        detail = " ".join(str(p) for p in n.params if isinstance(p, str))
        label = " ".join(x for x in (names.get(i, ""), f"{n.op}({detail})") if x).replace('"', "'")
        lines.append(f'  n{i} [label="{label}"];')
        lines.extend(f"  n{x} -> n{i};" for x in n.inputs)
    for i, n in enumerate(plan.graph.nodes):
        if n.op == "fix":
            k = len(n.params[0])
            lines.extend(f"  n{body} -> n{me} [style=dashed];" for body, me in zip(n.inputs[k:], n.params[1], strict=True))
    return "\n".join([*lines, "}"])
