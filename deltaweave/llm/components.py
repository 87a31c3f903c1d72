"""Connected components of a distributed edge list by hooking to the least neighbour and contracting.

Every node points to the least of itself and its neighbours, pointers are followed four deep, edges move to the
nodes pointed at, and edges within a node go; at least half of the nodes with edges vanish each round. Only partial
minima and equi-joins are used, so a star of any size costs one row per task at its centre; each round is staged in the
shared folder, so lineage stays short and lost executors cost one round's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; component is its least node. Self-loops and nulls are ignored."""
    e = staged(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "cc-edges")
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        for _ in range(2):
            nxt = hook.select(F.col("u").alias("w"), F.col("p").alias("q"))
            hook = hook.join(nxt, F.col("p") == F.col("w"), "left").select("u", F.coalesce("q", "p").alias("p"))
        hook = staged(hook, "cc-hook")
        at_a = hook.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        at_b = hook.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        moved = e.join(at_a, "a").join(at_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        nxt_e = staged(moved, "cc-edges")
        if labels is None:
            nxt_labels = hook.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            step = hook.select(F.col("u").alias("component"), "p")
            nxt_labels = staged(labels.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "cc-labels")
        old = (e, labels) if labels is not None else (e,)
        e, labels = nxt_e, nxt_labels
        if hasattr(old[-1], "_staged_at"):
            discard(*old)
    if labels is None:
        labels = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
