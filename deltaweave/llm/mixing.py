"""Mixing sources to target weights by drawing fixed-length blocks of words.

1. Sizes (words) and sources are counted over all documents; targets come from the weights, stop at ``cap`` times a
   source's size, and the excess is reshared (water filling over the few source rows).
2. The words of a source, document after document in the order of hashes of their rows, are cut into blocks of ``block`` words. Offsets are two-level prefix sums
   (within hash chunks of bounded size, then over chunk totals), so a source that holds a third of all rows is spread
   over many tasks.
3. Output shards of ``shard_slots`` slots get multinomial source counts, conditioned on every source's total: the slots
   are halved again and again, each half drawing binomial counts. A shard finds its counts by itself from the seeds of
   the halves above it, so shards are independent and reruns agree.
4. The k-th slot of a source takes the block at index pi(k mod blocks), pi a keyed Feistel permutation of the source
   and the pass; no block is taken more than ``cap`` times. Slots join blocks by (source, index).

Defined cases: null text has size 0 and is never taken; a null source is a source, ordered last; rows that repeat are
separate documents; a source without words gets target 0 ... its cap; empty tables give no row; other columns are kept
out of the result. The driver holds one row per source (the mixture's components), never documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh_names, staged

SPACE, SPACES = r"[\x20\x09-\x0D]", " \t\n\v\f\r"
BLOCK, SHARD_SLOTS, SHARE, CAP, SEED = 64, 4096, 1.5, 2, 20240607
WEIGHTS = (3, 1, 2)
#: Documents of a chunk, about: the rows one task sorts for offsets.
CHUNK_DOCS = 2_000


def _mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (fixed values), elementwise."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network, walked until the value is below n."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    key = key.astype(np.uint64)
    while todo.any():
        left, right, k = out[todo] >> half, out[todo] & mask, key[todo]
        for r in range(4):
            left, right = right, left ^ (_mix64(right ^ _mix64(k + np.uint64(r))) & mask)
        out[todo] = (left << half) | right
        todo[todo] = out[todo] >= n
    return out.astype(np.int64)


def water_fill(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets in proportion to the weights that sum to ``share`` of all sizes, none above ``cap`` times its size."""
    total, caps = share * sum(sizes), [cap * s for s in sizes]
    targets, free, left = [0.0] * len(sizes), sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i]), total
    weight = float(sum(weights))
    for pos, i in enumerate(free):
        level = left / weight if weight else 0.0
        if caps[i] <= level * weights[i]:
            targets[i] = float(caps[i])
            left -= caps[i]
            weight -= weights[i]
        else:
            for j in free[pos:]:
                targets[j] = level * weights[j]
            break
    return targets


def shard_counts(quota: np.ndarray, shard: int, shards: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts per source of one shard and each source's slots before it, from the binomial halvings above the shard."""
    lo, hi, left_total = 0, shards, int(quota.sum())
    counts, before = quota.astype(np.int64), np.zeros(len(quota), dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        want = min(left_total, (mid - lo) * slots)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.binomial(counts, want / max(1, left_total))
        gap = want - int(left.sum())
        room = counts - left if gap > 0 else left  # settle the halves' sizes in proportion to what may move
        if gap:
            move = np.floor(abs(gap) * room / max(1, room.sum())).astype(np.int64)
            short = abs(gap) - int(move.sum())
            for i in np.argsort(-(room - move), kind="stable"):
                step = min(short, int(room[i] - move[i]))
                move[i] += step
                short -= step
                if not short:
                    break
            left = left + np.sign(gap) * move
        if shard < mid:
            counts, hi, left_total = left, mid, want
        else:
            before, counts, lo, left_total = before + left, counts - left, mid, left_total - want
    return counts, before


def _row_keys() -> list[Column]:
    """Two 64-bit hashes by which a row is found again."""
    row = (F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return [F.xxhash64(*row), F.xxhash64(F.lit(1), *row)]


class Mixture:
    """The parts of a mix: ``rows`` (documents with offsets), ``sources``, ``slots`` and what each document gives."""

    def __init__(self, spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> None:
        self.spark, self.block = spark, block
        base = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            *(k.alias(n) for k, n in zip(_row_keys(), ("key", "key2"), strict=True)),
        )
        self.base = base = staged(base, "mix-sizes")
        per_source = [(r["source"], r["size"], r["docs"]) for r in base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()]
        per_source.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
        sizes = [r[1] for r in per_source]
        w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
        targets = water_fill(sizes, w, share, cap)
        blocks = [-(-s // block) for s in sizes]
        quota = [min(cap * b, round(t / (s / b))) if b else 0 for t, s, b in zip(targets, sizes, blocks, strict=True)]
        table = [(i, r[0], int(s), float(t), int(b), int(q)) for i, (r, s, t, b, q) in enumerate(zip(per_source, sizes, targets, blocks, quota, strict=True))]
        #: One row per source: small by nature, so it is joined by broadcast.
        self.sources = spark.createDataFrame(table, "sid int, source string, source_size long, target double, blocks long, quota long")
        self.rows = self._offsets(sum(r[2] for r in per_source))
        self.slots = self._slots(np.asarray(blocks, dtype=np.int64), np.asarray(quota, dtype=np.int64), shard_slots, seed)

    def _offsets(self, n_docs: int) -> DataFrame:
        """Each document's first word within its source."""
        chunks = max(1, n_docs // CHUNK_DOCS + 1)
        named = self.base.join(F.broadcast(self.sources.select("sid", F.col("source").alias("s"), "source_size", "target")), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
        named = named.withColumn("chunk", F.pmod("key", F.lit(chunks)))
        totals = named.groupBy("sid", "chunk").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        firsts = totals.select("sid", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first"))
        within = Window.partitionBy("sid", "chunk").orderBy("key", "key2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = named.withColumn("start", F.sum("size").over(within) - F.col("size")).join(firsts, ["sid", "chunk"])
        return staged(placed.select("doc_id", "key", "key2", "size", "sid", "source_size", "target", (F.col("start") + F.col("first")).alias("start")), "mix-rows")

    def _slots(self, blocks: np.ndarray, quota: np.ndarray, shard_slots: int, seed: int) -> DataFrame:
        shards = max(1, -(-int(quota.sum()) // shard_slots))

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for shard in frame["id"].tolist():
                    counts, before = shard_counts(quota, shard, shards, shard_slots, seed)
                    sid = np.repeat(np.arange(len(quota)), counts)
                    if not len(sid):
                        continue
                    k = np.concatenate([np.arange(b, b + c) for b, c in zip(before, counts, strict=True)])
                    n, at = blocks[sid], np.empty(len(sid), dtype=np.int64)
                    turn = k // n
                    for s in np.unique(sid):
                        mine = sid == s
                        at[mine] = permute(k[mine] % n[mine], int(blocks[s]), _mix64(np.uint64(seed) + (turn[mine] * 1_000_003 + s).astype(np.uint64)))
                    slot = np.random.default_rng([seed, 1, shard]).permutation(len(sid))  # order within the shard
                    yield pd.DataFrame({"shard": shard, "slot": slot, "sid": sid.astype(np.int32), "block": at, "pass": turn})

        tasks = max(1, min(shards, 4 * self.spark.sparkContext.defaultParallelism + shards // 64))
        return self.spark.range(0, shards, 1, tasks).mapInPandas(draw, "shard long, slot long, sid int, block long, pass long")

    def pieces(self) -> DataFrame:
        """A row for each block that a document has words in: the words [lo, hi) of the document."""
        b = F.lit(self.block)
        rows = self.rows.where("size > 0").select("sid", "start", "size", F.explode(F.sequence(F.expr(f"start div {self.block}"), F.expr(f"(start + size - 1) div {self.block}"))).alias("block"))
        return rows.select("sid", "start", "block", (F.greatest(F.col("start"), F.col("block") * b) - F.col("start")).alias("lo"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.col("start")).alias("hi"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target and the words that the mix takes of each document, repeats counted."""
        # Slots come from a range, which Spark takes for small: without the hint it would broadcast them.
        times = self.slots.groupBy("sid", "block").agg(F.count("*").alias("times")).hint("merge")
        words = self.pieces().join(times, ["sid", "block"]).groupBy("sid", "start").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
        some = self.rows.where("size > 0").join(words, ["sid", "start"], "left")
        cols = ["doc_id", "size", "source_size", "target"]
        return some.select(*cols, F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(self.rows.where("size = 0").select(*cols, F.lit(0).cast("long").alias("taken")))

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mix as documents: for each document and pass, the text between the words taken (white space kept)."""
        hits = self.pieces().join(self.slots.select("sid", "block", "pass").hint("merge"), ["sid", "block"])
        # Bounded by one document's blocks.
        spans = hits.groupBy("sid", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
        names = fresh_names(docs, "key", "key2", "nth", "spans", "words", "whole", "from", "to", "tokens", "cut")
        key, key2, nth, span, words, whole, first, last, tokens, cut = names.values()
        chosen = spans.join(self.rows.where("size > 0").select("sid", "start", "key", "key2", F.col("size").alias(words)), ["sid", "start"])
        chosen = chosen.select(F.col("key").alias(key), F.col("key2").alias(key2), F.col("spans").alias(span), words)
        # Identical rows are numbered on the partitioning that the join needs; each takes its own spans from one of them.
        once = docs.withColumns(dict(zip((key, key2), _row_keys(), strict=True)))
        once = once.withColumn(nth, F.row_number().over(Window.partitionBy(key, key2).orderBy(F.lit(1)))).where(F.col(nth) == 1).drop(nth)
        joined = once.join(chosen, [key, key2])

        def computed(df: DataFrame, **columns: Column) -> DataFrame:
            """Columns that are computed once for each row, whatever uses them."""
            return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))

        # Runs of adjacent spans become one; the words of a run keep the white space between them.
        parts = F.col(span)
        begins = F.filter(parts, lambda s, i: (i == 0) | (F.get(parts, i - 1)["hi"] != s["lo"]))
        ends = F.filter(parts, lambda s, i: (i == F.size(parts) - 1) | (F.get(parts, i + 1)["lo"] != s["hi"]))
        joined = computed(joined, **{first: F.transform(begins, lambda s: s["lo"].cast("int")), last: F.transform(ends, lambda s: s["hi"].cast("int")), whole: (F.size(parts) > 0) & (F.get(parts, F.lit(0))["lo"] == 0) & (F.element_at(parts, -1)["hi"] == F.col(words)) & (F.size(begins) == 1)})
        joined = computed(joined, **{tokens: F.when(~F.col(whole), F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD + SPACE + "*"), F.lit(0)))})
        run = F.zip_with(first, last, lambda lo, hi: F.rtrim(F.array_join(F.slice(tokens, lo + 1, hi - lo), ""), F.lit(SPACES)))
        joined = computed(joined, **{cut: F.when(F.col(whole), F.col("text").cast("string")).otherwise(F.array_join(run, "\n"))})
        made = {"text": F.col(cut)} | ({"n_chars": F.length(cut).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
        return joined.select(*(made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, **parameters) -> Mixture:
    return Mixture(spark, docs, **parameters)
