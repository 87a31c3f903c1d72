"""Exact n-gram Jaccard self-join of whole texts by prefix lists, with skipping by set relations.

1. One pass hashes every text to its set of distinct n-word shingles. Equal sets form a class (a node); a counting sketch
   of fixed size gives every shingle a rough frequency, and (frequency class, hash) is the global order of shingles.
2. Two sets with Jaccard >= t share a shingle among the first n - ceil(t n) + 1 of each. These prefixes form index lists,
   keyed by shingle and read in blocks by position: entries whose size or position cannot reach the overlap any more are
   skipped before a pair is made.
3. Answers are computed for pivots first: each list's block of least position gives its pivot, each set is compared with
   the pivots that it shares most lists with. Sets verified against a pivot take it as leader.
4. Answers of the others are derived from their leaders': lists are collapsed to leaders, and only leaders of different
   components meet. With Jaccard distance d a metric, a leader pair with d > (1 - t) + radii rejects all its member
   pairs at once; a linked one joins all of them; only members of undecided leader pairs are compared themselves.

So a group of near copies costs rows in proportion to its size, never its pairs, and no link between different sets is
lost. All grouping is partial aggregation and equi-joins on shingles, nodes or pairs.

Defined cases: words are parted by ASCII white space and A-Z are lower-cased, nothing else; a text with fewer words than
n is one shingle; a null or empty text has no shingle and links with nothing; repeated rows and doc_ids are documents of
their own; a null doc_id is never the least (a component of none but such has a null id); empty tables give no row; other columns are ignored. Shingles are 64-bit hashes: two different shingles of
two compared texts coincide with probability below 1e-12.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh_names, slices, staged
from .components import connected_components
from .mixing import _mix64

SKETCH_BITS, WANTED_BITS = 20, 20
#: Shared shingles that are asked of the shortest prefixes which must share that many.
AHEAD = 2
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random 64-bit number for each byte, and the odd base of the polynomial over them.
_BYTE = _mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51))
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(1 << (n - 1).bit_length(), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased: differences of one running polynomial over the text's bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)  # bytes: only A-Z change
    space = np.empty(len(data) + 2, dtype=bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return _mix64((total[ends] - total[starts]) * down[starts])


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles (fewer words: one shingle; none: empty)."""
    h = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(h):
        return h
    width = min(n, len(h))
    factors = _mix64(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(width << 8)) | np.uint64(1)
    total = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for i in range(width):
        total += h[i : i + len(total)] * factors[i]
    return np.unique(_mix64(total))


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def at_least(size: Column, t: int) -> Column:
    """ceil(t % of size) in integers."""
    return F.floor((size * t + 99) / 100)


def _need(nx: Column, ny: Column, t: int) -> Column:
    """Least overlap of two sets of these sizes with Jaccard >= t %."""
    return F.ceil((nx + ny) * t / (100 + t) - 1e-9)


def _signatures(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_hash, n_shingles, node) per document, and the frequency class of each sketch bucket."""
    size = 1 << SKETCH_BITS
    shift = np.uint64(64 - SKETCH_BITS)
    part = size >> 4

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        names = ["doc_id", "text_hash", "n_shingles", "node", "part", "counts"]
        for batch in slices(batches):
            sizes, nodes, rows = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, n)
                sizes.append(len(s))
                nodes.append(_node(s) if len(s) else None)
                rows.append((s >> shift).astype(np.int64))
            if sizes:
                counts += np.bincount(np.concatenate(rows), minlength=size)
                k = len(sizes)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, type=pa.int64()), pa.array(nodes, type=pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        for p in range(16):
            mine = counts[p * part : (p + 1) * part]
            if mine.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([p], type=pa.int32()), pa.array([mine.astype("<u4").tobytes()], type=pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for p, c in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts[p * part : (p + 1) * part] += np.frombuffer(c, dtype="<u4")
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000].astype(np.int32)), pa.array(counts[at[i : i + 100_000]])], names=["bucket", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    both = staged(rows.mapInArrow(first, "doc_id long, text_hash long, n_shingles long, node long, part int, counts binary"), "ngram-signatures")
    # Each task adds the sketches that it reads; 2**SKETCH_BITS sums reach the driver, whatever the input.
    sums = both.where("part is not null").select("part", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    classes = np.zeros(size, dtype=np.uint8)
    classes[sums.column("bucket").to_numpy()] = np.floor(2 * np.log2(sums.column("n").to_numpy().astype(np.float64))).astype(np.uint8)
    return both.where("part is null").select("doc_id", "text_hash", "n_shingles", "node"), classes


def _postings(docs: DataFrame, n: int, t: int, classes: np.ndarray) -> DataFrame:
    """Index lists of two or more entries: token, node, n (set size), pos."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(classes)  # 2**SKETCH_BITS bytes
    shift = np.uint64(64 - SKETCH_BITS)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in slices(batches):
            nodes, sizes, heads = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, n)
                if len(s):
                    k = len(s) - (len(s) * t + 99) // 100 + 1
                    r = rank[(s >> shift).astype(np.int64)]
                    cut = np.partition(r, k - 1)[k - 1]
                    few = s[r <= cut]
                    few = few[np.argsort(r[r <= cut], kind="stable")][:k]  # by class, then hash
                    nodes.append(_node(s))
                    sizes.append(len(s))
                    heads.append(few.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array(sizes, type=pa.int64()), pa.array(heads, type=pa.binary())], names=["node", "n", "head"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                heads = [np.frombuffer(h, dtype="<i8") for h in some.column("head").to_pylist()]
                if not heads:
                    continue
                lengths = np.asarray([len(h) for h in heads])
                pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), pa.array(np.repeat(np.asarray(some.column("node")), lengths)), pa.array((np.repeat(np.asarray(some.column("n")), lengths) << 32) | pos)], names=["token", "node", "at"])

    def shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # streaming: an entry stays if a neighbour in token order has the same token

        def settle(held: pa.RecordBatch, follows: int | None, precedes: int | None) -> pa.RecordBatch:
            tok = np.asarray(held.column("token"))
            same = tok[1:] == tok[:-1]
            keep = np.zeros(len(tok), dtype=bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= precedes is not None and tok[0] == precedes
            keep[-1] |= follows is not None and tok[-1] == follows
            return held.filter(pa.array(keep))

        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                yield settle(last, int(batch.column("token")[0].as_py()), before)
                before = int(last.column("token")[last.num_rows - 1].as_py())
            last = batch
        if last is not None:
            yield settle(last, None, before)

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(prefixes, "node long, n long, head binary")
    one = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("head").alias("head"))  # copies fall together before the lists
    lists = one.mapInArrow(entries, "token long, node long, at long").repartition("token").sortWithinPartitions("token")
    kept = lists.mapInArrow(shared_lists, "token long, node long, at long")
    return staged(kept.select("token", "node", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("pos")), "ngram-lists")


def _reachable(t: int, nx: str, px: str, ny: str, py: str) -> Column:
    """Size and position skipping: can two list entries still reach the overlap?"""
    x, y = F.col(nx), F.col(ny)
    rest = F.least(x - F.col(px), y - F.col(py))
    return (F.least(x, y) * 100 >= F.greatest(x, y) * t) & (rest + F.least(px, py) >= _need(x, y, t))


def _whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of ``wanted`` (node, text_hash), from texts of those hashes.

    A first filter by hash buckets (at most 2**WANTED_BITS numbers, so it may be broadcast) keeps most other texts out of
    the exact join's shuffle; were all buckets wanted, it would only filter nothing.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                found = [s for s in (shingle_set(x, n) for x in batch.column("text").slice(i, 500).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in found], type=pa.int64()), pa.array([s.astype("<u8").tobytes() for s in found], type=pa.binary())], names=["node", "shingles"])

    def bucket(c: str) -> Column:
        return F.xxhash64(c).bitwiseAND((1 << WANTED_BITS) - 1)

    ids = wanted.select("text_hash").distinct()
    rows = docs.select(F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    near = rows.join(F.broadcast(ids.select(bucket("text_hash").alias("bucket")).distinct()), bucket("text_hash") == F.col("bucket"), "left_semi")
    texts = near.join(ids, "text_hash", "left_semi")
    sets = texts.select("text").mapInArrow(whole, "node long, shingles binary")
    return staged(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "ngram-sets")


def _overlaps(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """pairs (a, b) with the exact size of their sets and intersection."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, y, both = [], [], []
            for p, q in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                p, q = np.frombuffer(p, dtype="<u8"), np.frombuffer(q, dtype="<u8")
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                x.append(len(p))
                y.append(len(q))
                both.append(int((q[at] == p).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(x, type=pa.int64()), pa.array(y, type=pa.int64()), pa.array(both, type=pa.int64())], names=["a", "b", "na", "nb", "both"])

    pairs = staged(pairs.select("a", "b"), "ngram-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node")
    sets = _whole_sets(docs, wanted, n)
    at_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    at_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(at_a, "a").join(at_b, "b").select("a", "b", "sa", "sb").mapInArrow(count, "a long, b long, na long, nb long, both long")


def _linked(t: int) -> Column:
    return F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * t


def _near_members(both_have: DataFrame, whose: DataFrame, s: str, other: str, t: int) -> DataFrame:
    """Early list entries of the members (side ``s``) of undecided leader pairs that are near enough for a link with a member of the other leader.

    ``both_have``: a, b, dab, ra, rb, and per token the least position (at_) and least and greatest sizes (lo_, hi_) of both
    leaders' members (x: of a, y: of b). Two sets with overlap >= least share AHEAD of the first size - least + AHEAD shingles of each.
    """
    leader, radius = {"x": ("a", "rb"), "y": ("b", "ra")}[s]
    slack = 1 - t / 100 + 1e-9
    who = whose.select("token", F.col("leader").alias(leader), *(F.col(c).alias(f"{s}_{k}") for c, k in (("node", "node"), ("d", "d"), ("size", "n"), ("pos", "pos"))))
    early = F.col(f"{s}_pos") < F.col(f"{s}_n") - _need(F.col(f"{s}_n"), F.col(f"lo_{other}"), t) + AHEAD
    theirs = F.col(f"at_{other}") < F.col(f"hi_{other}") - _need(F.col(f"{s}_n"), F.col(f"lo_{other}"), t) + AHEAD
    near = both_have.join(who, [leader, "token"]).where((F.col("dab") - F.col(f"{s}_d") - F.col(radius) <= slack) & early & theirs)
    return near.select("a", "b", "token", "dab", f"{s}_node", f"{s}_d", f"{s}_n", f"{s}_pos")


def similar_sets(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (class of equal sets), group (a node of its component), component_id (least doc_id reachable by links)."""
    t = percent
    signatures, classes = _signatures(docs, n)
    lists = _postings(docs, n, t, classes)
    nodes = staged(signatures.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("text_hash").alias("text_hash")), "ngram-nodes")

    # Pivots: the entry of least position in each list and size class answers first.
    sized = lists.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(t / 100))))
    pivots = sized.groupBy("token", "cls").agg(F.min(F.struct("pos", "n", "node")).alias("p")).select("token", "cls", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"))
    stars = sized.join(pivots, ["token", "cls"]).where(F.col("node") != F.col("pivot")).where(_reachable(t, "n", "pos", "pn", "ppos"))
    stars = stars.groupBy("node", "pivot").agg(F.count("*").alias("lists"), F.first("n").alias("n"), F.first("pn").alias("pn"))
    stars = stars.where(F.col("lists") * 2 >= _need(F.col("n"), F.col("pn"), t) - at_least(F.greatest("n", "pn"), t) + 1)
    best = stars.groupBy("node").agg(F.max(F.struct("lists", "pivot")).alias("p")).select(F.col("node").alias("a"), F.col("p.pivot").alias("b"))
    answers = staged(_overlaps(best, docs, nodes, n).where(_linked(t)), "ngram-answers")
    components = connected_components(answers)

    # Leaders: a set's verified pivot, if that pivot is not led itself.
    led = answers.select(F.col("a").alias("node"), F.col("b").alias("leader"), (1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("d"))
    mutual = led.select(F.col("node").alias("m_node"), F.col("leader").alias("m_leader"))
    led = led.join(mutual, F.col("leader") == F.col("m_node"), "left").where(F.col("m_node").isNull() | ((F.col("m_leader") == F.col("node")) & (F.col("leader") < F.col("node")))).select("node", "leader", "d")
    known = lists.select("node", "n").distinct().join(led, "node", "left").join(components.select("node", "component"), "node", "left")
    known = staged(known.select("node", "n", F.coalesce("leader", "node").alias("leader"), F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("component", "node").alias("component")), "ngram-leaders")
    groups = known.groupBy("leader").agg(F.max("d").alias("radius"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.first("component").alias("component"))

    # Lists of leaders; only leaders of different components meet.
    entries = lists.select("token", "node", "pos").join(known.select("node", "leader"), "node").groupBy("token", "leader").agg(F.min("pos").alias("pos"), F.max("pos").alias("far")).join(groups, "leader")
    mixed = entries.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("token")
    entries = staged(entries.join(mixed, "token", "left_semi"), "ngram-open-lists")
    x = entries.select("token", *(F.col(c).alias(f"x_{c}") for c in ("leader", "pos", "far", "radius", "lo", "hi", "component")))
    y = entries.select("token", *(F.col(c).alias(f"y_{c}") for c in ("leader", "pos", "far", "radius", "lo", "hi", "component")))
    sizes_meet = (F.col("x_hi") * 100 >= F.col("y_lo") * t) & (F.col("y_hi") * 100 >= F.col("x_lo") * t)
    least = _need(F.col("x_lo"), F.col("y_lo"), t)
    in_reach = F.least(F.col("x_hi") - F.col("x_pos"), F.col("y_hi") - F.col("y_pos")) + F.least("x_far", "y_far") >= least
    # Of two sets with overlap >= least, the first n - least + AHEAD shingles of each share AHEAD (fewer where a list ends before).
    early = (F.col("x_pos") < F.col("x_hi") - least + AHEAD) & (F.col("y_pos") < F.col("y_hi") - least + AHEAD)
    share = F.least(F.lit(AHEAD), least + 1 - at_least(F.col("x_hi"), t), least + 1 - at_least(F.col("y_hi"), t))
    meets = x.join(y, "token").where((F.col("x_leader") < F.col("y_leader")) & (F.col("x_component") != F.col("y_component")) & sizes_meet & in_reach & early)
    meets = meets.groupBy(F.col("x_leader").alias("a"), F.col("y_leader").alias("b")).agg(F.count("*").alias("early"), F.first(share).alias("share"), F.first("x_radius").alias("ra"), F.first("y_radius").alias("rb"), F.first(least - at_least(F.greatest("x_hi", "y_hi"), t) + 1).alias("least"))
    meets = staged(meets.where("early >= share"), "ngram-early")
    # Those few are counted over their whole prefixes: a pair must share ``least`` of them.
    of_a = entries.select(F.col("leader").alias("a"), "token")
    of_b = entries.select(F.col("leader").alias("b"), "token")
    shared = meets.select("a", "b").join(of_a, "a").join(of_b, ["b", "token"]).groupBy("a", "b").agg(F.count("*").alias("lists"))
    meets = staged(meets.join(shared, ["a", "b"]).where("lists >= least").select("a", "b", "ra", "rb"), "ngram-meets")
    measured = _overlaps(meets, docs, nodes, n).withColumn("d", 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
    measured = staged(measured.join(meets.select("a", "b", "ra", "rb"), ["a", "b"]), "ngram-measured")
    linked = measured.where(_linked(t)).select("a", "b")
    # Pairs whose components have met meanwhile need no answer.
    met = connected_components(answers.select("a", "b").unionByName(linked))
    at = lambda s: met.select(F.col("node").alias(f"{s}_"), F.col("component").alias(f"c{s}"))
    slack = 1 - t / 100 + 1e-9
    open_pairs = measured.where(~_linked(t) & (F.col("ra") + F.col("rb") > 0) & (F.col("d") <= slack + F.col("ra") + F.col("rb")))
    open_pairs = open_pairs.join(at("a"), F.col("a") == F.col("a_"), "left").join(at("b"), F.col("b") == F.col("b_"), "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    open_pairs = staged(open_pairs.select("a", "b", F.col("d").alias("dab"), "ra", "rb"), "ngram-open")

    # Members of undecided leader pairs that are far enough from their leader for a link by the triangle inequality. They
    # meet on shingles that members of both leaders have, so entries are first matched with those, not with all pairs.
    extent = lambda s, leader: entries.select(F.col("leader").alias(leader), "token", F.col("pos").alias(f"at_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))
    both_have = open_pairs.join(extent("x", "a"), "a").join(extent("y", "b"), ["b", "token"])
    whose = lists.join(known.select("node", "leader", "d"), "node").select("token", "leader", "node", "d", F.col("n").alias("size"), "pos")
    x_side = _near_members(both_have, whose, "x", "y", t)
    fine = x_side.join(_near_members(both_have, whose, "y", "x", t).drop("dab"), ["a", "b", "token"]).where((F.col("dab") - F.col("x_d") - F.col("y_d") <= slack) & _reachable(t, "x_n", "x_pos", "y_n", "y_pos"))
    least = _need(F.col("x_n"), F.col("y_n"), t)
    fine = fine.where((F.col("x_pos") < F.col("x_n") - least + AHEAD) & (F.col("y_pos") < F.col("y_n") - least + AHEAD))
    share = F.least(F.lit(AHEAD), least + 1 - at_least(F.col("x_n"), t), least + 1 - at_least(F.col("y_n"), t))
    fine = fine.groupBy("x_node", "y_node").agg(F.count("*").alias("early"), F.first(share).alias("share"), F.first(least - at_least(F.greatest("x_n", "y_n"), t) + 1).alias("least"))
    fine = staged(fine.where("early >= share").select(F.col("x_node").alias("a"), F.col("y_node").alias("b"), "least"), "ngram-fine")
    # Those few are counted over their whole prefixes.
    of = lambda s: lists.select(F.col("node").alias(s), "token")
    fine = fine.join(of("a"), "a").join(of("b"), ["b", "token"]).groupBy("a", "b").agg(F.count("*").alias("lists"), F.first("least").alias("least")).where("lists >= least").select("a", "b")
    more = _overlaps(fine, docs, nodes, n).where(_linked(t)).select("a", "b")

    final = connected_components(answers.select("a", "b").union(linked).union(more))
    placed = nodes.join(final, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("group"))
    least_id = placed.groupBy("group").agg(F.min("rep").alias("component_id"))
    classes_of = placed.join(least_id, "group").select(F.col("node").alias("n2"), "group", "component_id")
    out = signatures.join(classes_of, F.col("node") == F.col("n2"), "left")
    return out.select("doc_id", "text_hash", "n_shingles", "node", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with their own columns: one of each component, and those that have no words.

    It is the one of least doc_id (rows without one come last), then of least text hash; of rows of equal doc_id and text,
    one (rows without doc_id and words all stay).
    """
    found = similar_sets(docs.select("doc_id", "text"), n, percent).where("node is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    names = fresh_names(docs, "id", "hash")
    chosen = found.groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("a"), F.col("first.text_hash").alias("b"))
    own = docs.withColumns({names["id"]: F.col("doc_id").cast("long"), names["hash"]: F.xxhash64(F.col("text").cast("string"))})
    words = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    kept = own.where(words).join(chosen, F.col(names["id"]).eqNullSafe(F.col("a")) & (F.col(names["hash"]) == F.col("b")), "left_semi")
    kept = kept.unionByName(own.where(~words & F.col("doc_id").isNotNull())).dropDuplicates(list(names.values()))
    return kept.drop(*names.values()).unionByName(docs.where(~words & F.col("doc_id").isNull()))
