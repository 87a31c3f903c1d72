"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors of a label form one class, which carries its number of copies. Every class gets ``bits`` signs in each of
``tables`` tables; classes of a label that agree on all signs of a table meet there. A bucket of n classes is dealt into
chunks, and pairs of chunks (tiles of bounded size) are compared in double precision. A pair is counted in the first
table where it meets only, so links per vector are sums over tiles; a tile sends on those sums and a spanning forest of
its links, never its pairs. At a cosine of 0.98, 20 bits and 32 tables miss a pair with probability 5e-5.

Defined cases: a null label, and a vector that is null, empty, zero or holds null or non-finite components, link with
nothing; vectors of different dimension do not link; repeated rows count as vectors of their own; empty tables give no
row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components
from .runs import bounds, forest, runs, vectors

BITS, TABLES, CHUNK, SEED = 20, 32, 512, 20240607


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def sign_codes(v: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """(rows, tables) integers of ``bits`` sign bits; hyperplanes follow from the seed and the dimension."""
    planes = np.random.default_rng([seed, v.shape[1]]).standard_normal((v.shape[1], tables * bits))
    signs = (_unit(v) @ planes >= 0).reshape(len(v), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2).astype(np.int32)


def near_duplicates(rows: DataFrame, threshold: float = 0.98, bits: int = BITS, tables: int = TABLES, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """rows (vec_id, embedding, label) -> vec_id, n_links, component_id, kept, label."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False)))
    usable = F.coalesce(F.col("label").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda e: e != 0), F.lit(False))
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda e: e.cast("double")).alias("embedding"), usable.alias("usable"))
    base = base.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    classes = base.where("usable").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))

    def hash_signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column("embedding")
            dims = np.asarray(col.value_lengths())
            codes: list[list[int] | None] = [None] * len(dims)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                for i, c in zip(at.tolist(), sign_codes(vectors(col.take(pa.array(at))), bits, tables, seed).tolist(), strict=True):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h1"), batch.column("h2"), batch.column("rep"), batch.column("copies"), col, pa.array(dims.astype(np.int32)), pa.array(codes, type=pa.list_(pa.int32()))], names=["label", "h1", "h2", "rep", "copies", "embedding", "dim", "codes"])

    classes = classes.mapInArrow(hash_signs, "label long, h1 long, h2 long, rep long, copies long, embedding array<double>, dim int, codes array<int>")
    # A class has a number of its own, as its vec_ids may occur in others too; it is staged, so it stays what it is.
    classes = staged(classes.withColumn("class", F.monotonically_increasing_id()), "embedding-classes")
    entries = classes.select("label", "dim", F.col("class").alias("of"), "h1", F.posexplode("codes").alias("t", "code"))
    met = entries.groupBy("label", "dim", "t", "code").agg(F.count("*").alias("n")).where("n > 1")
    entries = entries.join(met, ["label", "dim", "t", "code"])
    entries = entries.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("own", F.pmod(F.col("h1"), F.col("chunks")).cast("int"))
    tiles = entries.select("label", "dim", "t", "code", "of", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    tiles = tiles.select("label", "dim", "t", "code", "of", "own", F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"))
    payload = classes.select("class", "copies", "embedding", "codes")
    tiles = tiles.join(payload, F.col("of") == F.col("class")).select("label", "dim", "t", "code", "ta", "tb", "own", "class", "copies", "embedding", "codes")
    keys = ["label", "dim", "t", "code", "ta", "tb"]
    dealt = tiles.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys):
            reps, copies, own = (table.column(c).to_numpy() for c in ("class", "copies", "own"))
            ta, tb, t = (table.column(c).to_numpy() for c in ("ta", "tb", "t"))
            rep_out: list[int] = []
            adds: list[int] = []
            to: list[int | None] = []
            emb, cod = table.column("embedding").combine_chunks(), table.column("codes").combine_chunks()
            starts, ends = bounds(table, keys)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s < 2:
                    continue
                u, c = _unit(vectors(emb.slice(s, e - s))), vectors(cod.slice(s, e - s))
                close = np.triu(u @ u.T >= threshold, 1)
                if ta[s] != tb[s]:  # two chunks: pairs within one are another tile's
                    close &= own[s:e, None] != own[None, s:e]
                i, j = np.nonzero(close)
                if not len(i):
                    continue
                if t[s]:
                    first = ~(c[i, : t[s]] == c[j, : t[s]]).any(axis=1)
                    i, j = i[first], j[first]
                total = np.bincount(i, weights=copies[s:e][j], minlength=e - s) + np.bincount(j, weights=copies[s:e][i], minlength=e - s)
                for p in np.flatnonzero(total).tolist():
                    rep_out.append(int(reps[s + p]))
                    adds.append(int(total[p]))
                    to.append(None)
                for p, q in forest(i, j, e - s):
                    rep_out.append(int(reps[s + p]))
                    adds.append(0)
                    to.append(int(reps[s + q]))
            if rep_out:
                yield pa.RecordBatch.from_arrays([pa.array(rep_out, type=pa.int64()), pa.array(adds, type=pa.int64()), pa.array(to, type=pa.int64())], names=["class", "links", "other"])

    found = staged(dealt.mapInArrow(compare, "class long, links long, other long"), "embedding-links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    summary = classes.select("label", "h1", "h2", "rep", "copies", "class").join(links, "class", "left").join(parts.select(F.col("node").alias("class"), "component"), "class", "left")
    summary = summary.withColumn("component", F.coalesce("component", "class"))
    least = summary.groupBy("component").agg(F.min("rep").alias("least"))
    summary = summary.join(least, "component").select(F.col("label").alias("l2"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("least").alias("component_id"))
    out = base.join(summary, F.col("usable") & (F.col("label") == F.col("l2")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), "label")
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), "label")
