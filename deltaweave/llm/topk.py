"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets and each bucket into blocks of bounded size. A first look at a few of the
longest blocks gives every query a lower bound on its k-th score. With it, a bucket's local cosine threshold is
bound / (query length * bucket's greatest length): a threshold over 1 skips the bucket; a high one prunes by
coordinates (a candidate's normalised value at the query's largest coordinates must lie in a range); a low one prunes by
length (a prefix of the block, which is sorted by length). What is left is verified with the exact product.

Blocks of queries meet blocks of candidates by an equi-join on the bucket and block; each meeting is bounded, and the
best k of each query per meeting go on, so nothing grows with a bucket's size. Equal lengths only fill more blocks.

Components are held as doubles, which hold floor(scale * x) exactly; a product that doubles could round is computed in
integers of any size.

Defined cases: vectors that are null or hold null or non-finite components take no part; a score beyond a long is held at
the end of its range (a component beyond a double likewise); vectors of different dimension are not compared; rows with
the query's own id are not candidates; ties go to the smaller id; identical repeated rows count once; empty tables give no
row; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import staged
from .runs import vectors

BUCKETS, BLOCK, QUERY_BLOCK, SEED_BLOCKS = 32, 2048, 256, 4
#: Local thresholds from here on prune by coordinates; below, by length.
COORDINATE_FROM, FOCUS = 0.5, 4


def scaled_rows(rows: DataFrame, id_col: str, vector: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<double>, dim, norm2): components floor(scale * x), x as double; only vectors that take part."""
    x, most = F.col(vector), F.lit(sys.float_info.max)
    finite = F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False)))  # false for null, NaN and infinities
    scaled = lambda e: F.greatest(F.least(e.cast("double") * scale, most), -most)
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  larger doubles are integers
    out = rows.where(x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: whole(scaled(e))).alias("v")).distinct()
    norm2: Column = F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)
    return out.select("vec_id", "v", F.size("v").alias("dim"), norm2.alias("norm2"))


def _pack(keys: list[str]):
    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        norm2 = table.column("norm2").to_numpy()
        order = np.lexsort((ids, -norm2))
        m = vectors(table.column("v"))[order].astype("<f8")
        cols = {k: [table.column(k)[0].as_py()] for k in keys}
        return pa.table({**{k: pa.array(v, type=pa.int32()) for k, v in cols.items()}, "ids": [ids[order].astype("<i8").tobytes()], "m": pa.array([m.tobytes()], type=pa.binary()), "longest": [float(norm2.max()) ** 0.5]})

    return pack


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    schema = ", ".join(f"{k} int" for k in keys) + ", ids binary, m binary, longest double"
    return rows.groupBy(*keys).applyInArrow(_pack(keys), schema)


def _matrix(ids: bytes, m: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, dtype="<i8")
    return i, np.frombuffer(m, dtype="<f8").reshape(len(i), -1)


def _products(p: np.ndarray, q: np.ndarray, pn: np.ndarray, qn: np.ndarray) -> np.ndarray:
    """Exact inner products; floating point only while every partial sum is an exact integer."""
    with np.errstate(over="ignore", invalid="ignore"):
        scores = p @ q.T
        wide = ~(pn[:, None] * qn[None, :] < 2.0**53 - 1)
    scores[wide] = 0
    out = np.rint(scores).astype(np.int64)
    for i in np.flatnonzero(wide.any(axis=1)).tolist():
        row = [int(x) for x in p[i].tolist()]
        for j in np.flatnonzero(wide[i]).tolist():
            exact = sum(x * int(y) for x, y in zip(row, q[j].tolist(), strict=True))
            out[i, j] = max(-(1 << 63), min((1 << 63) - 1, exact))
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smallest id."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_block(cids: np.ndarray, c: np.ndarray, qids: np.ndarray, q: np.ndarray, theta: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """The best k of one block (sorted by length, longest first) for each query, none below the query's theta."""
    with np.errstate(over="ignore"):
        cn = np.sqrt((c**2).sum(1))
        qn = np.sqrt((q**2).sum(1))
    top = cn[0] if len(cn) else 0.0
    out: tuple[list[int], list[int], list[int]] = ([], [], [])

    def give(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        ok = (cids[at] != qids[i]) & (scores >= theta[i])
        at, scores = at[ok], scores[ok]
        best = _best(cids[at], scores, k)
        out[0].extend([int(qids[i])] * len(best))
        out[1].extend(cids[at[best]].tolist())
        out[2].extend(scores[best].tolist())

    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        local = np.where(theta > 0, theta / (qn * top), -1.0)  # inf or nan where a length is 0: no positive score there
    local = np.where(np.isnan(local), np.inf, local)
    by_coordinate = np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1 + 1e-9))
    by_length = np.flatnonzero(local < COORDINATE_FROM)
    if len(by_coordinate):
        unit = c / np.where(cn > 0, cn, 1.0)[:, None]
        unit_columns = np.ascontiguousarray(unit.T)
        for i in by_coordinate.tolist():
            t, u = min(1.0, float(local[i])), q[i] / qn[i]
            keep = np.arange(int(np.searchsorted(-cn, -theta[i] / qn[i] * (1 - 1e-9), side="right")))
            for f in np.argsort(-np.abs(u))[:FOCUS].tolist():
                # For unit vectors with cosine >= t: |x_f - t' u_f| is least at t' = t, so x_f lies in this range.
                reach = float(np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(max(0.0, 1 - u[f] * u[f]))) + 1e-9
                lo = -1.0 if u[f] < 0 and -u[f] >= t else t * u[f] - reach
                hi = 1.0 if u[f] > 0 and u[f] >= t else t * u[f] + reach
                x = unit_columns[f][keep]
                keep = keep[(x >= lo) & (x <= hi)]
            if len(keep):
                give(i, keep, _products(c[keep], q[i : i + 1], cn[keep], qn[i : i + 1])[:, 0])
    if len(by_length):
        scores = _products(c, q[by_length], cn, qn[by_length])
        for j, i in enumerate(by_length.tolist()):
            n = len(cn) if theta[i] <= 0 or qn[i] == 0 else int(np.searchsorted(-cn, -theta[i] / qn[i] * (1 - 1e-9), side="right"))
            give(i, np.arange(n), scores[:n, j])
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of each query with all ``rows``.

    Both are frames of ``scaled_rows``. Bucket limits (``buckets`` numbers per dimension) and counts are all that the
    driver sees.
    """
    spark = rows.sparkSession
    rows = staged(rows, "topk-rows")
    limits = rows.groupBy("dim").agg(F.percentile_approx("norm2", [i / buckets for i in range(1, buckets)], 2000).alias("limits"))
    placed = rows.join(F.broadcast(limits), "dim").withColumn("bucket", F.size(F.array_distinct(F.filter("limits", lambda x: x < F.col("norm2"))))).drop("limits")
    stats = placed.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("norm2").alias("most")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    stats = spark.createDataFrame(stats.collect(), stats.schema)  # at most ``buckets`` rows per dimension
    placed = placed.join(F.broadcast(stats.select("dim", "bucket", "blocks")), ["dim", "bucket"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    held = staged(_blocks(placed, ["dim", "bucket", "block"]), "topk-blocks")
    n_queries = queries.count()
    asked = queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n_queries // QUERY_BLOCK)))).cast("int"))
    asked = staged(_blocks(asked, ["dim", "q"]), "topk-queries")

    # Lower bounds from a fixed number of the longest blocks: SEED_BLOCKS * block vectors per dimension.
    first = held.withColumn("nth", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("longest"), "bucket", "block"))).where(F.col("nth") <= SEED_BLOCKS)
    seeds = first.select("dim", "ids", "m")

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                qids, q = _matrix(r.q_ids, r.q_m)
                best = np.full((len(qids), k), -np.inf)
                for ids, m in zip(r.s_ids, r.s_m, strict=True):
                    cids, c = _matrix(ids, m)
                    with np.errstate(over="ignore", invalid="ignore"):
                        s = np.clip(np.nan_to_num(c @ q.T, nan=-np.inf), -np.inf, 2.0**62)  # no bound where it says nothing
                    s[cids[:, None] == qids[None, :]] = -np.inf
                    best = -np.sort(-np.concatenate([best, s.T], axis=1), axis=1)[:, :k]
                theta = best[:, k - 1]
                theta = np.where(np.isfinite(theta), theta - 1 - np.abs(theta) * 1e-12, -np.inf)  # safe against rounding
                with np.errstate(over="ignore"):
                    qn = np.sqrt((q**2).sum(1))
                need = np.where(theta > 0, theta / np.where(qn > 0, qn, 1e-300), -np.inf)
                yield pd.DataFrame({"dim": [r.dim], "q": [r.q], "q_ids": [r.q_ids], "q_m": [r.q_m], "theta": [theta.astype("<f8").tobytes()], "least": [float(need.min())]})

    gathered = seeds.groupBy("dim").agg(F.collect_list("ids").alias("s_ids"), F.collect_list("m").alias("s_m"))
    met = asked.select("dim", "q", F.col("ids").alias("q_ids"), F.col("m").alias("q_m")).join(gathered, "dim")
    bounded = staged(met.mapInPandas(bound, "dim int, q int, q_ids binary, q_m binary, theta binary, least double"), "topk-bounds")

    # A query block visits the buckets whose greatest length can reach the least length it needs.
    visits = bounded.join(F.broadcast(stats), "dim").where(F.sqrt("most") * (1 + 1e-9) >= F.col("least"))
    visits = visits.select("dim", "q", "q_ids", "q_m", "theta", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                found = search_block(*_matrix(r.ids, r.m), *_matrix(r.q_ids, r.q_m), np.frombuffer(r.theta, dtype="<f8"), k)
                yield pd.DataFrame({"query_id": found[0], "vec_id": found[1], "score": found[2]}, dtype="int64")

    cells = visits.hint("merge").join(held.select("dim", "bucket", "block", "ids", "m"), ["dim", "bucket", "block"])
    hits = cells.mapInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
