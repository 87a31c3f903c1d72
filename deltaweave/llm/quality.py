"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk estimator.

Trusted positives (label 1) and unlabelled web text are described by style features of the whole text (shares of
character classes, repetition, word and line shape; never ids, language, source or labels). An additive model over
quantile bins of the features minimises

    prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1))

with logistic loss, and steps back on the negative part whenever it falls below zero. The class prior is estimated as
the smoothed share of label 1 among the labelled training rows.

The driver holds feature rows only, of at most ``sample`` positives and ``sample`` unlabelled documents, chosen by the
least hash of doc_id, so the sample does not depend on partitions; every whole text is scored in one pass without a shuffle.

Defined cases: a null or empty text is scored by its (zero) features; without any trusted positive nothing can be told
apart and every score is 1; a doc_id without label, repeated or null is scored like any other; repeated label rows add
nothing (a doc_id with several labels counts as positive only if all are 1); an empty table gives no row; other columns
are ignored, and kept by ``keep_good``.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, slices, staged

SAMPLE, BINS, THRESHOLD, SEED = 20_000, 12, 0.7, 7

_CLASS = np.full(256, 3, dtype=np.int64)  # 0 upper, 1 lower, 2 digit, 3 beyond ASCII and control, 4 space, 5 line feed, 6.. punctuation
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = 0 if _s.isupper() else 1 if _s.islower() else 2 if _s.isdigit() else 5 if _s == "\n" else 4 if _s.isspace() else 6 + string.punctuation.index(_s) if _s in string.punctuation else 3
_CLASSES = 6 + len(string.punctuation)
FEATURES = _CLASSES + 14


def features(text: str) -> np.ndarray:
    """Style features of one whole text, all finite."""
    out = np.zeros(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return out
    shares = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=_CLASSES) / len(data)
    out[:_CLASSES] = np.sqrt(shares)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    distinct = set(words)
    pairs = set(zip(words, words[1:]))
    triples = set(zip(words, words[1:], words[2:]))
    long_lines = [x for x in lines if x]
    marks = shares[6:].sum()
    out[_CLASSES:] = (
        np.log1p(len(data)),
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        len(distinct) / n,
        len(pairs) / max(1, n - 1),
        len(triples) / max(1, n - 2),
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(long_lines)) / max(1, len(long_lines)),
        np.log1p(max(map(len, lines))),
        np.log1p(len(lines)),
        sum(map(str.isalpha, words)) / n,
        sum(map(str.isupper, words)) / n,
        marks,
        max(map(len, words), default=0) ** 0.5,
    )
    return out


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.stack([features(t or "") for t in texts]) if texts else np.zeros((0, FEATURES))


class Model:
    """Additive over quantile bins: score = sigmoid(bias + sum of the bins' weights)."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.edges, self.weights, self.bias = edges, weights, bias

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1) if len(x) else np.zeros(x.shape, dtype=np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return 1 / (1 + np.exp(-(self.bias + self.weights[np.arange(FEATURES), b].sum(axis=1))))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = BINS, steps: int = 300, rate: float = 0.05, ridge: float = 2e-4, seed: int = SEED) -> Model:
    """Minimise the non-negative risk by mini-batch Adam; deterministic."""
    both = np.concatenate([positive, unlabelled])
    inner = np.quantile(both, np.concatenate([np.linspace(0, 1, bins + 1)[1:-1], [0.97, 0.99]]), axis=0).T
    model = Model(inner, np.zeros((FEATURES, bins + 2)), 0.0)
    bp, bu = model.binned(positive), model.binned(unlabelled)
    rng, at = np.random.default_rng(seed), np.arange(FEATURES) * (bins + 2)
    flat = np.zeros(model.weights.size + 1)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        ip, iu = (rng.integers(0, len(b), min(len(b), 2048)) for b in (bp, bu))
        xp, xu = bp[ip] + at, bu[iu] + at
        gp, gu = flat[xp].sum(1) + flat[-1], flat[xu].sum(1) + flat[-1]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()

        def push(x: np.ndarray, d: np.ndarray) -> np.ndarray:
            g = np.bincount(x.ravel(), weights=np.repeat(d, FEATURES), minlength=len(flat))
            g[-1] = d.sum()
            return g

        on_negative = push(xu, sigmoid(gu) / len(iu)) - push(xp, prior * sigmoid(gp) / len(ip))
        grad = push(xp, -prior * sigmoid(-gp) / len(ip)) + on_negative if negative >= 0 else -on_negative
        grad[:-1] += ridge * flat[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        flat = flat - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias = flat[:-1].reshape(FEATURES, bins + 2), float(flat[-1])
    return model


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the doc_id as text, modulo 4, is 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sample_features(rows: DataFrame, sample: int) -> np.ndarray:
    """Features of the ``sample`` rows of least hash; the texts stay on the executors."""
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = _matrix(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x.astype("<f4")), type=pa.list_(pa.float32()))], names=["x"])

    found = texts.mapInArrow(describe, "x array<float>").toArrow()
    x = found.column("x").combine_chunks()
    flat = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, FEATURES).astype(np.float64)
    return x[np.lexsort(x.T)] if len(x) else x


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from the labels of rows that are not held out; None without trusted positives."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out())
    known = staged(known, "quality-labels")
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good")).first()
    if not counts["good"]:
        return None
    prior = min(0.99, (counts["good"] + 1) / (counts["n"] + 2))
    trusted = known.where("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text")
    positive = _sample_features(rows.join(F.broadcast(trusted), "doc_id", "left_semi"), sample)  # at most ``sample`` ids
    unlabelled = _sample_features(rows.where(~held_out()), sample)
    return fit(positive, unlabelled, prior) if len(positive) and len(unlabelled) else None


def score_documents(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` with a score in 0..1 for every row in the column ``name`` (which replaces one of that name), by one pass over the whole texts."""
    docs = docs.drop(name)
    fields = [f.name for f in docs.schema.fields]
    if model is None:
        return docs.withColumn(name, F.lit(1.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = model.score(_matrix(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(s, type=pa.float64())], names=[*fields, name])

    schema = docs.limit(0).select(*(F.col(f"`{f}`") for f in fields)).schema.add(name, "double")
    return docs.mapInArrow(score, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their own columns, whatever their names."""
    name = fresh_names(docs, "score")["score"]
    return score_documents(docs, learn(docs, labels), name).where(F.col(name) >= threshold).drop(name)
