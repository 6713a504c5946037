"""Document quality by Bradley-Terry pairwise ranking.

Every preference pair (better, worse) is one observation of P(better beats worse) = sigmoid(s(better) - s(worse)), with
s linear in text statistics: logistic loss on feature differences. Scores are then cut at a quantile of the training
scores, the share of documents marked 0, and squeezed so that the cut is 0.5.

Defined results: null and empty texts have the features of an empty text and a score like any other; a model fitted
without both labels scores 0.5 everywhere; rows are kept one for one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, append, bounded_rows, col, flat_bytes, mix, range_hashes, words_of

#: Byte classes whose shares are features.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".", ",", "!?", "|", "#$%&*@^~", "<>{}[]()=/\\_+", ":;\"'`-", "\n")
N_FEATURES = len(CLASSES) + 13
_TABLE = np.zeros((256, len(CLASSES)), np.int32)
for _i, _chars in enumerate(CLASSES):
    _TABLE[[ord(x) for x in _chars], _i] = 1


def features(texts: pa.Array) -> np.ndarray:
    """float64 [n, N_FEATURES] of whole texts."""
    data, off = flat_bytes(texts)
    n = len(texts)
    size = np.diff(off).astype(float)
    doc_of_byte = np.repeat(np.arange(n), np.diff(off))
    hist = np.bincount(doc_of_byte * 256 + data, minlength=n * 256).reshape(n, 256)
    shares = np.sqrt(hist @ _TABLE / np.maximum(size, 1)[:, None])
    high = np.sqrt(hist[:, 128:].sum(1) / np.maximum(size, 1))
    starts, ends, doc = words_of(data, off, SPACE[data])
    per = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(per, 1)
    h = range_hashes(data, starts, ends)
    lengths = (ends - starts).astype(float)
    mean_len = np.bincount(doc, weights=lengths, minlength=n) / some
    var_len = np.maximum(np.bincount(doc, weights=lengths**2, minlength=n) / some - mean_len**2, 0)
    first, last = data[starts] if len(starts) else data, data[ends - 1] if len(ends) else data
    title = np.bincount(doc, weights=(first >= 65) & (first <= 90), minlength=n) / some
    odd_end = np.bincount(doc, weights=np.isin(last, np.frombuffer(b"#$%&*@!|", np.uint8)), minlength=n) / some
    short = np.bincount(doc, weights=lengths <= 2, minlength=n) / some
    same = np.zeros(n)
    if len(h) > 1:
        again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        same = np.bincount(doc[1:], weights=again, minlength=n) / some
    key = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(doc[np.unique(key, return_index=True)[1]], minlength=n) / some if len(key) else np.zeros(n)
    pair_new = np.zeros(n)
    if len(h) > 1:
        two = (key[1:] * np.uint64(3) + key[:-1])[doc[1:] == doc[:-1]]
        d2 = doc[1:][doc[1:] == doc[:-1]]
        pair_new = np.bincount(d2[np.unique(two, return_index=True)[1]], minlength=n) / np.maximum(np.bincount(d2, minlength=n), 1)
    p = hist / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    other = [high, np.log1p(per), np.log1p(mean_len), np.log1p(var_len), title, odd_end, short, np.sqrt(same), distinct, pair_new, entropy / 8, distinct * np.log1p(per), (1 - pair_new) * np.log1p(per)]
    return np.column_stack([shares, *other])


@dataclass(frozen=True)
class PairwiseRanker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    width: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip((s - self.cut) / self.width, -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, partners: int = 8, ridge: float = 1e-3, seed: int = 7) -> PairwiseRanker:
    """Fit on every document of either label against `partners` documents of the other, drawn with a fixed seed."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return PairwiseRanker(mean, scale, np.zeros(x.shape[1] if len(x) else N_FEATURES), 0.0, 1.0)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    a = np.r_[np.repeat(good, partners), rng.choice(good, len(bad) * partners)]
    b = np.r_[rng.choice(bad, len(good) * partners), np.repeat(bad, partners)]
    d = z[a] - z[b]
    w = np.zeros(d.shape[1])
    for _ in range(25):  # Newton steps on the logistic loss of the differences
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        g = d.T @ (p - 1) / len(d) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    # the quantile that leaves the share of label 0 below, midway to the next score
    ranked = np.sort(s)
    k = len(bad)
    lo, hi = ranked[max(k - 1, 0)], ranked[min(k, len(ranked) - 1)]
    return PairwiseRanker(mean, scale, w, float(lo + hi) / 2, float(s.std() / 4 + 1e-9))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column | None = None, per_label: int = 3000) -> PairwiseRanker:
    """Fit on at most `per_label` labelled rows of each label (a documented bound), the same ones on every run.

    Of documents that repeat an id the least text counts, and a label that repeats counts once.
    The drawn label rows are broadcast (at most 2 * per_label of them); documents are not shuffled and the driver gets
    one row of N_FEATURES numbers for each match.
    """
    rows = labels.where(col(label_col).isin(0, 1) & col(id_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.select(col(id_col).alias("__i"), col(label_col).cast("int").alias("__y"))
    drawn = bounded_rows(rows.where("__y = 0"), per_label, F.col("__i")).union(bounded_rows(rows.where("__y = 1"), per_label, F.col("__i"))).distinct()
    found = docs.select(col(id_col).alias("__i"), col(text_col).alias("__t")).join(F.broadcast(drawn), "__i")
    found = found.groupBy("__i", "__y").agg(F.min(F.coalesce("__t", F.lit(""))).alias("__t"))

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(list(features(texts)), pa.list_(pa.float64()))]

        return run

    seen = append(found, "__t", [T.StructField("x", T.ArrayType(T.DoubleType()))], make).select("__i", "__y", "x").toPandas().sort_values(["__i", "__y"])
    x = np.array(seen["x"].tolist()).reshape(len(seen), N_FEATURES)
    return fit_pairs(x, seen["__y"].to_numpy())


def predict(docs: DataFrame, model: PairwiseRanker, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5)."""

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            s = model.score(features(texts))
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

        return run

    return append(docs, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)
