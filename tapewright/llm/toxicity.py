"""Toxicity by subword-bag embeddings and a linear softmax.

A bag is a run of words; its vector is the mean of the embeddings of all character n-grams (3 to 6, word ends marked)
of its words, and a softmax over two classes reads it. Embeddings and softmax are trained jointly in numpy, so an unseen
misspelling shares the vectors of its n-grams. A document's score comes from its most toxic bag: a few words in a long
text are not averaged away.

Defined results: null and empty texts have an empty bag and a score like any other; a model fitted without both labels
scores 0 everywhere; rows are kept one for one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, bounded_rows, col, flat_chars, give_back, range_hashes, small_batches, words_of
from .langid import letters

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 20
#: An n-gram of fewer training documents than this has no vector.
LEAST_DOCS = 4
#: Runs that a very long training text is learnt from.
RUNS = 16
#: Added to a bag's number of n-grams, so that bags of a word or two stay near zero.
PRIOR = 60


def subwords(texts: pa.Array, bag_words: int, hop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram buckets, the hop (a run of `hop` words) of each, and the document of each hop.

    Words are runs of letters and digits, lower-cased, with one mark on either side; a word that repeats the one before
    it counts once.
    """
    chars, off = flat_chars(pc.utf8_lower(pc.fill_null(texts, "")))
    is_word = letters(chars) | ((chars >= 48) & (chars <= 57))
    starts, ends, doc = words_of(chars, off, ~is_word)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = range_hashes(chars, starts, ends)
    fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    is_word = is_word & np.repeat(np.r_[True, fresh], np.diff(np.r_[0, starts, len(chars)]))
    starts, ends, doc = starts[fresh], ends[fresh], doc[fresh]
    padded = ends - starts + 2
    first = np.cumsum(padded) - padded
    c = np.zeros(int(padded.sum()), np.uint32)
    word_of = np.repeat(np.arange(len(starts)), padded)
    letter = np.ones(len(c), bool)
    letter[first] = letter[first + padded - 1] = False
    c[letter] = chars[is_word]
    begins = np.r_[True, doc[1:] != doc[:-1]]
    nth = np.arange(len(doc)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
    opens = begins | (nth % hop == 0)
    hop_of_word, hop_doc = np.cumsum(opens) - 1, doc[opens]
    left = first[word_of] + padded[word_of] - np.arange(len(c))  # marks and letters up to the word's end
    grams, hops = [], []
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max(SIZES) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ c[n - 1 :]) * np.uint32(16777619) + np.uint32(n)
        if n in SIZES:
            at = np.flatnonzero(left[:m] >= n)
            x = h[at]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            grams.append(((x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int32))
            hops.append(hop_of_word[word_of[at]])
    return np.concatenate(grams), np.concatenate(hops), hop_doc


def bag_means(values: np.ndarray, hops: np.ndarray, hop_doc: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of values over each bag of `span` consecutive hops of a document (fewer at its end), and the bag's document."""
    n = len(hop_doc)
    total, count = np.bincount(hops, weights=values, minlength=n), np.bincount(hops, minlength=n).astype(float)
    t, k = total.copy(), count.copy()
    for s in range(1, span):
        same = hop_doc[s:] == hop_doc[:-s] if n > s else np.zeros(0, bool)
        t[: n - s][same] += total[s:][same]
        k[: n - s][same] += count[s:][same]
    return t / (k + PRIOR), hop_doc


@dataclass(frozen=True)
class SubwordSoftmax:
    margins: np.ndarray  # float32 [BUCKETS]: embedding . (w_toxic - w_clean), all that scoring needs
    bias: float
    slope: float
    shift: float
    bag_words: int = 12
    hop: int = 4

    def logits(self, texts: pa.Array) -> np.ndarray:
        grams, hops, hop_doc = subwords(texts, self.bag_words, self.hop)
        out = np.full(len(texts), self.bias)
        if len(grams):
            m, doc = bag_means(self.margins[grams], hops, hop_doc, self.bag_words // self.hop)
            at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            out[doc[at]] = np.maximum.reduceat(m + self.bias, at)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -40, 40)))


def _slices(texts: pa.Array, n: int = 64):
    """(first, texts) in small runs, so that training needs little memory at a time."""
    for at in range(0, len(texts), n):
        yield at, texts.slice(at, n)


class _Bags:
    """All bags of the training texts as slices of one array of known n-grams, with their full sizes."""

    def __init__(self, texts: pa.Array, known: np.ndarray, bag_words: int, hop: int):
        place = np.full(BUCKETS, -1, np.int32)
        place[known] = np.arange(len(known), dtype=np.int32)
        held_grams, held_n, all_n, docs = [], [], [], []
        for first, part in _slices(texts):
            grams, hops, hop_doc = subwords(part, bag_words, hop)
            at = place[grams]
            ok = at >= 0
            all_n.append(np.bincount(hops, minlength=len(hop_doc)))
            held_n.append(np.bincount(hops[ok], minlength=len(hop_doc)))
            held_grams.append(at[ok][np.argsort(hops[ok], kind="stable")])
            docs.append(hop_doc + first)
        hop_doc, span = np.concatenate(docs), bag_words // hop
        n = len(hop_doc)
        size = np.concatenate([[0], np.cumsum(np.concatenate(all_n))])
        self.grams = np.concatenate(held_grams)
        held = np.concatenate([[0], np.cumsum(np.concatenate(held_n))])
        last = np.searchsorted(hop_doc, hop_doc, "right")
        end = np.minimum(np.arange(n) + span, last)
        self.begin, self.end, self.doc = held[:-1], held[end], hop_doc
        self.size = (size[end] - size[:-1] + PRIOR).astype(np.float32)

    def flat(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.end[idx] - self.begin[idx]
        row = np.repeat(np.arange(len(idx)), n)
        return self.grams[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[idx], n)], row

    def values(self, margin: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """The value of every bag; running sums over a run of bags at a time, for they overlap."""
        out = np.empty(len(self.begin))
        for at in range(0, len(out), step):
            begin, end = self.begin[at : at + step], self.end[at : at + step]
            lo, hi = int(begin[0]), int(end.max())
            total = np.concatenate([[0.0], np.cumsum(margin[self.grams[lo:hi]], dtype=np.float64)])
            out[at : at + step] = (total[end - lo] - total[begin - lo]) / self.size[at : at + step]
        return out

    def best(self, value: np.ndarray, most: int) -> np.ndarray:
        """The `most` bags of greatest value of each document."""
        order = np.lexsort((-value, self.doc))
        d = self.doc[order]
        begins = np.r_[True, d[1:] != d[:-1]]
        nth = np.arange(len(d)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        return order[nth < most]


def _train(bags: _Bags, idx: np.ndarray, y: np.ndarray, e: np.ndarray, w: np.ndarray, b: np.ndarray, epochs: int, rng: np.random.Generator, rate: float = 0.25, decay: float = 2e-4) -> None:
    """Jointly train embeddings e [n, dim] and the softmax w, b in place by Adagrad on mini-batches of bags."""
    ge, gw, gb = np.full(len(e), 1e-6, np.float32), np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    label = y[bags.doc[idx]]
    share = np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1)).astype(np.float32) * len(idx)
    for _ in range(epochs):
        order = rng.permutation(len(idx))
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            flat, row = bags.flat(idx[pick])
            uniq, inv = np.unique(flat, return_inverse=True)
            size = bags.size[idx[pick]]
            x = np.column_stack([np.bincount(row, weights=e[flat, j], minlength=len(pick)) for j in range(e.shape[1])]).astype(np.float32) / size[:, None]
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), label[pick]] -= 1
            p *= share[pick][:, None] / len(pick)
            dx = (p @ w.T) / size[:, None]
            g = x.T @ p
            gw += g**2
            w -= rate * g / np.sqrt(gw)
            g = p.sum(0)
            gb += g**2
            b -= rate * g / np.sqrt(gb)
            d = np.column_stack([np.bincount(inv, weights=dx[row, j], minlength=len(uniq)) for j in range(e.shape[1])]).astype(np.float32)
            ge[uniq] += (d**2).mean(1)
            e[uniq] -= rate * d / np.sqrt(ge[uniq])[:, None] + decay * e[uniq]


def fit_texts(texts: pa.Array, y: np.ndarray, dim: int = 4, bag_words: int = 12, hop: int = 4, seed: int = 11) -> SubwordSoftmax:
    """Passes over chosen bags: first a few of each document under its label; then, of a toxic document, those that the
    last pass finds most toxic, and of the others the ones that come closest to it."""
    none = SubwordSoftmax(np.zeros(BUCKETS, np.float32), 0.0, 0.0, -40.0, bag_words, hop)
    if not (y == 1).any() or not (y == 0).any():
        return none
    docs_of = np.zeros(BUCKETS, np.int32)
    for _, part in _slices(texts):
        grams, hops, hop_doc = subwords(part, bag_words, hop)
        if len(grams):
            docs_of += np.bincount(np.unique(hop_doc[hops] * BUCKETS + grams) % BUCKETS, minlength=BUCKETS).astype(np.int32)
    known = np.flatnonzero(docs_of >= LEAST_DOCS)
    if not len(known):
        return none
    bags = _Bags(texts, known, bag_words, hop)
    rng = np.random.default_rng(seed)
    e = ((rng.random((len(known), dim), np.float32) - 0.5) * 0.02).astype(np.float32)
    w = ((rng.random((dim, 2), np.float32) - 0.5) * 0.4).astype(np.float32)
    b = np.zeros(2, np.float32)
    toxic_bag = y[bags.doc] == 1
    value = rng.random(len(bags.doc))
    for top_toxic, top_clean, epochs in ((16, 16, 2), (3, 8, 2), (2, 8, 2), (2, 8, 3)):
        hard, few = bags.best(value, top_clean), bags.best(value, top_toxic)
        loose = bags.best(rng.random(len(value)), 4)
        idx = np.concatenate([hard[~toxic_bag[hard]], loose[~toxic_bag[loose]], few[toxic_bag[few]]])
        _train(bags, idx, y, e, w, b, epochs, rng)
        value = bags.values(e @ (w[:, 1] - w[:, 0]))
    margins = np.zeros(BUCKETS, np.float32)
    margins[known] = e @ (w[:, 1] - w[:, 0])
    bias = float(b[1] - b[0])
    plain = SubwordSoftmax(margins, bias, 1.0, 0.0, bag_words, hop)
    slope, shift = _platt(np.concatenate([plain.logits(part) for _, part in _slices(texts)]), y)
    return SubwordSoftmax(margins, bias, slope, shift, bag_words, hop)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on one number, both classes weighing the same."""
    scale = z.std() + 1e-9
    x = np.column_stack([z / scale, np.ones(len(z))])
    wt = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    v = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        g = x.T @ ((p - y) * wt) + 1e-3 * v
        h = (x * (wt * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        v = v - np.linalg.solve(h, g)
    return float(v[0] / scale), float(v[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column | None = None, per_toxic: int = 500, per_clean: int = 1500, most_bytes: int = 4 << 20) -> SubwordSoftmax:
    """Fit on at most per_toxic + per_clean labelled rows and about `most_bytes` of text (documented bounds).

    Of the drawn rows (the same ones on every run, broadcast) texts are taken in a fixed order until the bytes are spent.
    Of a text of more than a thirty-second of them, RUNS runs of characters at even distances, as many as that share holds,
    are learnt from; of documents that repeat an id the least text counts. Scoring reads whole texts.
    """
    rows = labels.where(col(label_col).isin(0, 1) & col(id_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.select(col(id_col).alias("__i"), col(label_col).cast("int").alias("__y"))
    drawn = bounded_rows(rows.where("__y = 0"), per_clean, F.col("__i")).union(bounded_rows(rows.where("__y = 1"), per_toxic, F.col("__i"))).distinct()
    found = docs.select(col(id_col).alias("__i"), col(text_col).alias("__t")).join(F.broadcast(drawn), "__i")
    t, most = F.coalesce("__t", F.lit("")), most_bytes // 32
    step = F.char_length(t) / RUNS
    runs = F.transform(F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda i: F.substring(t, F.floor(i * step).cast("int") + 1, F.lit(most // (4 * RUNS))))
    found = found.select("__i", "__y", F.when(F.octet_length(t) <= most, t).otherwise(F.array_join(runs, " ")).alias("__t"))
    found = found.groupBy("__i", "__y").agg(F.min("__t").alias("__t"))

    def train(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        seen = pa.Table.from_batches(held).to_pandas().sort_values(["__i", "__y"])
        order = np.random.default_rng(5).permutation(len(seen))
        size = seen["__t"].fillna("").map(len).to_numpy()[order]
        seen = seen.iloc[np.sort(order[np.cumsum(size) <= most_bytes])]
        m = fit_texts(pa.array(seen["__t"].tolist(), pa.string()), seen["__y"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([m.margins.tobytes()]), pa.array([m.bias]), pa.array([m.slope]), pa.array([m.shift])], names=["margins", "bias", "slope", "shift"])
        del held, seen, m
        give_back()

    # the bounded sample is trained on in one task, so that the driver needs no room for it
    rows = small_batches(found).repartition(1).mapInArrow(train, "margins binary, bias double, slope double, shift double").collect()
    if not rows:
        return SubwordSoftmax(np.zeros(BUCKETS, np.float32), 0.0, 0.0, -40.0)
    return SubwordSoftmax(np.frombuffer(rows[0]["margins"], np.float32), rows[0]["bias"], rows[0]["slope"], rows[0]["shift"])


def predict(docs: DataFrame, model: SubwordSoftmax, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold)."""

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            s = model.score(texts)
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

        return run

    return append(docs, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)
