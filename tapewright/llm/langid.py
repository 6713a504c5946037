"""Language identification by multilingual mixtures.

A model holds P(trigram | language), learnt from labelled texts. A document is a mixture: each word comes from one
language, with the document's unknown proportions. Expectation-maximisation estimates the proportions from the words'
n-gram likelihoods; the language set is the one of greatest penalised likelihood. See Lui, Lau and Baldwin,
"Automatic detection and language identification of multilingual documents" (2014), for the setting.

The share says which of the learnt languages a text is in, not whether it is in any; that is what `fit` is for: the mean,
over letters, of the log-likelihood of each word's best language over that of trigrams drawn evenly from all buckets. On
the given tables texts have 0.7 or more, random letters and languages that were not learnt less than -2.

Defined results: null texts and texts without a letter give `und` with score and fit 0; a model without languages gives
`und` everywhere; rows are kept one for one, repeated ones too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, col, flat_chars, give_back, small_batches, steps, words_of

BUCKETS = 1 << 15


def letters(chars: np.ndarray) -> np.ndarray:
    """Where a lower-cased code point is a letter: ASCII by rule, others by Python's table, each distinct one once."""
    out = (chars >= 97) & (chars <= 122) | (chars >= 65) & (chars <= 90)
    if len(at := np.flatnonzero(chars >= 128)):
        kinds, which = np.unique(chars[at], return_inverse=True)
        out[at] = np.array([chr(k).isalpha() for k in kinds.tolist()], bool)[which]
    return out


def word_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of every letter (with its neighbours, word ends as 0), the first position of each word, its document."""
    chars, off = flat_chars(pc.utf8_lower(pc.fill_null(texts, "")))
    is_letter = letters(chars)
    starts, ends, doc = words_of(chars, off, ~is_letter)
    if not len(starts):
        return np.zeros(0, np.int64), starts, doc
    # words with a 0 on either side, laid out one after another
    sizes = ends - starts
    inside = np.flatnonzero(is_letter)
    c = chars[inside].astype(np.uint32)
    first = np.cumsum(sizes) - sizes
    left = np.empty_like(c)
    left[1:], left[first] = c[:-1], 0
    right = np.empty_like(c)
    right[:-1] = c[1:]
    right[first + sizes - 1] = 0
    h = (left * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA77)) ^ (right * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64), first, doc


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_p: np.ndarray  # float32 [BUCKETS, languages]
    penalty: float = 3.0
    rounds: int = 12

    def proportions(self, texts: pa.Array) -> np.ndarray:
        """[documents, languages]; rows of zeros where there is no letter."""
        return self.judge(texts)[0]

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and fit of each text."""
        grams, first, doc = word_grams(texts)
        n, k = len(texts), len(self.languages)
        out, fit = np.zeros((n, k)), np.zeros(n)
        if not len(grams) or not k:
            return out, fit
        ll = np.add.reduceat(self.log_p[grams], first, axis=0).astype(np.float32)
        top = ll.max(1)
        lik = np.exp(ll - top[:, None])
        begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        docs, counts = doc[begin], np.diff(np.r_[begin, len(doc)])
        total = np.add.reduceat(ll.astype(np.float64), begin, axis=0)
        base = np.add.reduceat(top.astype(np.float64), begin)
        letters_of = np.diff(np.r_[first[begin], len(grams)])
        fit[docs] = base / letters_of + np.log(BUCKETS)
        best = total.argmax(1)
        single = total[np.arange(len(docs)), best] - self.penalty
        pi = _em(lik, begin, counts, np.full((len(docs), k), 1.0 / k), 3)
        chosen = np.zeros((len(docs), k))
        chosen[np.arange(len(docs)), best] = 1.0
        score = single.copy()
        open_ = np.flatnonzero(pi.max(1) < 0.98)  # the others have one language at any penalty
        order = np.argsort(-pi, axis=1, kind="stable")
        for size in range(2, k + 1):
            if not len(open_):
                break
            allowed = np.zeros((len(open_), k), bool)
            np.put_along_axis(allowed, order[open_, :size], True, axis=1)
            rows = np.concatenate([np.arange(a, a + c) for a, c in zip(begin[open_], counts[open_], strict=True)])
            sub_n = counts[open_]
            sub_begin = np.cumsum(sub_n) - sub_n
            got = _em(lik[rows], sub_begin, sub_n, allowed / allowed.sum(1, keepdims=True), self.rounds)
            mixed = np.log((lik[rows] * np.repeat(got, sub_n, axis=0)).sum(1) + 1e-300)
            now = np.add.reduceat(mixed, sub_begin) + base[open_] - self.penalty * size * (1 + 0.5 * np.log(sub_n))
            better = now > score[open_]
            chosen[open_[better]], score[open_[better]] = got[better], now[better]
            open_ = open_[better]  # a larger set is tried only where this one paid
        out[docs] = chosen
        return out, fit


def _em(lik: np.ndarray, begin: np.ndarray, counts: np.ndarray, pi: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        w = lik * np.repeat(pi, counts, axis=0)
        w /= w.sum(1, keepdims=True) + 1e-300
        new = np.add.reduceat(w, begin, axis=0) / counts[:, None]
        if np.abs(new - pi).max() < 1e-3:
            return new
        pi = new
    return pi


def fit(docs: DataFrame, text_col: str, lang_col: str, usable: Column | None = None, per_language: int = 3000) -> LanguageModel:
    """Learn trigram tables from about `per_language` labelled documents of each language (a documented bound).

    The documents are drawn by a hash of their text, so reruns agree; a text counts once however often it is copied, both
    for the share that is drawn and for the tables.
    Counting is distributed and the driver gets one row for each language and bucket.
    """
    rows = docs.where(col(lang_col).isNotNull() & col(text_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.select(col(text_col).alias("t"), col(lang_col).cast("string").alias("l"))
    each = rows.select("l", F.xxhash64("t").alias("h")).distinct()
    sizes = {r["l"]: r["n"] for r in each.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, per_language / sizes[name])))])
    drawn = rows.where((F.crc32(F.col("t").cast("binary")) / F.lit(float(1 << 32))) < share[F.col("l")]).dropDuplicates()

    def count(batches):
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            for name in set(batch.column(1).to_pylist()):
                for part in steps(batch.column(0).filter(pc.equal(batch.column(1), name))):
                    grams, _, _ = word_grams(part)
                    kept[name] = kept.get(name, 0) + np.bincount(grams, minlength=BUCKETS)
        for name, n in kept.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["l", "b", "n"])
        give_back()

    counts = small_batches(drawn).mapInArrow(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    seen = counts.toPandas()
    table = np.full((BUCKETS, len(languages)), 0.05)
    table[seen["b"].to_numpy(int), seen["l"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] += seen["n"].to_numpy(float)
    return LanguageModel(languages, np.log(table / table.sum(0)).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (the share of lang_pred), lang_set (all languages found, by share) and fit."""
    names = np.array([*model.languages, "und"], dtype=object)

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            p, fit = model.judge(texts)
            none = p.sum(1) == 0 if p.shape[1] else np.ones(len(texts), bool)
            top = np.where(none, len(names) - 1, p.argmax(1) if p.shape[1] else 0)
            order = np.argsort(-p, axis=1, kind="stable")
            sets = [[str(names[j]) for j in o if row[j] > 0] for o, row in zip(order, p, strict=True)]
            return [pa.array(names[top].tolist(), pa.string()), pa.array(np.where(none, 0.0, p.max(1) if p.shape[1] else 0.0), pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(fit)]

        return run

    return append(docs, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.ArrayType(T.StringType())), T.StructField("fit", T.DoubleType())], make)
