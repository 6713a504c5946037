"""Weighted MinHash signatures of word-shingle multisets.

BagMinHash (Ertl, 2018): every element owns a Poisson process for each interval of a discretised weight axis; a point
has a time and falls on one of K registers; a document's register holds the earliest point that its weights reach.
Intervals double in length (0,1], (1,2], (2,4], ...; the process of a whole interval has its length as rate and each
point carries a level inside it, which is the binary splitting of that process done at once, so a weight that reaches
into an interval keeps the points up to its level. Registers of two documents agree with the probability of their
weighted Jaccard similarity. Points come in order of time and stop at a document's horizon, so the cost is about one
draw an element plus K log K points a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import SPACE, flat_bytes, mix, range_hashes, words_of

U = np.uint64
SHINGLE = 5


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, document by document, and len+1 offsets.

    A word is a run without ASCII white space. A text of fewer than n words (but one at least) is one shingle.
    """
    data, off = flat_bytes(texts)
    starts, ends, doc = words_of(data, off, SPACE[data])
    w = range_hashes(data, starts, ends)
    per_doc = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    seeds = mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    m = len(w)
    whole, whole_doc = np.zeros(0, U), np.zeros(0, np.int64)
    if m >= n:
        acc = np.zeros(m - n + 1, U)
        for k in range(n):
            acc += w[k : m - n + 1 + k] * seeds[k]
        inside = doc[: m - n + 1] == doc[n - 1 :]
        whole, whole_doc = mix(acc[inside]), doc[: m - n + 1][inside]
    short = np.flatnonzero((per_doc > 0) & (per_doc < n))
    if len(short):
        first = np.cumsum(per_doc) - per_doc
        h = np.array([mix((w[first[d] : first[d] + per_doc[d]] * seeds[: per_doc[d]]).sum(dtype=U, keepdims=True) + U(per_doc[d]))[0] for d in short], U)
        whole, whole_doc = np.r_[whole, h], np.r_[whole_doc, short]
        order = np.argsort(whole_doc, kind="stable")
        whole, whole_doc = whole[order], whole_doc[order]
    return whole, np.concatenate([[0], np.cumsum(np.bincount(whole_doc, minlength=len(texts)))]).astype(np.int64)


def multisets(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements with counts and their document, documents in order, elements sorted within one."""
    hashes = hashes.copy()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        hashes[a:b].sort()
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), doc
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.r_[at, len(hashes)]), doc[at]


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(elements: np.ndarray, counts: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """float64 [n_docs, k] of earliest times; inf in all registers of a document without elements."""
    sig = np.full(n_docs * k, np.inf)
    weight = np.bincount(doc, weights=counts, minlength=n_docs)
    horizon = np.zeros(n_docs)
    has = weight > 0
    horizon[has] = k * (np.log(k) + 1.5) / weight[has]
    # one entry for each element and weight interval that the element's count reaches
    h, d, low, width, c = [elements], [doc], [np.zeros(len(doc), np.int64)], [np.ones(len(doc), np.int64)], [counts]
    lower = 1
    while (up := np.flatnonzero(counts > lower)).size:
        h.append(mix(elements[up] + U(lower * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)))
        d.append(doc[up])
        low.append(np.full(len(up), lower))
        width.append(np.full(len(up), lower))
        c.append(counts[up])
        lower *= 2
    h, d, low, width, c = (np.concatenate(x) for x in (h, d, low, width, c))
    open_docs = has.copy()
    while open_docs.any():
        on = np.flatnonzero(open_docs[d])
        state, dd, lo, wd, cc, t = h[on], d[on], low[on], width[on], c[on], np.zeros(len(on))
        while len(state):
            state = mix(state + U(0x9E3779B97F4A7C15))
            t = t - np.log(_unit(state)) / wd
            live = np.flatnonzero(t <= horizon[dd])
            state, dd, lo, wd, cc, t = state[live], dd[live], lo[live], wd[live], cc[live], t[live]
            mark = mix(state ^ U(0xD1B54A32D192ED03))
            hit = lo + ((mark >> U(32)) * wd.astype(U) >> U(32)).astype(np.int64) < cc
            np.minimum.at(sig, dd[hit] * k + ((mark & U(0xFFFFFFFF)) * U(k) >> U(32)).astype(np.int64)[hit], t[hit])
        unfilled = np.isinf(sig.reshape(n_docs, k)).any(1) & has
        horizon[unfilled] *= 1.6
        open_docs = unfilled
    return sig.reshape(n_docs, k)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """int64 [n_docs, bands]: a hash of each band's registers (to single precision, alike on any CPU) and its number."""
    n, k = sig.shape
    bits = np.ascontiguousarray(sig.astype(np.float32)).view(np.uint32).astype(U).reshape(n, bands, k // bands)
    acc = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U) * U(0xA0761D6478BD642F)), (n, bands)).copy()
    for r in range(k // bands):
        acc = mix(acc * U(0x2545F4914F6CDD1D) + bits[:, :, r])
    return acc.view(np.int64)


def _counts(side: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    e, c, d = multisets(*shingles(side))
    return e, c, d, np.bincount(d, weights=c, minlength=n)


def compare(left: pa.Array, right: pa.Array, threshold: float | None = None) -> tuple[np.ndarray, list[pa.Array]]:
    """Exact multiset Jaccard of the shingles of two text columns, row by row (two texts without words give 1), and, with
    a threshold, token lists of the left text.

    Tokens are int32 hashes of shingle occurrences: first those that the right text lacks (extra), then of those that it
    has (common) as many as a prefix of n - ceil(threshold * n) + 1 tokens may still need, n being the left text's
    occurrences. In any order of all occurrences that puts extra before common and depends on the right text alone, the
    prefixes of two texts with at least this similarity share a token.
    """
    n = len(left)
    e, c, d, n_left = _counts(left, n)
    f, g, h, n_right = _counts(right, n)
    both, kind = np.concatenate([e, f]), np.repeat([0, 1], [len(e), len(f)])
    row = np.concatenate([d, h])
    order = np.lexsort((kind, both, row))
    at = np.flatnonzero((both[order][1:] == both[order][:-1]) & (row[order][1:] == row[order][:-1]))
    mine, theirs = order[at], order[at + 1] - len(e)
    other = np.zeros(len(e), np.int64)
    other[mine] = g[theirs]
    inter = np.bincount(d, weights=np.minimum(c, other), minlength=n)
    total = n_left + n_right
    j = np.where(total > 0, inter / np.maximum(total - inter, 1), 1.0)
    if threshold is None:
        return j, []
    rep = np.repeat(np.arange(len(e)), c)
    occ = np.arange(len(rep)) - np.repeat(np.cumsum(c) - c, c)
    token = (mix(e[rep] + occ.astype(U) * U(0x8CB92BA72F3D8DD7)) >> U(32)).astype(np.uint32).view(np.int32)
    known, doc = occ < other[rep], d[rep]
    n_extra = (n_left - inter).astype(np.int64)
    fill = np.maximum(prefix_size(n_left, threshold) - n_extra, 0)
    at = np.flatnonzero(known)
    at = at[np.lexsort((token[at], doc[at]))]
    n_common = inter.astype(np.int64)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n_common) - n_common, n_common)
    few = at[nth < fill[doc[at]]]

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))

    return j, [lists(token[~known], n_extra), lists(token[few], np.minimum(fill, n_common))]


def prefix_size(n: np.ndarray, threshold: float) -> np.ndarray:
    return (n - np.ceil(threshold * n - 1e-9) + 1).astype(np.int64) * (n > 0)


def weighted_jaccard(left: pa.Array, right: pa.Array) -> np.ndarray:
    return compare(left, right)[0]
