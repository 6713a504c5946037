"""BagMinHash: unbiased signatures, exact verification, classes against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tapewright.llm import bagminhash as B
from tapewright.llm import neardup


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    x, y = bag(a), bag(b)
    both, either = sum((x & y).values()), sum((x | y).values())
    return both / either if either else 1.0


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return w


def corpus(seed=3):
    rng = random.Random(seed)
    texts = []
    for f in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(120)] + ["again and again we say it"] * rng.randrange(4)
        texts += [" ".join(edited(rng, base, rng.randrange(5))) for _ in range(14)]
        texts += [" ".join(edited(rng, base, 1))] * 3
    texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    return texts + ["", "   ", None, "one", "one", "a b c d", "a b c d"]


def components(texts, threshold):
    n = len(texts)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or (bag(texts[i]) and jaccard(texts[i], texts[j]) >= threshold):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_registers_agree_as_often_as_the_weighted_jaccard():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(40):
        n = 200
        e = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        a = rng.integers(1, 12, n)
        b = np.maximum(1, a + rng.integers(-2, 3, n))
        keep = rng.random(n) < 0.85
        want = np.minimum(a, b)[keep].sum() / np.maximum(a, np.where(keep, b, 0)).sum()
        s = B.signatures(np.r_[e, e[keep]], np.r_[a, b[keep]], np.r_[np.zeros(n, int), np.ones(keep.sum(), int)], 2, 512)
        off.append((s[0] == s[1]).mean() - want)
    assert abs(np.mean(off)) < 4 * np.std(off) / len(off) ** 0.5 + 1e-3


def test_similarity_is_the_multiset_one():
    texts = corpus()
    a, b = texts[:-1], texts[1:]
    got = B.weighted_jaccard(pa.array(a, pa.string()), pa.array(b, pa.string()))
    assert np.allclose(got, [jaccard(x, y) for x, y in zip(a, b)])


def test_classes_are_the_brute_force_components(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bands string")
    got = {r["id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts, 0.8)


def test_a_family_without_its_original(spark):
    """Every copy lacks what all others have in common with the original; links among them must still be found."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(rng, base, rng.choice([1, 2, 3, 6]))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts, 0.8)


def test_odd_rows(spark, odd, empty):
    got = {r["id"]: r["class_id"] for r in neardup.classes(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    assert neardup.classes(empty).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 4, 5, 6, 7, 8]
