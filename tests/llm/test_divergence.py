"""The quadtree and the audit against plain loops; odd inputs; blocks and tiles."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapewright.llm import divergence as V


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, least=3, top=200):
    """Of (text, lang, source) rows, by the definition and in Python's integers."""
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = terms(text)
        docs[lang].update(set(found))
        count[lang, source].update(found)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        p = {s: [1 + 10**9 * (count[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept] for s in sources}
        q = [1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept]
        for s in sources:
            pair = [(sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            term = [((a - b) ** 2 // b, t) for a, b, t in zip(p[s], q, kept) if count[lang, s][t] and a > b]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def audit(spark, rows, **more):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in V.audit(df, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    vocabulary = np.array([f"{c}w" + "abcdefghij"[i % 10] * (1 + i // 10) for c in "ÄbxZ" for i in range(40)])
    rows = []
    for i in range(160):
        lang = ["en", "de", None][i % 3]
        mine = rng.permutation(vocabulary)[: 20 + i % 30]
        rows.append((" ".join(rng.choice(mine, 5 + i % 60)) + ", 12!", lang, [f"s{i % 11}", None][i % 13 == 0]))
    return rows + [("12 !!", "en", "bare"), (None, "en", "none"), ("", "xx", "one"), ("few words", "yy", "a"), ("few words", "yy", "b"), *[("alone again", "zz", "only")] * 3]


def test_audit_equals_plain_loops(spark, corpus):
    want = brute(corpus)
    assert audit(spark, corpus) == want
    # many small blocks, and tiles of few sources
    assert audit(spark, corpus, block=7) == want
    assert audit(spark, corpus, block=16, tile=3) == want
    assert audit(spark, corpus, top=4) == brute(corpus, top=4)
    assert {x[3] for x in want if x[:3] == ("en", "bare", "pair")} >= {"none", "s1"}
    assert {x[4] for x in want if x[0] == "yy"} == {0}  # no term is in three documents
    assert not {x for x in want if x[0] == "xx"} and {x[2] for x in want if x[0] == "zz"} == set()


def test_no_rows_and_other_columns(spark, odd, empty):
    assert V.audit(empty).count() == 0
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.select("text", "lang", "source").collect()]
    got = {tuple(r) for r in V.audit(odd, least=1).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == brute(rows, least=1)


@given(st.integers(0, 2**32 - 1), st.integers(1, 9), st.integers(1, 9), st.integers(1, 40), st.floats(0, 1), st.booleans())
@settings(max_examples=60, deadline=None)
def test_traversal_meets_each_leaf_of_either_once(seed, rows_a, rows_b, cols, density, same):
    rng = np.random.default_rng(seed)
    a = rng.random((rows_a, cols)) < density * rng.random(cols)
    b = a if same else rng.random((rows_b, cols)) < density * rng.random(cols)
    depth = V.depth_of(*a.shape, len(b))
    ta = V.Quadtree(a, depth)
    found = Counter(x for i, j, c in V.traverse(ta, ta if same else V.Quadtree(b, depth)) for x in zip(i.tolist(), j.tolist(), c.tolist()))
    want = {(i, j, c) for i in range(len(a)) for j in range(len(b)) for c in range(cols) if (a[i, c] or b[j, c]) and (not same or i < j)}
    assert set(found) == want and set(found.values()) <= {1}


def test_a_single_cell_is_no_pair_with_itself():
    one = V.Quadtree(np.ones((1, 1), bool), V.depth_of(1, 1, 1))
    assert len(one.levels) == 1 and list(V.traverse(one, one)) == []
    assert [tuple(x.tolist() for x in found) for found in V.traverse(one, V.Quadtree(np.zeros((1, 1), bool), 0))] == [([0], [0], [0])]


def test_empty_quadrants_are_not_entered():
    """Of two sources with terms of their own far apart, the traversal sees little more than their cells."""
    filled = np.zeros((2, 4096), bool)
    filled[0, :4], filled[1, 4000:4004] = True, True
    tree = V.Quadtree(filled, V.depth_of(*filled.shape))
    seen = sum(len(c) for _, _, c in V.traverse(tree, tree))
    assert seen == 8
    assert [level.sum() for level in tree.levels] == [1, 2, 2, 2, 2, 2, 8]


def test_shares_are_exact():
    rng = np.random.default_rng(3)
    for total in (1, 17, 10**9 + 7, 10**12 + 39, 9 * 10**15 - 10**6):
        count = rng.integers(0, total + 1, 50)
        got = V.share(count, total, 1000)
        assert got.tolist() == [1 + 10**9 * (int(c) + 1) // (total + 1000) for c in count]


def test_counts_of_a_task_are_merged_exactly(monkeypatch):
    monkeypatch.setattr(V, "HELD", 5)
    c = V._Counter()
    for texts in (["b a a", None, "Ä b"], ["a", "b b"]):
        c.add(pa.array(["en"] * len(texts)), pa.array(["x", "y", "x"][: len(texts)]), pa.array(texts, pa.string()))
    got = {tuple(r.values()) for b in c.take() for r in b.to_pylist()}
    assert got == {("en", "x", "a", 3, 2), ("en", "x", "b", 2, 2), ("en", "x", "Ä", 1, 1), ("en", "y", "b", 2, 1)}
