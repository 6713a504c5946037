"""Suffix arrays against plain loops; odd inputs; several passes."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewright.llm import decontamination as D
from tapewright.llm.queries import op12_decontamination


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window=10):
    """[(n_words, hit words, sorted item names)] of each document."""
    every = []
    for name, text in items:
        w = words(text)
        m = min(len(w), window)
        every += [(name, w[i : i + m]) for i in range(len(w) - m + 1)] if w else []
    out = []
    for text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, x in every:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    names |= {name} - {None}
        out.append((len(w), hit, sorted(names)))
    return out


def of_shard(docs, items, window):
    pieces = [(name, 0, True, D.hashed_words(pa.array([text]))[0]) for name, text in items]
    tests = D.suffixes(pieces, window)
    hashes, offsets = D.hashed_words(pa.array(docs, pa.string()))
    spans, names = D.Shard(hashes, offsets, tests).hits()
    return [(n, {i for a, b in s for i in range(a, b)}, x) for n, s, x in zip(np.diff(offsets).tolist(), spans, names)]


text = st.lists(st.sampled_from(["a", "B", "ab", "ü", "7"]), max_size=14).map(" ".join)


@given(docs=st.lists(text, min_size=1, max_size=5), items=st.lists(st.tuples(st.sampled_from(["1", "2", "10", None]), text), max_size=4), window=st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_hits_are_those_of_plain_loops(docs, items, window):
    assert of_shard(docs, items, window) == brute(docs, items, window)


def test_suffix_array_is_sorted_where_test_suffixes_fall_and_longest_matches_are_right():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(6)]
    passage = " ".join(rng.choice(vocabulary, 40))
    docs = [" ".join(rng.choice(vocabulary, 60)) for _ in range(8)] + [f"x {passage} y", passage, passage]
    item = " ".join(rng.choice(vocabulary, 8)) + " " + passage + " q " + " ".join(rng.choice(vocabulary, 30))
    tests = D.suffixes([("1", 0, True, D.hashed_words(pa.array([item]))[0])], 3)
    shard = D.Shard(*D.hashed_words(pa.array(docs)), tests)
    test, size, place = shard.longest()
    flat = shard.ids.tolist()
    for t, n, p in zip(test.tolist(), size.tolist(), place.tolist()):
        suffix = tests.ids[t : t + tests.left[t]].tolist()
        common = lambda q: next((k for k, (x, y) in enumerate(zip(suffix, flat[q:])) if x != y), min(len(suffix), len(flat) - q))
        assert n == max(common(q) for q in range(len(flat)) if flat[q]) == common(p)
    assert size.max() >= 40
    # where a test suffix goes in the array: before the suffixes whose first words are not below its own
    at, after = (shard.bound(test, tests.left[test], right) for right in (False, True))
    for t, i, j in zip(test.tolist(), at.tolist(), after.tolist()):
        suffix = tests.ids[t : t + tests.left[t]].tolist()
        inside = [flat[p : p + len(suffix)] for p in shard.array[shard.lo[t] : shard.hi[t]].tolist()]
        assert i - shard.lo[t] == sum(x < suffix for x in inside) and j - i == inside.count(suffix)


def test_long_runs_of_one_word_and_long_items():
    """No work that grows with the square of a repeat; an item in pieces loses no window."""
    run = " ".join(["same"] * 30_000)
    got = of_shard([run, "same " * 9, "other"], [("1", run)], 10)
    assert [len(x[1]) for x in got] == [30_000, 0, 0] and [x[2] for x in got] == [["1"], [], []]


def test_operator_on_odd_rows_and_in_several_passes(spark, odd, empty, monkeypatch):
    items = [(1, "brown fox jumps over the lazy dog again and again indeed"), (2, "fox jumps"), (3, None), (4, ""), (None, "no id but some"), (10, "word3 runs word4 runs word5 runs word6 runs word7 runs word8"), (10, "braune Fuchs")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit("clash"))
    rows = odd.select("doc_id", "text", "score").withColumn("Items", F.lit("clash"))
    texts = [r["text"] for r in rows.select("text").collect()]
    want = brute(texts, [(str(i) if i else None, t) for i, t in items])
    monkeypatch.setattr(D, "PIECE_WORDS", 11)
    for size in (1 << 20, 4):
        found = D.find(rows, bench, pass_words=size).collect()
        got = Counter((r["text"], r["n_words"], frozenset(i for a, b in r["hits"] for i in range(a, b)), tuple(r["items"])) for r in found)
        assert got == Counter((t, n, frozenset(h), tuple(x)) for t, (n, h, x) in zip(texts, want, strict=True))
        assert all(a["stop"] < b["start"] for r in found for a, b in zip(r["hits"], r["hits"][1:]))
    clean = D.decontaminate(rows, bench)
    assert clean.columns == ["doc_id", "text", "score"] and clean.count() == sum(not h for _, h, _ in want)
    assert D.find(rows, bench.where("false")).where("size(hits) > 0").count() == 0
    assert D.find(empty, bench).count() == 0
    assert D.longest_matches(rows, bench.where("false")).count() == 0


def test_longest_matches_over_shards(spark):
    passage = [f"p{i}" for i in range(30)]
    docs = [(i, " ".join(["x"] * i + passage[i % 3 : 20 + i % 7])) for i in range(14)]
    bench = spark.createDataFrame([("a", " ".join(passage))], "item_id string, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["item_start"]: r for r in D.longest_matches(rows, bench, least=10).collect()}
    for start in range(17):
        best = max(20 + i % 7 - start for i in range(14) if i % 3 <= start)
        if best < 10:
            assert start not in got
            continue
        r = got[start]
        assert r["length"] == best and r["item"] == "a"
        text = dict(docs)[r["doc"]].split()
        assert text[r["doc_start"] : r["doc_start"] + best] == passage[start : start + best]


def test_query_on_planted_passages(spark, tmp_path):
    items = [(i, " ".join(f"k{i}x{j}" for j in range(8 + i))) for i in range(12)]
    docs = [(i, f"Intro, {items[i % 12][1].upper()}! the end {i}") for i in range(24)] + [(100, "clean"), (101, None), (102, items[11][1] + " and " + items[3][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in op12_decontamination(spark, str(tmp_path)).collect()}
    for (i, _), (n, hit, names) in zip(docs, brute([t for _, t in docs], [(str(k), t) for k, t in items])):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, len(hit), len(names), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()


def test_columns_may_have_odd_names(spark):
    df = spark.createDataFrame([("a b c",)], "`my.text` string")
    bench = spark.createDataFrame([("1", "b c")], "`item.id` string, `the text` string")
    assert D.find(df, bench, "my.text", "item.id", "the text").first()["items"] == ["1"]
    with pytest.raises(Exception):
        D.find(df, bench, "absent", "item.id", "the text").count()
