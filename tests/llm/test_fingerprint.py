from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tapewright.llm import fingerprint as P


def want(rows, pairs=False):
    """(id, text) in descending id order -> edited texts."""
    out = []
    for i, (k, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        out.append((k, t[: len(t) - half] + nxt[:half]))
    return out if pairs else dict(out)


def test_edits_by_ranges_are_those_of_one_order(spark):
    data = [(i * 3 - 50, f"größe {i} " + " ".join(f"w{(i * j) % 89}é" for j in range(i % 40))) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    for size in (20, 10_000):
        rows = {r["doc_id"]: r for r in P.edits(df, per_range=size).collect()}
        expected = want(sorted(data, reverse=True))
        assert {k: r["edited_text"] for k, r in rows.items()} == expected
        for k, r in rows.items():
            assert r["edited_sha256"] == hashlib.sha256(expected[k].encode()).hexdigest()
            assert r["n_chars"] == len(dict(data)[k]) and 0 <= r["near_edited"] <= 1


def shingle_set(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_likeness_estimates_jaccard_and_containment(spark):
    a = " ".join(f"a{i}" for i in range(6000))
    b = " ".join(f"a{i}" for i in range(3000, 3600))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    s = P.add_sketch(P.add_sketch(df, "a", "x", 0.25), "b", "y", 0.25)
    r = s.select(P.likeness(F.col("x"), F.col("y")).alias("j"), P.containment(F.col("y"), F.col("x")).alias("c"), (P.merge(F.col("x"), F.col("y"), 0.25) == F.col("x")).alias("m"), (P.likeness(F.col("x"), F.col("x")) == 1).alias("one")).first()
    x, y = shingle_set(a), shingle_set(b)
    assert abs(r["j"] - len(x & y) / len(x | y)) < 0.03 and r["c"] == 1.0 and r["m"] and r["one"]


def test_odd_rows(spark, odd, empty):
    out = P.edits(odd).collect()
    assert len(out) == odd.count()
    by = {r["doc_id"]: r for r in out}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == by[4]["fingerprint"] == "" and by[2]["n_chars"] == 0
    assert by[8]["fingerprint"] and by[8]["n_chars"] == 1
    assert P.edits(empty).count() == 0
    one = P.edits(odd.where("doc_id = 7")).first()
    assert one["near_next"] == 1.0


def test_hot_ids_and_rows_keep_one_order(spark):
    """A third of the rows under one id, a third alike, nulls last: the order is that of (id falling, hash, text)."""
    data = [(5, f"text {i} of a hot id with some words") for i in range(90)] + [(9, "the same row again and again")] * 90 + [(i if i % 3 else None, f"row {i} has words of its own") for i in range(100, 190)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    expected = want(sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]])), pairs=True)
    got = sorted(((r["doc_id"], r["edited_text"]) for r in P.edits(df, per_range=10).collect()), key=str)
    assert got == sorted(expected, key=str)


def test_likeness_is_near_the_exact_one_on_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = P.edits(docs).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    exact = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    edited, near = [], []
    after = dict(zip(order, [*order[1:], order[0]]))
    for doc, e, x, y in zip(rows["doc_id"], rows["edited_text"], rows["near_edited"], rows["near_next"]):
        edited.append(abs(x - exact(shingle_set(texts[doc]), shingle_set(e))))
        near.append(abs(y - exact(shingle_set(texts[doc]), shingle_set(texts[after[doc]]))))
    assert sum(edited) / len(edited) < 0.045 and sum(near) / len(near) < 0.02
