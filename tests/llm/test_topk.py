from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tapewright.llm import topk


def brute(rows, k):
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in good.items():
        if q % 50 == 0:
            s = sorted(((sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q), key=lambda t: (-t[0], t[1]))
            out |= {(q, r + 1, i, x) for r, (x, i) in enumerate(s[:k])}
    return out


def test_pruned_search_is_exact_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 12))
    rows = [(i, [float(np.float32(x)) for x in (centre[i % 6] + 0.2 * rng.normal(size=12)) / 4]) for i in range(700)]
    rows += [(700 + i, rows[50][1]) for i in range(12)]
    rows += [(800, None), (801, [0.1, None] + [0.0] * 10), (802, [float("nan")] * 12), (803, [float("inf")] * 12), (850, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    for size in (8192, 150):
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, group_rows=size, chunk_rows=4)
        assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, 5)


def test_pruning_leaves_blocks_out():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 16)) * 100
    x = np.floor(np.repeat(centre, 200, axis=0) + rng.normal(size=(4000, 16)))
    ids = np.arange(4000)
    q = x[::400]
    _, _, scored = topk.search_blocks(q, ids[::400], x, ids, 5, np.full(len(q), topk.NONE), True)
    assert scored < len(q) * (4000 / topk.BLOCK) * 0.5


def test_only_queries_that_a_bound_lets_through_are_shipped(spark):
    """Separate clusters: a query meets few of the other groups; none of the pairs left out could matter (see above)."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in 4.0 * np.eye(16)[i % 16] + 0.05 * rng.normal(size=16)]) for i in range(3200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    placed = topk.place(df, F.col("vec_id") % 50 == 0, "vec_id", "embedding", 256, 200).cache()
    blocks = topk.summaries(placed, 16)
    near = {i: sorted((sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(v, w)) for j, w in rows if j != i), reverse=True)[4] for i, v in rows if i % 50 == 0}
    floors = spark.createDataFrame(list(near.items()), "tag long, floor long")
    queries = placed.where("q").select(F.col("id").alias("tag"), F.col("v").alias("qv"), F.col("g").alias("home")).join(floors, "tag")
    groups = placed.select("g").distinct().count()
    met = topk.meetings(queries, blocks, 16, 16, wide=3)
    assert groups > 8 and met.count() < queries.count() * groups / 3
    assert met.distinct().count() == met.count()


def test_products_beyond_double_precision(spark):
    big = [(0, [float(2**22), 1.0, 0.0]), (1, [float(2**22), 1.0 / 256, 0.0]), (2, [float(2**22), 2.0 / 256, 1.0])]
    got = topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5)
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(2, 2**60 + 512), (1, 2**60 + 256)]


def test_repeated_query_ids_are_answered_row_by_row(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 1).select("query_id", "rank", "vec_id", "score").collect())
    assert got == [(0, 1, 1, 65536), (0, 1, 2, 131072)]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (50, [2.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
    assert len(got) == 4
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0, 5).count() == 0
