"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors lie in document-range blocks, each with a forward index (its vectors) and, for every term (component), its
greatest and least weight. A query's bound on a block is the sum over its terms of weight times the block's maximum (or
minimum, for negative weights). A query visits blocks by falling bound and stops when the bounds are below its k-th
score. Vectors are put in order by their strongest terms before they are cut into ranges, which makes bounds tight.

Blocks lie in block groups. Each query is first scored in the group where it lives; the k-th score found there is its
floor. Then queries meet the block summaries alone (two vectors for BLOCK of them), and a query goes on only to those
groups that hold a block whose bound reaches its floor. No block or query is left out unless its bound proves that it
cannot matter. Scores are 64-bit integers; double precision is used where it holds every sum exactly, and for bounds.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part; vectors of unequal
lengths are compared as if filled up with zeros; a query that repeats an id is answered once for each row; ties go to the
smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, stash

BLOCK = 128
#: Stands for no score; no floor is below it.
NONE = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null, no non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, in double precision."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1)), pa.int32()), pa.array(x.ravel()))


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """[queries, blocks]: no vector of a block scores more with a query; rounded up."""
    q, high, low = q.astype(float), high.astype(float), low.astype(float)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = (up @ np.abs(high).T - down @ np.abs(low).T) * 1e-12
    return up @ high.T + down @ low.T + slack


def search_blocks(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, floor: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids [queries, k] (NONE where fewer) of the rows of x that may beat each query's floor; blocks scored.

    same: rows whose id is the query's own do not count.
    """
    n_q, n_x = len(q), len(x)
    edges = np.arange(0, n_x, BLOCK)
    bound = bounds(q, np.maximum.reduceat(x, edges, axis=0), np.minimum.reduceat(x, edges, axis=0))
    order = np.argsort(-bound, axis=1, kind="stable")
    score, ids = np.full((n_q, k), NONE), np.full((n_q, k), np.iinfo(np.int64).max)
    kth, scored = floor.copy(), 0
    live = np.arange(n_q)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**53:
        q, x = q.astype(float), x.astype(float)
    for step in range(len(edges)):
        block = order[live, step]
        keep = bound[live, block] >= kth[live]  # a bound that equals the k-th may still tie with a smaller id
        live, block = live[keep], block[keep]
        if not len(live):
            break
        by = np.argsort(block, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
            b, rows = block[part[0]], live[part]
            at = slice(edges[b], min(edges[b] + BLOCK, n_x))
            s = (q[rows] @ x[at].T).astype(np.int64)
            i = np.broadcast_to(x_id[at], s.shape)
            if same:
                own = i == q_id[rows][:, None]
                s, i = np.where(own, NONE, s), np.where(own, np.iinfo(np.int64).max, i)
            all_s, all_i = np.hstack([score[rows], s]), np.hstack([ids[rows], i])
            best = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
            score[rows], ids[rows] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
            kth[rows] = np.maximum(kth[rows], score[rows, k - 1])
            scored += len(rows)
    return score, ids, scored


def place(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int, group_rows: int) -> DataFrame:
    """(id, v, q, o, g): integer vectors dealt to block groups by their strongest terms; not yet stored."""
    rows = vectors.where(usable(col(vector_col)) & col(id_col).isNotNull()).select(col(id_col).cast("long").alias("id"), integers(col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    strength = F.transform("v", lambda x, i: F.struct((-F.abs(x)).alias("a"), (i * 2 + (x < 0).cast("int")).alias("t")))
    top = F.slice(F.array_sort(strength), 1, 3)
    rows = rows.withColumn("o", F.array_join(F.transform(top, lambda s: F.lpad(s["t"].cast("string"), 6, "0")), ""))
    groups = max(1, -(-rows.count() // group_rows))
    if groups == 1:
        return rows.withColumn("g", F.lit(0))
    return rows.repartitionByRange(groups, "o", F.xxhash64("id")).withColumn("g", F.spark_partition_id())


def summaries(group: DataFrame, width: int) -> DataFrame:
    """(g, block, high, low) of every block of the groups; a group's vectors are cut to blocks in the order o, id."""

    def run(rows: pa.Table) -> pa.Table:
        x = _matrix(rows.column("v"), width)[_order(rows)]
        edges = np.arange(0, len(x), BLOCK)
        g = rows.column("g").combine_chunks()[0].as_py()
        return pa.table({"g": pa.array([g] * len(edges), pa.int32()), "block": pa.array(np.arange(len(edges)), pa.int32()), "high": _lists(np.maximum.reduceat(x, edges, axis=0)), "low": _lists(np.minimum.reduceat(x, edges, axis=0))})

    return group.select("g", "id", "v", "o").groupBy("g").applyInArrow(run, "g int, block int, high array<long>, low array<long>")


def _order(rows: pa.Table) -> np.ndarray:
    return np.lexsort((rows.column("id").to_numpy(), np.array(rows.column("o").to_pylist(), dtype=object).astype(str)))


def meetings(queries: DataFrame, blocks: DataFrame, width: int, chunk_rows: int, wide: int = 64) -> DataFrame:
    """(tag, g): the pairs of a query (tag, qv, floor, home) and a group other than its home with a block whose bound
    reaches the query's floor. Chunks of queries meet the block summaries of `wide` groups at a time, no vectors."""
    chunks = max(1, -(-queries.count() // chunk_rows))
    spans = (blocks.agg(F.max("g")).first()[0] or 0) // wide
    left = queries.withColumns({"c": F.pmod(F.xxhash64("tag"), F.lit(chunks)).cast("int"), "s": F.explode(F.sequence(F.lit(0), F.lit(spans)))})
    right = blocks.withColumns({"s": F.floor(F.col("g") / wide).cast("int"), "c": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))})

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return pa.table({"tag": pa.array([], pa.int64()), "g": pa.array([], pa.int32())})
        reach = bounds(_matrix(q.column("qv"), width), _matrix(b.column("high"), width), _matrix(b.column("low"), width)) >= q.column("floor").to_numpy()[:, None]
        groups, of = np.unique(b.column("g").to_numpy(), return_inverse=True)
        met = np.zeros((q.num_rows, len(groups)), bool)
        np.logical_or.at(met.T, of, reach.T)
        met &= groups[None, :] != q.column("home").to_numpy()[:, None]
        row, at = np.nonzero(met)
        return pa.table({"tag": q.column("tag").combine_chunks().take(pa.array(row)), "g": pa.array(groups[at], pa.int32())})

    return left.groupBy("s", "c").cogroup(right.groupBy("s", "c")).applyInArrow(run, "tag long, g int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, group_rows: int = 8192, chunk_rows: int = 4096) -> DataFrame:
    """(query_id, rank, id, score): the k rows of greatest integer inner product for every query row, never its own id."""
    placed = stash(place(vectors, is_query, id_col, vector_col, scale, group_rows))
    width = placed.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: queries with floors, right: a block group."""
        none = pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "tag": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        q_id, floor, order = left.column("qid").to_numpy(), left.column("floor").to_numpy(), _order(right)
        score, ids, _ = search_blocks(_matrix(left.column("qv"), width), q_id, _matrix(right.column("v"), width)[order], right.column("id").to_numpy()[order], k, floor, True)
        row, at = np.nonzero(score != NONE)
        return pa.table({"qid": pa.array(q_id[row]), "id": pa.array(ids[row, at]), "score": pa.array(score[row, at]), "tag": left.column("tag").combine_chunks().take(pa.array(row))})

    schema = "qid long, id long, score long, tag long"
    group = placed.select("g", "id", "v", "o")
    # tag tells rows apart that repeat a query's id
    tagged = stash(placed.where("q").select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("g").alias("home"), F.monotonically_increasing_id().alias("tag")))
    first = tagged.select("qid", "qv", "tag", F.lit(NONE).alias("floor"), F.col("home").alias("g"))
    near = stash(first.groupBy("g").cogroup(group.groupBy("g")).applyInArrow(search, schema))
    found = near
    blocks = stash(summaries(placed, width))
    if blocks.select("g").distinct().limit(2).count() > 1:
        kth = near.groupBy("tag").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("tag", F.get("s", F.lit(k - 1)).alias("floor"))
        known = stash(tagged.join(kth, "tag", "left").fillna({"floor": NONE}))
        met = stash(meetings(known, blocks, width, chunk_rows))
        # a group goes once to every `chunk_rows` of the queries that come to it, and nowhere if none does
        chunks = met.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("n"))
        come = met.join(chunks, "g").join(known.drop("home"), "tag").withColumn("c", F.pmod(F.xxhash64("tag"), F.col("n")).cast("int")).drop("n")
        there = group.join(chunks, "g").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        far = come.groupBy("g", "c").cogroup(there.groupBy("g", "c")).applyInArrow(search, schema)
        found = near.union(far)
    # per query: the k best of k from each group
    rank = F.row_number().over(W.partitionBy("tag").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(F.col("qid").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
