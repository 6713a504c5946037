"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a shuffle of the edges; nothing is collected but a count. Each step's edges go to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stash


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the least of u and its neighbours; the aggregate is joined back, so a hub's rows stay spread."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u long, v long) edges -> (id, component): every id in an edge with the least id of its component.

    Null ends and loops are left out; an empty table gives an empty table.
    """
    e = stash(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _least(down)
        e, old = stash(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()), e
        drop(old)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)), F.sum(F.xxhash64("v", "u") % F.lit(1 << 40))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
