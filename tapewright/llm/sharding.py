"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard follows from the key and the number of shards alone: no ring table, and one more shard takes rows only
into itself. Column expressions only. The 64-bit generator runs in decimals, which hold its products exactly.

Defined results: a null key goes to shard 0 for any number of shards; a null text has 8 bytes of size; repeated rows get
slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, without

#: Multiplier of the generator in the paper.
MULTIPLIER = 2862933555777941757
#: The usual walk may visit this many times 3 + log2(shards) shards.
USUAL = 3
_BIG, _STATE = "decimal(38,0)", "decimal(20,0)"


def jump_walk(key: Column, shards: int) -> Column:
    """struct(shard, grown_shard) of a non-null long key among `shards` and among one more, in one walk.

    A walk visits about ln(shards) shards, in rising order; the few keys with longer walks than that allows for go on.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    modulus = F.lit(str(1 << 64)).cast(_STATE)
    zero = F.lit(0).cast("long")
    start = F.struct(F.pmod(key.cast(_BIG), modulus).cast(_STATE).alias("k"), zero.alias("b"), zero.alias("g"), zero.alias("j"))

    def step(acc: Column, _: Column) -> Column:
        k = ((acc["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)")).cast(_BIG) + F.lit(1).cast("decimal(1,0)")) % modulus
        k = k.cast(_STATE)
        high = F.floor(k / F.lit(1 << 33).cast("decimal(10,0)")).cast("double")
        j = F.floor((acc["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1.0))).cast("long")
        b = F.when(acc["j"] < shards, acc["j"]).otherwise(acc["b"])
        return F.when(acc["j"] <= shards, F.struct(k.alias("k"), b.alias("b"), acc["j"].alias("g"), j.alias("j"))).otherwise(acc)

    walk = lambda state, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, step)
    usual = USUAL * (3 + shards.bit_length())
    ended = lambda s: F.struct(s["b"].cast("int").alias("shard"), s["g"].cast("int").alias("grown_shard"))
    if usual >= shards + 1:
        return F.transform(F.array(walk(start, shards + 1)), ended)[0]
    return F.transform(F.array(walk(start, usual)), lambda s: F.when(s["j"] > shards, ended(s)).otherwise(ended(walk(s, shards + 1 - usual))))[0]


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a long key; a null key has shard 0."""
    return F.when(key.isNull(), F.lit(0)).otherwise(jump_walk(key, shards)["shard"])


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = 50_000) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) for every row.

    size: UTF-8 bytes of the text plus 8. slot numbers a shard's rows without gaps from 0. Rows alike in all columns are
    counted before they move and spread out again at the end; a shard is numbered in hash chunks of about `chunk_rows`,
    each a window of its own, on top of the rows of the chunks before. No window holds a shard, or the copies of a row.
    """
    text = col(text_col).cast("binary")
    chunks = max(1, -(-docs.count() // (shards * chunk_rows)))
    named = docs.select(
        col(id_col).alias("__id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
    )
    alike = named.groupBy("__id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("__rows"))
    walk = F.when(F.col("__id").isNull(), F.struct(F.lit(0).alias("shard"), F.lit(0).alias("grown_shard"))).otherwise(jump_walk(F.col("__id").cast("long"), shards))
    rows = alike.withColumn("__to", walk).select("*", "__to.*", F.pmod(F.xxhash64("__id", "text_crc32"), F.lit(chunks)).cast("int").alias("__chunk")).drop("__to")
    order = W.partitionBy("shard", "__chunk").orderBy("__id", "size", "text_crc32")
    placed = rows.withColumn("__before", F.sum("__rows").over(order) - F.col("__rows"))
    if chunks > 1:
        counts = rows.groupBy("shard", "__chunk").agg(F.sum("__rows").alias("n"))
        below = counts.select("shard", "__chunk", (F.sum("n").over(W.partitionBy("shard").orderBy("__chunk")) - F.col("n")).alias("__below"))
        placed = placed.join(below, ["shard", "__chunk"]).withColumn("__before", F.col("__before") + F.col("__below"))
    each = placed.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__rows") - 1)))
    return each.select(F.col("__id").alias(id_col), "size", "text_crc32", "shard", (F.col("__before") + F.col("__at")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id") -> None:
    """Write the rows themselves, a folder for each shard; no shuffle, each task writes to the shards it holds."""
    without(docs, ["shard"]).withColumn("shard", jump_hash(col(id_col).cast("long"), shards)).write.partitionBy("shard").parquet(path)

