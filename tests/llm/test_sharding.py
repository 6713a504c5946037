from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from tapewright.llm import sharding


def jump(key, buckets):
    """The published algorithm."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_are_the_published_ones(spark):
    keys = [0, 1, 2, 3, 255, 2**40, 2**62, -1, -(2**63), 2**63 - 1, *range(1000, 1300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 25, 100):
        got = {r["k"]: tuple(r["s"]) for r in df.select("k", sharding.jump_walk(F.col("k"), n).alias("s")).collect()}
        assert got == {k: (jump(k, n), jump(k, n + 1)) for k in keys}
        assert df.where(sharding.jump_hash(F.col("k"), n) != sharding.jump_walk(F.col("k"), n)["shard"]).count() == 0


def test_long_walks_go_on(spark, monkeypatch):
    """A key that visits more shards than the usual walk allows for."""
    monkeypatch.setattr(sharding, "USUAL", 1)
    df = spark.range(2000)
    got = {r["id"]: tuple(r["s"]) for r in df.select("id", sharding.jump_walk(F.col("id"), 200).alias("s")).collect()}
    assert got == {k: (jump(k, 200), jump(k, 201)) for k in range(2000)}


def test_a_hot_row_and_a_hot_key(spark):
    """A third of all rows alike, a third of one (null) key."""
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).when(F.col("id") < 2000, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 1000, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = sharding.assign(rows, 5, chunk_rows=50).toPandas()
    assert len(out) == 3000 and (out["doc_id"] == 7).sum() == 1000 and out["doc_id"].isna().sum() == 1000
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_columns_that_sql_can_say(spark):
    import duckdb

    from tapewright.llm.queries import QUERIES

    out = QUERIES["op6_jump_sharding"](spark, "/root/testdata/sf0.001").select("doc_id", "size", "law").collect()
    want = duckdb.sql("SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 8 AS BIGINT), 'key' FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert sorted(tuple(r) for r in out) == sorted(want)


def test_rows_slots_and_growth(spark, odd, empty, tmp_path):
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"), F.lit("x").alias("shard"))
    out = sharding.assign(many, 24, chunk_rows=13).toPandas()
    assert len(out) == 5000
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    moved = out[out["shard"] != out["grown_shard"]]
    assert (moved["grown_shard"] == 24).all() and 5000 / 25 * 0.7 < len(moved) < 5000 / 25 * 1.3
    rows = sharding.assign(odd, 24).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
        assert r["shard"] == (0 if r["doc_id"] is None else jump(r["doc_id"], 24))
    assert sharding.assign(empty, 24).count() == 0
    sharding.write_shards(many, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 5000 and back.select("shard").distinct().count() == 5
