"""Stores and streams: what comes twice, in parts, late, or is lost half way."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewright.operators import indicators as I
from tapewright.operators import trades
from tapewright.sources import writers
from tapewright.streaming import ingest as X
from tapewright.streaming import live as L

EVENTS = "event_id long, ts timestamp, user_id long, value double"
BARS = "symbol string, date date, close double"


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def test_upsert_takes_the_named_row_and_leaves_no_folder_behind(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("A", dt.date(2024, 1, 2), v) for v in (3.0, 1.0, 2.0)] + [(None, None, 5.0), (None, None, 4.0)], BARS)
    for part in (rows, rows.withColumn("close", F.lit(0.5)), rows):
        writers.upsert(part, path)
    assert sorted((r["symbol"] or "", r["close"]) for r in writers.read_store(spark, path).collect()) == [("", 4.0), ("A", 1.0)]
    assert [p.name for p in tmp_path.iterdir()] == ["store"]
    assert writers.read_store(spark, path).columns == ["symbol", "date", "close", "yyyymm"]
    late = writers.upsert(rows.withColumn("symbol", F.lit("B")).withColumn("rank", -F.col("close")), str(tmp_path / "b"), ("rank",))
    assert {r["close"] for r in late.collect()} == {3.0, 5.0}


def test_fetch_asks_once_and_adds_once(spark, tmp_path):
    days = [dt.date(2024, 1, d) for d in range(1, 11)]
    table = spark.createDataFrame([(s, d, float(d.day)) for s in "AB" for d in days], BARS)
    wanted = spark.createDataFrame([("A",), ("B",), ("NONE",), ("A",)], "symbol string")
    store, marks, calls = str(tmp_path / "s"), str(tmp_path / "m"), []

    def source(asked):
        calls.append(sorted(map(tuple, asked.collect())))
        return table.join(asked.withColumnRenamed("symbol", "s"), (F.col("symbol") == F.col("s")) & F.col("date").between(F.col("from"), F.col("to"))).select(*table.columns)

    def go(end, now):
        writers.fetch(wanted, source, store, marks, days[0], end, ttl_hours=24, now=F.lit(now).cast("timestamp"))

    go(days[4], "2024-02-01 00:00:00")
    go(days[9], "2024-02-01 10:00:00")  # too early: only the symbol without bars is asked for
    go(days[9], "2024-02-02 00:00:00")
    go(days[9], "2024-02-09 00:00:00")  # nothing is left
    assert [[c[0] for c in asked] for asked in calls] == [["A", "B", "NONE"], ["NONE"], ["A", "B", "NONE"], ["NONE"]]
    assert calls[2][0][1:] == (days[5], days[9])
    assert writers.read_store(spark, store).count() == 20
    got = {r["symbol"]: r for r in writers.read_marks(spark, marks).collect()}
    assert set(got) == {"A", "B"} and got["A"]["last_date"] == days[9] and str(got["A"]["last_fetch_ts"]) == "2024-02-02 00:00:00"
    # a fetch that was lost before its marks were whole is done again
    (tmp_path / "m" / "version=00000009").mkdir()
    assert writers.read_marks(spark, marks).count() == 2


def test_bucketed_store_needs_no_exchange(spark, tmp_path):
    n = 400
    panel = spark.range(n).select(F.concat(F.lit("S"), F.col("id") % 7).alias("symbol"), F.expr("date_add(date'2024-01-01', int(id / 7))").alias("date"), (F.col("id") % 11 + 1.0).alias("close"), F.lit(1).alias("volume"))
    panel = panel.withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1})
    store = writers.bucketed_store(panel, "bars_in_buckets", str(tmp_path / "b"), 4)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (I.add_named(store, ["rsi_7", "sma_5"]), trades.with_exits(store), store.join(store.groupBy("symbol").count(), "symbol")):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert dict(store.dtypes)["volume"] == "double" and store.count() == n
    assert len(list((tmp_path / "b").glob("*.parquet"))) <= 4
    spark.sql("drop table bars_in_buckets")


def test_a_large_day_is_shared_out(spark, tmp_path):
    rows = spark.range(4000).select(F.lit("R").alias("filter_code"), F.concat(F.lit("S"), F.col("id")).alias("symbol"), F.lit(dt.date(2024, 1, 2)).alias("date"))
    writers.daily_signals(rows, str(tmp_path / "d"))
    files = list((tmp_path / "d" / "signals" / "date=2024-01-02").glob("*.csv"))
    assert len(files) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.read.option("header", True).csv(str(tmp_path / "d" / "signals")).count() == 4000


# ------------------------------------------------------------------ events


def take(spark, folder, rows, checkpoint="c"):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    schema = spark.createDataFrame([], EVENTS).schema
    X.ingest_events(spark, f"{folder}/in", schema, f"{folder}/store", f"{folder}/{checkpoint}").awaitTermination()
    return bars(spark, folder)


def bars(spark, folder):
    return {(r["symbol"], str(r["date"])): (r["close"], r["volume"]) for r in X.read_bars(spark, f"{folder}/store").collect()}


def test_events_without_ids_and_replays(spark, tmp_path):
    folder = str(tmp_path)
    first = [(None, at(1, 9), 1, 5.0), (None, at(1, 10), 1, 7.0), (3, at(1, 8), 1, 1.0), (3, at(1, 8), 1, 1.0), (None, at(1, 10), 1, 7.0)]
    assert take(spark, folder, first) == {("U1", "2024-01-01"): (7.0, 13.0)}
    assert take(spark, folder, [(4, at(1, 23), 1, 2.0), (None, at(1, 9), 1, 5.0), (5, at(2, 1), 2, 9.0)]) == {("U1", "2024-01-01"): (2.0, 15.0), ("U2", "2024-01-02"): (9.0, 9.0)}
    want = bars(spark, folder)
    assert take(spark, folder, [], "again") == want  # all files once more, under another checkpoint
    X.compact_bars(spark, f"{folder}/store")
    assert bars(spark, folder) == want and len(X._parts(spark, f"{folder}/store/bars")) == 1
    X.compact_bars(spark, f"{folder}/store")
    assert take(spark, folder, [(6, at(2, 2), 2, 1.0)])[("U2", "2024-01-02")] == (1.0, 10.0)


def test_a_compaction_that_is_lost_half_way_counts_nothing_twice(spark, tmp_path):
    folder = str(tmp_path)
    for k in range(3):
        take(spark, folder, [(k, at(1, k), 1, 1.0)])
    want = bars(spark, folder)
    parts = {p: [(f.name, f.read_bytes()) for f in (tmp_path / "store" / "bars" / p).iterdir()] for p in X._parts(spark, f"{folder}/store/bars")}
    X.compact_bars(spark, f"{folder}/store")
    for p, files in parts.items():  # as if the parts had not been removed
        (tmp_path / "store" / "bars" / p).mkdir()
        for name, data in files:
            (tmp_path / "store" / "bars" / p / name).write_bytes(data)
    assert bars(spark, folder) == want == {("U1", "2024-01-01"): (1.0, 3.0)}


def test_a_batch_that_is_run_again_writes_the_same(spark, tmp_path):
    """The checkpoint is lost after the events of the batch were written and before its bars were."""
    folder = str(tmp_path)
    take(spark, folder, [(1, at(1, 1), 1, 1.0), (2, at(1, 2), 1, 2.0)])
    import shutil

    shutil.rmtree(tmp_path / "store" / "bars")
    shutil.rmtree(tmp_path / "c")
    assert take(spark, folder, []) == {("U1", "2024-01-01"): (2.0, 3.0)}


def test_bars_come_when_their_day_is_over_and_late_events_apart(spark, tmp_path):
    rows = lambda x: spark.createDataFrame(x, "symbol string, ts timestamp, event_id long, value double")
    held = spark.conf.get(L.PROVIDER[0], None)
    spark.conf.set(*L.PROVIDER)
    try:
        parts = [
            [("A", at(1, 9), 1, 5.0), ("A", at(1, 9), 1, 5.0), ("A", at(1, 8), 2, 1.0), ("A", at(1, 9), None, 2.0), ("B", at(1, 1), 3, 4.0)],
            [("A", at(4, 9), 4, 1.0)],
            [("A", at(1, 23), 5, 100.0), ("A", at(3, 12), 6, 8.0), ("B", at(1, 5), None, 9.0)],
            [("B", at(9, 1), 7, 1.0)],
        ]
        for part in parts:
            rows(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            L.write_live(L.live_bars(spark.readStream.schema(rows([]).schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    finally:
        spark.conf.unset(L.PROVIDER[0]) if held is None else spark.conf.set(L.PROVIDER[0], held)
    bars_ = {(r["symbol"], str(r["date"])): (r["value"], r["volume"], r["events"]) for r in L.read_live(spark, str(tmp_path / "out"), "bar").collect()}
    assert bars_ == {("A", "2024-01-01"): (5.0, 8.0, 3), ("B", "2024-01-01"): (4.0, 4.0, 1), ("A", "2024-01-03"): (8.0, 8.0, 1), ("A", "2024-01-04"): (1.0, 1.0, 1)}
    late = L.read_live(spark, str(tmp_path / "out"), "late").collect()
    assert sorted((r["symbol"], r["value"]) for r in late) == [("A", 100.0), ("B", 9.0)]


def test_unknown_policies_and_empty_events(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.symbol_store(spark.createDataFrame([], BARS), str(tmp_path / "x"), "maybe")
    assert X.read_bars(spark, str(tmp_path / "none")).count() == 0
    X.compact_bars(spark, str(tmp_path / "none"))
