"""Queries that write to the shared folder and read back: stores, signals, streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import rules as R
from ..operators import summary
from ..sources import bars as B
from ..sources import readers, writers
from ..streaming import ingest as X
from ..streaming import live as L
from .bars import bench_pct, signals, trade_table
from .base import long, query, r4, scratch, settled
from .indicators import RSI_7


@query("k5_s3_symbol_store_whole", "SELECT symbol, date, open, high, low, close, volume FROM panel", ("panel",))
def symbol_store_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-5: the panel written by symbol, all of it read back."""
    path = scratch(spark)
    writers.symbol_store(B.panel(spark, sf_dir), path, tasks=B.tasks(spark, sf_dir))
    return spark.read.parquet(path).select(F.col("symbol").cast("string").alias("symbol"), "date", "open", "high", "low", "close", "volume")


@query("k5_s3_symbol_store", "SELECT symbol, date, close FROM panel WHERE symbol IN ('S1', 'S3', 'S7') AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'", ("panel",))
def symbol_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-5, S-1, S-3: written by symbol, read for some symbols, dates and columns."""
    path = scratch(spark)
    writers.symbol_store(B.panel(spark, sf_dir), path, tasks=B.tasks(spark, sf_dir))
    return readers.prices(spark, path, ["S1", "S3", "S7"], "1997-01-01", "1999-12-31", ["close"])


@query("k1_s8_daily_signals_whole", "SELECT DISTINCT date, symbol, filter_code FROM signals", ("signals",))
def daily_signals_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-1, S-8: all signals in a folder a day, read back as one table."""
    path = scratch(spark)
    writers.daily_signals(signals(spark, sf_dir), path)
    return spark.read.schema("symbol string, filter_code string, date date").option("header", True).csv(f"{path}/signals").select("date", "symbol", "filter_code")


@query("k1_s8_daily_signals", "SELECT DISTINCT date, symbol, filter_code FROM signals", ("signals",))
def daily_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-1, K-4, S-8: all signals under the policy `timestamp`, in a folder of the run's own."""
    path = scratch(spark)
    where, _ = writers.target(path, "timestamp", dt.datetime(2024, 1, 1, 12, 0, 7))
    writers.daily_signals(signals(spark, sf_dir), where, policy="fail")
    return spark.read.schema("symbol string, filter_code string, date date").option("header", True).csv(f"{path}-20240101-120007/signals").select("date", "symbol", "filter_code")


@query("k1_days_written", "SELECT date, CAST(coalesce(n, 0) AS BIGINT) AS signals FROM cal LEFT JOIN (SELECT date, count(*) AS n FROM (SELECT DISTINCT date, symbol, filter_code FROM signals) GROUP BY date) USING (date)", ("signals", "cal"))
def days_written_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-1: all signals written, counted on every trading day of the panel's span."""
    from ..operators.calendar import trading_days

    days = trading_days(B.panel(spark, sf_dir))
    return writers.daily_signals(signals(spark, sf_dir), scratch(spark), days).select("date", long("signals").alias("signals"))


@query("k2_report_tables", f"SELECT date, count(*) AS n_trades, {r4('avg(return_pct)')} AS mean_ret FROM trades WHERE return_pct IS NOT NULL GROUP BY date", ("trades",))
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-2, K-4: report tables as CSV, read back."""
    path = scratch(spark)
    t = trade_table(spark, sf_dir)
    writers.report_tables({"days": summary.trade_days(t), "rules": summary.rule_metrics(t, bench_pct(spark, sf_dir))}, path, "fail")
    return settled(readers.dated_csv(spark, f"{path}/days", "date date, n_trades long, mean_ret double, hit_ratio double").drop("hit_ratio"), "mean_ret")


@query("k6_upsert_whole", "SELECT symbol, date, close, volume FROM panel", ("panel",))
def upsert_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-6: half of the panel, then all with other values for what is there, then all again: what came first stays, once."""
    path = scratch(spark)
    p = B.panel(spark, sf_dir).select("symbol", "date", "close", "volume")
    writers.upsert(p.where("day(date) <= 15"), path)
    changed = p.withColumn("close", F.when(F.dayofmonth("date") <= 15, F.col("close") + 1).otherwise(F.col("close")))
    writers.upsert(changed, path)
    writers.upsert(p, path)
    return writers.read_store(spark, path).select("symbol", "date", "close", "volume")


@query("k6_upsert", "SELECT symbol, date, low AS close, volume FROM panel", ("panel",))
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-6: every (symbol, date) comes three times at once, and the least close is the one that counts."""
    path = scratch(spark)
    p = B.panel(spark, sf_dir).select("symbol", "date", F.explode(F.array("close", "low", F.col("high") + 1)).alias("close"), "volume")
    return writers.upsert(p, path, ("close",)).drop("yyyymm")


@query("k7_fetch_due", "SELECT symbol, min(date) AS first_date, max(date) AS last_date, CAST(count(*) AS BIGINT) AS bars, 2 AS fetches FROM panel GROUP BY symbol", ("panel",))
def fetch_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-1, K-7: what is due is fetched to the middle of the span, asked for again too early, then fetched to its end; no
    bar comes twice and every symbol is asked for twice."""
    path = scratch(spark)
    B.panel(spark, sf_dir).write.parquet(f"{path}/provider")  # asked three times, made once
    p = spark.read.parquet(f"{path}/provider")
    wanted = p.select("symbol").distinct()

    def provider(asked: DataFrame) -> DataFrame:
        return p.join(asked.withColumnRenamed("symbol", "__s"), (F.col("symbol") == F.col("__s")) & F.col("date").between(F.col("from"), F.col("to"))).select(*p.columns)

    asked = []
    for end, now in (("1995-06-30", "2024-01-01 08:00:00"), ("2010-12-31", "2024-01-01 20:00:00"), ("2010-12-31", "2024-01-02 09:00:00")):
        # read from the marks as they were: what is asked for is known once it has been written
        due = writers.fetch(wanted, provider, f"{path}/store", f"{path}/marks", "1990-01-01", end, "panel", 24, F.lit(now).cast("timestamp"))
        due.write.parquet(f"{path}/asked/{len(asked)}")
        asked.append(f"{path}/asked/{len(asked)}")
    counts = spark.read.parquet(*asked).groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("fetches"))
    store = writers.read_store(spark, f"{path}/store").groupBy("symbol").agg(F.min("date").alias("first_date"), F.count(F.lit(1)).alias("bars"))
    return store.join(writers.read_marks(spark, f"{path}/marks").select("symbol", "last_date"), "symbol").join(counts, "symbol").select("symbol", "first_date", "last_date", "bars", "fetches")


@query("k5_bucketed_rsi", RSI_7, ("bars",))
def bucketed_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-5, S-3 in buckets: indicators on the stored table need no exchange."""
    path = scratch(spark)
    store = writers.bucketed_store(B.panel(spark, sf_dir), f"bars_{path[-32:].replace('-', '_')}", path, B.tasks(spark, sf_dir))
    return settled(I.add_named(store, ["rsi_7"]).select("symbol", "date", "rsi_7"), "rsi_7")


def _key(*columns: str):
    """Compares as the columns do, one after the other: joined to one text, S1 and a date would come after S10."""
    return F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)]).alias("key")


@query("o1_o2_file_order", "SELECT unnest(['bars', 'trades']) AS kind, unnest([(SELECT count(*) FROM panel), (SELECT count(*) FROM trades)]) AS n, 0 AS out_of_order", ("panel", "trades"))
def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1, O-2: within each file, bars by symbol and date, trades of a day by rule and symbol."""
    path = scratch(spark)
    writers.bucketed_store(B.panel(spark, sf_dir), f"bars_{path[-32:].replace('-', '_')}", f"{path}/bars", B.tasks(spark, sf_dir))
    writers.per_day(trade_table(spark, sf_dir).select("filter_code", "symbol", "date", "return_pct"), lambda written: written.groupBy("date").count(), f"{path}/days", rows_by_day=B.rows_by_day(spark, sf_dir), tasks=B.tasks(spark, sf_dir))
    bars = spark.read.parquet(f"{path}/bars").select(F.lit("bars").alias("kind"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), _key("symbol", "date"))
    trades = spark.read.schema("filter_code string, symbol string, return_pct double, date date").option("header", True).csv(f"{path}/days/trades")
    trades = trades.select(F.lit("trades").alias("kind"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), _key("filter_code", "symbol"))
    w = W.partitionBy("file").orderBy("at")
    both = bars.unionByName(trades).withColumn("late", F.lag("key").over(w) > F.col("key"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").cast("int").alias("out_of_order"))


@query("k7_high_water", "SELECT symbol, max(date) AS last_date FROM panel GROUP BY symbol", ("panel",))
def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.high_water(B.panel(spark, sf_dir)).select("symbol", "last_date")


@query("k8_k9_documents", f"SELECT filter_code, CAST(count(*) AS BIGINT) AS n FROM signals GROUP BY filter_code", ("signals",))
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-8: metrics as JSON lines, read back."""
    path = scratch(spark)
    writers.documents({"counts": signals(spark, sf_dir).groupBy("filter_code").agg(F.count(F.lit(1)).alias("n"))}, path)
    return spark.read.schema("filter_code string, n long").json(f"{path}/counts")


@query("k11_retain_whole", "SELECT symbol, date, close FROM panel WHERE date >= DATE '1999-01-01'", ("panel",))
def retain_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-11: a store of the whole panel without what lies before the cutoff."""
    path = scratch(spark)
    writers.upsert(B.panel(spark, sf_dir).select("symbol", "date", "close"), f"{path}/a")
    writers.retain(spark, f"{path}/a", "1999-01-01", f"{path}/b")
    return writers.read_store(spark, f"{path}/b").select("symbol", "date", "close")


@query("k11_retain", "SELECT symbol, date, close FROM panel WHERE date >= DATE '1997-06-15'", ("panel",))
def retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-11: a cutoff inside a month, on a store of two upserts, which is compacted first."""
    path = scratch(spark)
    p = B.panel(spark, sf_dir).select("symbol", "date", "close")
    for k in range(2):
        writers.upsert(p.where(F.dayofmonth("date") % 2 == k), f"{path}/a")
    writers.compact(spark, f"{path}/a", f"{path}/c")
    writers.retain(spark, f"{path}/c", "1997-06-15", f"{path}/b")
    return writers.read_store(spark, f"{path}/b").select("symbol", "date", "close")


_EVENT_BARS = "SELECT 'U' || user_id AS symbol, CAST(ts AS DATE) AS date, last(value ORDER BY ts, event_id) AS close, {v} AS volume FROM events GROUP BY ALL"


def _event_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The events as a folder that a stream can follow."""
    path = scratch(spark)
    B.read(spark, sf_dir, "events").write.parquet(f"{path}/in")
    return path, f"{path}/in"


@query("x1_x2_ingest", _EVENT_BARS.format(v=r4("sum(value)")))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-1, X-2: a stream of events into the store; a second run finds nothing new, the same files again add nothing."""
    path, source = _event_files(spark, sf_dir)
    schema = B.read(spark, sf_dir, "events").schema
    for checkpoint in ("c", "c", "again"):
        X.ingest(spark, source, schema, f"{path}/store", f"{path}/{checkpoint}", X.event_bars).awaitTermination()
    return settled(writers.read_store(spark, f"{path}/store").select("symbol", "date", "close", "volume"), "volume")


@query(
    "x1_null_ids_and_replays",
    f"SELECT 'U' || user_id AS symbol, CAST(ts AS DATE) AS date, last(value ORDER BY ts, CASE WHEN event_id % 7 <> 0 THEN event_id END NULLS FIRST) AS close, {r4('sum(value)')} AS volume FROM events GROUP BY ALL",
)
def stream_null_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-1: every seventh event has no id; days come bit by bit, all files come again under another checkpoint, and the
    bars of all batches merge on read, compacted or not."""
    path = scratch(spark)
    e = B.read(spark, sf_dir, "events").withColumn("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_id")))
    for k in range(3):
        e.where(F.pmod(F.xxhash64("ts"), F.lit(3)) == k).write.mode("append").parquet(f"{path}/in")
        X.ingest_events(spark, f"{path}/in", e.schema, f"{path}/store", f"{path}/c").awaitTermination()
        if k == 1:
            X.compact_bars(spark, f"{path}/store")
    X.ingest_events(spark, f"{path}/in", e.schema, f"{path}/store", f"{path}/again").awaitTermination()
    return settled(X.read_bars(spark, f"{path}/store"), "volume")


_CLOSED = "CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"


@query(
    "x2_timed_bars",
    f"""WITH b AS (SELECT 'U' || user_id AS symbol, CAST(ts AS DATE) AS date, last(value ORDER BY ts, event_id) AS close, {r4('sum(value)')} AS volume, count(*) AS events FROM events WHERE {_CLOSED} GROUP BY ALL),
        l AS (SELECT 'U' || user_id AS symbol, CAST(ts AS DATE) AS date, count(*) AS late FROM events WHERE {_CLOSED} AND event_id % 5 = 0 GROUP BY ALL)
        SELECT b.*, coalesce(late, 0) AS late FROM b LEFT JOIN l USING (symbol, date)""",
)
def timed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-2: bars given out when the watermark passes their day, once; a fifth of the events comes again when its day is
    over, with other ids, and is found in the table of late events. What comes twice in time counts once."""
    path = scratch(spark)
    e = B.read(spark, sf_dir, "events").select(X.symbol_of().alias("symbol"), "ts", "event_id", "value")
    middle = e.agg(F.min("ts"), F.max("ts")).select(F.expr("`min(ts)` + (`max(ts)` - `min(ts)`) / 2")).first()[0]
    early, later = e.where(F.col("ts") < F.lit(middle)), e.where(F.col("ts") >= F.lit(middle))
    for part in (early.unionAll(early.where("event_id % 3 = 0")), later, e.where("event_id % 5 = 0").withColumn("event_id", -F.col("event_id") - 1)):
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{path}/in")
        L.write_live(L.live_bars(stream), f"{path}/out", f"{path}/c").awaitTermination()
    late = L.read_live(spark, f"{path}/out", "late").groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("late"))
    bars = L.read_live(spark, f"{path}/out", "bar").select("symbol", "date", F.col("value").alias("close"), "volume", "events")
    return settled(bars.join(late, ["symbol", "date"], "left").fillna({"late": 0}), "volume")


@query("x2_unique_in_watermark", "SELECT DISTINCT event_id, CAST(ts AS DATE) AS date FROM events")
def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-2 by state: every event twice in the stream, once in the sink."""
    path, source = _event_files(spark, sf_dir)
    B.read(spark, sf_dir, "events").write.mode("append").parquet(source)
    stream = spark.readStream.schema(B.read(spark, sf_dir, "events").schema).parquet(source)
    once = X.unique_bars(stream, "ts", "60 days", ("event_id",)).select("event_id", F.col("ts").cast("date").alias("date"))
    once.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("x3_incremental_scan", "WITH b AS (" + _EVENT_BARS.format(v="sum(value)") + ") SELECT symbol, date, 'RISE' AS filter_code FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM b) WHERE close > p")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-3: days arrive in two files; the second scan sees the first's bars as history."""
    path = scratch(spark)
    b = X.event_bars(B.read(spark, sf_dir, "events"))
    rules = [R.Rule("RISE", "close > before")]
    prepare = lambda h: h.withColumn("before", F.expr("lag(close) over (partition by symbol order by date)"))
    middle = b.agg(F.min("date"), F.max("date")).select(F.expr("date_add(`min(date)`, int(datediff(`max(date)`, `min(date)`) / 2))")).first()[0]
    for part in (F.col("date") < middle, F.col("date") >= middle):
        b.where(part).write.mode("append").parquet(f"{path}/in")
        X.scan_new(spark, f"{path}/in", b.schema, f"{path}/store", f"{path}/signals", f"{path}/c", rules, prepare).awaitTermination()
    return spark.read.parquet(f"{path}/signals").select("symbol", "date", "filter_code")
