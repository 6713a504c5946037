"""Queries that write a table to files in the shared folder and read it through the library's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import clean, folds, rules, summary
from ..operators.calendar import trading_days
from ..sources import bars as B
from ..sources import readers, writers
from ..streaming import ingest as X
from .bars import RULES, signals, smas, trade_table
from .base import long, query, r4, scratch, settled


def _csv(df: DataFrame) -> str:
    path = scratch(df.sparkSession)
    df.write.option("header", True).csv(path)
    return path


@query("s1_parquet_panel", "SELECT * FROM panel", ("panel",))
def parquet_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-1, O-1: the panel sorted within files, read under the panel's schema."""
    path = scratch(spark)
    B.panel(spark, sf_dir).sortWithinPartitions("symbol", "date").write.parquet(path)
    return readers.parquet_panel(spark, path)


@query("s2_csv_panel", "SELECT * FROM panel", ("panel",))
def csv_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-2: a CSV whose columns come in another order."""
    p = B.panel(spark, sf_dir)
    return readers.csv_panel(spark, _csv(p.select(*reversed(p.columns)))).select(*p.columns)


@query("s4_symbol_files", "SELECT symbol, date, close, volume FROM panel", ("panel",))
def symbol_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-4: a file for each symbol, which is named by the path alone."""
    path = scratch(spark)
    p = B.panel(spark, sf_dir).select("symbol", "date", "close", "volume")
    writers.symbol_files(p, path, B.tasks(spark, sf_dir))
    raw = readers.symbol_files(spark, path, writers.WRITTEN)
    return raw.select(writers.name_symbol(F.col("symbol")).alias("symbol"), S.mixed_date("date").alias("date"), F.col("close").try_cast("double").alias("close"), F.col("volume").try_cast("double").alias("volume"))


@query("s5_holidays", "SELECT DISTINCT date FROM panel WHERE day(date) = 1", ("panel",))
def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-5: days written day first, under a header in capitals, some twice."""
    days = B.panel(spark, sf_dir).where("day(date) = 1").select(F.date_format("date", "dd.MM.yyyy").alias("DATE"))
    return readers.holidays(spark, _csv(days))


@query("s6_benchmark_csv", f"SELECT date, {r4('close')} AS close FROM bench", ("bench",))
def benchmark_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-6: the benchmark from a CSV with names of its own."""
    path = _csv(B.benchmark(spark, sf_dir).select(F.col("date").alias("day"), F.col("close").alias("level")))
    return settled(readers.benchmark(spark, path, "day", "level").select("date", "close"), "close")


@query("s7_corporate_actions", "SELECT symbol, date, 1.0 / day(date) AS factor FROM panel WHERE day(date) IN (2, 4)", ("panel",))
def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-7: symbols padded and in small letters; factors are checked."""
    raw = B.panel(spark, sf_dir).where("day(date) in (2, 4)").select(F.concat(F.lit(" "), F.lower("symbol")).alias("symbol"), "date", (F.lit(1.0) / F.dayofmonth("date")).alias("factor"))
    return readers.corporate_actions(spark, _csv(raw))


@query("s8_signal_files", "SELECT date, symbol, filter_code FROM signals", ("signals",))
def signal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-8: signals from all CSV files under a folder."""
    path = scratch(spark)
    signals(spark, sf_dir).select("date", "symbol", "filter_code").write.option("header", True).csv(f"{path}/some")
    return readers.signal_files(spark, path)


@query("s10_aliases", "SELECT 'S' || l_suppkey AS symbol, l_extendedprice AS close, l_tax AS sma_20 FROM lineitem")
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-10: an alias table from a CSV, used on a table that it names."""
    table = readers.alias_table(spark, _csv(spark.sql("select * from values ('Px', 'close'), ('Mean20', 'sma_20') as t(alias, canonical_name)").coalesce(1)))
    raw = B.read(spark, sf_dir, "lineitem").select(B.symbol_of("l_suppkey").alias("Symbol"), F.col("l_extendedprice").alias("Px"), F.col("l_tax").alias("Mean20"))
    return clean.canonicalise(raw, table)[0]


@query("t4_add_canonical", "SELECT l_extendedprice AS \"KAPANIŞ\", l_quantity AS lots, l_extendedprice AS close, l_quantity AS volume FROM lineitem")
def add_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-4: canonical copies beside the provider's columns; the user's schema names the volume."""
    raw = B.read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("KAPANIŞ"), F.col("l_quantity").alias("lots"))
    return clean.add_canonical(raw, {"volume": "lots"})


@query("t2_numbered_copies", "SELECT l_extendedprice AS close, l_tax AS close_alt, l_quantity AS cci_20, l_discount AS aroon_up_14 FROM lineitem")
def numbered_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-2, T-3: a header that repeats Close, numbered by its reader, and a loader's spellings."""
    c = {n: F.col(f"l_{n}") for n in ("extendedprice", "tax", "quantity", "discount")}
    raw = B.read(spark, sf_dir, "lineitem").select(c["extendedprice"].alias("Close"), c["extendedprice"].alias("Close.1"), c["tax"].alias("Close.2"), c["quantity"].alias("CCI_20_0"), c["discount"].alias("AROONU_14"))
    return clean.merge_equal_columns(raw)


@query("k3_per_day", f"SELECT filter_code, symbol, date, {r4('return_pct')} AS return_pct FROM trades", ("trades",))
def per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-3, O-2: all trades in a folder a day, sorted by rule and symbol, read back."""
    path = scratch(spark)
    t = trade_table(spark, sf_dir).select("filter_code", "symbol", "date", "return_pct")
    stats = lambda written: summary.trade_days(written.withColumn("win", F.col("return_pct") > 0))
    back = writers.per_day(t, stats, path, rows_by_day=B.rows_by_day(spark, sf_dir), tasks=B.tasks(spark, sf_dir))
    return settled(back.select("filter_code", "symbol", "date", "return_pct"), "return_pct")


@query("k9_folds", "WITH o AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)) SELECT CAST(fold AS INTEGER) AS fold, date, CASE WHEN pos >= fold * (n // 4) AND pos < (fold + 1) * (n // 4) THEN 'test' WHEN pos < greatest(0, fold * (n // 4) - 5) OR pos >= least(n, (fold + 1) * (n // 4) + 5) THEN 'train' ELSE 'embargo' END AS part FROM o, (SELECT unnest(generate_series(0, 3)) AS fold)", ("panel",))
def folds_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-9: folds as JSON lines."""
    path = scratch(spark)
    writers.documents({"folds": folds.purged_kfold(B.panel(spark, sf_dir), 4, 5)}, path)
    return spark.read.schema("fold int, date date, part string").json(f"{path}/folds")


@query("k10_audit_events", "SELECT r.code, d.date, coalesce(h.hits, 0) AS hits, r.code = 'BROKEN' AS skipped FROM (VALUES ('DOWN_DAY'), ('UP_DAY'), ('BROKEN')) r(code) CROSS JOIN (SELECT DISTINCT date FROM panel) d LEFT JOIN (SELECT filter_code, date, count(*) AS hits FROM signals GROUP BY ALL) h ON h.filter_code = r.code AND h.date = d.date", ("signals", "panel"))
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-10, Q-4: an event for each rule and day as JSON lines."""
    path = scratch(spark)
    p = smas(spark, sf_dir)
    events = rules.rule_audit(p, [*RULES[:2], rules.Rule("BROKEN", "no_such_column > 1")], p.select("date").distinct())
    writers.documents({"audit": events}, path)
    return spark.read.schema("code string, date date, hits long, skipped boolean").json(f"{path}/audit")


@query("k7_due", """WITH m AS (SELECT symbol, max(date) AS last_date, 24 * (CAST(substr(symbol, 2) AS INTEGER) % 3) AS age FROM panel WHERE CAST(substr(symbol, 2) AS INTEGER) % 5 > 0 GROUP BY symbol)
    SELECT s.symbol, coalesce(m.last_date + 1, DATE '1990-01-01') AS "from", DATE '2005-01-01' AS "to" FROM (SELECT DISTINCT symbol FROM panel) s LEFT JOIN m USING (symbol) WHERE age IS NULL OR age >= 36""", ("panel",))
def still_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-7, X-1: what is fresh stays, the rest goes on from the last stored date; symbols without a mark from the start."""
    p = B.panel(spark, sf_dir)
    number = F.substring("symbol", 2, 10).cast("int")
    fetched = F.expr("timestamp'2005-01-01 12:00:00' - make_interval(0, 0, 0, cast(substring(symbol, 2) as int) % 3)")
    marks = writers.high_water(p.where(number % 5 > 0), "test", 36, fetched)
    return writers.due(p, marks, "1990-01-01", "2005-01-01", F.lit("2005-01-01 12:00:00").cast("timestamp"))


@query("x1_days_in_parts", f"SELECT 'U' || user_id AS symbol, CAST(ts AS DATE) AS date, last(value ORDER BY ts, event_id) AS close, {r4('sum(value)')} AS volume FROM events GROUP BY ALL")
def days_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-1, X-2: the events of every day come in three files and runs; then all come again under another checkpoint."""
    path = scratch(spark)
    events = B.read(spark, sf_dir, "events")
    for part in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(f"{path}/in")
        X.ingest_events(spark, f"{path}/in", events.schema, f"{path}/store", f"{path}/c").awaitTermination()
    X.ingest_events(spark, f"{path}/in", events.schema, f"{path}/store", f"{path}/again").awaitTermination()
    return settled(X.read_bars(spark, f"{path}/store"), "volume")


@query("f6_rounding", "SELECT l_orderkey, l_linenumber, (c // 8 + CASE WHEN c % 8 > 4 OR (c % 8 = 4 AND c // 8 % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS cents FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-6, D-5: money to cents, halves to even."""
    rows = B.read(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", S.round_even(F.col("l_extendedprice").cast("decimal(12,2)") / 8, 2).cast("double").alias("cents"))


@query("q3_order_and_columns", "SELECT symbol, CASE WHEN bool_or(date < p) THEN 'missing_cols,not_sorted' ELSE 'missing_cols' END AS issues FROM (SELECT symbol, date, lag(date) OVER (PARTITION BY symbol ORDER BY day(date), date) AS p FROM panel) GROUP BY symbol", ("panel",))
def order_and_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-3: a store in another order than that of its dates and without a column; weekends and gaps aside."""
    from ..operators import quality as Q

    p = B.panel(spark, sf_dir).select("symbol", "date", "close").withColumn("at", F.struct(F.dayofmonth("date"), "date"))
    found = Q.store_integrity(p, p, trading_days(p), ("close", "vwap"), "at")
    return found.select("symbol", F.array_join(F.array_intersect("issues", F.array(F.lit("missing_cols"), F.lit("not_sorted"))), ",").alias("issues"))
