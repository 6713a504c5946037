"""The driver's star-schema tables as bars, benchmark, actions, fills, weights and equity (see FIXTURES.md)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def by_symbol():
    return W.partitionBy("symbol").orderBy("date")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def symbol_of(key: str) -> Column:
    return F.concat(F.lit("S"), F.col(key).cast("string"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item: symbol, date, px, quantity and the order within a day."""
    return read(spark, sf_dir, "lineitem").select(
        symbol_of("l_suppkey").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        "l_quantity",
        "l_extendedprice",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("at"),
    )


#: Line items that one task is given, at most about.
TASK_ROWS = 1 << 17


def tasks(spark: SparkSession, sf_dir: str, table: str = "lineitem") -> int:
    """How many tasks a table's rows are dealt to: their number grows with the table, so that a task's memory does not."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(read(spark, sf_dir, table).count() / TASK_ROWS))


def rows_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, rows: line items of each day, from their dates alone; a day has no more bars than that."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("rows"))


def panel(spark: SparkSession, sf_dir: str, *by: str, cell: Column | None = None) -> DataFrame:
    """symbol, date, open, high, low, close, volume: one row for each symbol and day, partitioned by symbol (or `by`).

    Line items are dealt out once, by symbol, and make their bars where the windows over a symbol want them. With `cell`, a
    function of the date, they are dealt by symbol and cell, and bars have it as __cell (see operators.series)."""
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    t = ticks(spark, sf_dir).select("symbol", "date", *[F.col("at")[c].alias(c) for c in order], *([cell.alias("__cell")] if cell is not None else []))
    cells = ("__cell",) if cell is not None else ()
    t = t.repartition(tasks(spark, sf_dir), *(by or ("symbol", *cells)))
    day = t.withColumns({"px": F.col("l_extendedprice") / F.col("l_quantity"), "at": F.struct(*order)}).groupBy("symbol", "date", *cells)
    # the first and the last line item whole: their prices are in them, and each is compared once
    made = day.agg(F.min("at").alias("__first"), F.max("px").alias("high"), F.min("px").alias("low"), F.max("at").alias("__last"), F.sum("l_quantity").alias("volume"))
    price = lambda at: F.col(f"{at}.l_extendedprice") / F.col(f"{at}.l_quantity")
    return made.select("symbol", "date", *cells, price("__first").alias("open"), "high", "low", price("__last").alias("close"), "volume")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, close of the volume-weighted market; one row a day."""
    return ticks(spark, sf_dir).groupBy("date").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, factor: a halving for every supplier, a second one a year later for even keys."""
    s = read(spark, sf_dir, "supplier").select(symbol_of("s_suppkey").alias("symbol"), "s_suppkey", F.date_add(F.lit("1998-01-01").cast("date"), F.pmod("s_suppkey", F.lit(365)).cast("int")).alias("date"))
    first = s.select("symbol", "date", F.lit(0.5).alias("factor"))
    second = s.where(F.pmod("s_suppkey", F.lit(2)) == 0).select("symbol", F.date_add("date", 365).alias("date"), F.lit(0.8).alias("factor"))
    return first.unionByName(second)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, date, symbol, side, fill_price, quantity of every line item."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        symbol_of("l_suppkey").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("fill_price"),
        F.col("l_quantity").alias("quantity"),
    )


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, symbol, weight: each user's share of a day's summed value."""
    e = read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol")).agg(F.sum("value").alias("v"))
    day = e.groupBy("date").agg(F.sum("v").alias("total"))
    return e.join(F.broadcast(day), "date").select("date", "symbol", (F.col("v") / F.col("total")).alias("weight"))


def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, r: the mean one-bar return of the symbols that trade, damped to a thousandth so that equity stays finite."""
    p = panel(spark, sf_dir).select("date", "symbol", (F.col("close") / F.lag("close").over(by_symbol()) - 1).alias("r"))
    return p.where("r is not null").groupBy("date").agg((F.avg("r") / 1000).alias("r"))


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, equity: 100 grown by the daily returns. A table of days, small enough for one window."""
    w = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return daily_returns(spark, sf_dir).select("date", (F.lit(100.0) * F.exp(F.sum(F.log1p("r")).over(w))).alias("equity"))
