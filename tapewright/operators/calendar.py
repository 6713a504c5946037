"""Trading calendars, next bars, missing days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import is_weekend


def trading_days(panel: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """date, ord: all days from the panel's first to its last without weekends and holidays, numbered from 0."""
    span = panel.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date")).where(~is_weekend("date"))
    return number_days(days.join(F.broadcast(holidays.select("date").distinct()), "date", "left_anti") if holidays is not None else days)


def number_days(days: DataFrame) -> DataFrame:
    """Dense ordinals. A calendar has a few thousand rows; this is the one kind of table that a single window orders."""
    return days.select("date", (F.row_number().over(W.orderBy("date")) - 1).cast("long").alias("ord"))


def next_bar(panel: DataFrame) -> DataFrame:
    """Adds next_date and next_close: the symbol's own next bar."""
    w = W.partitionBy("symbol").orderBy("date")
    return panel.withColumns({"next_date": F.lead("date").over(w), "next_close": F.lead("close").over(w)})


def after_days(rows: DataFrame, days: DataFrame, n: int, date: str = "date", out: str = "exit_date") -> DataFrame:
    """Adds the trading day n days on; null where `date` is no trading day or the calendar ends. Calendars are broadcast:
    one row for each day of the span, whatever the number of symbols."""
    here = days.select(F.col("date").alias("__d"), (F.col("ord") + n).alias("__o"))
    then = days.select(F.col("date").alias(out), F.col("ord").alias("__o"))
    step = here.join(F.broadcast(then), "__o", "left").drop("__o")
    return rows.join(F.broadcast(step), rows[date] == F.col("__d"), "left").drop("__d")


def next_by_calendar(panel: DataFrame, days: DataFrame, n: int = 1) -> DataFrame:
    """Adds next_date (the calendar's) and next_close, the symbol's close on that very day or null."""
    then = panel.select("symbol", F.col("date").alias("next_date"), F.col("close").alias("next_close"))
    return after_days(panel, days, n, out="next_date").join(then, ["symbol", "next_date"], "left").select(*panel.columns, "next_date", "next_close")


def missing_days(panel: DataFrame, days: DataFrame, by_symbol: bool = True) -> DataFrame:
    """Trading days without a bar: of the whole panel, or between each symbol's first and last bar.

    By symbol, only holes are expanded: a bar meets the ordinal of its day, and of the one before it in its symbol; what
    lies between is listed and named by the calendar. Bars on other days than trading days count by the last one before.
    """
    if not by_symbol:
        return days.select("date").join(panel.select("date").distinct(), "date", "left_anti")
    # every day of the calendar's span with its own ordinal, if it is a trading day, and that of the last one up to it
    ends = days.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("a is not null")
    every = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date")).join(days.select("date", F.col("ord").alias("own")), "date", "left")
    upto = every.withColumn("last", F.last("own", ignorenulls=True).over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
    bars = panel.select("symbol", "date").where("date is not null").distinct().join(F.broadcast(upto), "date", "left").join(F.broadcast(ends))
    last = F.coalesce(F.col("last"), F.when(F.col("date") < F.col("a"), F.col("lo") - 1).otherwise(F.col("hi")))
    bars = bars.select("symbol", "date", last.alias("last"), F.when(F.col("own").isNull(), last).otherwise(F.col("own") - 1).alias("to"))
    holes = bars.select("symbol", (F.lag("last").over(W.partitionBy("symbol").orderBy("date")) + 1).alias("from"), "to").where(F.col("from") <= F.col("to"))
    gone = holes.select("symbol", F.explode(F.sequence("from", "to")).alias("ord"))
    return gone.join(F.broadcast(days.select("ord", "date")), "ord").select("symbol", "date")


class MissingTradingDays(ValueError):
    pass


def check_missing(panel: DataFrame, days: DataFrame, raise_error: bool = True) -> DataFrame:
    """The missing days of the panel; raises where there are any and raise_error is set."""
    gone = missing_days(panel, days, by_symbol=False)
    if raise_error and (some := [r[0] for r in gone.orderBy("date").limit(10).collect()]):
        raise MissingTradingDays("no bars on " + ", ".join(map(str, some)))
    return gone
