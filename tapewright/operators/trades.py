"""Signals to trades: entry and exit prices, holding-period returns, reasons for rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from .calendar import after_days, trading_days

INVALID_SIDE, INVALID_ENTRY, INVALID_EXIT = "Invalid Side", "Invalid EntryClose", "Invalid ExitClose"


def returns(panel: DataFrame, signals: DataFrame, holding: int = 1, cost_pct: float = 0.0, days: DataFrame | None = None, mode: str | None = None) -> DataFrame:
    """filter_code, grp, symbol, date, entry_close, exit_date, exit_close, side, return_pct, win, reason for every signal.

    mode "bars": the exit is the symbol's own h-th next bar. mode "calendar": the close on the h-th next trading day, and
    a day without that bar is an invalid exit. Default: bars for a holding of 1, else calendar (weekdays of the panel's
    span where `days` is not given). return_pct = (exit / entry - 1) * 100 * (1 long, -1 short) - cost.
    A missing side is long; another word than long or short is kept as a row with its reason and no result.
    """
    if holding < 1:
        raise ValueError("holding must be 1 at least")
    mode = mode or ("bars" if holding == 1 and days is None else "calendar")
    one_bar = panel.select("symbol", "date", "close").dropDuplicates(["symbol", "date"])
    w = W.partitionBy("symbol").orderBy("date")
    priced = one_bar.withColumn("entry_close", F.col("close"))
    asked = _with_columns(signals).dropDuplicates(["filter_code", "symbol", "date"])
    if mode == "bars":
        priced = priced.withColumns({"exit_date": F.lead("date", holding).over(w), "exit_close": F.lead("close", holding).over(w)}).drop("close")
        joined = asked.join(priced, ["symbol", "date"], "left")
    else:
        calendar = days if days is not None else trading_days(panel)
        later = one_bar.select("symbol", F.col("date").alias("exit_date"), F.col("close").alias("exit_close"))
        joined = after_days(asked.join(priced.drop("close"), ["symbol", "date"], "left"), calendar, holding).join(later, ["symbol", "exit_date"], "left")
    return settle_trades(joined, cost_pct)


def with_exits(panel: DataFrame, holding: int = 1) -> DataFrame:
    """Adds entry_close, exit_date and exit_close (the symbol's h-th next bar) to bars that are unique, in the exchange by
    symbol that their indicators need anyway. Carried through a scan they make trades without a join."""
    w = W.partitionBy("symbol").orderBy("date")
    return panel.withColumns({"entry_close": F.col("close"), "exit_date": F.lead("date", holding).over(w), "exit_close": F.lead("close", holding).over(w)})


def settle_trades(joined: DataFrame, cost_pct: float = 0.0) -> DataFrame:
    """The table of returns() from signals that have their entry_close, exit_date and exit_close."""
    side = F.lower(F.trim(F.coalesce("side", F.lit(""))))
    sign = F.when(side.isin("", "long"), 1.0).when(side == "short", -1.0)
    reason = F.when(sign.isNull(), INVALID_SIDE).when(~S.gt("entry_close", 0.0), INVALID_ENTRY).when(~S.gt("exit_close", 0.0), INVALID_EXIT)
    gain = (S.divide("exit_close", "entry_close") - 1) * 100 * sign - F.lit(float(cost_pct))
    out = joined.withColumn("reason", reason).withColumn("return_pct", F.when(F.col("reason").isNull(), gain))
    shown = F.when(side == "", "long").when(sign.isNotNull(), side).otherwise(F.col("side"))
    return out.withColumns({"side": shown, "win": F.col("return_pct") > 0}).select("filter_code", "grp", "symbol", "date", "entry_close", "exit_date", "exit_close", "side", "return_pct", "win", "reason")


def _with_columns(signals: DataFrame) -> DataFrame:
    for c in ("grp", "side"):
        if c not in signals.columns:
            signals = signals.withColumn(c, F.lit(None).cast("string"))
    return signals.select("filter_code", "grp", "symbol", "side", "date")


def losing_runs(trades: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """by..., trades, longest run of losses and the run at the end: gaps and islands over the trades of a group."""
    w = W.partitionBy(*by).orderBy(*order)
    lost = S.lt(value, 0.0)
    marked = trades.withColumn("__i", F.sum(F.when(lost, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    islands = marked.groupBy(*by, "__i").agg(F.sum(F.when(lost, 1).otherwise(0)).alias("run"), F.count(F.lit(1)).alias("n"))
    return islands.groupBy(*by).agg(F.sum("n").cast("long").alias("trades"), F.max("run").cast("long").alias("longest_losses"), F.max_by("run", "__i").cast("long").alias("losses_now"))
