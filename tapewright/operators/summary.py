"""Aggregates of signals and trades by day and rule, against a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from .indicators import forward_return


def signal_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("date", "filter_code").agg(F.count(F.lit(1)).alias("signals"))


def benchmark_returns(benchmark: DataFrame, horizon: int = 1) -> DataFrame:
    """date, bench_ret (a fraction, `horizon` rows ahead): the benchmark has a row a day, so one window orders it."""
    w = W.orderBy("date")
    return benchmark.select("date", (S.divide(F.lead("close", horizon).over(w), "close") - 1).alias("bench_ret"))


def daily(panel: DataFrame, signals: DataFrame, benchmark: DataFrame, horizon: int = 1) -> DataFrame:
    """date, signals, filters, coverage, mean_ret, bench_ret, alpha for every day with a signal.

    Returns are over the next `horizon` bars and of equal weight over a day's distinct symbols; coverage is the distinct
    symbols with a return; alpha is null unless both returns are there.
    """
    fwd = panel.select("symbol", "date", forward_return(horizon).alias("fwd"))
    counts = signals.groupBy("date").agg(F.count(F.lit(1)).alias("signals"), F.countDistinct("filter_code").alias("filters"))
    picked = signals.select("symbol", "date").distinct().join(fwd, ["symbol", "date"], "left")
    perf = picked.groupBy("date").agg(F.count("fwd").alias("coverage"), F.avg("fwd").alias("mean_ret"))
    bench = benchmark_returns(benchmark, horizon)
    return counts.join(perf, "date").join(F.broadcast(bench), "date", "left").withColumn("alpha", F.col("mean_ret") - F.col("bench_ret"))


def summarise_range(panel: DataFrame, signals: DataFrame, benchmark: DataFrame, horizon: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per day and rule counts, the daily table, and its one-row mean alpha."""
    table = daily(panel, signals, benchmark, horizon)
    return signal_counts(signals), table, table.agg(F.avg("alpha").alias("mean_alpha"), F.count("alpha").alias("days"))


def rule_by_day(trades: DataFrame, days: list, by_side: bool = False) -> DataFrame:
    """Mean return of every rule (and side) on every day, a column a day; the list of days spares a job that finds them."""
    keys = ["filter_code", "side"] if by_side else ["filter_code"]
    return trades.groupBy(*keys).pivot("date", days).agg(F.avg("return_pct"))


def win_rate_by_day(trades: DataFrame, days: list) -> DataFrame:
    return trades.groupBy("filter_code").pivot("date", days).agg(F.avg(F.col("win").cast("double")))


def rule_day(trades: DataFrame) -> DataFrame:
    """The long form of the pivot: filter_code, date, ret, n; days on which a rule has no valid trade are absent."""
    return trades.where("return_pct is not null").groupBy("filter_code", "date").agg(F.avg("return_pct").alias("ret"), F.count(F.lit(1)).alias("n"))


def rule_side_day(trades: DataFrame) -> DataFrame:
    """rule_day for each side: filter_code, side, date, ret."""
    return trades.where("return_pct is not null").groupBy("filter_code", "side", "date").agg(F.avg("return_pct").alias("ret"))


def win_day(trades: DataFrame) -> DataFrame:
    """The long form of win_rate_by_day: filter_code, date, win_rate."""
    return trades.where("return_pct is not null").groupBy("filter_code", "date").agg(F.avg(F.col("win").cast("double")).alias("win_rate"))


def rule_metrics(trades: DataFrame, bench_pct: DataFrame) -> DataFrame:
    """filter_code, mean_ret, bench_mean_ret, alpha_ret, hit_ratio, n_trades.

    The mean of a rule's daily means; the share of its days above 0; the benchmark's mean over just the days that the
    rule traded and the benchmark has. bench_pct: date, bench_ret in percent.
    """
    per = rule_day(trades).join(F.broadcast(bench_pct.select("date", "bench_ret")), "date", "left")
    out = per.groupBy("filter_code").agg(F.avg("ret").alias("mean_ret"), F.avg("bench_ret").alias("bench_mean_ret"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hit_ratio"), F.sum("n").cast("long").alias("n_trades"))
    return out.withColumn("alpha_ret", F.col("mean_ret") - F.col("bench_mean_ret"))


def ranked(metrics: DataFrame, most: int | None = None) -> DataFrame:
    """Rules by falling alpha, ties by code; with `most` a top-k."""
    out = metrics.orderBy(F.col("alpha_ret").desc_nulls_last(), "filter_code")
    return out.limit(most) if most else out


def against_benchmark(trades: DataFrame, bench_pct: DataFrame) -> DataFrame:
    """filter_code, date, diff: each rule's day minus the benchmark's; empty unless every traded day has a benchmark value."""
    per = rule_day(trades).join(F.broadcast(bench_pct.select("date", "bench_ret")), "date", "left")
    gaps = per.agg(F.count_if(F.col("bench_ret").isNull()).alias("gaps"))
    return per.crossJoin(F.broadcast(gaps)).where("gaps = 0").select("filter_code", "date", (F.col("ret") - F.col("bench_ret")).alias("diff"))


def trade_days(trades: DataFrame) -> DataFrame:
    """date, n_trades, mean_ret, hit_ratio of valid trades."""
    return trades.where("return_pct is not null").groupBy("date").agg(F.count(F.lit(1)).alias("n_trades"), F.avg("return_pct").alias("mean_ret"), F.avg(F.col("win").cast("double")).alias("hit_ratio"))


def kpi(daily_table: DataFrame) -> DataFrame:
    """(metric, value): total_days, mean_alpha, pos_alpha_ratio, mean_signals."""
    one = daily_table.agg(
        F.count(F.lit(1)).cast("double").alias("total_days"),
        F.avg("alpha").alias("mean_alpha"),
        F.avg(F.when(F.col("alpha") > 0, 1.0).when(F.col("alpha").isNotNull(), 0.0)).alias("pos_alpha_ratio"),
        F.avg("signals").alias("mean_signals"),
    )
    return one.unpivot([], ["total_days", "mean_alpha", "pos_alpha_ratio", "mean_signals"], "metric", "value")


def counts_by_day(signals: DataFrame, codes: list[str]) -> DataFrame:
    """date, one column a rule: counts, 0 where none."""
    return signals.groupBy("date").pivot("filter_code", codes).agg(F.count(F.lit(1))).fillna(0)
