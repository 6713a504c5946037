"""The end-to-end job: clean bars, calendar, indicators that the rules ask for, signals, trades, summaries, quality."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import clean, quality, rules, summary, trades
from ..operators import indicators as I
from ..sources import bars as B
from ..sources import writers
from .base import query, r4, settled


def run_range(panel: DataFrame, catalog: list[rules.Rule], start: str, end: str, benchmark: DataFrame | None = None, actions: DataFrame | None = None, holidays: DataFrame | None = None, holding: int = 1, cost_pct: float = 0.0, keep: Iterable[str] | None = None, out: str | None = None, policy: str = "replace", tasks: int | None = None) -> dict[str, DataFrame]:
    """All tables of a range scan, by name; written under `out` where that is given (signals a day, the others as CSV).

    keep: glob patterns of rule codes. The benchmark has date and close. `tasks`: bars are dealt by symbol to so many. Trades
    that are held for one bar take their exits from the bars' own windows and join nothing.
    """
    bars = clean.clean_panel(clean.require(panel), tasks=tasks)
    if actions is not None:
        bars = clean.adjust_for_actions(bars, actions)
    chosen, _ = rules.tidy(rules.select_codes(catalog, keep) if keep else catalog)
    exits = ("entry_close", "exit_date", "exit_close") if holding == 1 else ()
    named = I.add_named(bars, I.demanded(r.predicate for r in chosen if isinstance(r.predicate, str)))
    days = C.trading_days(bars, holidays)
    found = rules.scan_range(trades.with_exits(named) if exits else named, chosen, start, end, carry=exits, dates=clean.clean_rows(panel))
    signals = found.drop(*exits)
    made = trades.settle_trades(found, cost_pct) if exits else trades.returns(bars, signals, holding, cost_pct, days)
    tables = {"trades": made, "days": summary.trade_days(made), "profile": quality.profile(bars), "issues": quality.row_issues(bars), "missing_days": C.missing_days(bars, days)}
    if benchmark is not None:
        pct = summary.benchmark_returns(benchmark, holding).withColumn("bench_ret", F.col("bench_ret") * 100)
        daily = summary.daily(bars, signals, benchmark, holding)
        tables |= {"rules": summary.rule_metrics(made, pct), "daily": daily, "kpi": summary.kpi(daily)}
    if out:
        where, _ = writers.target(out, policy)
        writers.daily_signals(signals, f"{where}/daily", days.where(F.col("date").between(start, end)))
        writers.report_tables(tables, f"{where}/tables")
    return {"signals": signals, **tables}


_JOB = f"""
    WITH s AS (SELECT * FROM signals WHERE filter_code <> 'DOWN_DAY' AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'),
    t AS (SELECT s.filter_code, s.date, (p.nc / p.close - 1) * 100 - 0.1 AS ret FROM s JOIN (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS nc FROM panel) p ON p.symbol = s.symbol AND p.date = s.date),
    d AS (SELECT filter_code, date, avg(ret) AS ret, count(*) AS n FROM t WHERE ret IS NOT NULL GROUP BY ALL)
    SELECT filter_code, {r4('avg(ret)')} AS mean_ret, {r4('avg(bench_ret)')} AS bench_mean_ret, {r4('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_ratio, CAST(sum(n) AS BIGINT) AS n_trades, {r4('avg(ret) - avg(bench_ret)')} AS alpha_ret
    FROM d LEFT JOIN bench_pct USING (date) GROUP BY filter_code"""


@query("b6_range_job", _JOB, ("signals", "panel", "bench_pct"))
def range_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-6: the whole job over three years; its rule table."""
    catalog = [rules.Rule("UP_DAY", "close > open", "day", "long"), rules.Rule("DOWN_DAY", "close < open", "day", "short"), rules.Rule("SMA_UP", "sma_5 > sma_10", "trend")]
    tables = run_range(B.panel(spark, sf_dir), catalog, "1997-01-01", "1999-12-31", B.benchmark(spark, sf_dir), cost_pct=0.1, keep=["UP_*", "SMA_*"], tasks=B.tasks(spark, sf_dir))
    return settled(tables["rules"], "mean_ret", "bench_mean_ret", "hit_ratio", "alpha_ret")


@query(
    "f3_f8_scalars",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, upper(l_returnflag) || regexp_replace(CAST(l_shipdate AS DATE)::VARCHAR, '-', '/', 'g') AS text, strftime(l_shipdate, '%Y%m') AS month, isodow(l_shipdate) > 5 AS weekend,
       CAST(l_shipdate AS DATE) + 10 AS later, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS days, CAST(greatest(0, CAST(floor(greatest(l_quantity * 1.3, 1)) AS BIGINT) - CAST(floor(greatest(l_quantity * 1.3, 1)) AS BIGINT) % 10) AS BIGINT) AS lots FROM lineitem""",
)
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-3 to F-8."""
    from ..functions import scalar as S

    li = B.read(spark, sf_dir, "lineitem").withColumn("d", F.col("l_shipdate").cast("date"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.upper(F.trim("l_returnflag")), F.regexp_replace(F.col("d").cast("string"), "-", "/")).alias("text"), S.month_key("d").alias("month"), S.is_weekend("d").alias("weekend"), F.date_add("d", 10).alias("later"), F.datediff("d", F.lit("1995-01-01").cast("date")).cast("long").alias("days"), S.to_lots(F.col("l_quantity") * 1.3, 10, 1).alias("lots"))


@query("u1_u4_sets", "SELECT symbol, date FROM panel p WHERE NOT EXISTS (SELECT 1 FROM panel q WHERE q.date = p.date AND q.symbol = 'S' || (CAST(substr(p.symbol, 2) AS BIGINT) + 1))", ("panel",))
def sets_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-1, U-3, U-4 over all symbols: of each, the days on which the symbol of the next number has no bar."""
    p, n = B.panel(spark, sf_dir, "symbol", "date"), B.tasks(spark, sf_dir)
    number = F.substring("symbol", 2, 20).cast("long")
    odd, even = p.where(number % 2 == 1), p.where(number % 2 == 0)
    every = odd.select("symbol", "date").unionByName(even.select("date", "symbol", "close"), allowMissingColumns=True).unionByName(odd.select("symbol", "date"), allowMissingColumns=True)
    after = p.select(F.concat(F.lit("S"), (number - 1).cast("string")).alias("symbol"), "date")
    # dealt by their keys to as many tasks as the line items are, before rows are made one and joined
    every, after = every.select("symbol", "date").repartition(n, "symbol", "date"), after.repartition(n, "symbol", "date")
    return every.dropDuplicates().join(after, ["symbol", "date"], "left_anti").select("symbol", "date")
