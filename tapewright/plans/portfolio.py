"""Queries: orders, costs, risk, cash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orders as O
from ..operators.indicators import add_atr, by_symbol
from ..sources import bars as B
from .bars import smas
from .base import query, r4, r8, settled

_SIG = """sig AS (SELECT symbol, date, close, sma_5 > sma_10 AND NOT coalesce(p5 > p10, false) AS entry_long, sma_5 < sma_10 AND coalesce(p5 >= p10, false) AS exit_long, CASE WHEN day(date) = 10 THEN 0.05 WHEN day(date) = 11 THEN -0.03 END AS target_weight
    FROM (SELECT *, lag(sma_5) OVER w AS p5, lag(sma_10) OVER w AS p10 FROM smas WINDOW w AS (PARTITION BY symbol ORDER BY date))),
    atr AS (SELECT symbol, date, CASE WHEN count(tr) OVER w5 = 5 THEN avg(tr) OVER w5 END AS atr FROM (SELECT symbol, date, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr FROM bars) WINDOW w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING)),
    sm AS (SELECT * FROM sig LEFT JOIN atr USING (symbol, date))"""


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = smas(spark, sf_dir).withColumns({"p5": F.lag("sma_5").over(by_symbol()), "p10": F.lag("sma_10").over(by_symbol())})
    day = F.dayofmonth("date")
    no = lambda c: F.coalesce(c, F.lit(False))
    return s.select("symbol", "date", ((F.col("sma_5") > F.col("sma_10")) & ~no(F.col("p5") > F.col("p10"))).alias("entry_long"), ((F.col("sma_5") < F.col("sma_10")) & no(F.col("p5") >= F.col("p10"))).alias("exit_long"), F.when(day == 10, 0.05).when(day == 11, -0.03).alias("target_weight"))


def _qty(x: str) -> str:
    return f"CAST(greatest(0, floor(greatest({x}, 1)) - floor(greatest({x}, 1)) % 10) AS BIGINT)"


_ORDERS = {
    "risk_per_trade": (f"CASE WHEN entry_long THEN 'BUY' ELSE 'EXIT' END", f"CASE WHEN entry_long THEN {_qty('1000000.0 * 0.005 / greatest(CASE WHEN atr > 0 THEN 2 * atr ELSE 0.02 * close END, 1e-9)')} ELSE 0 END", "entry_long OR exit_long"),
    "fixed_fraction": (f"CASE WHEN entry_long THEN 'BUY' ELSE 'EXIT' END", f"CASE WHEN entry_long THEN {_qty('1000000.0 * 0.1 / close')} ELSE 0 END", "entry_long OR exit_long"),
    "target_weight": (
        "CASE WHEN target_weight > 0 THEN 'BUY' WHEN target_weight IS NOT NULL THEN 'SELL' WHEN entry_long THEN 'BUY' ELSE 'EXIT' END",
        f"CASE WHEN target_weight IS NOT NULL THEN {_qty('abs(1000000.0 * target_weight) / close')} WHEN entry_long THEN {_qty('1000000.0 * 0.1 / close')} ELSE 0 END",
        "target_weight IS NOT NULL OR entry_long OR exit_long",
    ),
}


def _orders(mode: str):
    side, qty, where = _ORDERS[mode]

    @query(f"d4_orders_{mode}", f"WITH {_SIG} SELECT date, symbol, {side} AS side, close AS price, {qty} AS qty FROM sm WHERE {where}", ("smas", "bars"))
    def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
        """D-1 to D-4, F-7, J-5, I-12: lots of ten for a million of equity."""
        return O.order_table(flags(spark, sf_dir), B.panel(spark, sf_dir), 1_000_000.0, O.Sizing(mode=mode, atr_period=5, lot=10))

    return orders


ORDER_QUERIES = [_orders(m) for m in _ORDERS]


@query(
    "d5_costs",
    f"""SELECT trade_id, date, symbol, side, {r8('fill_price * quantity')} AS notional, {r8('greatest(fill_price * quantity * 0.0005, 20)')} AS cost_commission,
        {r8('fill_price * quantity * (3.5 + least(greatest(coalesce(atr / close, 0), 0), 0.2) * 10) * 0.0001')} AS cost_slippage, {r8('fill_price * quantity * 0.0002')} AS cost_taxes FROM fills
        LEFT JOIN (SELECT b.symbol, b.date, b.close, CASE WHEN n >= 3 THEN avg(greatest(high - low, abs(high - prev_close), abs(low - prev_close))) OVER w END AS atr FROM bars b WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 2 PRECEDING)) m USING (symbol, date)""",
    ("fills", "bars"),
)
def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-5 before rounding to cents, so that SQL can follow; the rounding is tested by hand."""
    market = add_atr(B.panel(spark, sf_dir), 3, "atr").select("symbol", "date", "close", "atr")
    f = B.fills(spark, sf_dir).join(market, ["symbol", "date"], "left")
    out = O.with_costs(f, O.Costs(commission_least=20.0, tax_bps=2.0, decimals=12))
    return settled(out, "notional", "cost_commission", "cost_slippage", "cost_taxes", digits=8).select("trade_id", "date", "symbol", "side", "notional", "cost_commission", "cost_slippage", "cost_taxes")


@query("a22_day_notional", f"SELECT date, {r4('sum(fill_price * quantity)')} AS notional FROM fills GROUP BY date", ("fills",))
def day_notional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(O.day_notional(B.fills(spark, sf_dir), "fill_price", "quantity"), "notional")


_STATE = "state AS (SELECT date, CASE WHEN day(date) = 5 THEN -600.0 ELSE -10.0 END AS dd FROM (SELECT DISTINCT date FROM fills))"
_FLAGS = f"""{_STATE}, day AS (SELECT date, count(*) AS n_orders, sum(fill_price * quantity) AS notional FROM fills GROUP BY date),
    fl AS (SELECT date, n_orders, notional, dd <= -500 AS deep, n_orders >= 36 AS many, notional > 1200000 AS over FROM day JOIN state USING (date))"""
LIMITS = O.Limits(max_daily_trades=36, max_intraday_dd_bps=500.0, exposure_pct=1.2)


def day_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = B.fills(spark, sf_dir)
    state = f.select("date").distinct().withColumn("intraday_dd_bps", F.when(F.dayofmonth("date") == 5, -600.0).otherwise(-10.0))
    return O.risk_flags(f, 1_000_000.0, LIMITS, state)


@query("d6_risk_flags", f"WITH {_FLAGS} SELECT date, n_orders, {r4('notional')} AS notional, CASE WHEN deep OR many THEN 'block' WHEN over THEN 'modify' ELSE 'allow' END AS action, concat_ws(',', CASE WHEN deep THEN 'intraday_drawdown' END, CASE WHEN many THEN 'max_daily_trades' END, CASE WHEN over THEN 'per_symbol_cap' END) AS reasons FROM fl", ("fills",))
def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = day_flags(spark, sf_dir)
    return settled(out.withColumn("reasons", F.array_join("reasons", ",")), "notional")


@query("d7_exposure_cap", f"WITH {_FLAGS} SELECT trade_id, f.date, side, fill_price, CASE WHEN over THEN floor(quantity * (1200000.0 / notional)) ELSE quantity END AS quantity, over AS capped FROM fills f JOIN fl ON fl.date = f.date WHERE NOT deep AND NOT many", ("fills",))
def exposure_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.apply_risk(B.fills(spark, sf_dir), day_flags(spark, sf_dir), 1_000_000.0, LIMITS)
    return out.select("trade_id", "date", "side", "fill_price", "quantity", "capped")


@query("d8_cash_ledger", f"WITH d AS (SELECT date, sum(CASE WHEN side = 'BUY' THEN -1 ELSE 1 END * fill_price * quantity) AS flow FROM fills GROUP BY date) SELECT date, {r4('flow')} AS flow, {r4('1000000.0 + sum(flow) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS cash FROM d", ("fills",))
def cash_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(O.cash_ledger(B.fills(spark, sf_dir)), "flow", "cash")
