"""Queries: windows and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators.series import days
from ..sources import bars as B
from .base import query, r4, r8, settled


def _roll(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"


def _full(n: int, x: str, agg: str) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {r4(agg)} END"


@query(
    "w1_w4_lags",
    f"""SELECT symbol, date, lag(close, 3) OVER w AS close_3, {r4('lead(close, 5) OVER w / close - 1')} AS fwd_5, {r4('close - lag(close, 4) OVER w')} AS mom_4, {r4('close / lag(close, 4) OVER w - 1')} AS roc_4
        FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    ("panel",),
)
def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-1, W-4, I-6, I-7."""
    p = B.panel(spark, sf_dir)
    return settled(p.select("symbol", "date", F.lag("close", 3).over(I.by_symbol()).alias("close_3"), I.forward_return(5).alias("fwd_5"), I.momentum(4).alias("mom_4"), I.change_rate(4).alias("roc_4")), "fwd_5", "mom_4", "roc_4")


@query(
    "w5_w6_rolling",
    f"""SELECT symbol, date, {_full(7, 'close', 'avg(close) OVER w7')} AS mean_7, {_full(7, 'close', 'max(close) OVER w7')} AS max_7, {_full(7, 'close', 'min(close) OVER w7')} AS min_7,
        {_full(7, 'close', 'stddev_samp(close) OVER w7')} AS std_7, {_full(7, 'close', 'sum(volume) OVER w7')} AS sum_7, {_full(6, 'close', 'median(close) OVER w6')} AS med_6
        FROM panel WINDOW w7 AS {_roll(7)}, w6 AS {_roll(6)}""",
    ("panel",),
)
def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-5, W-6, I-1: full windows only."""
    p = B.panel(spark, sf_dir)
    p = I.add_medians(p, {"med_6": ("close", 6)})
    cols = {"mean_7": ("close", 7, "mean"), "max_7": ("close", 7, "max"), "min_7": ("close", 7, "min"), "std_7": ("close", 7, "std"), "sum_7": ("volume", 7, "sum")}
    return settled(p.select("symbol", "date", "med_6", *[I.rolling(*a).alias(n) for n, a in cols.items()]), "med_6", *cols)


@query(
    "i3_wma",
    f"""SELECT symbol, date, CASE WHEN n >= 5 THEN {r8('(5 * close + 4 * lag(close, 1) OVER w + 3 * lag(close, 2) OVER w + 2 * lag(close, 3) OVER w + lag(close, 4) OVER w) / 15')} END AS wma_5
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    ("bars",),
)
def wma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(I.add_named(B.panel(spark, sf_dir), ["wma_5"]).select("symbol", "date", "wma_5"), "wma_5", digits=8)


@query(
    "i8_cci",
    f"""WITH t AS (SELECT *, (high + low + close) / 3 AS tp FROM panel), s AS (SELECT *, CASE WHEN count(tp) OVER w6 = 6 THEN avg(tp) OVER w6 END AS sma FROM t WINDOW w6 AS {_roll(6)})
        SELECT symbol, date, CASE WHEN count(abs(tp - sma)) OVER w6 = 6 AND avg(abs(tp - sma)) OVER w6 <> 0 THEN {r4('(tp - sma) / (0.015 * avg(abs(tp - sma)) OVER w6)')} END AS cci_6 FROM s WINDOW w6 AS {_roll(6)}""",
    ("panel",),
)
def cci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(I.add_named(B.panel(spark, sf_dir), ["cci_6"]).select("symbol", "date", "cci_6"), "cci_6")


@query(
    "i11_bollinger",
    f"""SELECT symbol, date, {_full(8, 'close', 'avg(close) OVER w8 - 2 * stddev_pop(close) OVER w8')} AS bbl_8_2, {_full(8, 'close', 'avg(close) OVER w8')} AS bbm_8_2,
        {_full(8, 'close', 'avg(close) OVER w8 + 2 * stddev_pop(close) OVER w8')} AS bbh_8_2 FROM panel WINDOW w8 AS {_roll(8)}""",
    ("panel",),
)
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.add_named(B.panel(spark, sf_dir), ["bbl_8_2", "bbm_8_2", "bbh_8_2"])
    return settled(out.select("symbol", "date", "bbl_8_2", "bbm_8_2", "bbh_8_2"), "bbl_8_2", "bbm_8_2", "bbh_8_2")


@query(
    "i12_atr",
    f"""WITH t AS (SELECT symbol, date, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr FROM bars)
        SELECT symbol, date, {_full(5, 'tr', 'avg(tr) OVER w5')} AS atr_5 FROM t WINDOW w5 AS {_roll(5)}""",
    ("bars",),
)
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(I.add_named(B.panel(spark, sf_dir), ["atr_5"]).select("symbol", "date", "atr_5"), "atr_5")


# Exponential weights as sums over all earlier bars of a symbol; the recursive ones follow the bars one by one.

_EWM_20 = "sum(b.close * pow(1 - 2 / 21.0, a.n - b.n)) / sum(pow(1 - 2 / 21.0, a.n - b.n))"


@query("i2_ewm", f"SELECT a.symbol, a.date, {r4(_EWM_20)} AS ewm_20 FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY a.symbol, a.date", ("bars",))
def ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-2 (a), R-1: weighted from the first bar on."""
    return settled(I.add_named(B.panel(spark, sf_dir), ["ewm_20"]).select("symbol", "date", "ewm_20"), "ewm_20")


@query("r1_ewm_native", f"SELECT a.symbol, a.date, {r4(_EWM_20)} AS ewm_20 FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY a.symbol, a.date", ("bars",))
def ewm_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-1 in cells of 200 days: each cell's scan, then the states that cells begin with; no task holds a symbol."""
    p = B.panel(spark, sf_dir, cell=days(200)).select("symbol", "date", "__cell", "close")
    return settled(I.add_named(p, ["ewm_20"], F.col("__cell"), tasks=B.tasks(spark, sf_dir)).select("symbol", "date", "ewm_20"), "ewm_20")


def _ema(n: int, x: str, src: str, out: str) -> str:
    """Recursive CTEs of an EMA seeded with the mean of the first n values of x in src(symbol, k, x), k from 1."""
    return f"""{out}(symbol, k, v) AS (SELECT symbol, CAST({n} AS BIGINT), avg({x}) FROM {src} WHERE k <= {n} GROUP BY symbol HAVING count(*) = {n}
        UNION ALL SELECT s.symbol, s.k, e.v + (s.{x} - e.v) * 2 / ({n} + 1.0) FROM {out} e JOIN {src} s ON s.symbol = e.symbol AND s.k = e.k + 1)"""


_MACD = f"""
    WITH src AS MATERIALIZED (SELECT symbol, date, n AS k, close AS x FROM bars), {_ema(6, 'x', 'src', 'fast')}, {_ema(13, 'x', 'src', 'slow')},
    line AS MATERIALIZED (SELECT s.symbol, f.k AS n, f.v - s.v AS x, row_number() OVER (PARTITION BY s.symbol ORDER BY f.k) AS k FROM fast f JOIN slow s ON s.symbol = f.symbol AND s.k = f.k), {_ema(5, 'x', 'line', 'sig')}
    SELECT src.symbol, src.date, {r4('fast.v')} AS ema_6, {r4('line.x')} AS macd_6_13_5, {r4('sig.v')} AS macd_signal_6_13_5, {r4('line.x - sig.v')} AS macd_hist_6_13_5
    FROM src LEFT JOIN fast ON fast.symbol = src.symbol AND fast.k = src.k LEFT JOIN line ON line.symbol = src.symbol AND line.n = src.k LEFT JOIN sig ON sig.symbol = line.symbol AND sig.k = line.k"""


@query("i2_i10_ema_macd", _MACD, ("bars",), recursive=True)
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-2 (b), I-10."""
    names = ["ema_6", "macd_6_13_5", "macd_signal_6_13_5", "macd_hist_6_13_5"]
    out = I.add_recursive(B.panel(spark, sf_dir).select("symbol", "date", "close"), [("ema", (6,)), ("macd", (6, 13, 5))])
    return settled(out.select("symbol", "date", *names), *names)


_RSI = """m AS MATERIALIZED (SELECT symbol, date, n, CASE WHEN close > prev_close THEN close - prev_close ELSE 0 END AS up, CASE WHEN close < prev_close THEN prev_close - close ELSE 0 END AS down FROM bars WHERE n > 1),
    rs AS MATERIALIZED (SELECT a.symbol, a.date, a.n, sum(b.up * pow(1 - 1 / 7.0, a.n - b.n)) AS u, sum(b.down * pow(1 - 1 / 7.0, a.n - b.n)) AS d FROM m a JOIN m b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY ALL),
    rsi AS MATERIALIZED (SELECT symbol, date, n, CASE WHEN u + d > 0 THEN 100 * u / (u + d) END AS v FROM rs)"""


@query("r1_macd_cells", _MACD, ("bars",), recursive=True)
def macd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-1, I-2 (b), I-10 in cells of 300 days: three scans, one upon the other."""
    names = ["ema_6", "macd_6_13_5", "macd_signal_6_13_5", "macd_hist_6_13_5"]
    p = B.panel(spark, sf_dir, cell=days(300)).select("symbol", "date", "__cell", "close")
    out = I.add_recursive(p, [("ema", (6,)), ("macd", (6, 13, 5))], F.col("__cell"), B.tasks(spark, sf_dir))
    return settled(out.select("symbol", "date", *names), *names)


RSI_7 = f"WITH {_RSI} SELECT p.symbol, p.date, CASE WHEN p.n > 7 THEN {r4('v')} END AS rsi_7 FROM bars p LEFT JOIN rsi ON rsi.symbol = p.symbol AND rsi.date = p.date"


@query("i4_rsi", RSI_7, ("bars",))
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(I.add_named(B.panel(spark, sf_dir), ["rsi_7"]).select("symbol", "date", "rsi_7"), "rsi_7")


_STOCH = f"""WITH {_RSI},
    a AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi, count(v) OVER w AS c FROM rsi WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS 4 PRECEDING)),
    b AS (SELECT *, CASE WHEN c = 5 AND hi > lo THEN (v - lo) / (hi - lo) END AS s FROM a),
    k AS (SELECT *, CASE WHEN count(s) OVER w = 3 THEN avg(s) OVER w END AS k FROM b WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS 2 PRECEDING)),
    d AS (SELECT *, CASE WHEN count(k) OVER w = 4 THEN avg(k) OVER w END AS d FROM k WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS 3 PRECEDING))
    SELECT p.symbol, p.date, {r4('d.k')} AS stochrsi_k_7_5_4_3, {r4('d.d')} AS stochrsi_d_7_5_4_3 FROM bars p LEFT JOIN d ON d.symbol = p.symbol AND d.date = p.date"""


@query("i5_stochrsi", _STOCH, ("bars",))
def stochrsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["stochrsi_k_7_5_4_3", "stochrsi_d_7_5_4_3"]
    return settled(I.add_recursive(B.panel(spark, sf_dir), [("stochrsi", (7, 5, 4, 3))]).select("symbol", "date", *names), *names)


_ADX = f"""
    WITH t AS MATERIALIZED (SELECT symbol, date, n, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr,
      CASE WHEN high - prev_high > prev_low - low AND high - prev_high > 0 THEN high - prev_high ELSE 0 END AS up, CASE WHEN prev_low - low > high - prev_high AND prev_low - low > 0 THEN prev_low - low ELSE 0 END AS down FROM bars WHERE n > 1),
    s AS MATERIALIZED (SELECT a.symbol, a.date, a.n, sum(b.tr * pow(1 - 1 / 6.0, a.n - b.n)) AS tr, sum(b.up * pow(1 - 1 / 6.0, a.n - b.n)) AS up, sum(b.down * pow(1 - 1 / 6.0, a.n - b.n)) AS down FROM t a JOIN t b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY ALL),
    d AS MATERIALIZED (SELECT *, CASE WHEN tr > 0 THEN 100 * up / tr END AS p, CASE WHEN tr > 0 THEN 100 * down / tr END AS m FROM s),
    x AS MATERIALIZED (SELECT *, CASE WHEN p + m > 0 THEN 100 * abs(p - m) / (p + m) END AS dx FROM d),
    e AS MATERIALIZED (SELECT a.symbol, a.n, sum(b.dx * pow(1 - 1 / 6.0, a.n - b.n)) / sum(CASE WHEN b.dx IS NOT NULL THEN pow(1 - 1 / 6.0, a.n - b.n) END) AS adx FROM x a JOIN x b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY ALL)
    SELECT q.symbol, q.date, CASE WHEN q.n > 6 THEN {r4('e.adx')} END AS adx_6, CASE WHEN q.n > 6 THEN {r4('x.p')} END AS dmp_6, CASE WHEN q.n > 6 THEN {r4('x.m')} END AS dmn_6
    FROM bars q LEFT JOIN x ON x.symbol = q.symbol AND x.n = q.n LEFT JOIN e ON e.symbol = q.symbol AND e.n = q.n"""


@query("i9_adx", _ADX, ("bars",))
def adx(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["adx_6", "dmp_6", "dmn_6"]
    return settled(I.add_named(B.panel(spark, sf_dir), names).select("symbol", "date", *names), *names)


@query(
    "w5_w6_long_series",
    f"""WITH t AS (SELECT symbol, date, close, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr, close - lag(close, 4) OVER (PARTITION BY symbol ORDER BY date) AS mom FROM bars)
        SELECT symbol, date, {r4('mom')} AS mom_4, {_full(7, 'close', 'avg(close) OVER w7')} AS sma_7, {_full(8, 'close', 'avg(close) OVER w8 + 2 * stddev_pop(close) OVER w8')} AS bbh_8_2, {_full(5, 'tr', 'avg(tr) OVER w5')} AS atr_5, {_full(50, 'close', 'median(close) OVER w50')} AS med_50
        FROM t WINDOW w5 AS {_roll(5)}, w7 AS {_roll(7)}, w8 AS {_roll(8)}, w50 AS {_roll(50)}""",
    ("bars",),
)
def long_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-5, W-6, I-1, I-6, I-11, I-12 in buckets of 64 bars into which the bars before are copied."""
    names = ["mom_4", "sma_7", "bbh_8_2", "atr_5"]
    p = B.panel(spark, sf_dir, cell=days(200)).select("symbol", "date", "__cell", "high", "low", "close")
    out = I.add_named(p, names, F.col("__cell"), 64, B.tasks(spark, sf_dir), {"med_50": ("close", 50)})
    return settled(out.select("symbol", "date", *names, "med_50"), *names, "med_50")


@query(
    "i13_demand",
    f"""SELECT symbol, date, {r4('close - lag(close, 2) OVER w')} AS mom_2, CASE WHEN count(close) OVER w4 = 4 THEN {r4('avg(close) OVER w4')} END AS sma_4
        FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date), w4 AS {_roll(4)}""",
    ("panel",),
)
def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-13: just what the texts of rules name."""
    names = I.demanded(["sma_4 > close and mom_2 > 0", "close > sma_4 or open > 1"])
    return settled(I.add_named(B.panel(spark, sf_dir), names).select("symbol", "date", "mom_2", "sma_4"), "mom_2", "sma_4")
