"""Queries: data quality and guardrails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import quality as Q
from ..sources import bars as B
from .bars import flawed
from .base import query, r4, settled


@query("a10_profile", "SELECT symbol, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (close IS NULL) AS null_closes, count(date) - count(DISTINCT date) AS duplicates FROM (SELECT * FROM flawed UNION ALL SELECT * FROM flawed WHERE day(date) = 1) GROUP BY symbol", ("flawed",))
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flawed(spark, sf_dir)
    return Q.profile(f.unionByName(f.where("day(date) = 1")))


@query(
    "q1_row_issues",
    """SELECT symbol, date, 'non_positive_close' AS issue FROM flawed WHERE close <= 0 UNION ALL SELECT symbol, date, 'na_close' FROM flawed WHERE close IS NULL
       UNION ALL SELECT symbol, date, 'non_positive_volume' FROM flawed WHERE volume <= 0 UNION ALL SELECT symbol, date, 'high_lt_low' FROM flawed WHERE high < low UNION ALL SELECT symbol, date, 'na_open' FROM flawed WHERE open IS NULL""",
    ("flawed",),
)
def row_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.row_issues(flawed(spark, sf_dir)).select("symbol", "date", "issue")


_CONTRACT = """c AS (SELECT symbol, CAST(count(date) - count(DISTINCT date) AS DOUBLE) AS duplicate_dates, CAST(count(*) FILTER (volume < 0) AS DOUBLE) AS negative_volume,
      CAST(count(*) FILTER (coalesce(low > least(open, high, low, close), false) OR coalesce(high < greatest(open, high, low, close), false)) AS DOUBLE) AS bounds,
      greatest(count(*) FILTER (open IS NULL), count(*) FILTER (close IS NULL)) / count(*) AS null_ratio, (count(date) - count(DISTINCT date)) / count(*) AS duplicate_ratio
    FROM (SELECT * FROM flawed UNION ALL SELECT * FROM flawed WHERE day(date) = 1) GROUP BY symbol)"""


@query("q2_contract", f"WITH {_CONTRACT} SELECT symbol, problem, CASE WHEN problem LIKE '%ratio' THEN 'warning' ELSE 'critical' END AS severity, {r4('amount')} AS amount FROM (UNPIVOT c ON duplicate_dates, negative_volume, bounds, null_ratio, duplicate_ratio INTO NAME problem VALUE amount) WHERE amount > CASE WHEN problem = 'null_ratio' THEN 0.02 ELSE 0 END", ("flawed",))
def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flawed(spark, sf_dir)
    return settled(Q.contract(f.unionByName(f.where("day(date) = 1"))), "amount")


@query(
    "q3_store_integrity",
    """WITH g AS (SELECT s.symbol, count(*) AS gaps FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM flawed GROUP BY symbol) s JOIN cal c ON c.date BETWEEN s.a AND s.b LEFT JOIN flawed p ON p.symbol = s.symbol AND p.date = c.date WHERE p.symbol IS NULL GROUP BY s.symbol),
       f AS (SELECT symbol, count(*) FILTER (open IS NULL OR close IS NULL) > 0 AS n, count(*) FILTER (isodow(date) > 5) > 0 AS w FROM flawed GROUP BY symbol)
       SELECT s.symbol, concat_ws(',', CASE WHEN g.gaps IS NOT NULL THEN 'gaps' END, CASE WHEN f.symbol IS NULL THEN 'missing' END, CASE WHEN f.n THEN 'nan_values' END, CASE WHEN f.w THEN 'weekend' END) AS issues
       FROM (SELECT DISTINCT symbol FROM flawed UNION ALL SELECT 'NOPE') s LEFT JOIN f ON f.symbol = s.symbol LEFT JOIN g ON g.symbol = s.symbol""",
    ("flawed", "cal"),
)
def store_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flawed(spark, sf_dir)
    asked = f.select("symbol").distinct().union(spark.sql("select 'NOPE'"))
    return Q.store_integrity(f, asked, C.trading_days(f)).select("symbol", F.array_join("issues", ",").alias("issues"))


@query("q6_warm_up", "SELECT symbol, count(*) FILTER (close > open) AS early FROM bars WHERE n <= 9 GROUP BY symbol", ("bars",))
def warm_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.warm_up(B.panel(spark, sf_dir).withColumn("sig", F.col("close") > F.col("open")), "sig", 9)


@query("q6_silenced", "SELECT symbol, date, CASE WHEN n > 9 THEN close > open END AS sig FROM bars", ("bars",))
def silenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.panel(spark, sf_dir).select("symbol", "date", (F.col("close") > F.col("open")).alias("sig"))
    return Q.silence_warm_up(p, ["sig"], 9)


@query("q7_misaligned", "SELECT symbol, date, 'left' AS side FROM panel WHERE day(date) = 2 UNION ALL SELECT symbol, date, 'right' FROM panel WHERE day(date) = 3", ("panel",))
def misaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.panel(spark, sf_dir, "symbol", "date")
    return Q.misaligned(p.where("day(date) <> 3"), p.where("day(date) <> 2"), tasks=B.tasks(spark, sf_dir))


@query("w11_monotonic", "SELECT symbol, count(*) FILTER (date < p) AS backward, count(date) - count(DISTINCT date) AS repeated FROM (SELECT symbol, date, lag(date) OVER (PARTITION BY symbol ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS p FROM ticks) GROUP BY symbol", ("ticks",))
def monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.monotonic(B.ticks(spark, sf_dir), "at")


@query("q8_preflight", "SELECT date, count(*) AS rows FROM panel WHERE date = DATE '1998-06-15' GROUP BY date", ("panel",))
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.panel(spark, sf_dir)
    n, missing = Q.preflight_day(p, "1998-06-15", ["symbol", "date", "close"])
    if missing:
        raise ValueError(f"missing {missing}")
    return p.where("date = '1998-06-15'").groupBy("date").agg(F.count(F.lit(1)).alias("rows")).where(F.lit(n > 0))


@query("q10_absent_inputs", "SELECT date FROM cal WHERE date NOT IN (SELECT date FROM panel)", ("panel", "cal"))
def absent_inputs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-10: the days of all symbols over the panel's span."""
    p = B.panel(spark, sf_dir)
    start, end = p.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    return Q.absent_inputs(spark, p.select(F.concat(F.lit("signals_"), F.col("date").cast("string"), F.lit(".csv")).alias("name")), start, end)


@query("j8_unknown_codes", "SELECT DISTINCT filter_code, symbol FROM signals WHERE filter_code <> 'UP_DAY'", ("signals",))
def unknown_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bars import signals

    s = signals(spark, sf_dir).select("filter_code", "symbol").distinct()
    return Q.unknown_codes(s, spark.sql("select 'UP_DAY' as filter_code")).select("filter_code", "symbol")
