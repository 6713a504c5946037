"""The registry, and SQL that queries share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions; each names those it needs.
CTES = {
    "ticks": ((), "SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, * FROM lineitem"),
    "panel": (
        ("ticks",),
        """SELECT symbol, date, first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS open, max(px) AS high, min(px) AS low,
           last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS close, sum(l_quantity) AS volume
           FROM ticks GROUP BY symbol, date""",
    ),
    "bench": (("ticks",), "SELECT date, sum(l_extendedprice) / sum(l_quantity) AS close FROM ticks GROUP BY date"),
    "cal": (("panel",), "SELECT date, row_number() OVER (ORDER BY date) - 1 AS ord FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM panel) WHERE isodow(date) < 6"),
    "flawed": (
        ("panel",),
        """SELECT symbol, date, CASE WHEN day(date) = 15 THEN NULL ELSE open END AS open, CASE WHEN day(date) = 17 THEN low - 1 ELSE high END AS high, low,
           CASE WHEN day(date) = 13 THEN NULL WHEN day(date) = 14 THEN -close ELSE close END AS close, CASE WHEN day(date) = 16 THEN 0 WHEN day(date) = 18 THEN -5 ELSE volume END AS volume FROM panel""",
    ),
    "bars": (("panel",), "SELECT *, lag(close) OVER w AS prev_close, lag(high) OVER w AS prev_high, lag(low) OVER w AS prev_low, row_number() OVER w AS n FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)"),
    "smas": (("panel",), "SELECT *, CASE WHEN count(close) OVER w5 = 5 THEN avg(close) OVER w5 END AS sma_5, CASE WHEN count(close) OVER w10 = 10 THEN avg(close) OVER w10 END AS sma_10 FROM panel WINDOW w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING), w10 AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING)"),
    "signals": (
        ("smas",),
        """SELECT 'UP_DAY' AS filter_code, 'day' AS grp, symbol, 'long' AS side, date FROM smas WHERE close > open
           UNION ALL SELECT 'DOWN_DAY', 'day', symbol, 'short', date FROM smas WHERE close < open
           UNION ALL SELECT 'SMA_UP', 'trend', symbol, NULL, date FROM smas WHERE sma_5 > sma_10""",
    ),
    "trades": (
        ("signals", "panel"),
        """SELECT s.*, p.close AS entry_close, p.nd AS exit_date, p.nc AS exit_close,
           (p.nc / p.close - 1) * 100 * CASE WHEN side = 'short' THEN -1 ELSE 1 END - 0.1 AS return_pct
           FROM signals s LEFT JOIN (SELECT *, lead(date) OVER w AS nd, lead(close) OVER w AS nc FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)) p USING (symbol, date)""",
    ),
    "bench_pct": (("bench",), "SELECT date, (lead(close) OVER (ORDER BY date) / close - 1) * 100 AS bench_ret FROM bench"),
    "dret": (("bars",), "SELECT date, avg(close / prev_close - 1) / 1000 AS r FROM bars WHERE prev_close IS NOT NULL GROUP BY date"),
    "equity": (("dret",), "SELECT date, 100.0 * exp(sum(ln(1 + r)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM dret"),
    "dd": (("equity",), "SELECT *, equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM equity"),
    "actions": (
        (),
        """SELECT 'S' || s_suppkey AS symbol, DATE '1998-01-01' + CAST(s_suppkey % 365 AS INTEGER) AS date, 0.5 AS factor FROM supplier
           UNION ALL SELECT 'S' || s_suppkey, DATE '1998-01-01' + CAST(s_suppkey % 365 + 365 AS INTEGER), 0.8 FROM supplier WHERE s_suppkey % 2 = 0""",
    ),
    "weights": ((), "SELECT date, symbol, v / sum(v) OVER (PARTITION BY date) AS weight FROM (SELECT CAST(ts AS DATE) AS date, 'U' || user_id AS symbol, sum(value) AS v FROM events GROUP BY 1, 2)"),
    "fills": ((), "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS trade_id, CAST(l_shipdate AS DATE) AS date, 'S' || l_suppkey AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_extendedprice / l_quantity AS fill_price, l_quantity AS quantity FROM lineitem"),
}


def with_ctes(sql: str, *names: str, recursive: bool = False) -> str:
    """The SQL with its common table expressions before it, each once and after those it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    head = ", ".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        body = body[5:]
        return f"WITH {'RECURSIVE ' * recursive}{head}, {body}" if head else f"WITH {'RECURSIVE ' * recursive}{body}"
    return f"WITH {head} {body}" if head else body


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = (), recursive: bool = False):
    """Register a query (spark, sf_dir) -> DataFrame under a name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *ctes, recursive=recursive)
        return f

    return add


def r4(x: str) -> str:
    """SQL of settle(x, 4)."""
    return f"floor(({x}) * 10000.0 + 0.5) / 10000.0"


def r8(x: str) -> str:
    """SQL of settle(x, 8), for money whose exact value may lie half way at fewer digits."""
    return f"floor(({x}) * 100000000.0 + 0.5) / 100000000.0"


def settled(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Round computed columns the way r4() does."""
    return df.withColumns({c: settle(F.col(c), digits) for c in columns})


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, the folder that a cluster shares; where that is unset, a temporary one if
    all of Spark runs in this process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-bars-')}"
    return f"{root.rstrip('/')}/bars-{uuid.uuid4().hex}"


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")
