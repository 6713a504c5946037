"""Queries: bars, cleaning, calendars, rules, signals, trades, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import calendar as C
from ..operators import clean, rules, summary, trades
from ..operators import indicators as I
from ..sources import bars as B
from ..sources import readers
from .base import long, query, r4, scratch, settled

RULES = [rules.Rule("UP_DAY", "close > open", "day", "long"), rules.Rule("DOWN_DAY", "close < open", "day", "short"), rules.Rule("SMA_UP", "sma_5 > sma_10", "trend", None)]


def smas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.panel(spark, sf_dir).withColumns({"sma_5": I.sma(5), "sma_10": I.sma(10)})


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scan(smas(spark, sf_dir), RULES)


def trade_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = trades.with_exits(smas(spark, sf_dir))
    return trades.settle_trades(rules.scan(bars, RULES, carry=("entry_close", "exit_date", "exit_close")), 0.1)


def bench_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.benchmark_returns(B.benchmark(spark, sf_dir)).withColumn("bench_ret", F.col("bench_ret") * 100)


def flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with defects on some days of the month."""
    day = F.dayofmonth("date")
    return B.panel(spark, sf_dir).withColumns(
        {
            "open": F.when(day != 15, F.col("open")),
            "high": F.when(day == 17, F.col("low") - 1).otherwise(F.col("high")),
            "close": F.when(day == 14, -F.col("close")).when(day != 13, F.col("close")),
            "volume": F.when(day == 16, 0.0).when(day == 18, -5.0).otherwise(F.col("volume")),
        }
    )


_METRICS = f"""
    WITH per AS (SELECT filter_code, date, avg(return_pct) AS ret, count(*) AS n FROM trades WHERE return_pct IS NOT NULL GROUP BY ALL)
    SELECT filter_code, {r4('avg(ret)')} AS mean_ret, {r4('avg(bench_ret)')} AS bench_mean_ret, {r4('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_ratio,
           CAST(sum(n) AS BIGINT) AS n_trades, {r4('avg(ret) - avg(bench_ret)')} AS alpha_ret
    FROM per LEFT JOIN bench_pct USING (date) GROUP BY filter_code"""


@query("flagship_rule_metrics", _METRICS, ("trades", "bench_pct"))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-17, B-1, A-5: screen the whole panel, hold a bar, rate the rules against the benchmark."""
    out = summary.rule_metrics(trade_table(spark, sf_dir), bench_pct(spark, sf_dir))
    return settled(out, "mean_ret", "bench_mean_ret", "hit_ratio", "alpha_ret")


@query("s1_panel", "SELECT * FROM panel", ("panel",))
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.panel(spark, sf_dir)


@query("s6_benchmark", f"SELECT date, {r4('close')} AS close FROM bench", ("bench",))
def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(B.benchmark(spark, sf_dir), "close")


@query("s9_wide_to_long", "SELECT symbol, date, close, volume FROM panel", ("panel",))
def wide_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-9: a two-field wide panel of all symbols, in pages of some hundred symbols each, and back."""
    path, fields = scratch(spark), ("close", "volume")
    readers.page_header(B.ticks(spark, sf_dir)).write.parquet(path)
    header = spark.read.parquet(path)
    pages = readers.wide_pages(B.panel(spark, sf_dir).select("symbol", "date", *fields), header, fields, B.tasks(spark, sf_dir))
    return readers.pages_to_long(pages, header, fields).where("close is not null")


@query("t1_t2_canonical_names", "SELECT 'S' || l_suppkey AS symbol, l_extendedprice AS close, l_quantity AS volume, l_tax AS sma_20, l_discount AS bbu_20_2 FROM lineitem")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-1, T-2, T-4: provider spellings to canonical names; of two closes the first stays."""
    raw = B.read(spark, sf_dir, "lineitem").select(B.symbol_of("l_suppkey").alias("Symbol"), F.col("l_extendedprice").alias("KAPANIŞ"), F.col("l_quantity").alias("İşlem Hacmi"), F.col("l_tax").alias("SMA20"), F.col("l_discount").alias("BBUpper_20_2.0"), F.col("l_tax").alias("Close"))
    out, _ = clean.canonicalise(raw, policy="prefer_first")
    return out


@query("t3_equal_columns", "SELECT 'S' || l_suppkey AS symbol, l_extendedprice AS close, l_tax AS close_alt FROM lineitem")
def equal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-3: a copy that holds the same data goes, another is renamed."""
    raw = B.read(spark, sf_dir, "lineitem").select(B.symbol_of("l_suppkey").alias("symbol"), F.col("l_extendedprice").alias("close"), F.col("l_extendedprice").alias("Kapanis"), F.col("l_tax").alias("CLOSE "))
    return clean.merge_equal_columns(raw)


@query("t6_clean_panel", "SELECT symbol, date, open, high, low, close, volume FROM flawed WHERE close IS NOT NULL", ("flawed",))
def clean_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-6 on twice the rows, with padded lower-case symbols and dates as text."""
    f = flawed(spark, sf_dir)
    raw = f.unionByName(f).withColumns({"symbol": F.concat(F.lit(" "), F.lower("symbol")), "date": F.date_format("date", "dd.MM.yyyy"), "close": F.coalesce(F.col("close"), F.lit(float("nan")))})
    return clean.clean_panel(raw)


@query("t7_clean_loaded", "SELECT symbol, date, open, high, low, close, volume FROM flawed WHERE open >= 0 AND high >= 0 AND low >= 0 AND close >= 0 AND volume >= 0", ("flawed",))
def clean_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_loaded(flawed(spark, sf_dir).withColumn("date", F.concat(F.col("date").cast("string"), F.lit("T00:00:00"))))


@query("t8_clean_provider", "SELECT symbol, date, floor(close) AS close, CAST(trunc(coalesce(volume, 0)) AS BIGINT) AS volume FROM panel", ("panel",))
def clean_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-8, T-9: numbers written 1.234,0 and dates written day first."""
    p = B.panel(spark, sf_dir)
    text = lambda c: F.concat(F.translate(F.format_number(F.floor(c), 0), ",", "."), F.lit(",0"))
    raw = p.select("symbol", F.date_format("date", "dd/MM/yyyy").alias("Date"), text(F.col("close")).alias("CLOSE"), text(F.col("volume")).alias("Volume"))
    return clean.clean_provider(raw)


_ADJUSTED = """
    SELECT p.symbol, p.date, p.close * coalesce(f, 1) AS close, p.volume / coalesce(f, 1) AS volume
    FROM panel p LEFT JOIN (SELECT p.symbol, p.date, product(a.factor) AS f FROM panel p JOIN actions a ON a.symbol = p.symbol AND a.date > p.date GROUP BY ALL) x
    ON x.symbol = p.symbol AND x.date = p.date"""


@query("t10_j3_corporate_actions", f"SELECT symbol, date, {r4('close')} AS close, {r4('volume')} AS volume FROM ({_ADJUSTED})", ("panel", "actions"))
def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-10, J-3, W-8: back-adjustment by a strict forward as-of join."""
    out = clean.adjust_for_actions(B.panel(spark, sf_dir), readers.validated_actions(B.actions(spark, sf_dir)))
    return settled(out.select("symbol", "date", "close", "volume"), "close", "volume")


@query("w8_suffix_factors", f"SELECT a.symbol, a.date, a.factor, {r4('product(b.factor)')} AS cum_factor FROM actions a JOIN actions b ON a.symbol = b.symbol AND b.date >= a.date GROUP BY ALL", ("actions",))
def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(clean.suffix_factors(B.actions(spark, sf_dir)), "cum_factor")


@query("t11_delay", "SELECT symbol, date, coalesce(lag(close > open) OVER (PARTITION BY symbol ORDER BY date), false) AS sig FROM panel", ("panel",))
def delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.delay(B.panel(spark, sf_dir).withColumn("sig", F.col("close") > F.col("open")).select("symbol", "date", "sig"), ["sig"])


# ------------------------------------------------------------------ predicates


@query(
    "p1_p4_predicates",
    """SELECT symbol, date, coalesce(close > open, false) AS gt, coalesce(open < close AND close <= high, false) AS chained, NOT coalesce(close > prev_close, false) AS not_up,
       coalesce(close <> prev_close, false) AS differs, coalesce(close - prev_close, 0) <> 0 AS truth, close IN (open, high) AS among, prev_close IS NOT NULL AS there, regexp_matches(symbol, '^S1') AS pattern, symbol = 'S1' AS text FROM bars""",
    ("bars",),
)
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-1, P-2, P-4, P-11, P-12, P-13: what is missing compares as false."""
    p = B.panel(spark, sf_dir).withColumn("before", F.lag("close").over(I.by_symbol()))
    return p.select("symbol", "date", S.gt("close", "open").alias("gt"), S.chain("open", ("<", "close"), ("<=", "high")).alias("chained"), (~S.gt("close", "before")).alias("not_up"), S.ne("close", "before").alias("differs"), S.nonzero(F.col("close") - F.col("before")).alias("truth"), S.one_of("close", [F.col("open"), F.col("high")]).alias("among"), S.present("before").alias("there"), S.contains_pattern("symbol", "^S1").alias("pattern"), S.eq("symbol", F.lit("S1")).alias("text"))


@query(
    "p3_f1_arithmetic",
    f"""SELECT symbol, date, CASE WHEN high - low = 0 THEN NULL ELSE {r4('(close - low) / (high - low)')} END AS place,
        {r4('(close - 1000) - 7 * floor((close - 1000) / 7)')} AS mod7, {r4('(close - 1000) - (-7) * floor((close - 1000) / (-7))')} AS mod_neg,
        {r4('abs(open - close)')} AS gap, {r4('ln(close)')} AS log_close, {r4('exp(-volume / 50)')} AS decay, floor(close) AS fl, ceil(close) AS ce, greatest(open, close) AS top, least(greatest(volume, 10), 40) AS clipped FROM panel""",
    ("panel",),
)
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-3, F-1, F-2: division by 0 is null, a remainder has the divisor's sign."""
    p = B.panel(spark, sf_dir)
    c = F.col("close")
    out = p.select("symbol", "date", S.divide(c - F.col("low"), F.col("high") - F.col("low")).alias("place"), S.modulo(c - 1000, F.lit(7.0)).alias("mod7"), S.modulo(c - 1000, F.lit(-7.0)).alias("mod_neg"), F.abs(F.col("open") - c).alias("gap"), F.ln("close").alias("log_close"), F.exp(-F.col("volume") / 50).alias("decay"), F.floor(c).cast("double").alias("fl"), F.ceil(c).cast("double").alias("ce"), F.greatest("open", "close").alias("top"), S.clip("volume", 10.0, 40.0).alias("clipped"))
    return settled(out, "place", "mod7", "mod_neg", "gap", "log_close", "decay")


_CROSS = """
    SELECT symbol, date, coalesce(p5 <= p10 AND sma_5 > sma_10, false) AS up, coalesce(p5 >= p10 AND sma_5 < sma_10, false) AS down,
           coalesce(pc <= 1500 AND close > 1500, false) AS over_level, coalesce(pc >= 1500 AND close < 1500, false) AS under_level, coalesce(pc > 1500 AND close <= 1500, false) AS falls,
           coalesce(p5 <= p10 AND sma_5 > sma_10, false) AND nd IS NOT NULL AS up_masked
    FROM (SELECT *, lag(sma_5) OVER w AS p5, lag(sma_10) OVER w AS p10, lag(close) OVER w AS pc, lead(date) OVER w AS nd FROM smas WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


@query("p5_p10_crossings", _CROSS, ("smas",))
def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-5 to P-10: crossings of series and levels, in both forms."""
    specs = [("up", "up", "sma_5", "sma_10"), ("down", "down", "sma_5", "sma_10"), ("over_level", "up", "close", 1500.0), ("under_level", "down", "close", 1500.0), ("skipped", "up", "absent", 1.0)]
    out, _ = rules.add_crossovers(smas(spark, sf_dir), specs)
    w = I.by_symbol()
    return out.select("symbol", "date", "up", "down", "over_level", "under_level", S.falls_to("close", F.lit(1500.0), w).alias("falls"), S.not_on_last_bar(F.col("up"), w).alias("up_masked"))


@query("p14_keep", "SELECT symbol, date, close FROM smas WHERE coalesce(sma_5 > sma_10, false)", ("smas",))
def keep_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.keep(smas(spark, sf_dir), "sma_5 > sma_10").select("symbol", "date", "close")


@query("p15_p16_scan_day", "SELECT filter_code, grp, symbol, side, date FROM signals WHERE date = DATE '1998-06-15'", ("signals",))
def scan_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-15, P-16: one day, on the whole history."""
    return rules.scan_day(smas(spark, sf_dir), RULES, "1998-06-15")


@query("p17_scan_range", "SELECT filter_code, grp, symbol, side, date FROM signals", ("signals",))
def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-17 with P-18, P-19 and Q-4: rules picked by pattern, empty and broken ones left out."""
    more = [*RULES, rules.Rule("EMPTY", ""), rules.Rule("BROKEN", "no_such_column > 1"), rules.Rule("AHEAD", "lead(close) over (order by date) > close"), rules.Rule("SIDE", "true", None, "foo"), rules.Rule("OTHER", "true")]
    chosen, _ = rules.tidy(rules.select_codes(more, ["*_DAY", "SMA_*", "EMPTY", "BROKEN", "AHEAD", "SIDE"]))
    return rules.scan_range(smas(spark, sf_dir), chosen, "1990-01-01", "2010-01-01")


@query(
    "p17_many_rules",
    "SELECT 'R' || lpad(CAST(k AS VARCHAR), 3, '0') AS filter_code, count(*) AS hits FROM smas, (SELECT unnest(generate_series(0, 299)) AS k) WHERE close > sma_5 * (1 + (k - 150) / 1000.0) AND sma_5 IS NOT NULL GROUP BY ALL",
    ("smas",),
)
def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 rules over the whole panel in one plan, counted by rule."""
    many = [rules.Rule(f"R{k:03d}", f"close > sma_5 * (1 + ({k} - 150) / 1000.0D)") for k in range(300)]
    return rules.count_hits(smas(spark, sf_dir), many)


@query(
    "q4_k10_rule_audit",
    "SELECT r.code, d.date, coalesce(h.hits, 0) AS hits FROM (VALUES ('DOWN_DAY'), ('UP_DAY'), ('BROKEN')) r(code) CROSS JOIN (SELECT DISTINCT date FROM panel) d LEFT JOIN (SELECT filter_code, date, count(*) AS hits FROM signals GROUP BY ALL) h ON h.filter_code = r.code AND h.date = d.date",
    ("signals", "panel"),
)
def audit_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-4, K-10: every day of the panel."""
    p = smas(spark, sf_dir)
    return rules.rule_audit(p, [*RULES[:2], rules.Rule("BROKEN", "no_such_column > 1")], p.select("date").distinct()).select("code", "date", "hits")


# ------------------------------------------------------------------ calendars and trades


@query("b5_w14_trading_days", "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS ord FROM cal WHERE NOT (month(date) = 1 AND day(date) = 1)", ("cal",))
def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-5, S-5, W-14: weekdays of the span without new-year days, numbered."""
    p = B.panel(spark, sf_dir)
    off = p.where("month(date) = 1 and day(date) = 1").select("date").union(spark.sql("select explode(sequence(date'1990-01-01', date'2010-01-01', interval 1 year)) as date"))
    return C.trading_days(p, off)


@query("w2_next_bar", "SELECT symbol, date, close, lead(date) OVER w AS next_date, lead(close) OVER w AS next_close FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)", ("panel",))
def next_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.next_bar(B.panel(spark, sf_dir).select("symbol", "date", "close"))


@query("w3_j4_next_by_calendar", "SELECT p.symbol, p.date, p.close, n.date AS next_date, q.close AS next_close FROM panel p LEFT JOIN cal c ON c.date = p.date LEFT JOIN cal n ON n.ord = c.ord + 1 LEFT JOIN panel q ON q.symbol = p.symbol AND q.date = n.date", ("panel", "cal"))
def next_by_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.panel(spark, sf_dir)
    return C.next_by_calendar(p.select("symbol", "date", "close"), C.trading_days(p))


@query("j7_q9_missing_days", "SELECT s.symbol, CAST(count(*) AS BIGINT) AS missing FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM panel GROUP BY symbol) s JOIN cal c ON c.date BETWEEN s.a AND s.b LEFT JOIN panel p ON p.symbol = s.symbol AND p.date = c.date WHERE p.symbol IS NULL GROUP BY s.symbol", ("panel", "cal"))
def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.panel(spark, sf_dir)
    return C.missing_days(p, C.trading_days(p)).groupBy("symbol").agg(F.count(F.lit(1)).alias("missing"))


@query("q9_missing_panel_days", "SELECT date FROM cal WHERE date NOT IN (SELECT date FROM panel)", ("panel", "cal"))
def missing_panel_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.panel(spark, sf_dir)
    return C.check_missing(p, C.trading_days(p), raise_error=False)


@query("b1_j1_trades", f"SELECT filter_code, grp, symbol, date, entry_close, exit_date, exit_close, coalesce(side, 'long') AS side, {r4('return_pct')} AS return_pct, return_pct > 0 AS win, CASE WHEN exit_close IS NULL THEN 'Invalid ExitClose' END AS reason FROM trades", ("trades",))
def trades_one_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-1, J-1, J-2, W-2: the next bar of each symbol."""
    return settled(trade_table(spark, sf_dir), "return_pct")


_REASONS = f"""
    WITH s AS (SELECT symbol, date, CASE WHEN day(date) % 4 = 0 THEN 'foo' WHEN day(date) % 4 = 1 THEN 'SHORT ' WHEN day(date) % 4 = 2 THEN '' END AS side FROM panel WHERE day(date) BETWEEN 10 AND 20),
    x AS (SELECT s.*, e.close AS entry_close, n.date AS exit_date, q.close AS exit_close FROM s LEFT JOIN flawed e ON e.symbol = s.symbol AND e.date = s.date
          LEFT JOIN cal c ON c.date = s.date LEFT JOIN cal n ON n.ord = c.ord + 3 LEFT JOIN flawed q ON q.symbol = s.symbol AND q.date = n.date),
    y AS (SELECT *, CASE WHEN side = 'foo' THEN 'Invalid Side' WHEN NOT coalesce(entry_close > 0, false) THEN 'Invalid EntryClose' WHEN NOT coalesce(exit_close > 0, false) THEN 'Invalid ExitClose' END AS reason FROM x)
    SELECT symbol, date, entry_close, exit_date, exit_close, CASE WHEN side = 'foo' THEN 'foo' WHEN side = 'SHORT ' THEN 'short' ELSE 'long' END AS side, reason,
           CASE WHEN reason IS NULL THEN {r4("(exit_close / entry_close - 1) * 100 * CASE WHEN side = 'SHORT ' THEN -1 ELSE 1 END - 0.2")} END AS return_pct FROM y"""


@query("b2_b4_reasons", _REASONS.replace(" WHERE day(date) BETWEEN 10 AND 20", ""), ("panel", "flawed", "cal"))
def reasons_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-2, B-3, B-4, J-4: a signal for every bar of the panel."""
    p, f = B.panel(spark, sf_dir), flawed(spark, sf_dir)
    day = F.dayofmonth("date")
    s = p.select(F.lit("A").alias("filter_code"), "symbol", F.when(day % 4 == 0, "foo").when(day % 4 == 1, "SHORT ").when(day % 4 == 2, "").alias("side"), "date")
    return settled(trades.returns(f, s, 3, 0.2, C.trading_days(p)).select("symbol", "date", "entry_close", "exit_date", "exit_close", "side", "reason", "return_pct"), "return_pct")


# ------------------------------------------------------------------ summaries


@query("a1_signal_counts", "SELECT date, filter_code, count(*) AS signals FROM signals GROUP BY ALL", ("signals",))
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.signal_counts(signals(spark, sf_dir))


_DAILY = f"""
    SELECT c.date, c.signals, c.filters, f.coverage, {r4('f.m')} AS mean_ret, {r4('b.r')} AS bench_ret, {r4('f.m - b.r')} AS alpha
    FROM (SELECT date, count(*) AS signals, count(DISTINCT filter_code) AS filters FROM signals GROUP BY date) c
    JOIN (SELECT s.date, count(fwd) AS coverage, avg(fwd) AS m FROM (SELECT DISTINCT symbol, date FROM signals) s LEFT JOIN (SELECT symbol, date, lead(close, 2) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS fwd FROM panel) p USING (symbol, date) GROUP BY s.date) f USING (date)
    LEFT JOIN (SELECT date, lead(close, 2) OVER (ORDER BY date) / close - 1 AS r FROM bench) b USING (date)"""


@query("a2_a3_daily_summary", _DAILY, ("signals", "panel", "bench"))
def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-2, A-3, J-6, W-4: two-bar forward returns against the benchmark."""
    _, table, _ = summary.summarise_range(B.panel(spark, sf_dir), signals(spark, sf_dir), B.benchmark(spark, sf_dir), 2)
    return settled(table, "mean_ret", "bench_ret", "alpha")


@query("a8_kpi", f"WITH d AS ({_DAILY}) SELECT unnest(['total_days', 'mean_alpha', 'pos_alpha_ratio', 'mean_signals']) AS metric, unnest([CAST(count(*) AS DOUBLE), {r4('avg(alpha)')}, {r4('avg(CASE WHEN alpha > 0 THEN 1.0 WHEN alpha IS NOT NULL THEN 0.0 END)')}, {r4('avg(signals)')}]) AS value FROM d", ("signals", "panel", "bench"))
def kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(summary.kpi(daily(spark, sf_dir)), "value")


@query("a4_rule_by_day", f"SELECT filter_code, coalesce(side, 'long') AS side, date, {r4('avg(return_pct)')} AS mean_ret FROM trades WHERE return_pct IS NOT NULL GROUP BY ALL", ("trades",))
def rule_by_day_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-4: every day, in the long form."""
    return settled(summary.rule_side_day(trade_table(spark, sf_dir)).select("filter_code", "side", "date", F.col("ret").alias("mean_ret")), "mean_ret")


_MONTHS = [f"{y}-{m:02d}" for y in range(1992, 1999) for m in range(1, 13)]


@query("a4_rule_pivot", "SELECT filter_code, coalesce(side, 'long') AS side, " + ", ".join(f"""{r4(f"avg(return_pct) FILTER (strftime(date, '%Y-%m') = '{m}')")} AS "{m}\"""" for m in _MONTHS) + " FROM trades WHERE return_pct IS NOT NULL GROUP BY ALL", ("trades",))
def rule_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-4: the pivot itself, a column a month of the tables' span."""
    t = trade_table(spark, sf_dir).where("return_pct is not null").withColumn("date", F.date_format("date", "yyyy-MM"))
    return settled(summary.rule_by_day(t, _MONTHS, by_side=True), *_MONTHS)


@query("a1_a9_hit_counts", "SELECT date, filter_code, count(*) AS hits FROM signals GROUP BY ALL", ("signals",))
def hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-1, A-9 from the rules themselves: a day's hits counted without a row for each."""
    return rules.count_hits(smas(spark, sf_dir), RULES, ("date",))


@query("a24_win_rate", f"SELECT filter_code, date, {r4('avg(CAST(return_pct > 0 AS DOUBLE))')} AS win_rate FROM trades WHERE return_pct IS NOT NULL GROUP BY ALL", ("trades",))
def win_rate_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-24: every day, in the long form."""
    return settled(summary.win_day(trade_table(spark, sf_dir)), "win_rate")


@query("a5_o3_ranked_rules", f"SELECT * EXCLUDE (n_trades, hit_ratio), CAST(row_number() OVER (ORDER BY alpha_ret DESC, filter_code) AS INTEGER) AS place FROM ({_METRICS.replace('WITH per', 'WITH per')}) LIMIT 2", ("trades", "bench_pct"))
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-5, O-3: the two best rules by alpha."""
    top = summary.ranked(settled(summary.rule_metrics(trade_table(spark, sf_dir), bench_pct(spark, sf_dir)), "mean_ret", "bench_mean_ret", "alpha_ret"), 2)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.col("alpha_ret").desc(), "filter_code"))).select("filter_code", "mean_ret", "bench_mean_ret", "alpha_ret", "place")


@query("a6_against_benchmark", f"SELECT filter_code, date, {r4('avg(return_pct) - any_value(bench_ret)')} AS diff FROM trades JOIN bench_pct USING (date) WHERE return_pct IS NOT NULL AND bench_ret IS NOT NULL GROUP BY ALL", ("trades", "bench_pct"))
def against_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-6: all days but those that the benchmark has no value for."""
    bench = bench_pct(spark, sf_dir)
    t = trade_table(spark, sf_dir).join(F.broadcast(bench.where("bench_ret is not null").select("date")), "date", "left_semi")
    return settled(summary.against_benchmark(t, bench), "diff")


@query("a7_trade_days", f"SELECT date, count(*) AS n_trades, {r4('avg(return_pct)')} AS mean_ret, {r4('avg(CAST(return_pct > 0 AS DOUBLE))')} AS hit_ratio FROM trades WHERE return_pct IS NOT NULL GROUP BY date", ("trades",))
def trade_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(summary.trade_days(trade_table(spark, sf_dir)), "mean_ret", "hit_ratio")


@query("a9_counts_by_day", "SELECT date, count(*) FILTER (filter_code = 'UP_DAY') AS up, count(*) FILTER (filter_code = 'DOWN_DAY') AS down, count(*) FILTER (filter_code = 'SMA_UP') AS sma FROM signals GROUP BY date", ("signals",))
def counts_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.counts_by_day(signals(spark, sf_dir), ["UP_DAY", "DOWN_DAY", "SMA_UP"])
    return out.select("date", long("UP_DAY").alias("up"), long("DOWN_DAY").alias("down"), long("SMA_UP").alias("sma"))
