"""Hand-valued cases of the operators, invariants, and files."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewright.functions import names
from tapewright.functions import scalar as S
from tapewright.operators import calendar as C
from tapewright.operators import clean, folds, orders, quality, rules, summary, trades
from tapewright.operators import indicators as I
from tapewright.operators import metrics as M
from tapewright.sources import readers, writers

PANEL = "symbol string, date date, open double, high double, low double, close double, volume double"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def panel(spark, closes, symbol="AAA", start=0):
    rows = [(symbol, day(start + i), c, None if c is None else c + 1, None if c is None else c - 1, c, 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, PANEL)


def signals(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3] if len(r) > 3 else None) for r in rows], "filter_code string, symbol string, date date, side string")


# ------------------------------------------------------------------ names and cleaning


@pytest.mark.parametrize(
    ("name", "want"),
    [("Kapanış", "close"), ("İşlem Hacmi", "volume"), ("SMA20", "sma_20"), ("RSI_14", "rsi_14"), ("BBUpper20_2.0", "bbu_20_2"), ("BBM_20_2.5", "bbm_20_2p5"), ("+DI14", "plus_di_14"), ("-DI_14", "minus_di_14"), ("bbl_20_2p05", "bbl_20_2p05"), ("Adj Close", "adj_close"), ("", "")],
)
def test_canonical_names(name, want):
    assert names.canonical(name) == want


@given(st.text(alphabet="abcXYZ _-.0123ğİı", min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_canonical_is_stable(name):
    once = names.canonical(name)
    assert names.canonical(once) == once or not once.strip()


def test_collisions(spark):
    assert names.canonical("Adj Close", {"Adj Close": "close"}) == "close"
    with pytest.raises(clean.NameCollision):
        clean.plan_names(["Close", "close"])
    assert clean.plan_names(["Close", "KAPANIS", "x"], policy="prefer_first").kept == {"Close": "close", "x": "x"}
    assert clean.plan_names(["Close", "KAPANIS"], policy="suffix").kept == {"Close": "close", "KAPANIS": "close_dup1"}
    with pytest.raises(clean.MissingColumns, match="volume"):
        clean.require(spark.createDataFrame([("A", 1.0)], "symbol string, close double"))


def test_locale_numbers_and_dates(spark):
    df = spark.createDataFrame([("1.234,5", "07.03.2025"), ("x", "2025-03-07"), (None, "07/03/2025"), ("-3,25", "nope")], "n string, d string")
    rows = df.select(S.local_number("n").alias("n"), S.mixed_date("d").alias("d")).collect()
    assert [r["n"] for r in rows] == [1234.5, None, None, -3.25]
    assert [r["d"] for r in rows] == [dt.date(2025, 3, 7)] * 3 + [None]


def test_written_dates_do_not_pass_through_a_time_zone(spark):
    """Apia had no 30th of December 2011, so that its midnight is one of the day after."""
    texts = ["2011-12-30", " 2011-12-30T10:00 ", "2024-02-30", "2024-13-01", "2024-1-5", "2024", "2024-01-0\n", "05.01.2024"]
    held = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Apia")
    try:
        got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "d string").select(S.mixed_date("d")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)
    assert got == [dt.date(2011, 12, 30)] * 2 + [None] * 5 + [dt.date(2024, 1, 5)]


def test_corporate_actions_equal_a_loop(spark):
    p = panel(spark, [10.0, 20.0, 30.0]).unionByName(panel(spark, [8.0, 9.0], "BBB"))
    actions = spark.createDataFrame([("AAA", day(1), 0.5), ("AAA", day(2), 0.5), ("BBB", day(5), 0.1)], "symbol string, date date, factor double")
    got = {(r["symbol"], r["date"]): (r["close"], r["volume"]) for r in clean.adjust_for_actions(p, actions).collect()}
    assert got[("AAA", day(0))] == (2.5, 400.0) and got[("AAA", day(1))] == (10.0, 200.0) and got[("AAA", day(2))] == (30.0, 100.0)
    assert got[("BBB", day(1))][0] == pytest.approx(0.9)
    for bad in (0.0, -1.0, None):
        with pytest.raises(readers.BadTable):
            readers.validated_actions(spark.createDataFrame([("A", day(1), bad)], "symbol string, date date, factor double"))


# ------------------------------------------------------------------ predicates


def test_crossings_by_hand(spark):
    df = spark.createDataFrame([("A", day(i), float(a), float(b)) for i, (a, b) in enumerate([(1, 2), (3, 2), (1, 2), (2, 2)])], "symbol string, date date, a double, b double")
    w = I.by_symbol()
    rows = df.select("date", S.cross_up("a", "b", w).alias("u"), S.cross_down("a", "b", w).alias("d"), S.falls_to("a", 2.0, w).alias("f"), S.falls_to("a", F.lit(2.0), w).alias("g")).orderBy("date").collect()
    assert [r["u"] for r in rows] == [False, True, False, False] and [r["d"] for r in rows] == [False, False, True, False]
    assert [r["f"] for r in rows] == [r["g"] for r in rows] == [False, False, True, False]
    assert not any(r["u"] and r["d"] for r in rows)


def test_rules_are_checked(spark):
    p = panel(spark, [1.0, 2.0])
    with pytest.raises(rules.RuleError):
        rules.from_table([{"FilterCode": "A", "PythonQuery": "true"}, {"FilterCode": "A", "PythonQuery": "true"}])
    with pytest.raises(rules.RuleError):
        rules.scan(p, [rules.Rule("X", "nope > 1")], on_error="raise")
    with pytest.raises(rules.RuleError):
        rules.keep(p, "close + 1")
    with pytest.raises(rules.RuleError):
        rules.scan_range(p, [rules.Rule("X")], "1990-01-01", "1990-02-01")
    assert rules.scan(p, [rules.Rule("N", "close - 1"), rules.Rule("T", "true", "g", "long")]).count() == 3
    assert rules.scan(p, []).count() == 0
    rising = rules.Rule("UP", "close > lag(close) over (partition by symbol order by date)")
    assert rules.scan_day(p, [rising, rules.Rule("IT'S \\", "true")], day(1)).count() == 2  # a day sees the history before it
    assert [a["reason"] for a in rules.audit(p, [rules.Rule("A", "shift(-1) > 0"), rules.Rule("S", "true", None, "foo")])] == ["looks ahead", "invalid side foo"]
    out, skipped = rules.add_crossovers(p)
    assert out.columns == p.columns and len(skipped) == 4


# ------------------------------------------------------------------ trades and summaries


def test_returns_by_hand(spark):
    p = panel(spark, [10.0, 11.0, 12.1])
    s = signals(spark, ("T1", "AAA", day(0)), ("T1", "AAA", day(0)), ("T2", "AAA", day(0), "short"), ("T3", "AAA", day(0), "foo"), ("T4", "AAA", day(2)), ("T5", "ZZZ", day(0)))
    got = {r["filter_code"]: r for r in trades.returns(p, s, 1, 1.0).collect()}
    assert len(got) == 5
    assert got["T1"]["return_pct"] == pytest.approx(9.0) and got["T1"]["win"] and got["T1"]["side"] == "long"
    assert got["T2"]["return_pct"] == pytest.approx(-11.0) and not got["T2"]["win"]
    assert (got["T3"]["reason"], got["T4"]["reason"], got["T5"]["reason"]) == ("Invalid Side", "Invalid ExitClose", "Invalid EntryClose")
    two = trades.returns(p, s.where("filter_code = 'T1'"), 2, 0.0).first()
    assert two["return_pct"] == pytest.approx(21.0) and two["exit_date"] == day(2)


def test_bar_mode_for_longer_holdings_and_duplicates(spark):
    p = panel(spark, [10.0, 11.0]).unionByName(panel(spark, [12.0], start=7)).unionByName(panel(spark, [10.0, 11.0]))
    r = trades.returns(p, signals(spark, ("T", "AAA", day(0))), 2, mode="bars").collect()
    assert len(r) == 1 and r[0]["exit_date"] == day(7) and r[0]["return_pct"] == pytest.approx(20.0)


def test_daily_summary_by_hand(spark):
    p = panel(spark, [100.0, 110.0]).unionByName(panel(spark, [50.0, 55.0], "BBB"))
    bench = spark.createDataFrame([(day(0), 100.0), (day(1), 101.0)], "date date, close double")
    d = summary.daily(p, signals(spark, ("X", "AAA", day(0)), ("Y", "AAA", day(0)), ("X", "BBB", day(0))), bench).first()
    assert (d["signals"], d["filters"], d["coverage"]) == (3, 2, 2)
    assert d["mean_ret"] == pytest.approx(0.10) and d["bench_ret"] == pytest.approx(0.01) and d["alpha"] == pytest.approx(0.09)


def test_rule_metrics_use_benchmark_days_of_the_rule(spark):
    t = spark.createDataFrame([("A", day(0), 1.0, True), ("A", day(0), 3.0, True), ("A", day(1), -1.0, False), ("B", day(2), 4.0, True)], "filter_code string, date date, return_pct double, win boolean")
    bench = spark.createDataFrame([(day(0), 0.5), (day(1), 1.5)], "date date, bench_ret double")
    m = {r["filter_code"]: r for r in summary.rule_metrics(t, bench).collect()}
    assert (m["A"]["mean_ret"], m["A"]["hit_ratio"], m["A"]["bench_mean_ret"], m["A"]["alpha_ret"], m["A"]["n_trades"]) == (0.5, 0.5, 1.0, -0.5, 3)
    assert m["B"]["bench_mean_ret"] is None
    assert [r["filter_code"] for r in summary.ranked(summary.rule_metrics(t, bench)).collect()] == ["A", "B"]
    assert summary.against_benchmark(t, bench).count() == 0 and summary.against_benchmark(t.where("filter_code = 'A'"), bench).count() == 2


# ------------------------------------------------------------------ indicators


def test_recursive_indicators_equal_pandas(spark):
    closes = [10 + (i * 7 % 5) - (i % 3) for i in range(60)]
    p = panel(spark, [float(c) for c in closes])
    got = I.add_named(p, ["ewm_5", "ema_5", "rsi_6", "stochrsi_k_6_4_3_2", "adx_5", "dmp_5", "unknown_name", "sma_3"]).orderBy("date").toPandas()
    x = pd.Series(closes, dtype=float)
    assert got["ewm_5"].to_numpy() == pytest.approx(x.ewm(span=5).mean().to_numpy())
    seed = x[:5].mean()
    want = [seed]
    for v in x[5:]:
        want.append(want[-1] + (v - want[-1]) * 2 / 6)
    assert got["ema_5"][4:].to_numpy() == pytest.approx(want) and got["ema_5"][:4].isna().all()
    assert got["rsi_6"][:6].isna().all() and got["rsi_6"][6:].between(0, 100).all()
    assert "unknown_name" not in got and got["sma_3"][2] == pytest.approx(x[:3].mean())
    native = p.select("date", I.ewm_native("close", 1 / 3).alias("e")).orderBy("date").toPandas()["e"]
    assert native.to_numpy() == pytest.approx(got["ewm_5"].to_numpy())


def test_rsi_of_a_rise_is_100_and_of_no_move_null(spark):
    up = I.add_named(panel(spark, [float(i) for i in range(1, 9)]), ["rsi_3"]).orderBy("date").toPandas()["rsi_3"]
    flat = I.add_named(panel(spark, [5.0] * 8), ["rsi_3"]).toPandas()["rsi_3"]
    assert (up[3:] == 100).all() and flat.isna().all()


# ------------------------------------------------------------------ metrics


def test_risk_metrics_by_hand(spark):
    r = spark.createDataFrame([(day(i), v) for i, v in enumerate([0.05, -0.02, 0.03, -0.01])], "date date, r double")
    one = r.agg(M.sharpe("r", "null", freq=1).alias("s"), M.sortino("r", "null", freq=1).alias("d")).first()
    assert one["s"] == pytest.approx(0.436852028, abs=1e-8) and one["d"] == pytest.approx(2.5)
    eq = M.with_growth(r).select("date", F.col("growth").alias("equity"))
    assert M.drawdown_runs(eq).first()["max_drawdown"] == pytest.approx(-0.02)
    w = spark.createDataFrame([(day(i), "A", x) for i, x in enumerate([1.0, 0.5, 1.0, 0.0])], "date date, symbol string, weight double")
    assert M.turnover(w).first()[0] == pytest.approx(1.0)
    assert M.turnover(w.where("weight > 0"), w).first()[0] == pytest.approx(1.0)


def test_turnover_counts_what_appears_and_vanishes(spark):
    w = spark.createDataFrame([(day(0), "A", 1.0), (day(1), "B", 1.0), (day(2), "A", 1.0)], "date date, symbol string, weight double")
    assert M.turnover(w).first()[0] == pytest.approx(2.0)


def test_confusion_and_tail(spark):
    p = panel(spark, [10.0, 11.0, 10.0, 12.0]).withColumn("sig", F.col("close") < 11)
    a = M.confusion(p, ["sig"], 1, 50.0).first()
    assert (a["tp"], a["fp"], a["tn"], a["fn"]) == (2, 0, 1, 0) and a["f1"] == 1.0
    assert M.confusion(p, ["sig"], 1, 50.0, count_tail=True).first()["tn"] == 2


# ------------------------------------------------------------------ orders, folds, quality


def test_orders_by_hand(spark):
    p = panel(spark, [100.0] * 3)
    s = spark.createDataFrame([("AAA", day(0), True, None), ("AAA", day(1), None, True), ("AAA", day(2), None, None), ("ZZZ", day(0), True, None)], "symbol string, date date, entry_long boolean, exit_long boolean")
    got = orders.order_table(s, p, 10_000.0, orders.Sizing(risk_bps=100.0, atr_period=2)).orderBy("date").collect()
    assert [(r["side"], r["qty"]) for r in got] == [("BUY", 50), ("EXIT", 0)]
    lots = spark.createDataFrame([(0.2,), (2.5,), (37.0,)], "q double").select(S.to_lots("q", 10, 1).alias("a"), S.to_lots("q", 1, 1, "round").alias("b"), S.to_lots("q", 1, 1, "ceil").alias("c")).collect()
    assert [tuple(r) for r in lots] == [(0, 1, 1), (0, 2, 3), (30, 37, 37)]


def test_costs_are_half_even_cents(spark):
    f = spark.createDataFrame([(100.0, 10.0, 100.0, 5.0), (1.0, 0.0, 1.0, None)], "fill_price double, quantity double, close double, atr double")
    rows = orders.with_costs(f, orders.Costs(commission_bps=5.0, tax_bps=1.0)).collect()
    assert (rows[0]["cost_commission"], rows[0]["cost_slippage"], rows[0]["cost_taxes"], rows[0]["cost_total"], rows[0]["net_price"]) == (0.5, 0.4, 0.1, 1.0, 100.0)
    assert rows[1]["cost_total"] == 0 and rows[1]["net_price"] is None
    assert orders.with_costs(f, orders.Costs(commission="per_share_flat")).first()["cost_commission"] == 0


@given(cap=st.floats(1.0, 5000.0), quantities=st.lists(st.integers(0, 300), min_size=1, max_size=6))
@settings(max_examples=8, deadline=None)
def test_cap_is_never_exceeded(spark, cap, quantities):
    f = spark.createDataFrame([(day(0), 7.0, float(q)) for q in quantities], "date date, fill_price double, quantity double")
    assert orders.cap_exposure(f, cap).agg(F.sum(F.col("fill_price") * F.col("quantity"))).first()[0] <= cap + 1e-6


def test_folds_do_not_overlap(spark):
    f = folds.walk_forward(spark, "2025-03-01", "2025-03-20", 7, 5, 5).orderBy("fold").collect()
    assert [str(r["test_start"]) for r in f] == ["2025-03-08", "2025-03-13", "2025-03-18"] and str(f[-1]["test_end"]) == "2025-03-20"
    assert all(r["train_end"] < r["test_start"] for r in f)
    assert folds.walk_forward(spark, "2025-03-01", "2025-03-05", 7, 5).count() == 0
    with pytest.raises(ValueError):
        folds.walk_forward(spark, "2025-03-02", "2025-03-01", 7, 5)
    rows = spark.createDataFrame([(day(i),) for i in range(20)], "date date")
    for parts in (folds.purged_kfold(rows, 3, 2), folds.expanding(rows, 3, 2)):
        p = parts.toPandas()
        for _, g in p.groupby("fold"):
            test, train = set(g[g["part"] == "test"]["date"]), set(g[g["part"] == "train"]["date"])
            assert test and not test & train and min(abs((a - b).days) for a in test for b in train) > 2


def test_search_draws_and_best(spark):
    d = folds.draws(spark, {"a": [1.0, 2.0], "n": (3, 9)}, 5, 1)
    assert d.count() == 5 and folds.draws(spark, {"a": [1.0, 2.0], "n": (3, 9)}, 5, 1).exceptAll(d).count() == 0
    s = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0)], "iter int, score double")
    assert M.best(s).first()["iter"] == 1


def test_quality_reports(spark):
    p = spark.createDataFrame([("A", day(5), None, 1.0, 2.0, 3.0, 0.0), ("A", day(5), 1.0, 2.0, 1.0, None, -5.0)], PANEL).withColumn("n", F.monotonically_increasing_id())
    issues = sorted(r["issue"] for r in quality.row_issues(p).collect())
    assert issues == ["high_lt_low", "na_close", "na_open", "non_positive_volume", "non_positive_volume"]
    problems = {r["problem"] for r in quality.contract(p).collect()}
    assert {"duplicate_dates", "negative_volume", "bounds", "null_ratio", "duplicate_ratio"} == problems
    days = C.number_days(spark.createDataFrame([(day(i),) for i in range(0, 5)], "date date"))
    store = panel(spark, [1.0, 2.0]).unionByName(panel(spark, [3.0], start=5))
    flags = {r["symbol"]: r["issues"] for r in quality.store_integrity(store, spark.createDataFrame([("AAA",), ("NO",)], "symbol string"), days).collect()}
    assert flags == {"AAA": ["gaps", "weekend"], "NO": ["missing"]}
    with pytest.raises(C.MissingTradingDays):
        C.check_missing(store, days)
    assert quality.suggestions(["clse"], ["close", "open"]) == {"clse": ["close"]}
    assert quality.check_types(store, readers.PANEL) == []


# ------------------------------------------------------------------ files


def test_csv_sources(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "aaa.csv").write_text("Date,Close,Volume\n2024-01-02,\"1,5\",10\n03.01.2024,\"2,5\",x\n")
    (tmp_path / "p" / "bbb.csv").write_text("Date,Close,Volume\n2024-01-02,\"1.000,5\",7\n")
    out = clean.clean_provider(readers.symbol_files(spark, str(tmp_path / "p")))
    assert {(r["symbol"], str(r["date"]), r["close"], r["volume"]) for r in out.collect()} == {("AAA", "2024-01-02", 1.5, 10), ("AAA", "2024-01-03", 2.5, 0), ("BBB", "2024-01-02", 1000.5, 7)}
    (tmp_path / "h.csv").write_text("DATE\n2024-01-01\n2024-01-01\n")
    assert readers.holidays(spark, str(tmp_path / "h.csv")).count() == 1
    (tmp_path / "b.csv").write_text("day,xu\n2024-01-02,101\n2024-01-01,100\n2024-01-03,\n")
    assert [r["close"] for r in readers.benchmark(spark, str(tmp_path / "b.csv"), "day", "xu").collect()] == [100.0, 101.0]
    assert readers.benchmark(spark, None) is None
    with pytest.raises(readers.BadTable):
        readers.benchmark(spark, str(tmp_path / "b.csv"))
    (tmp_path / "a.csv").write_text("alias,canonical_name\nVOL,volume\nVOL,close\n")
    with pytest.raises(readers.BadTable, match="VOL"):
        readers.alias_table(spark, str(tmp_path / "a.csv"))
    (tmp_path / "panel.csv").write_text("date,symbol,close,open\n2024-01-02,A,1.5,x\n")
    row = readers.csv_panel(spark, str(tmp_path / "panel.csv")).first()
    assert (row["symbol"], row["close"], row["open"], row["volume"]) == ("A", 1.5, None, None)


def test_store_and_policies(spark, tmp_path):
    p = panel(spark, [1.0, 2.0, 3.0]).unionByName(panel(spark, [4.0], "BBB"))
    writers.symbol_store(p, str(tmp_path / "s"))
    assert readers.prices(spark, str(tmp_path / "s"), ["AAA"], day(1), None, ["close"]).count() == 2
    with pytest.raises(readers.MissingSymbols, match="ZZZ"):
        readers.prices(spark, str(tmp_path / "s"), ["AAA", "ZZZ"])
    assert writers.target("x", "fail") == ("x", "errorifexists") and writers.target("x", "timestamp")[0].startswith("x-")
    with pytest.raises(ValueError):
        writers.target("x", "maybe")
    assert writers.upsert(p, str(tmp_path / "u")).count() == 4
    assert writers.upsert(p, str(tmp_path / "u")).count() == 0
    assert writers.read_store(spark, str(tmp_path / "u")).count() == 4
    assert {str(r["last_date"]) for r in writers.high_water(p).collect()} == {"2024-01-01", "2024-01-03"}


def test_daily_files_and_days_written(spark, tmp_path):
    s = signals(spark, ("X", "AAA", day(0)), ("X", "AAA", day(0)))
    days = spark.createDataFrame([(day(0),), (day(1),)], "date date")
    written = {str(r["date"]): r["signals"] for r in writers.daily_signals(s, str(tmp_path / "d"), days).collect()}
    assert written == {"2024-01-01": 1, "2024-01-02": 0}
    writers.documents({"m": days.limit(1)}, str(tmp_path / "j"))
    text = "".join(f.read_text() for f in (tmp_path / "j" / "m").glob("*.json"))
    assert json.loads(text)["date"] == "2024-01-01"


def test_results_do_not_depend_on_partitions(spark):
    p = panel(spark, [float(5 + i * 3 % 7) for i in range(40)]).unionByName(panel(spark, [float(9 - i * 2 % 5) for i in range(40)], "BBB"))
    run = lambda d: sorted(map(tuple, I.add_named(d, ["sma_4", "rsi_5"]).select("symbol", "date", "sma_4", "rsi_5").na.fill(-1).collect()))
    assert run(p) == run(p.orderBy(F.rand(3)).repartition(7))


def test_upsert_returns_rows_that_can_be_read(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([("A", "2024-01-02", 1.0), ("B", "2024-02-01", 2.0)], "symbol string, day string, close double").select("symbol", F.col("day").cast("date").alias("date"), "close")
    more = first.withColumn("close", F.col("close") + 1).union(spark.sql("select 'A', date'2024-01-03', 5.0D"))
    assert writers.upsert(first, path).count() == 2
    added = writers.upsert(more, path)
    again = writers.upsert(more, path)
    assert [(r["symbol"], str(r["date"]), r["close"], r["yyyymm"]) for r in added.collect()] == [("A", "2024-01-03", 5.0, "202401")]
    assert again.count() == 0 and writers.read_store(spark, path).count() == 3


def test_upsert_appends_to_the_months_it_touches(spark, tmp_path):
    path = str(tmp_path / "store")
    empty = spark.createDataFrame([], "symbol string, date date, close double")
    assert writers.upsert(empty, path).count() == 0 and not writers.exists(spark, path)
    bars = spark.sql("select concat('S', id % 50) symbol, date_add(date'2024-01-01', int(id / 50)) date, double(id) close from range(3000)")
    assert writers.upsert(bars, path).count() == 3000
    files = {f: f.read_bytes() for f in (tmp_path / "store").rglob("*.parquet")}
    assert {f.parent.name for f in files} == {"yyyymm=202401", "yyyymm=202402"} and len(files) <= 2 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    more = spark.sql("select 'S1' symbol, date'2024-02-10' date, -1D close union all select 'NEW', date'2024-03-05', 1D union all select null, date'2024-03-05', 2D union all select 'S1', null, 3D")
    assert writers.upsert(more, path).count() == 3 and writers.upsert(more, path).count() == 0
    assert all(f.read_bytes() == b for f, b in files.items())
    assert writers.read_store(spark, path).where("symbol = 'S1' and date = date'2024-02-10'").first()["close"] == 2001.0
    writers.compact(spark, path, str(tmp_path / "compact"))
    assert writers.read_store(spark, str(tmp_path / "compact")).exceptAll(writers.read_store(spark, path)).count() == 0
    assert writers.read_store(spark, str(tmp_path / "compact")).count() == 3003


def test_exposure_is_capped_by_day_without_a_window(spark):
    rows = spark.sql("select * from values (date'2024-01-01', 10D, 8D), (date'2024-01-01', 10D, 4D), (date'2024-01-02', 10D, 1D), (null, 10D, 30D) t(date, fill_price, quantity)")
    out = orders.cap_exposure(rows, 100.0)
    assert sorted(map(tuple, out.select("quantity", "capped").collect())) == [(1.0, False), (3.0, True), (6.0, True), (10.0, True)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_numbered_copies_collide():
    from tapewright.functions.names import canonical_map, loader_name

    assert canonical_map(["Close", "Close.1", "SMA.20", "x.5"]) == {"Close": "close", "Close.1": "close", "SMA.20": "sma_20", "x.5": "x.5"}
    assert canonical_map(["KAPANIS", "Close.2"])["Close.2"] == "close"
    with pytest.raises(clean.NameCollision):
        clean.plan_names(["Close", "Close.1"])
    assert [loader_name(n) for n in ("cci_20_0", "psarl_0", "aroond_25", "bbm_20_2_0", "sma_5")] == ["cci_20", "psarl_0_02_0_2", "aroon_down_25", "bbm_20_2", "sma_5"]
