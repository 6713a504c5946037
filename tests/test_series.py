"""Scans, windows and medians over cells of time against plain loops; equity in segments; gaps, folds, hits."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewright.operators import calendar as C
from tapewright.operators import folds, rules
from tapewright.operators import indicators as I
from tapewright.operators import metrics as M
from tapewright.operators.series import Series, days, scanned

DAY0 = dt.date(2020, 1, 1)
BARS = "symbol string, date date, open double, high double, low double, close double, volume double"
NAMES = ["ewm_5", "ema_4", "rsi_6", "stochrsi_k_5_4_3_2", "stochrsi_d_5_4_3_2", "macd_3_7_4", "macd_signal_3_7_4", "macd_hist_3_7_4", "macd_2_5_3", "adx_5", "dmp_5", "dmn_5", "sma_4", "wma_3", "mom_2", "roc_3", "bbl_5_2", "bbh_5_2", "cci_4", "atr_3"]


def day(n):
    return DAY0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def bars(spark):
    """Three symbols with holes of weeks and missing closes."""
    rng = random.Random(5)
    rows = []
    for s, n in (("A", 90), ("B", 40), ("C", 3)):
        at, price = 0, 50.0
        for i in range(n):
            at += 1 if rng.random() < 0.9 else rng.randrange(2, 40)
            price = max(1.0, price + rng.choice([-2.0, -1.0, 0.0, 0.5, 1.5]))
            close = None if rng.random() < 0.07 else price
            rows.append((s, day(at), price - 0.5, price + rng.random(), price - rng.random() - 0.1, close, 100.0))
    return spark.createDataFrame(rows, BARS).repartition(5)


def closes(df, symbol):
    return [r for r in df.where(F.col("symbol") == symbol).orderBy("date").collect()]


def ewm_loop(x, alpha):
    """Weights by place, missing values included; null before the first value."""
    out, s, w = [], 0.0, 0.0
    for v in x:
        s, w = s * (1 - alpha) + (v or 0.0 if v is not None else 0.0), w * (1 - alpha) + (v is not None)
        out.append(s / w if w else None)
    return out


def ema_loop(x, n):
    out, seen, y = [], [], None
    for v in x:
        if v is None:
            out.append(None)
            continue
        seen.append(v)
        y = sum(seen) / n if len(seen) == n else y + (v - y) * 2 / (n + 1) if len(seen) > n else None
        out.append(y)
    return out


def near(got, want):
    assert [g is None for g in got] == [w is None for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], rel=1e-9, abs=1e-9)


def test_recursive_indicators_equal_plain_loops(spark, bars):
    out = I.add_named(bars, NAMES)
    for s in "ABC":
        rows = closes(out, s)
        c = [r["close"] for r in rows]
        near([r["ewm_5"] for r in rows], ewm_loop(c, 2 / 6))
        near([r["ema_4"] for r in rows], ema_loop(c, 4))
        line = [f - g if f is not None and g is not None else None for f, g in zip(ema_loop(c, 3), ema_loop(c, 7))]
        near([r["macd_3_7_4"] for r in rows], line)
        near([r["macd_signal_3_7_4"] for r in rows], ema_loop(line, 4))
        move = [None] + [b - a if a is not None and b is not None else None for a, b in zip(c, c[1:])]
        up, down = ([None if m is None else max(k * m, 0.0) for m in move] for k in (1, -1))
        share = [None if u is None or u + d <= 0 else 100 * u / (u + d) for u, d in zip(ewm_loop(up, 1 / 6), ewm_loop(down, 1 / 6))]
        near([r["rsi_6"] for r in rows], [None if i < 6 else v for i, v in enumerate(share)])
        h, low = [r["high"] for r in rows], [r["low"] for r in rows]
        plus, minus, tr = [None], [None], [None]
        for i in range(1, len(rows)):
            u, d = h[i] - h[i - 1], low[i - 1] - low[i]
            plus.append(u if u > d and u > 0 else 0.0)
            minus.append(d if d > u and d > 0 else 0.0)
            tr.append(max([h[i] - low[i], *([abs(h[i] - c[i - 1]), abs(low[i] - c[i - 1])] if c[i - 1] is not None else [])]))
        p, m, base = (ewm_loop(x, 1 / 5) for x in (plus, minus, tr))
        p, m = ([None if b is None or b <= 0 else 100 * x / b for x, b in zip(y, base)] for y in (p, m))
        dx = [None if x is None or x + y <= 0 else 100 * abs(x - y) / (x + y) for x, y in zip(p, m)]
        near([r["adx_5"] for r in rows], [None if i < 5 else v for i, v in enumerate(ewm_loop(dx, 1 / 5))])
        near([r["dmp_5"] for r in rows], [None if i < 5 else v for i, v in enumerate(p)])


@pytest.mark.parametrize("length", [4, 30, 1000])
def test_cells_of_time_change_nothing(spark, bars, length):
    whole = I.add_named(bars, NAMES).orderBy("symbol", "date").collect()
    cells = I.add_named(bars, NAMES, days(length), bucket=16)
    assert cells.columns == [*bars.columns, *[c for c in cells.columns if c not in bars.columns]] and set(NAMES) <= set(cells.columns)
    got = cells.orderBy("symbol", "date").collect()
    assert len(got) == len(whole)
    for name in NAMES:
        near([r[name] for r in got], [r[name] for r in whole])


def test_one_long_symbol_runs_in_many_tasks_without_python(spark):
    """300 000 minutes of one symbol: no task has them all, and no bar leaves the JVM."""
    n = 300_000
    long = spark.range(0, n, 1, 8).select(F.lit("X").alias("symbol"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("date"), (100 + F.col("id") % 977 - F.col("id") % 13).cast("double").alias("close"))
    cell = F.floor(F.unix_seconds("date") / (86400 * 10))
    out = I.add_recursive(long, [("ewm", (50,)), ("rsi", (14,))], cell)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    rows = out.withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in rows.groupBy("task").count().collect()]
    assert len(tasks) > 2 and max(tasks) < 0.7 * n
    x = np.array([100 + i % 977 - i % 13 for i in range(n)], float)
    r = 1 - 2 / 51
    got = {q["date"].timestamp(): q["ewm_50"] for q in out.where((F.unix_seconds("date") - 1_700_000_000) % (60 * 29_989) == 0).collect()}
    for at in range(0, n, 29_989):
        w = r ** np.arange(min(at + 1, 3000))
        assert got[at * 60 + 1_700_000_000] == pytest.approx((x[max(0, at - 2999) : at + 1][::-1] * w).sum() / w.sum(), rel=1e-12)


@given(ratios=st.lists(st.sampled_from([0.0, 1e-3, 0.2, 0.5, 0.9, 0.999, 1.0]), min_size=1, max_size=3, unique=True), n=st.integers(1, 60))
@settings(max_examples=4, deadline=None)
def test_scan_is_the_recurrence(spark, ratios, n):
    values = [float((i * 37) % 11 - 5) for i in range(n)]
    df = spark.createDataFrame([("s", i + 1, v) for i, v in enumerate(values)], "k string, at long, x double")
    out = scanned(df, {f"y{i}": ("x", r) for i, r in enumerate(ratios)}, "at", ("k",), "at").orderBy("at").collect()
    for i, r in enumerate(ratios):
        y, want = 0.0, []
        for v in values:
            y = r * y + v
            want.append(y)
        near([q[f"y{i}"] for q in out], want)


def test_medians_are_those_of_sorted_windows(spark, bars):
    def want(rows, n):
        c = [r["close"] for r in rows]
        return [statistics.median(c[i - n + 1 : i + 1]) if i >= n - 1 and None not in c[i - n + 1 : i + 1] else None for i in range(len(c))]

    for cell in (None, days(9)):
        out = I.add_medians(bars, {"m3": ("close", 3), "m6": ("close", 6)}, cell, bucket=8)
        assert out.columns == [*bars.columns, "m3", "m6"] and out.count() == bars.count()
        for s in "ABC":
            rows = closes(out, s)
            near([r["m3"] for r in rows], want(rows, 3))
            near([r["m6"] for r in rows], want(rows, 6))


def test_places_are_counted_over_cells(spark, bars):
    s = Series(bars, days(6), ["close"], ["close"])
    for symbol in "ABC":
        rows = [r for r in s.df.where(F.col("symbol") == symbol).orderBy("date").collect()]
        assert [r["__pos"] for r in rows] == list(range(1, len(rows) + 1))
        there = [r["close"] is not None for r in rows]
        assert [r["__n_close"] for r in rows] == list(itertools.accumulate(there))
        assert [r["__lag_close"] for r in rows] == [None, *[r["close"] for r in rows[:-1]]]


# ------------------------------------------------------------------ equity in segments


def runs_loop(values):
    peak, deepest, run, longest = None, 0.0, 0, 0
    for v in values:
        peak = v if peak is None else max(peak, v)
        deepest = min(deepest, v / peak - 1)
        run = run + 1 if v < peak else 0
        longest = max(longest, run)
    return deepest, longest


@given(st.lists(st.integers(1, 9), min_size=1, max_size=25), st.sampled_from([1, 3, 7, 1000]))
@settings(max_examples=6, deadline=None)
def test_drawdowns_merge_over_cells(spark, values, length):
    eq = spark.createDataFrame([("s", day(i), float(v)) for i, v in enumerate(values)], "k string, date date, equity double")
    before, M.CELL_DAYS = M.CELL_DAYS, length
    try:
        for by in (["k"], []):
            got = M.drawdown_runs(eq, by).first()
            deepest, longest = runs_loop(values)
            assert got["max_drawdown"] == pytest.approx(deepest) and got["max_dd_days"] == longest
        grown = [r["growth"] for r in M.with_growth(eq.withColumn("r", F.col("equity") / 10 - 0.5)).orderBy("date").collect()]
        assert grown == pytest.approx(np.cumprod([1 + v / 10 - 0.5 for v in values]).tolist())
        rets = [r["ret"] for r in M.with_returns(eq).orderBy("date").collect()]
        assert rets[0] is None and rets[1:] == pytest.approx([b / a - 1 for a, b in zip(values, values[1:])])
    finally:
        M.CELL_DAYS = before


def test_no_window_goes_over_a_whole_equity(spark):
    eq = spark.range(10).select(F.expr("date_add(date'2020-01-01', int(id))").alias("date"), (F.col("id") + 1.0).alias("equity"))
    for df in (M.with_returns(eq), M.with_drawdown(eq), M.drawdown_runs(eq), M.equity_metrics(eq), M.with_growth(eq, "equity")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert all("__cell" in line for line in plan.splitlines() if " Window " in line)
    assert M.drawdown_runs(eq.where("false")).first()["max_drawdown"] is None


def test_total_losses(spark):
    r = spark.createDataFrame([(k, day(i), v) for k, x in {"lost": [0.1, -1.0, 0.1], "first": [-1.0, 0.5], "fine": [0.1, 0.1]}.items() for i, v in enumerate(x)], "k string, date date, r double")
    got = {q["k"]: q for q in M.strategy_metrics(r, ["k"]).collect()}
    assert (got["lost"]["cagr"], got["lost"]["max_drawdown"]) == (-100.0, 100.0) and got["first"]["cagr"] == -100.0
    assert got["fine"]["max_drawdown"] == 0.0 and got["fine"]["cagr"] == pytest.approx((1.21**126 - 1) * 100)


@pytest.mark.parametrize("length", [5, 1000])
def test_search_equals_metrics_of_each_parameter(spark, monkeypatch, length):
    monkeypatch.setattr(M, "CELL_DAYS", length)
    monkeypatch.setattr(folds, "VECTOR", 4)
    rng = random.Random(3)
    r = spark.createDataFrame([(day(i), rng.gauss(0.001, 0.02) if i % 17 else None) for i in range(120)], "date date, r double")
    parts = folds.expanding(r, 3, 2)
    grid = folds.grid(spark, {"leverage": [0.5, 1.0, 40.0], "cost": [0.0, 0.001, 0.01]})
    got = {q["iter"]: q["score"] for q in folds.search(r, grid, parts, lambda p: F.col("r") * p["leverage"] - p["cost"]).collect()}
    tests = parts.where("part = 'test'").select("fold", "date")
    each = r.join(tests, "date").crossJoin(grid).withColumn("x", F.col("r") * F.col("leverage") - F.col("cost"))
    want = M.strategy_metrics(each, ["iter", "fold"], "x", 1.0).withColumn("score", M.objective()).groupBy("iter").agg(F.avg("score").alias("score")).collect()
    assert set(got) == set(range(9)) == {q["iter"] for q in want}
    for q in want:
        assert got[q["iter"]] == pytest.approx(q["score"], rel=1e-9)
    plan = folds.search(r, grid, parts, lambda p: F.col("r") * p["leverage"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    assert folds.search(r, grid.where("false"), parts, lambda p: F.col("r")).count() == 0


# ------------------------------------------------------------------ gaps, folds, hits


def test_gaps_are_the_days_between_bars(spark):
    rng = random.Random(9)
    open_ = [day(i) for i in range(5, 60) if day(i).weekday() < 5 and i % 11]
    calendar = C.number_days(spark.createDataFrame([(d,) for d in open_], "date date"))
    held = {s: sorted(rng.sample([day(i) for i in range(70)], n)) for s, n in (("A", 20), ("B", 6), ("C", 1), ("D", 45))}
    panel = spark.createDataFrame([(s, d) for s, x in held.items() for d in x for _ in range(2)], "symbol string, date date")
    missing = C.missing_days(panel, calendar)
    assert sorted(map(tuple, missing.collect())) == sorted((s, d) for s, x in held.items() for d in open_ if x[0] <= d <= x[-1] and d not in x)
    assert "NestedLoop" not in missing._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "").replace("BroadcastNestedLoopJoin BuildRight, Inner", "")
    assert C.missing_days(panel, calendar.where("false")).count() == 0


def test_rows_find_their_folds_by_an_equal_day(spark):
    rows = spark.createDataFrame([(day(i), i) for i in range(40)], "date date, n int")
    f = folds.walk_forward(spark, str(day(0)), str(day(39)), 10, 7, 3)
    for part in ("train", "test"):
        got = folds.in_folds(rows, f, part)
        want = [(r["n"], q["fold"]) for r in rows.collect() for q in f.collect() if q[f"{part}_start"] <= r["date"] <= q[f"{part}_end"]]
        assert sorted((r["n"], r["fold"]) for r in got.collect()) == sorted(want)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_hits_are_counted_as_a_scan_finds_them(spark, bars, monkeypatch):
    monkeypatch.setattr(rules, "CHUNK", 3)
    many = [rules.Rule(f"R{k}", f"close > {40 + k}") for k in range(8)] + [rules.Rule("N", "close - 50"), rules.Rule("NONE", "false"), rules.Rule("BAD", "nope > 1"), rules.Rule("COL", F.col("close") < 45)]
    for more in ({}, {"start": day(20), "end": day(60)}):
        found = rules.scan(bars, many, **more)
        for by in ((), ("date",), ("symbol", "date")):
            want = {tuple(r) for r in found.groupBy(*by, "filter_code").count().collect()}
            assert {tuple(r) for r in rules.count_hits(bars, many, by, **more).collect()} == want
    assert rules.count_hits(bars, []).count() == 0 and rules.count_hits(bars.where("false"), many).count() == 0
    assert math.isclose(sum(r["hits"] for r in rules.count_hits(bars, many).collect()), rules.scan(bars, many).count())


def test_an_rsi_of_100_has_no_stochastic(spark):
    # S228 of sf0.1: no close falls in the first six bars, so that all five RSIs are 100 and have no spread, however sums round
    closes = [200.514, 1146.621, 1178.003, 1565.579, 2272.854, 3553.328, 2583.913, 2600.5, 2400.25, 2700.0]
    p = spark.createDataFrame([("S228", dt.date(2024, 1, 1 + i), c) for i, c in enumerate(closes)], "symbol string, date date, close double")
    got = [r[0] for r in I.add_named(p, ["rsi_7", "stochrsi_k_7_5_4_3"]).orderBy("date").select("stochrsi_k_7_5_4_3").collect()]
    assert got[:8] == [None] * 8 and None not in got[8:]
