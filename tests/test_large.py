"""What larger tables brought to light: many symbols, extremes, files, the size of tasks."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewright.functions import scalar as S
from tapewright.operators import indicators as I
from tapewright.operators import metrics as M
from tapewright.operators import quality
from tapewright.operators import clean, rules, trades
from tapewright.plans import bars, evaluation, files, range_job, stores
from tapewright.sources import bars as B
from tapewright.sources import readers, writers
from tapewright.streaming import live as L

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.fixture
def market(spark, tmp_path):
    """120 suppliers, three days, two line items each."""
    lines = [(100 * s + d, 1, s, n, 1.0 + d, 10.0 * s + d + n, 0.0, 0.0, "R", "O", dt.datetime(2024, 1, 2 + d)) for s in range(120) for d in range(3) for n in (1, 2)]
    spark.createDataFrame(lines, LINE).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_symbols_whose_names_begin_alike_are_in_order(spark, market):
    got = {r["kind"]: (r["n"], r["out_of_order"]) for r in stores.file_order(spark, market).collect()}
    assert got["bars"] == (360, 0) and got["trades"][1] == 0


def test_no_downside_has_no_ratio(spark):
    rises = spark.createDataFrame([(dt.date(2024, 1, d), d / 100) for d in range(1, 6)], "date date, r double")
    one = evaluation.risk_table(rises).first()
    assert one["sortino_null"] is None and one["sortino_floor"] is None and one["sortino_sample"] is None and one["sharpe_null"] > 0


def test_rounding_keeps_what_a_long_cannot_hold(spark):
    rows = spark.createDataFrame([(0, float("inf")), (1, float("-inf")), (2, float("nan")), (3, 1e300), (4, 3e15), (5, -1.00005), (6, None)], "k int, x double")
    got = [r[0] for r in rows.orderBy("k").select(S.settle("x", 4)).collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and got[2] != got[2] and got[3:] == [1e300, 3e15, pytest.approx(-1.0, abs=1e-4), None]


def test_equity_that_only_grows_has_no_sortino_and_an_infinite_mar(spark):
    equity = spark.createDataFrame([(dt.date(2024, 1, d), 100.0 + d * d) for d in range(1, 6)], "date date, equity double")
    one = M.equity_metrics(equity).select("sortino", S.settle("mar").alias("mar"), "max_dd_days").first()
    assert one["sortino"] is None and one["mar"] == float("inf") and one["max_dd_days"] == 0


def test_a_wide_panel_of_more_symbols_than_a_pivot_takes(spark, market):
    held = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", 50)
    try:
        got = bars.wide_whole(spark, market)
        assert got.exceptAll(B.panel(spark, market).select(*got.columns)).count() == 0 and got.count() == 360
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", held)


def test_wide_pages_and_back(spark, market):
    panel = B.panel(spark, market).select("symbol", "date", "close", "volume")
    header = readers.page_header(panel, 7)
    pages = readers.wide_pages(panel, header, ("close", "volume"))
    assert header.select("page").distinct().count() > 10 and len(pages.columns) < 2 + 2 * 25
    assert sorted(readers.pages_to_long(pages, header, ("close", "volume")).collect()) == sorted(panel.collect())


def test_live_bars_need_no_python_and_keep_open_days_alone(spark, tmp_path):
    rows = lambda x: spark.createDataFrame([("A", dt.datetime(2024, 1, d, h), i, v) for d, h, i, v in x], "symbol string, ts timestamp, event_id long, value double")
    schema, kept = rows([(1, 0, 1, 1.0)]).schema, []
    for part in ([(1, 9, 1, 5.0), (1, 9, None, 1.0), (1, 9, None, 1.0)], [(1, 10, 1, 7.0), (4, 9, 2, 1.0)], [(1, 9, 3, 2.0)], [(9, 9, 4, 2.0)]):
        rows(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = L.live_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        L.write_live(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        kept.append({p.name for p in (tmp_path / "c/live/open").glob("batch=*/date=*")})
    assert "Python" not in stream._jdf.queryExecution().logical().toString()
    # an id that comes again counts as it came first, events without an id all count; what is closed goes a batch later
    assert {(str(r["date"]), r["value"], r["volume"], r["events"]) for r in L.read_live(spark, str(tmp_path / "out"), "bar").collect()} == {("2024-01-01", 5.0, 7.0, 3), ("2024-01-04", 1.0, 1.0, 1)}
    assert L.read_live(spark, str(tmp_path / "out"), "late").count() == 1
    assert kept[1] == {"date=2024-01-01", "date=2024-01-04"} and kept[2] == {"date=2024-01-04"}


def test_tasks_grow_with_the_table(spark, market, monkeypatch):
    monkeypatch.setattr(B, "TASK_ROWS", 40)
    assert B.tasks(spark, market) == 18 and B.panel(spark, market).rdd.getNumPartitions() == 18
    panel = B.panel(spark, market)
    assert quality.misaligned(panel, panel, tasks=9).rdd.getNumPartitions() == 9
    plan = I.add_named(panel, ["rsi_7"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1


def test_misaligned_counts_rows_that_repeat(spark):
    a = spark.createDataFrame([("A", dt.date(2024, 1, 1))] * 3 + [(None, None)], "symbol string, date date")
    b = a.limit(1).union(spark.createDataFrame([("B", dt.date(2024, 1, 1))] * 2, a.schema)).union(a.where("symbol is null"))
    assert sorted((r["symbol"], r["side"]) for r in quality.misaligned(a, b).collect()) == [("A", "left")] * 2 + [("B", "right")] * 2


def test_cells_and_buckets_are_dealt_to_tasks_that_grow_with_the_table(spark, market, monkeypatch):
    monkeypatch.setattr(B, "TASK_ROWS", 40)
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        p = B.panel(spark, market, cell=F.floor(F.unix_date("date") / 2))
        assert p.rdd.getNumPartitions() == 18
        names = ["ewm_2", "ema_2", "mom_1", "med_2"]
        got = I.add_named(p, names, F.col("__cell"), 2, B.tasks(spark, market), {"med_2": ("close", 2)})
        assert got.rdd.getNumPartitions() == 18 and "__cell" in p.columns
        want = I.add_medians(I.add_named(B.panel(spark, market), names), {"med_2": ("close", 2)})
        rounded = lambda t: t.select("symbol", "date", *[F.round(c, 9).alias(c) for c in names])
        assert rounded(got).exceptAll(rounded(want)).count() == 0 and got.count() == want.count() == 360
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_a_symbol_store_is_read_without_listing_the_other_symbols(spark, market, tmp_path):
    panel, where = B.panel(spark, market), str(tmp_path / "store")
    writers.symbol_store(panel, where, tasks=B.tasks(spark, market))
    got = readers.prices(spark, where, ["S1", "S17"], columns=["close", "volume"])
    assert {f.split("symbol=")[1].split("/")[0] for f in got.inputFiles()} == {"S1", "S17"} and len(got.inputFiles()) == 2
    assert sorted(got.collect()) == sorted(panel.where("symbol in ('S1', 'S17')").select("symbol", "date", "close", "volume").collect())
    with pytest.raises(readers.MissingSymbols, match="S999"):
        readers.prices(spark, where, ["S1", "S999"])


def test_a_range_job_makes_its_bars_once(spark, market, monkeypatch):
    monkeypatch.setattr(B, "TASK_ROWS", 40)
    catalog, p = [rules.Rule("UP", "close > open", side="long"), rules.Rule("MEAN", "sma_2 > close", side="short")], B.panel(spark, market)
    made = range_job.run_range(p, catalog, "2024-01-01", "2024-01-03", B.benchmark(spark, market), cost_pct=0.1, tasks=B.tasks(spark, market))
    plan = made["trades"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and plan.count("REPARTITION_BY_NUM") == plan.count("Exchange") == 2
    assert made["trades"].rdd.getNumPartitions() == 18
    named = I.add_named(clean.clean_panel(p), ["sma_2"])
    want = trades.returns(named, rules.scan_range(named, catalog, "2024-01-01", "2024-01-03"), 1, 0.1)
    assert want.count() > 240 and sorted(made["trades"].collect(), key=str) == sorted(want.collect(), key=str)
    assert made["rules"].count() == 2
    with pytest.raises(rules.RuleError, match="no bars"):
        range_job.run_range(p, catalog, "1990-01-01", "1990-02-01")


def test_trades_of_a_day_are_made_once_and_large_days_are_cut(spark, market, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "DAY_ROWS", 50)
    t = bars.trade_table(spark, market).select("filter_code", "symbol", "date", "return_pct")
    made, seen = spark.sparkContext.accumulator(0), []
    counted = F.udf(lambda x: made.add(1) or x, "string").asNondeterministic()
    rows = t.withColumn("symbol", counted("symbol"))
    back = writers.per_day(rows, lambda written: seen.append(written) or written.groupBy("date").count(), str(tmp_path / "w"), rows_by_day=B.rows_by_day(spark, market), tasks=6)
    assert made.value == back.count() == t.count() and seen == [back]
    assert sorted(back.select(*t.columns).collect(), key=str) == sorted(t.collect(), key=str)
    assert all(len(list(day.glob("*.csv"))) > 1 for day in (tmp_path / "w/trades").glob("date=*"))  # 240 line items a day
    for file in (tmp_path / "w/trades").glob("date=*/*.csv"):
        lines = [x.split(",")[:2] for x in file.read_text().splitlines()[1:]]
        assert lines == sorted(lines)


def test_a_panel_compares_its_first_and_last_line_items_once(spark, market):
    p = B.panel(spark, market)
    assert "min_by" not in (plan := p._jdf.queryExecution().executedPlan().toString()) and "max_by" not in plan
    day = B.ticks(spark, market).groupBy("symbol", "date")
    want = day.agg(F.min_by("px", "at"), F.max("px"), F.min("px"), F.max_by("px", "at"), F.sum("l_quantity"))
    assert p.count() == 360 and sorted(p.collect()) == sorted(want.collect())


def test_symbol_files_lie_in_one_folder_that_is_listed_once(spark, market):
    sc = spark.sparkContext
    sc.setJobGroup("s4", "symbol files")
    try:
        got = files.symbol_files(spark, market)
        stages = [st for j in sc.statusTracker().getJobIdsForGroup("s4") for st in sc.statusTracker().getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    named = got.inputFiles()
    assert len(named) == 120 and len({f.rsplit("/", 1)[0] for f in named}) == 1
    # no task for each file or folder
    assert stages and max(i.numTasks for i in map(sc.statusTracker().getStageInfo, stages) if i) < 20
    assert sorted(got.collect()) == sorted(B.panel(spark, market).select("symbol", "date", "close", "volume").collect())


@pytest.mark.parametrize("local", [True, False])
def test_symbol_files_keep_any_symbol_and_value(spark, tmp_path, monkeypatch, local):
    if not local:
        monkeypatch.setattr(writers, "_local", lambda spark, path: None)
    symbols = [None, "A", "A.CSV", "A/B", "_X", ".Y", "A+B C", "%41", "~41", "*?[{", "Ü", "=", "SYMBOL=A"]
    odd = ["1", None, 'a "b", c', "x\\y", "z z"]
    rows = spark.createDataFrame([(s, dt.date(2024, 1, 1 + i), 0.1 * i if i else None, v) for s in symbols for i, v in enumerate(odd)], "symbol string, date date, close double, note string")
    where = str(tmp_path / "s")
    writers.symbol_files(rows.repartition(3), where, 2)
    raw = readers.symbol_files(spark, where, writers.WRITTEN)
    back = raw.select(writers.name_symbol(F.col("symbol")).alias("symbol"), F.col("date").cast("date").alias("date"), F.col("close").cast("double").alias("close"), "note")
    assert len(back.inputFiles()) == len(symbols) and sorted(back.collect(), key=str) == sorted(rows.collect(), key=str)


def test_symbol_files_larger_than_a_batch_are_whole(spark, tmp_path):
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(300).select(F.concat(F.lit("S"), F.col("id") % 5).alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 5).cast("int")).alias("date"), "id")
        writers.symbol_files(rows, f"file://{tmp_path}/s", 3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["_SUCCESS", *[f"symbol=S{i}.csv" for i in range(5)]]
    for i in range(5):
        lines = (tmp_path / f"s/symbol=S{i}.csv").read_text().splitlines()
        assert lines[0] == "date,id" and [int(x.split(",")[1]) for x in lines[1:]] == list(range(i, 300, 5))
    with pytest.raises(FileExistsError):
        writers.symbol_files(rows, str(tmp_path / "s"))


def test_a_folder_without_symbol_files_is_an_error(spark, tmp_path):
    (tmp_path / "other.txt").write_text("date,close\n")
    with pytest.raises(readers.BadTable, match="no CSV files"):
        readers.symbol_files(spark, str(tmp_path))
