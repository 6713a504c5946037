"""Queries that stand for a whole table do their work on all of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright import plans
from tapewright.plans import stores
from tapewright.sources import bars as B

from .oracle import DATA

SF = str(DATA / "sf0.001")


def test_days_written_count_every_trading_day(spark):
    want = stores.signals(spark, SF).select("date", "symbol", "filter_code").distinct()
    assert stores.days_written_whole(spark, SF).agg(F.sum("signals")).first()[0] == want.where("dayofweek(date) between 2 and 6").count()


def test_queries_work_on_all_symbols_and_days(spark):
    q = plans.queries()
    bars = B.panel(spark, SF)
    days = bars.select("date").distinct().count()
    assert q["s9_wide_to_long"](spark, SF).count() == q["b2_b4_reasons"](spark, SF).count() == bars.count()
    assert q["q4_k10_rule_audit"](spark, SF).count() == 3 * days
