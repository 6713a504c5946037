"""Data-quality reports and guardrails."""

from __future__ import annotations

import datetime as dt
import difflib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from .calendar import missing_days


def profile(df: DataFrame) -> DataFrame:
    """symbol, rows, first_date, last_date, null_closes, duplicates."""
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.col("close").isNull()).alias("null_closes"), (F.count("date") - F.countDistinct("date")).alias("duplicates"))


def row_issues(df: DataFrame, arrival: str | None = None) -> DataFrame:
    """symbol, date, issue, value of every finding in every row; with an arrival column also dates that go back."""
    checks: list[tuple[str, Column, Column]] = [("non_positive_close", S.le("close", 0.0), F.col("close").cast("string")), ("na_close", F.col("close").isNull(), F.lit(""))]
    if "volume" in df.columns:
        checks.append(("non_positive_volume", S.le("volume", 0.0), F.col("volume").cast("string")))
    if {"high", "low"} <= set(df.columns):
        checks.append(("high_lt_low", S.lt("high", "low"), F.concat_ws("<", F.col("high").cast("string"), F.col("low").cast("string"))))
    if "open" in df.columns:
        checks.append(("na_open", F.col("open").isNull(), F.lit("")))
    rows = df
    if arrival:
        rows = rows.withColumn("__back", S.lt("date", F.lag("date").over(W.partitionBy("symbol").orderBy(arrival))))
        checks.append(("non_monotonic_dates", F.col("__back"), F.lit("")))
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("issue"), v.alias("value"), c.alias("hit")) for n, c, v in checks]), lambda x: x["hit"])
    return rows.select("symbol", "date", F.inline(found)).select("symbol", "date", "issue", "value")


def contract(df: DataFrame, by: str = "symbol", arrival: str | None = None, max_null: float = 0.02, max_duplicates: float = 0.0) -> DataFrame:
    """by, problem, severity, amount: unique and sorted dates, volumes of 0 or more, bounds of the bar, rows that are not
    all null (critical); shares of nulls and duplicates (warning). One aggregate."""
    cols = [c for c in ("open", "high", "low", "close", "volume") if c in df.columns]
    rows = df
    if arrival:
        rows = rows.withColumn("__back", S.lt("date", F.lag("date").over(W.partitionBy(by).orderBy(arrival))))
    n = F.count(F.lit(1))
    low, high = F.least("open", "high", "low", "close"), F.greatest("open", "high", "low", "close")
    empty = F.lit(True)
    for c in cols:
        empty = empty & F.col(c).isNull()
    dup = n - F.countDistinct("date") - F.count_if(F.col("date").isNull())
    one = rows.groupBy(by).agg(
        dup.cast("double").alias("duplicate_dates"),
        (F.count_if("__back") if arrival else F.lit(0)).cast("double").alias("unsorted_dates"),
        F.count_if(S.lt("volume", 0.0)).cast("double").alias("negative_volume"),
        F.count_if(S.gt("low", low) | S.lt("high", high)).cast("double").alias("bounds"),
        F.count_if(empty).cast("double").alias("empty_rows"),
        F.greatest(*[F.count_if(F.col(c).isNull()) / n for c in cols]).alias("null_ratio"),
        (dup / n).alias("duplicate_ratio"),
    )
    names = ["duplicate_dates", "unsorted_dates", "negative_volume", "bounds", "empty_rows", "null_ratio", "duplicate_ratio"]
    limit = F.when(F.col("problem") == "null_ratio", max_null).when(F.col("problem") == "duplicate_ratio", max_duplicates).otherwise(0.0)
    severity = F.when(F.col("problem").isin("null_ratio", "duplicate_ratio"), "warning").otherwise("critical")
    return one.unpivot([by], names, "problem", "amount").where(F.col("amount") > limit).select(by, "problem", severity.alias("severity"), "amount")


def check_types(df: DataFrame, required: T.StructType) -> list[str]:
    """Columns that are missing or of another type than a contract's."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [f"{f.name}: {'missing' if f.name not in have else have[f.name].simpleString() + ' is not ' + f.dataType.simpleString()}" for f in required.fields if have.get(f.name) != f.dataType]


def store_integrity(store: DataFrame, symbols: DataFrame, days: DataFrame, required: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """symbol, issues (sorted array) of every symbol asked for: missing, duplicate_dates, nan_values, weekend, gaps,
    missing_cols (the store lacks a required column) and not_sorted (dates fall somewhere in the order of a column)."""
    gaps = missing_days(store, days).groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"))
    values = [c for c in store.columns if c not in ("symbol", "date", "yyyymm", order)]
    lacking = [c for c in required if c not in store.columns]
    store = store.withColumn("__falls", F.col("date") < F.lag("date").over(W.partitionBy("symbol").orderBy(order)) if order else F.lit(False))
    nulls = F.lit(False)
    for c in values:
        nulls = nulls | F.col(c).isNull()
    flags = store.groupBy("symbol").agg((F.count("date") > F.countDistinct("date")).alias("dup"), (F.count_if(nulls) > 0).alias("nan"), (F.count_if(S.is_weekend("date")) > 0).alias("weekend"), (F.count_if("__falls") > 0).alias("falls"))
    rows = symbols.select("symbol").distinct().join(flags, "symbol", "left").join(gaps, "symbol", "left")
    found = [(F.col("dup").isNull(), "missing"), (S.known(F.col("dup")), "duplicate_dates"), (S.known(F.col("nan")), "nan_values"), (S.known(F.col("weekend")), "weekend"), (F.col("gaps").isNotNull(), "gaps"), (S.known(F.col("falls")), "not_sorted"), (F.col("dup").isNotNull() & F.lit(bool(lacking)), "missing_cols")]
    return rows.select("symbol", F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in found]))).alias("issues"))


def warm_up(signals: DataFrame, column: str, bars: int) -> DataFrame:
    """symbol, early: signals within a symbol's first bars, where there should be none."""
    w = W.partitionBy("symbol").orderBy("date")
    early = signals.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= bars)
    return early.groupBy("symbol").agg(F.count_if(S.known(F.col(column))).alias("early"))


def silence_warm_up(signals: DataFrame, columns: list[str], bars: int) -> DataFrame:
    """Signals null within a symbol's first bars."""
    w = W.partitionBy("symbol").orderBy("date")
    out = signals.withColumn("__n", F.row_number().over(w))
    return out.withColumns({c: F.when(F.col("__n") > bars, F.col(c)) for c in columns}).drop("__n")


def misaligned(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("symbol", "date"), tasks: int | None = None) -> DataFrame:
    """keys..., side: rows of one frame whose keys the other has not as often. Both are read and counted once; `tasks`: how
    many share the keys."""
    both = a.select(*keys, F.lit(1).alias("n")).unionByName(b.select(*keys, F.lit(-1).alias("n")))
    both = both.repartition(tasks, *keys) if tasks else both
    more = both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
    side = F.when(F.col("n") > 0, "left").otherwise("right")
    return more.select(*keys, F.explode(F.array_repeat(side, F.abs("n").cast("int"))).alias("side"))


def monotonic(df: DataFrame, arrival: str) -> DataFrame:
    """symbol, backward, repeated: dates that go back in order of arrival, and dates that occur again."""
    w = W.partitionBy("symbol").orderBy(arrival)
    return df.withColumn("__p", F.lag("date").over(w)).groupBy("symbol").agg(F.count_if(F.col("date") < F.col("__p")).alias("backward"), (F.count("date") - F.countDistinct("date")).alias("repeated"))


def preflight_day(df: DataFrame, day, required: list[str]) -> tuple[int, list[str]]:
    """Rows of a day, and required columns that are missing."""
    return df.where(F.col("date") == F.lit(day).cast("date")).count(), [c for c in required if c not in df.columns]


def absent_inputs(spark: SparkSession, names: DataFrame, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """date: trading days of [start, end] of which no input file (column `name`, holding an ISO date) exists."""
    span = spark.range(1).select(F.explode(F.sequence(F.lit(dt.date.fromisoformat(start)), F.lit(dt.date.fromisoformat(end)))).alias("date")).where(~S.is_weekend("date"))
    if holidays is not None:
        span = span.join(F.broadcast(holidays.select("date")), "date", "left_anti")
    there = names.select(S.iso_day(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1)).alias("date")).distinct()
    return span.join(there, "date", "left_anti")


def suggestions(unknown: list[str], columns: list[str]) -> dict[str, list[str]]:
    """Known columns close to each unknown name."""
    return {u: difflib.get_close_matches(u, columns, n=3, cutoff=0.6) for u in unknown}


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown_codes(strategies: DataFrame, rules: DataFrame, code: str = "filter_code") -> DataFrame:
    """Rows of strategies whose rule code is not among the rules."""
    return strategies.join(rules.select(code).distinct(), code, "left_anti")
