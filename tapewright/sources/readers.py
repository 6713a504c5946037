"""Readers: panels, per-symbol stores and files, calendars, benchmarks, actions, signals, aliases."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from .writers import exists

PANEL = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
SIGNALS = T.StructType([T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType()), T.StructField("filter_code", T.StringType())])


class MissingSymbols(ValueError):
    pass


class BadTable(ValueError):
    pass


def parquet_panel(spark: SparkSession, path: str, schema: T.StructType = PANEL) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def csv_panel(spark: SparkSession, path: str, schema: T.StructType = PANEL) -> DataFrame:
    """A CSV whose header names the columns in any order; values that are no number are null."""
    raw = spark.read.option("header", True).csv(path)
    first = raw.columns[0]
    out = raw.withColumnRenamed(first, "date") if "date" not in raw.columns else raw
    make = {"date": lambda f: S.mixed_date("date"), "symbol": lambda f: F.col("symbol")}
    have = {c.lower(): c for c in out.columns}
    return out.select(*[(make.get(f.name, lambda f: F.col(have[f.name]).try_cast(f.dataType.simpleString()))(f) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def prices(spark: SparkSession, root: str, symbols: list[str], start=None, end=None, columns: list[str] | None = None) -> DataFrame:
    """Bars of some symbols from a store partitioned by symbol: partitions are pruned, dates and columns pushed down.

    Raises where a symbol has no partition. Symbols that are plain names are read from their own folders, so that the
    others are not listed.
    """
    root = root.rstrip("/")
    if symbols and all(re.fullmatch(r"[A-Za-z][A-Za-z0-9_.-]*", s) for s in symbols):
        folders = {s: f"{root}/symbol={s}" for s in symbols}
        if gone := [s for s in symbols if not exists(spark, folders[s])]:
            raise MissingSymbols(", ".join(gone))
        store = spark.read.option("basePath", root).parquet(*folders.values()).withColumn("symbol", F.col("symbol").cast("string"))
        return _chosen(store, start, end, columns)
    store = spark.read.parquet(root).withColumn("symbol", F.col("symbol").cast("string"))
    there = {r[0] for r in store.where(F.col("symbol").isin(symbols)).select("symbol").distinct().collect()}
    if gone := [s for s in symbols if s not in there]:
        raise MissingSymbols(", ".join(gone))
    return _chosen(store.where(F.col("symbol").isin(symbols)), start, end, columns)


def _chosen(out: DataFrame, start, end, columns: list[str] | None) -> DataFrame:
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out.select("symbol", "date", *[c for c in columns if c not in ("symbol", "date")]) if columns else out


def symbol_files(spark: SparkSession, folder: str, pattern: str = r"/([^/]+)\.csv$") -> DataFrame:
    """All CSV files of a folder, one for each symbol, whose name is the file's; columns as strings, still to be cleaned.

    The folder is listed, not each file, and the names of the columns are one file's first line: where Spark looks for them
    itself, it asks for the status of every file once more."""
    files = spark.read.option("pathGlobFilter", "*.csv")
    head = files.text(folder).where(F.trim("value") != "").first()
    if head is None:
        raise BadTable(f"no CSV files in {folder}")
    names = spark.read.option("header", True).csv(spark.sparkContext.parallelize([head["value"]], 1)).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.option("pathGlobFilter", "*.csv").schema(schema).option("header", True).csv(folder)
    return raw.withColumn("symbol", F.upper(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)))


def holidays(spark: SparkSession, path: str) -> DataFrame:
    """date: distinct days of a CSV with a date column, in any case."""
    raw = spark.read.option("header", True).csv(path)
    if "date" not in [c.strip().lower() for c in raw.columns]:
        raise BadTable("no date column")
    name = next(c for c in raw.columns if c.strip().lower() == "date")
    return raw.select(S.mixed_date(F.col(f"`{name}`")).alias("date")).where("date is not null").distinct()


def benchmark(spark: SparkSession, path: str | None, date_column: str = "date", close_column: str = "close") -> DataFrame | None:
    """date, close in order of date without gaps; None without a path; an error where nothing usable is there."""
    if path is None:
        return None
    raw = spark.read.option("header", True).csv(path)
    if gone := [c for c in (date_column, close_column) if c.lower() not in {x.lower() for x in raw.columns}]:
        raise BadTable("missing columns: " + ", ".join(gone))
    out = raw.select(S.mixed_date(date_column).alias("date"), F.col(close_column).try_cast("double").alias("close")).dropna()
    if out.limit(1).count() == 0:
        raise BadTable("no benchmark rows")
    return out.orderBy("date")


def corporate_actions(spark: SparkSession, path: str) -> DataFrame:
    """symbol, date, factor; every factor must be a positive number."""
    raw = spark.read.option("header", True).csv(path)
    out = raw.select(F.upper(F.trim("symbol")).alias("symbol"), S.mixed_date("date").alias("date"), F.col("factor").try_cast("double").alias("factor"))
    return validated_actions(out)


def validated_actions(actions: DataFrame) -> DataFrame:
    bad = actions.where("factor is null or factor <= 0 or isnan(factor) or date is null or symbol is null").limit(5).collect()
    if bad:
        raise BadTable(f"bad corporate actions: {[tuple(r) for r in bad]}")
    return actions


def signal_files(spark: SparkSession, folder: str) -> DataFrame:
    """date, symbol, filter_code of all daily CSV files; empty files give no rows."""
    return spark.read.schema(SIGNALS).option("header", True).option("enforceSchema", False).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)


def page_header(symbols: DataFrame, width: int = 256) -> DataFrame:
    """page, slot, symbol: the distinct symbols dealt by hash to pages of about `width`, numbered from 0 on each."""
    each = symbols.select("symbol").where("symbol is not null").distinct()
    pages = max(1, math.ceil(each.count() / width))
    each = each.withColumn("page", F.pmod(F.xxhash64("symbol"), F.lit(pages)).cast("int"))
    return each.select("page", (F.row_number().over(W.partitionBy("page").orderBy("symbol")) - 1).alias("slot"), "symbol")


def wide_pages(bars: DataFrame, header: DataFrame, fields: tuple[str, ...], tasks: int | None = None) -> DataFrame:
    """page, date, 0_field, ...: bars side by side, a row for each page and day and a column for each slot and field, so that
    the width of a row, and of the plan, does not grow with the number of symbols. `tasks`: how many share the rows."""
    slots = header.agg(F.max("slot")).first()[0] or 0
    rows = bars.join(header, "symbol")
    rows = rows.repartition(tasks, "page", "date") if tasks else rows
    return rows.groupBy("page", "date").pivot("slot", list(range(slots + 1))).agg(*[F.first(f).alias(f) for f in fields])


def pages_to_long(pages: DataFrame, header: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """wide_pages() back: symbol, date, fields, a row for each symbol of a page and each of the page's days."""
    rows = wide_to_long(pages, fields, ("page",)).withColumn("slot", F.col("symbol").cast("int")).where(F.coalesce(*fields).isNotNull())
    return rows.drop("symbol").join(header, ["page", "slot"]).select("symbol", "date", *fields)


def wide_to_long(wide: DataFrame, fields: tuple[str, ...] = ("open", "high", "low", "close", "volume"), keys: tuple[str, ...] = ()) -> DataFrame:
    """date, SYM_field, ... -> keys, symbol, date, fields: the symbol is the upper-case prefix before the first underscore.

    The names are known to the driver, so that a bar's fields are built side by side and only unpivoted by symbol.
    """
    symbols: dict[str, dict[str, str]] = {}
    for c in wide.columns:
        head, _, tail = c.partition("_")
        if tail and head == head.upper() and c not in ("date", *keys):
            symbols.setdefault(head, {})[tail.lower()] = c
    extra = sorted({f for have in symbols.values() for f in have} - set(fields))
    names = [f for f in (*fields, *extra) if any(f in have for have in symbols.values())]
    bars = [F.struct(F.lit(s).alias("symbol"), *[(F.col(f"`{have[f]}`").cast("double") if f in have else F.lit(None).cast("double")).alias(f) for f in names]) for s, have in symbols.items()]
    if not bars:
        raise BadTable("no SYMBOL_field columns")
    return wide.select(*keys, "date", F.inline(F.array(*bars))).select(*keys, "symbol", "date", *names)


def alias_table(spark: SparkSession, path: str) -> dict[str, str]:
    """alias -> canonical name; the header must be alias,canonical_name and an alias may have one meaning only."""
    raw = spark.read.option("header", True).csv(path)
    if raw.columns != ["alias", "canonical_name"]:
        raise BadTable(f"header must be alias,canonical_name, not {raw.columns}")
    rows = raw.select(F.trim("alias").alias("alias"), F.trim("canonical_name").alias("canonical_name")).dropna().distinct()
    two = rows.groupBy("alias").agg(F.countDistinct("canonical_name").alias("n")).where("n > 1").select("alias").collect()
    if two:
        raise BadTable("conflicting aliases: " + ", ".join(sorted(r[0] for r in two)))
    return {r["alias"]: r["canonical_name"] for r in rows.collect()}


def dated_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Equity, weights, returns or signals: a CSV with a schema such as "date date, equity double"."""
    return spark.read.schema(columns).option("header", True).csv(path)


def file_days(spark: SparkSession, folder: str) -> DataFrame:
    """name of every input file, for quality.absent_inputs(); lists files without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))


def as_date(x: str | dt.date) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(x)
