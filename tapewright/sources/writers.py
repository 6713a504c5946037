"""Writers: daily signals, report tables, the per-symbol store with idempotent upserts, retention."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in ranges of their keys, in as many tasks as a shuffle has: a large day or symbol is shared out to several, small
    ones share a task. Folders, not bytes, are the work, and AQE would join small tasks to one."""
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


#: Rows of a day that lie in one task and file, at most about.
DAY_ROWS = 1 << 18


def _dealt_by_day(df: DataFrame, rows_by_day: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows by day, a large day in several parts, without the sample of _dealt(), which makes the rows twice.

    rows_by_day: date and rows, about how many rows a day has; a row a day, so it is broadcast."""
    parts = rows_by_day.select(F.col("date").alias("__day"), F.ceil(F.col("rows") / DAY_ROWS).alias("__parts"))
    rows = df.join(F.broadcast(parts), F.col("date").eqNullSafe(F.col("__day")), "left")
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(*keys), F.greatest(F.coalesce("__parts", F.lit(1)), F.lit(1))))
    number = max(tasks or 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(number, "date", "__part").sortWithinPartitions("date", *keys).select(*df.columns)


def target(path: str, policy: str = "replace", now: dt.datetime | None = None) -> tuple[str, str]:
    """(path, Spark mode) of an overwrite policy: replace, fail or timestamp (a new path)."""
    if policy == "replace":
        return path, "overwrite"
    if policy == "fail":
        return path, "errorifexists"
    if policy == "timestamp":
        return f"{path.rstrip('/')}-{(now or dt.datetime.now(dt.UTC)):%Y%m%d-%H%M%S}", "errorifexists"
    raise ValueError(f"unknown policy {policy!r}")


def daily_signals(signals: DataFrame, path: str, days: DataFrame | None = None, policy: str = "replace") -> DataFrame:
    """Write deduplicated date, symbol, filter_code as CSV, a folder a day; returns days_written (date, signals), in
    which empty days count too, and which is written beside them."""
    rows = signals.select("date", "symbol", "filter_code").dropDuplicates()
    where, mode = target(path, policy)
    _dealt(rows, "date", "symbol", "filter_code").write.mode(mode).partitionBy("date").option("header", True).csv(f"{where}/signals")
    counts = rows.groupBy("date").agg(F.count(F.lit(1)).alias("signals"))
    written = counts if days is None else days.select("date").join(counts, "date", "left").fillna({"signals": 0})
    written.write.mode(mode).parquet(f"{where}/days_written")
    return rows.sparkSession.read.parquet(f"{where}/days_written")


def report_tables(tables: dict[str, DataFrame], path: str, policy: str = "replace") -> list[str]:
    """Write each table as CSV in a folder of its name."""
    where, mode = target(path, policy)
    for name, table in tables.items():
        table.write.mode(mode).option("header", True).csv(f"{where}/{name}")
    return [f"{where}/{n}" for n in tables]


def per_day(trades: DataFrame, stats: DataFrame | Callable[[DataFrame], DataFrame], path: str, policy: str = "replace", rows_by_day: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Trades in a folder a day, sorted by rule and symbol within its files, and the days' statistics beside them. Returns
    the trades as a read of their files.

    `stats` may be a function, which is given that read, so that the trades are made once. `rows_by_day` (see
    _dealt_by_day) and `tasks` spare the sample that finds ranges of trades, for which they are made as well.
    """
    where, mode = target(path, policy)
    keys = ("filter_code", "symbol")
    rows = _dealt(trades, "date", *keys) if rows_by_day is None else _dealt_by_day(trades, rows_by_day, tasks, *keys)
    rows.write.mode(mode).partitionBy("date").option("header", True).csv(f"{where}/trades")
    schema = T.StructType([*[f for f in trades.schema.fields if f.name != "date"], trades.schema["date"]])
    back = trades.sparkSession.read.schema(schema).option("header", True).csv(f"{where}/trades")
    (stats(back) if callable(stats) else stats).write.mode(mode).option("header", True).csv(f"{where}/days")
    return back


def documents(tables: dict[str, DataFrame], path: str, policy: str = "replace") -> None:
    """Metrics, folds or audit events as JSON lines."""
    where, mode = target(path, policy)
    for name, table in tables.items():
        table.write.mode(mode).json(f"{where}/{name}")


def _doubles(panel: DataFrame) -> DataFrame:
    return panel.withColumns({f.name: F.col(f.name).cast("double") for f in panel.schema.fields if f.name not in ("symbol", "date")})


def symbol_store(panel: DataFrame, path: str, policy: str = "replace", tasks: int | None = None) -> None:
    """Bars as Parquet partitioned by symbol, all numbers doubles.

    `tasks`: symbols are dealt whole to so many, which costs nothing where the panel lies so (sources.bars.panel); ranges
    would make the panel twice, once for their sample.
    """
    where, mode = target(path, policy)
    rows = _doubles(panel)
    rows = rows.repartition(tasks, "symbol").sortWithinPartitions("symbol", "date") if tasks else _dealt(rows, "symbol", "date")
    rows.write.mode(mode).partitionBy("symbol").parquet(where)


#: How readers.symbol_files() finds in a path the name that symbol_files() gave it.
WRITTEN = r"/symbol=([^/]*?)(?:\.csv|/[^/]+)$"


def symbol_name(symbol: Column) -> Column:
    """A symbol, null too, as part of a file's name: what is no letter, digit or one of .-_+ is ~ and its code."""
    return F.coalesce(F.translate(F.replace(F.url_encode(symbol), F.lit("*"), F.lit("%2A")), "%", "~"), F.lit("~00"))


def name_symbol(name: Column) -> Column:
    """The symbol that symbol_name() made a name of."""
    return F.nullif(F.url_decode(F.translate(name, "~", "%")), F.lit("\0"))


def symbol_files(rows: DataFrame, path: str, tasks: int | None = None) -> None:
    """A CSV with a header for each symbol, in order of date, which only its path names (readers.symbol_files, WRITTEN), in
    a folder that is not there yet.

    `tasks`: see symbol_store(). On a file: path tasks write `symbol=S.csv` themselves, each file under a hidden name until
    it is whole: Hadoop's local file system starts processes of its own for the permissions of each file made or listed,
    which takes longer than the file. Elsewhere it is a folder a symbol, by Spark's writer.
    """
    spark = rows.sparkSession
    rows = rows.repartition(*filter(None, [tasks]), "symbol")
    named = rows.withColumn("__name", symbol_name(F.col("symbol")))
    columns = [c for c in rows.columns if c != "symbol"]
    folder = _local(spark, path)
    if folder is None:
        named = named.sortWithinPartitions("__name", "date").select(*columns, F.col("__name").alias("symbol"))
        named.write.partitionBy("symbol").option("header", True).csv(path)
        return
    os.makedirs(folder)
    lines = named.sortWithinPartitions("__name", "date").select("__name", F.concat(F.to_csv(F.struct(*columns)), F.lit("\n")).alias("line"))
    header = spark.range(1).select(F.to_csv(F.struct(*[F.lit(c) for c in columns]))).first()[0]
    lines.mapInArrow(_file_a_name(folder, f"{header}\n"), "files long").agg(F.sum("files")).collect()
    open(f"{folder}/_SUCCESS", "w").close()


def _file_a_name(folder: str, header: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the lines of sorted names to a file each; a file that is there, by a task that was lost, is replaced whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name, out = 0, None, None

        def done() -> int:
            if out is None:
                return 0
            out.close()
            os.replace(out.name, f"{folder}/symbol={name}.csv")
            return 1

        for batch in batches:
            if batch.num_rows == 0:
                continue
            runs = pc.run_end_encode(batch.column("__name"))
            ends = pa.concat_arrays([pa.array([0], pa.int32()), runs.run_ends])
            texts = pc.binary_join(pa.ListArray.from_arrays(ends, batch.column("line").cast(pa.string())), "")
            for here, text in zip(runs.values.to_pylist(), texts, strict=True):
                if here != name:
                    files += done()
                    name, out = here, open(f"{folder}/.{uuid.uuid4().hex}", "wb")
                    out.write(header.encode())
                out.write(text.as_buffer())
        files += done()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return run


def bucketed_store(panel: DataFrame, name: str, path: str, buckets: int, policy: str = "replace") -> DataFrame:
    """Bars as the table `name` at `path`, in `buckets` by symbol and sorted by symbol and date, all numbers doubles.

    Windows, groups and joins by symbol that read it need no exchange, and no folder or file is made for a symbol. About a
    task's worth of bars should fall to a bucket; series too long for a task are read by cells (operators.series).
    """
    where, mode = target(path, policy)
    rows = _doubles(panel).repartition(buckets, "symbol").sortWithinPartitions("symbol", "date")
    rows.write.mode(mode).bucketBy(buckets, "symbol").sortBy("symbol", "date").option("path", where).format("parquet").saveAsTable(name)
    return panel.sparkSession.table(name)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def _local(spark: SparkSession, path: str) -> str | None:
    """The path on the local file system, if that is where it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    at = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toUri()
    return at.getPath() if at.getScheme() == "file" else None


def _store(rows: DataFrame) -> DataFrameWriter:
    """Rows by month and, within a month, by ranges of symbols: about as many files as months and tasks, whose statistics
    let a reader of few symbols skip the others; AQE sets the number of tasks by bytes."""
    return rows.repartitionByRange("yyyymm", "symbol").sortWithinPartitions("yyyymm", "symbol", "date").write.partitionBy("yyyymm")


def first_of(rows: DataFrame, keys: tuple[str, ...], first: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key, null like any other: the least by `first`, then by its other columns in order."""
    rest = [c for c in rows.columns if c not in keys and c not in first]
    if not first and not rest:
        return rows.dropDuplicates(list(keys))
    kept = rows.groupBy(*keys).agg(F.min(F.struct(*first, *rest)).alias("__r"))
    return kept.select(*[c if c in keys else F.col("__r")[c].alias(c) for c in rows.columns])


def upsert(new: DataFrame, path: str, first: tuple[str, ...] = ()) -> DataFrame:
    """Add bars to the store yyyymm=; a (symbol, date) that is there stays as it is, so rows are only ever appended.

    Of the store just the keys of the months in question are read (their few names are broadcast and prune the folders).
    Of new rows with one (symbol, date) the least by `first` and then by all columns is taken. Returns the rows added, as
    a read of the store: each has the upsert's own number. The files of a run appear together, when its job commits; one
    that is lost before leaves the store as it was. Writing the same rows again adds none; a null symbol or date is a key
    like any other.
    """
    spark, number = new.sparkSession, uuid.uuid4().hex
    rows = first_of(new, ("symbol", "date"), first).withColumn("yyyymm", F.date_format("date", "yyyyMM"))
    there = exists(spark, path)
    if there:
        months = F.broadcast(new.select(F.date_format("date", "yyyyMM").alias("__month")).distinct())
        held = read_store(spark, path).join(months, F.col("yyyymm").eqNullSafe(F.col("__month")), "left_semi")
        held = held.select(F.col("symbol").alias("__symbol"), F.col("date").alias("__date"))
        rows = rows.join(held, F.col("symbol").eqNullSafe(F.col("__symbol")) & F.col("date").eqNullSafe(F.col("__date")), "left_anti")
    if not there and rows.isEmpty():  # a store without a row has no files to read a schema from
        return rows
    _store(rows.withColumn("__batch", F.lit(number))).mode("append").parquet(path)
    return _read(spark, path).where(F.col("__batch") == number).select(*rows.columns)


def compact(spark: SparkSession, path: str, out: str) -> None:
    """Copy a store that many upserts have left in small files, with each month in as few as its bytes ask for."""
    _store(_read(spark, path)).mode("overwrite").parquet(out)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("yyyymm", F.col("yyyymm").cast("string"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path).drop("__batch")


def high_water(store: DataFrame, source: str = "provider", ttl_hours: int = 0, fetched: Column | None = None) -> DataFrame:
    """symbol, last_date, last_fetch_ts, source, ttl_hours; `fetched` (now where not given) over symbol and last_date."""
    marks = store.groupBy("symbol").agg(F.max("date").alias("last_date"))
    return marks.withColumns({"last_fetch_ts": F.current_timestamp() if fetched is None else fetched, "source": F.lit(source), "ttl_hours": F.lit(ttl_hours)})


def due(wanted: DataFrame, marks: DataFrame, start, end, now: Column | None = None) -> DataFrame:
    """symbol, from, to: what is still to be fetched of the wanted symbols up to `end`.

    A symbol fetched within its ttl_hours is fresh and left out; another goes on from the day after its last_date, one
    without a mark from `start`; nothing is asked for that ends before it begins.
    """
    now = F.current_timestamp() if now is None else now
    rows = wanted.select("symbol").distinct().join(marks, "symbol", "left")
    age = F.unix_timestamp(now) - F.unix_timestamp("last_fetch_ts")
    stale = rows.where(F.col("last_fetch_ts").isNull() | (age >= F.col("ttl_hours") * 3600))
    begin = F.coalesce(F.date_add("last_date", 1), F.lit(start).cast("date"))
    return stale.select("symbol", begin.alias("from"), F.lit(end).cast("date").alias("to")).where("`from` <= `to`")


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """The newest high-water marks of a folder of versions; no rows where there are none."""
    versions = _versions(spark, path)
    empty = "symbol string, last_date date, last_fetch_ts timestamp, source string, ttl_hours int"
    return spark.read.parquet(f"{path}/version={versions[-1]:08d}").select("symbol", "last_date", "last_fetch_ts", "source", "ttl_hours") if versions else spark.createDataFrame([], empty)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole."""
    if not exists(spark, path):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(where)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and exists(spark, f"{path}/{n}/_SUCCESS"))


def fetch(wanted: DataFrame, source: Callable[[DataFrame], DataFrame], store: str, marks: str, start, end, name: str = "provider", ttl_hours: int = 0, now: Column | None = None) -> DataFrame:
    """Fetch what is due: due() -> source -> upsert -> new marks. Returns what was asked for (symbol, from, to).

    `source` turns a table of symbol, from, to into bars, all symbols in one job. Symbols whose bars came get a mark with
    the latest of their dates; the others keep theirs, and are asked for again. Marks are written last, as a new version
    of the folder `marks`: a fetch that is lost before is done again and adds nothing twice.
    """
    spark = wanted.sparkSession
    now = F.current_timestamp() if now is None else now
    old = read_marks(spark, marks)
    asked = due(wanted, old, start, end, now)
    bars = source(asked)
    upsert(bars, store)
    came = bars.groupBy("symbol").agg(F.max("date").alias("__last"))
    new = old.withColumnRenamed("symbol", "__symbol").join(came, F.col("symbol") == F.col("__symbol"), "full")
    here = F.col("__last").isNotNull()
    new = new.select(F.coalesce("symbol", "__symbol").alias("symbol"), F.greatest("last_date", "__last").alias("last_date"), F.when(here, now).otherwise(F.col("last_fetch_ts")).alias("last_fetch_ts"), F.when(here, F.lit(name)).otherwise(F.col("source")).alias("source"), F.when(here, F.lit(ttl_hours)).otherwise(F.col("ttl_hours")).alias("ttl_hours"))
    number = (_versions(spark, marks) or [0])[-1] + 1
    new.write.mode("overwrite").parquet(f"{marks}/version={number:08d}")
    return asked


def retain(spark: SparkSession, path: str, cutoff: str, out: str) -> None:
    """Copy the store without bars before the cutoff (by their own date); folders of months before it are not read, and the
    copy is compact."""
    month = F.date_format(F.lit(cutoff).cast("date"), "yyyyMM")
    kept = _read(spark, path).where((F.col("yyyymm") >= month) & (F.col("date") >= F.lit(cutoff).cast("date")))
    _store(kept).mode("overwrite").parquet(out)
