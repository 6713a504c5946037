"""Incremental bars: ingest what is new, once; scan what came.

The checkpoint is the high-water mark: a run with availableNow takes the files that no run has taken, and stops.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules as R
from ..sources import writers


def symbol_of() -> Column:
    return F.concat(F.lit("U"), F.col("user_id").cast("string"))


def event_bars(events: DataFrame) -> DataFrame:
    """symbol, date, close, volume of an event stream or table: the day's last value and the sum of values."""
    rows = events.select(symbol_of().alias("symbol"), F.col("ts").cast("date").alias("date"), "ts", "event_id", "value")
    return rows.groupBy("symbol", "date").agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.sum("value").alias("volume"))


def unique_bars(stream: DataFrame, time: str = "ts", late: str = "2 days", keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """One row for each key however often it arrives within the watermark; state older than it is dropped."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def ingest(spark: SparkSession, source: str, schema: T.StructType, store: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Take new Parquet files of `source` into the store by upsert; the same bars twice leave one row.

    Files hold bars, or all events of the bars that they touch; events that come bit by bit need ingest_events().
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            writers.upsert(shape(rows) if shape else rows, store)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- events that come bit by bit


def event_key(columns: list[str], key: str) -> Column:
    """What tells events apart: the id, or, where it is null, all that the event says."""
    said = F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns])), 256)
    return F.when(F.col(key).isNull(), F.concat(F.lit("row:"), said)).otherwise(F.concat(F.lit("id:"), F.col(key).cast("string")))


def partial_bars(events: DataFrame) -> DataFrame:
    """symbol, date, last (ts, event_id), close, volume: bars that merge with others of the same day by merged_bars()."""
    rows = events.select(symbol_of().alias("symbol"), F.col("ts").cast("date").alias("date"), F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id")).alias("at"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("symbol", "date").agg(F.max("at").alias("last"), F.max_by("value", F.struct("at", "value")).alias("close"), F.sum("value").alias("volume"))


def merged_bars(partials: DataFrame) -> DataFrame:
    """Partial bars of the same symbol and day as one; in any grouping, any number of times."""
    return partials.groupBy("symbol", "date").agg(F.max("last").alias("last"), F.max_by("close", F.struct("last", "close")).alias("close"), F.sum("volume").alias("volume"))


def _parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole parts of a folder."""
    if not writers.exists(spark, path):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(where)]
    return sorted(n for n in names if n.startswith("part=") and writers.exists(spark, f"{path}/{n}/_SUCCESS"))


def _live(spark: SparkSession, store: str) -> list[str]:
    """Parts of the bars that no compacted part has taken up."""
    parts = _parts(spark, f"{store}/bars")
    covered = {x for p in parts if writers.exists(spark, f"{store}/covered/{p}") for x in (r["part"] for r in spark.read.parquet(f"{store}/covered/{p}").collect())}
    return [p for p in parts if p not in covered]


_PARTIAL = "symbol string, date date, last struct<ts:timestamp,event_id:bigint>, close double, volume double"


def read_bars(spark: SparkSession, store: str) -> DataFrame:
    """symbol, date, close, volume from the partial bars of all parts, merged on read."""
    live = [f"{store}/bars/{p}" for p in _live(spark, store)]
    partials = spark.read.schema(_PARTIAL).parquet(*live) if live else spark.createDataFrame([], _PARTIAL)
    return merged_bars(partials).select("symbol", "date", "close", "volume")


def compact_bars(spark: SparkSession, store: str) -> None:
    """Merge all partial bars into one part. Readers go over to it at the moment it gets its name; the parts that it took
    up are listed beforehand, so that none is read twice, and removed afterwards."""
    live = _live(spark, store)
    if len(live) < 2:
        return
    name = f"part=compact-{uuid.uuid4().hex}"
    _by_day(merged_bars(spark.read.schema(_PARTIAL).parquet(*[f"{store}/bars/{p}" for p in live]))).parquet(f"{store}/bars/_{name}")
    spark.createDataFrame([(p,) for p in live], "part string").coalesce(1).write.mode("overwrite").parquet(f"{store}/covered/{name}")
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{store}/bars/{p}")
    files = at("x").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.rename(at(f"_{name}"), at(name)):
        raise OSError(f"{store}/bars/_{name} could not be renamed")
    for p in live:
        files.delete(at(p), True)


def _by_day(bars: DataFrame):
    """Bars by ranges of (date, symbol): no task holds a day because it is large."""
    return bars.repartitionByRange("date", "symbol").sortWithinPartitions("date", "symbol").write.mode("overwrite")


def ingest_events(spark: SparkSession, source: str, schema: T.StructType, store: str, checkpoint: str, key: str = "event_id", time: str = "ts") -> StreamingQuery:
    """Take new event files into `store`/events, once for each key (see event_key; a null id is no key, so such events count
    once for each different content), and their partial bars into `store`/bars, to be merged by read_bars().

    Each batch has a part of its own in both, named after checkpoint and number, and looks for known keys in the others'
    events of its days: a batch that is run again finds the same and writes the same. Where events of one batch share a
    key, the least row counts.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    names = [f.name for f in schema.fields]
    stored = T.StructType([*schema.fields, T.StructField("__key", T.StringType()), T.StructField("part", T.StringType()), T.StructField("day", T.DateType())])
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        part = f"{run}-{number:08d}"
        keyed = rows.select(*names, event_key(names, key).alias("__key"))
        new = writers.first_of(keyed, ("__key",)).withColumn("day", F.col(time).cast("date"))
        if writers.exists(spark, f"{store}/events"):
            held = spark.read.schema(stored).parquet(f"{store}/events").where(F.col("part") != part)
            known = held.join(F.broadcast(new.select("day").distinct()), "day", "left_semi").select("__key")
            new = new.join(known, "__key", "left_anti")
        # by ranges of day and key: a large day goes to several tasks
        new.repartitionByRange("day", "__key").write.mode("overwrite").partitionBy("day").parquet(f"{store}/events/part={part}")
        fresh = spark.read.schema(T.StructType([*schema.fields, T.StructField("day", T.DateType())])).parquet(f"{store}/events/part={part}")
        _by_day(partial_bars(fresh)).parquet(f"{store}/bars/part={part}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_new(spark: SparkSession, source: str, schema: T.StructType, store: str, signals: str, checkpoint: str, rules: list[R.Rule], prepare: Callable[[DataFrame], DataFrame], look_back_days: int = 90) -> StreamingQuery:
    """Take new bars into the store and append the signals of just the new bars.

    Rules see `look_back_days` of history of the symbols that got bars, read back from the store; no state is kept.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        writers.upsert(rows, store)
        new = rows.select("symbol", "date").distinct()
        since = new.groupBy("symbol").agg(F.date_sub(F.min("date"), look_back_days).alias("since"))
        history = writers.read_store(spark, store).join(since, "symbol").where("date >= since").drop("since", "yyyymm")
        found = R.scan(prepare(history), rules).join(new, ["symbol", "date"], "left_semi")
        # a batch that is run again overwrites its own folder
        found.select("date", "symbol", "filter_code").write.mode("overwrite").parquet(f"{signals}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
