"""Bars of events as they come: open days kept as files, bars once their day is over, and a table of what came too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The state store of queries with keyed state; live bars keep none there.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

OUT = "kind string, symbol string, date date, ts timestamp, event_id long, value double, volume double, events long"
_EVENT = "batch long, date date, symbol string, ts timestamp, event_id long, value double, mark timestamp"


def live_bars(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """symbol, date, ts, event_id, value, mark of a stream of symbol, ts, event_id, value, for write_live(); `mark` is how
    far the event moves the watermark (the latest time seen less `delay`)."""
    ts, value = F.col("ts").cast("timestamp"), F.col("value").cast("double")
    return events.select("symbol", ts.cast("date").alias("date"), ts.alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.when(~F.isnan(value), value).alias("value"), (ts - F.expr(f"interval {delay}")).alias("mark"))


def _over(mark: int | None) -> Column:
    """The day is over at this watermark (in microseconds); before the first event no day is."""
    return F.coalesce(F.date_add("date", 1).cast("timestamp") <= F.timestamp_micros(F.lit(mark).cast("long")), F.lit(False))


def _forget(spark: SparkSession, open_: str, last: str) -> None:
    """Remove the events of days up to `last`, whose bars an earlier batch has given out."""
    every = spark._jvm.org.apache.hadoop.fs.Path(f"{open_}/batch=*/date=*")
    files = every.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for found in files.globStatus(every) or []:
        if found.getPath().getName().removeprefix("date=") <= last:
            files.delete(found.getPath(), True)


def _day_bars(open_: DataFrame) -> DataFrame:
    """Of what repeats an id of its symbol and day the first to come counts; events without an id all count."""
    first = F.min(F.struct("batch", "ts", "value"))
    named = open_.where("event_id is not null").groupBy("symbol", "date", "event_id").agg(first.alias("e")).select("symbol", "date", "event_id", "e.ts", "e.value")
    rows = named.unionByName(open_.where("event_id is null").select(*named.columns)).withColumn("at", F.struct("ts", F.coalesce("event_id", F.lit(-1)).alias("id")))
    bars = rows.groupBy("symbol", "date").agg(F.max("at").alias("at"), F.max_by("value", "at").alias("value"), F.sum(F.coalesce("value", F.lit(0.0))).alias("volume"), F.count(F.lit(1)).alias("events"))
    return bars.select(F.lit("bar").alias("kind"), "symbol", "date", F.col("at")["ts"].alias("ts"), F.nullif(F.col("at")["id"], F.lit(-1)).alias("event_id"), "value", "volume", "events")


def write_live(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Bars and late events of live_bars() to `path`, a folder for each kind and batch.

    kind `bar`: the bar of a day, given out once, when no event may come for it any more: value is the last one by (ts,
    event_id), volume their sum, events their number, each id counting once. kind `late`: an event whose day was over, by
    the watermark of the batches before, when it came. Events of open days lie by batch and day beside the checkpoint, and
    a batch reads just the days that it closes; they go with the batch
    after. A batch that is run again overwrites its own files, and sees those of the
    batches before it alone.
    """
    open_, marks = f"{checkpoint}/live/open", f"{checkpoint}/live/marks"

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        mark = F.max("mark")
        upto = lambda n: spark.read.schema("batch long, mark timestamp").parquet(marks).where(F.col("batch") <= n).agg(F.unix_micros(mark), F.date_sub(mark, 1).cast("string")).first()
        before, last = upto(number - 1) if number else (None, None)
        if last:
            _forget(spark, open_, last)
        rows.agg(F.max("mark").alias("mark")).write.mode("overwrite").parquet(f"{marks}/batch={number}")
        after, _ = upto(number)
        rows.where(~_over(before)).hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(f"{open_}/batch={number}")
        held = spark.read.schema(_EVENT).parquet(open_).where(F.col("batch") <= number)
        late = rows.where(_over(before)).select(F.lit("late").alias("kind"), "symbol", "date", "ts", "event_id", "value", F.lit(None).cast("double").alias("volume"), F.lit(1).cast("long").alias("events"))
        closed = _day_bars(held.where(_over(after) & ~_over(before)))
        closed.unionByName(late).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={number}")

    return out.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_live(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The `bar` or the `late` rows that write_live() has written."""
    return spark.read.schema(f"{OUT}, batch long").parquet(path).where(F.col("kind") == kind).drop("kind", "batch")
