"""Walk-forward and cross-validation folds, parameter search."""

from __future__ import annotations

import datetime as dt
import itertools
import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import metrics as M


def walk_forward(spark: SparkSession, start: str, end: str, train: int, test: int, step: int | None = None, least_train: int | None = None) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end (dates): tests follow each other by `step` days, each after up
    to `train` days; the last is cut at `end`."""
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if last < first:
        raise ValueError("end is before start")
    lead = max(train, least_train or train)
    step = step or test
    days = lambda n: F.make_interval(days=F.lit(n))
    d0, d1 = F.lit(first), F.lit(last)
    begin = F.date_add(d0, lead)
    if first + dt.timedelta(days=lead) > last:
        starts = spark.range(0).select(F.lit(first).alias("test_start"))
    else:
        starts = spark.range(1).select(F.explode(F.sequence(begin, d1, days(step))).alias("test_start"))
    out = starts.select(
        (F.datediff("test_start", begin) / step).cast("int").alias("fold"),
        F.greatest(d0, F.date_sub("test_start", train)).alias("train_start"),
        F.date_sub("test_start", 1).alias("train_end"),
        "test_start",
        F.least(d1, F.date_add("test_start", test - 1)).alias("test_end"),
    )
    return out.where("train_end >= train_start")


def days_of(folds: DataFrame, part: str = "test") -> DataFrame:
    """The folds' rows, one for each day of their train or test span, named date: a lookup table."""
    return folds.withColumn("date", F.explode(F.sequence(F.col(f"{part}_start"), F.col(f"{part}_end"), F.expr("interval 1 day"))))


def in_folds(rows: DataFrame, folds: DataFrame, part: str = "test") -> DataFrame:
    """Each row with each fold whose train or test span holds its date: an equi-join with the folds' days, of which there
    are as many as the calendar has and as spans overlap, whatever the number of rows; the optimiser broadcasts them by
    their size."""
    lookup = days_of(folds.where(F.col(f"{part}_start") <= F.col(f"{part}_end")), part).withColumnRenamed("date", "__day")
    return rows.join(lookup, rows["date"].cast("date") == F.col("__day")).drop("__day")


def ordinals(rows: DataFrame) -> DataFrame:
    """date, pos (from 0), n: of the distinct dates of a table, one row a day."""
    days = rows.select("date").distinct()
    return days.select("date", (F.row_number().over(W.orderBy("date")) - 1).cast("long").alias("pos"), F.count(F.lit(1)).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"))


def purged_kfold(rows: DataFrame, splits: int, embargo: int = 0) -> DataFrame:
    """fold, date, part (train, test or embargo) for every fold and date: equal test blocks, train on the rest but for the
    embargo on both sides."""
    size = F.floor(F.col("n") / splits)
    a, b = F.col("fold") * size, (F.col("fold") + 1) * size
    part = F.when((F.col("pos") >= a) & (F.col("pos") < b), "test").when((F.col("pos") < F.greatest(F.lit(0), a - embargo)) | (F.col("pos") >= F.least(F.col("n"), b + embargo)), "train").otherwise("embargo")
    return ordinals(rows).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).select("fold", "date", part.alias("part"))


def expanding(rows: DataFrame, folds: int, embargo: int = 0) -> DataFrame:
    """fold, date, part: train on all before a test block, less the embargo; folds that run over the end are left out."""
    size = F.floor(F.col("n") / (folds + 1))
    end = size * (F.col("fold") + 1)
    a = end + embargo
    b = a + size
    part = F.when(F.col("pos") < end, "train").when((F.col("pos") >= a) & (F.col("pos") < b), "test").when((F.col("pos") >= end) & (F.col("pos") < a), "embargo")
    return ordinals(rows).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(b <= F.col("n")).select("fold", "date", part.alias("part")).where("part is not null")


def cross_validate(returns: DataFrame, parts: DataFrame, r: str = "r", by: tuple[str, ...] = (), turnover_each: float = 1.0, score: Column | None = None) -> DataFrame:
    """by..., fold and the strategy metrics of each fold's test rows, with score."""
    test = parts.where("part = 'test'").select("fold", "date")
    rows = returns.join(F.broadcast(test), "date")
    table = M.strategy_metrics(rows, [*by, "fold"], r, turnover_each)
    return table.withColumn("score", score if score is not None else M.objective())


def grid(spark: SparkSession, space: dict[str, list[float]], most: int | None = None) -> DataFrame:
    """iter and one column a parameter: the product of the values, in order."""
    combos = list(itertools.islice(itertools.product(*space.values()), most))
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(combos)], "iter int, " + ", ".join(f"{k} double" for k in space))


def drawn(space: dict[str, list[float] | tuple[int, int]], n: int, seed: int) -> list[tuple[float, ...]]:
    """(iter, values...): random picks from lists, or whole numbers from [low, high)."""
    rng = random.Random(seed)
    return [(i, *(float(rng.choice(v)) if isinstance(v, list) else float(rng.randrange(*v)) for v in space.values())) for i in range(n)]


def draws(spark: SparkSession, space: dict[str, list[float] | tuple[int, int]], n: int, seed: int) -> DataFrame:
    """iter and one column a parameter, as drawn()."""
    return spark.createDataFrame(drawn(space, n, seed), "iter int, " + ", ".join(f"{k} double" for k in space))


#: Parameters that one pass over the returns takes.
VECTOR = 256


def _segments(rows: pa.Table) -> pa.Table:
    """One row of arrays, an element a parameter, from the rows of a fold's cell in order of date: what search() merges.

    n, mean and m2 (squared deviations) of the returns and of those below 0, gains, the product of 1 + r, the greatest and
    the least of its running values, and the deepest drawdown.
    """
    rows = rows.take(pc.sort_indices(rows.column("date")))
    lists = rows.column("v").combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    there = ~np.isnan(x)
    zero = np.where(there, x, 0.0)
    low = there & (zero < 0)

    def moments(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = of.sum(axis=0)
        mean = np.where(of, zero, 0.0).sum(axis=0) / np.maximum(n, 1)
        return n.astype(float), mean, (np.where(of, zero - mean, 0.0) ** 2).sum(axis=0)

    growth = np.cumprod(np.maximum(1 + zero, 0.0), axis=0)
    peak = np.maximum.accumulate(growth, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        deepest = np.nanmin(np.where(peak > 0, growth / peak - 1, np.nan), axis=0, initial=0.0)
    columns = [*moments(there), *moments(low), (zero > 0).sum(axis=0).astype(float), np.full(x.shape[1], float(len(rows))), growth[-1], growth.max(axis=0), growth.min(axis=0), deepest]
    head = [rows.column(c).slice(0, 1).combine_chunks() for c in ("fold", "__cell")]
    return pa.table([*head, pa.array([np.column_stack(columns).ravel()], pa.list_(pa.float64()))], names=["fold", "__cell", "s"])


#: Numbers of a segment for each parameter.
SEGMENT = 12


def _scores(rows: pa.Table) -> pa.Table:
    """(fold, at, metrics...) from the segments of a fold: merged two at a time, in order."""
    rows = rows.take(pc.sort_indices(rows.column("__cell")))
    a = None
    for s in rows.column("s").to_pylist():
        b = np.array(s).reshape(-1, SEGMENT).T
        if a is None:
            a = b
            continue
        out = []
        for i in (0, 3):
            n = a[i] + b[i]
            gap = b[i + 1] - a[i + 1]
            out += [n, a[i + 1] + gap * b[i] / np.maximum(n, 1), a[i + 2] + b[i + 2] + gap**2 * a[i] * b[i] / np.maximum(n, 1)]
        with np.errstate(divide="ignore", invalid="ignore"):
            across = np.where(a[9] > 0, a[8] * b[10] / a[9] - 1, 0.0)
        out += [a[6] + b[6], a[7] + b[7], a[8] * b[8], np.maximum(a[9], a[8] * b[9]), np.minimum(a[10], a[8] * b[10]), np.minimum(np.minimum(a[11], b[11]), across)]
        a = np.array(out)
    n, mean, m2, down_n, _, down_m2, gains, days_, growth, _, _, deepest = a
    deviation = lambda k, m: np.where((k > 1) & (m > 0), np.sqrt(m / np.maximum(k - 1, 1)), 1.0)
    year = M.YEAR
    with np.errstate(invalid="ignore"):
        columns = {"sharpe": mean / deviation(n, m2) * year**0.5, "sortino": mean / deviation(down_n, down_m2) * year**0.5, "cagr": (growth ** (year / days_) - 1) * 100, "max_drawdown": -deepest * 100, "hit_rate": gains / days_}
    fold = pa.array([rows.column("fold")[0].as_py()] * len(n), pa.int32())
    return pa.table({"fold": fold, "at": pa.array(np.arange(len(n)), pa.int32()), **{k: pa.array(v) for k, v in columns.items()}, "trades": pa.array(days_.astype(np.int64))})


def search(returns: DataFrame, params: DataFrame, parts: DataFrame, outcome: Callable[[dict[str, Column]], Column], turnover_each: float = 1.0) -> DataFrame:
    """iter, params..., score: the mean over folds of the objective of outcome(p), a column over returns and parameters.

    A row of returns gets the outcomes of all parameters as one array; cells of a fold's rows become segments, arrays of
    sums that merge in any grouping, so nothing is multiplied by the grid but the arrays. The grid is configuration and
    lies on the driver, VECTOR of its rows in a pass.
    """
    names = [c for c in params.columns if c != "iter"]
    spark, grid_rows = returns.sparkSession, params.orderBy("iter").collect()
    tests = parts.where("part = 'test'").select(F.col("fold").cast("int").alias("fold"), "date")
    rows = M.in_cells(returns.join(F.broadcast(tests), "date"))
    out = None
    for a in range(0, len(grid_rows), VECTOR):
        some = grid_rows[a : a + VECTOR]
        vector = F.array(*[outcome({k: F.lit(r[k]) for k in names}).cast("double") for r in some])
        cells = rows.select("fold", "__cell", "date", vector.alias("v")).groupBy("fold", "__cell").applyInArrow(_segments, "fold int, __cell long, s array<double>")
        table = cells.groupBy("fold").applyInArrow(_scores, "fold int, at int, sharpe double, sortino double, cagr double, max_drawdown double, hit_rate double, trades long")
        table = table.withColumn("turnover", F.col("trades") * turnover_each).withColumn("score", M.objective())
        mean = table.groupBy("at").agg(F.avg("score").alias("score"))
        numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(some)], T.StructType([T.StructField("at", T.IntegerType()), *params.schema.fields]))
        part = mean.join(F.broadcast(numbered), "at").select("iter", *names, "score")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else params.where("false").withColumn("score", F.lit(None).cast("double"))
