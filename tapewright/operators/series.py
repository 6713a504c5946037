"""Recurrences and windows over the bars of a symbol, for symbols of any length and without Python.

A step y = r y' + x composes: n of them are y = r^n y' + b. So a symbol's bars may be cut into cells of time that run in
parallel. Inside a cell b is a running sum of x r^-i, scaled by r^i; since r^-i would leave the range of doubles, i starts
anew every K steps, where r^K is WEIGHT, and what lies further back than the K steps before weighs nothing in a double.
Each cell then hands on one row, (steps, b); the same scan over these rows, by symbol, gives every cell the state that
it starts from. Without cells (the default, for symbols that fit a task) the scan over a symbol is the scan over one cell,
and shares its exchange with all other windows by symbol.

Windows of n bars over cells are taken in buckets of a fixed number of bars, found by a bar's place in its symbol, into
which the n bars before are copied.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What weighs nothing against 1 in a double, with room for values of very different sizes.
WEIGHT = 1e-150
#: Bars of a bucket that windows of many bars are cut into.
BUCKET = 1 << 16

_BY: ContextVar[tuple[str, ...]] = ContextVar("columns that bars are windowed by", default=("symbol",))


@contextmanager
def windowed_by(*columns: str):
    """Window expressions that are built inside are partitioned by these columns, not by symbol."""
    token = _BY.set(columns)
    try:
        yield
    finally:
        _BY.reset(token)


def by_symbol():
    return W.partitionBy(*_BY.get()).orderBy("date")


def days(n: int = 1024, date: str = "date") -> Column:
    """Cells of n days."""
    return F.floor(F.unix_date(F.col(date).cast("date")) / n)


def steps_of(ratios: Iterable[float]) -> int:
    """After how many steps the powers of all ratios start anew."""
    return min((max(1, math.floor(math.log(WEIGHT) / math.log(r))) for r in ratios if 0 < r < 1), default=1 << 30)


def scanned(df: DataFrame, terms: dict[str, tuple[str, float]], step: str, by: tuple[str, ...], order: str) -> DataFrame:
    """Adds, for out -> (x, r), out = sum of x r^(steps since) over this row and those before it among the rows of the same
    `by`. x is never null; `step` counts from 0 or 1 in `order`, and may stand still where x is 0."""
    k = steps_of(r for _, r in terms.values())
    at = F.col(step) - 1  # the first bar weighs exactly 1
    chunk, i = F.floor(at / k), F.pmod(at, F.lit(k)).cast("double")
    rows = df.withColumns({"__chunk": chunk, "__i": i})
    scaled = {o: F.col(x) * F.pow(F.lit(r), -F.col("__i")) for o, (x, r) in terms.items() if 0 < r < 1}
    rows = rows.withColumns({f"__w_{o}": c for o, c in scaled.items()}) if scaled else rows
    here = W.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy("__chunk").rangeBetween(-1, -1)
    all_ = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    new = {}
    for o, (x, r) in terms.items():
        if r == 0:
            new[o] = F.col(x)
        elif r == 1:
            new[o] = F.sum(x).over(all_)
        else:
            new[f"__h_{o}"], new[f"__b_{o}"] = F.sum(f"__w_{o}").over(here), F.sum(f"__w_{o}").over(before)
    rows = rows.withColumns(new)
    done = {o: F.pow(F.lit(terms[o][1]), F.col("__i")) * (F.col(f"__h_{o}") + F.coalesce(F.col(f"__b_{o}"), F.lit(0.0)) * terms[o][1] ** k) for o in scaled}
    rows = rows.withColumns({f"__y_{o}": c for o, c in done.items()}) if done else rows
    # the last step as the recurrence itself takes it: a mean of few values is then as exact as theirs
    w = W.partitionBy(*by).orderBy(order)
    if done:
        rows = rows.withColumns({"__gap": (F.col(step) - F.lag(step).over(w)).cast("double")} | {f"__l_{o}": F.lag(f"__y_{o}").over(w) for o in done})
        rows = rows.withColumns({o: F.col(terms[o][0]) + F.coalesce(F.col(f"__l_{o}") * F.pow(F.lit(terms[o][1]), F.col("__gap")), F.lit(0.0)) for o in done})
    return rows.drop("__chunk", "__i", "__gap", *[f"__{p}_{o}" for o in scaled for p in "whbyl"])


class Series:
    """The bars of all symbols, in order of date, with columns added step by step.

    cell None: a symbol's bars lie in one task. Else a column that grows with the date; no task then holds more of a
    symbol than a cell (or a bucket); bars without a symbol or a date are then no series. Adds __pos, a bar's place in its symbol from 1, and for each column c of `present`
    __n_c and __s_c, the count and the sum of its values so far.

    tasks: bars lie in so many tasks by symbol and cell (sources.bars.panel(cell=)); what is joined to them, and buckets, are
    dealt to as many, so that a task's share does not grow with the table. Else as many as the session's shuffles have.
    """

    def __init__(self, df: DataFrame, cell: Column | None = None, edges: Iterable[str] = (), present: Iterable[str] = (), tasks: int | None = None):
        self.long, self.kept, self.tasks = cell is not None, df.columns, tasks
        self.by = ("symbol", "__cell") if self.long else ("symbol",)
        edges, present = list(edges), list(present)
        rows = df
        if self.long:
            rows = df.withColumn("__cell", cell.cast("long"))
            each = [F.count(F.lit(1)).alias("__rows"), *[F.max_by(c, "date").alias(f"__edge_{c}") for c in edges]]
            each += [f(c).alias(f"__{k}0_{c}") for c in present for k, f in (("n", F.count), ("s", F.sum))]
            w = W.partitionBy("symbol").orderBy("__cell")
            past = w.rowsBetween(W.unboundedPreceding, -1)
            sums = {n: F.coalesce(F.sum(n).over(past), F.lit(0)) for n in ["__rows", *[f"__{k}0_{c}" for c in present for k in "ns"]]}
            cells = rows.groupBy(*self.by).agg(*each).withColumns(sums | {f"__edge_{c}": F.lag(f"__edge_{c}").over(w) for c in edges})
            rows = self._joined(rows, cells)
        w = W.partitionBy(*self.by).orderBy("date")
        past = w.rowsBetween(W.unboundedPreceding, 0)
        new = {"__at": F.row_number().over(w)}
        for c in edges:
            new[f"__lag_{c}"] = F.lag(c).over(w)
        for c in present:
            new[f"__n_{c}"], new[f"__s_{c}"] = F.count(c).over(past), F.coalesce(F.sum(c).over(past), F.lit(0.0))
        rows = rows.withColumns(new)
        if self.long:
            first = F.col("__at") == 1
            rows = rows.withColumns({f"__lag_{c}": F.when(first, F.col(f"__edge_{c}")).otherwise(F.col(f"__lag_{c}")) for c in edges} | {f"__{k}_{c}": F.col(f"__{k}_{c}") + F.col(f"__{k}0_{c}") for c in present for k in "ns"})
        self.df = rows.withColumn("__pos", F.col("__at") + F.col("__rows") if self.long else F.col("__at").cast("long"))

    def _joined(self, rows: DataFrame, cells: DataFrame) -> DataFrame:
        """Rows with what belongs to their cell."""
        return rows.join(self._dealt(cells, *self.by), list(self.by), "left")

    def _dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(self.tasks, *keys) if self.tasks else rows

    def add(self, **columns: Column) -> Series:
        self.df = self.df.withColumns(columns)
        return self

    def lag(self, c: str) -> Column:
        """The bar before's value of an edge column."""
        return F.col(f"__lag_{c}")

    def scan(self, terms: dict[str, tuple[str, float]], step: str = "__pos") -> Series:
        """Adds out = r out' + x along `step` for out -> (x, r), from 0 before the first bar."""
        rows = scanned(self.df, terms, step, self.by, "date")
        if self.long:
            # a cell's last state and step; the states that the cells begin with, by the same scan over cells
            ends = rows.groupBy(*self.by).agg(F.max(step).alias("__end"), *[F.max_by(o, "date").alias(f"__e_{o}") for o in terms])
            states = scanned(ends, {f"__c_{o}": (f"__e_{o}", r) for o, (_, r) in terms.items()}, "__end", ("symbol",), "__cell")
            w = W.partitionBy("symbol").orderBy("__cell")
            states = states.select(*self.by, F.lag("__end").over(w).alias("__start"), *[F.lag(f"__c_{o}").over(w).alias(f"__c_{o}") for o in terms])
            past = {o: F.col(o) + F.coalesce(F.col(f"__c_{o}") * F.pow(F.lit(r), (F.col(step) - F.col("__start")).cast("double")), F.lit(0.0)) for o, (_, r) in terms.items() if r > 0}
            rows = self._joined(rows, states).withColumns(past).drop("__start", *[f"__c_{o}" for o in terms])
        self.df = rows
        return self

    def windows(self, look_back: int, build: Callable[[DataFrame], DataFrame], bucket: int = BUCKET) -> Series:
        """build(df), which adds columns by windows (by_symbol()) that reach at most `look_back` bars back."""
        if not self.long:
            self.df = build(self.df)
            return self
        size = max(bucket, look_back)
        number, place = F.floor((F.col("__pos") - 1) / size), F.pmod(F.col("__pos") - 1, F.lit(size))
        # the last bars of a bucket are there for the next one as well
        both = F.when(place >= size - look_back, F.array(number, number + 1)).otherwise(F.array(number))
        rows = self.df.withColumn("__bucket", F.explode(both)).withColumn("__own", F.col("__bucket") == number)
        rows = self._dealt(rows, "symbol", "__bucket")
        with windowed_by("symbol", "__bucket"):
            rows = build(rows)
        self.df = rows.where("__own").drop("__bucket", "__own")
        return self

    def result(self, *names: str) -> DataFrame:
        """The bars with their own columns and the named ones."""
        return self.df.select(*[c for c in self.kept if c not in names], *names)
