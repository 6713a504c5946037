"""Column canonicalisation, cleaning, corporate actions and execution delay."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..functions.names import canonical_map, loader_name

OHLCV = ("open", "high", "low", "close", "volume")


class MissingColumns(ValueError):
    pass


class NameCollision(ValueError):
    pass


@dataclass(frozen=True)
class Renaming:
    """What canonicalise did: new name of every kept column, groups that collided, columns left out."""

    kept: dict[str, str]
    collisions: dict[str, list[str]]
    dropped: list[str]

    def rows(self) -> list[tuple[str, str, str]]:
        out = [(old, new, "renamed" if old != new else "kept") for old, new in self.kept.items()]
        out += [(old, new, "collision") for new, olds in self.collisions.items() for old in olds]
        return out + [(old, "", "dropped") for old in self.dropped]


def plan_names(columns: list[str], aliases: dict[str, str] | None = None, policy: str = "strict", settle: Callable[[str], str] = str) -> Renaming:
    """Resolve canonical names, numbered copies (Close.1) with their original; `settle` may change a canonical name; policy says what to do where several columns share one: strict, prefer_first or suffix."""
    if policy not in ("strict", "prefer_first", "suffix"):
        raise ValueError(f"unknown policy {policy!r}")
    wanted = {c: settle(new) for c, new in canonical_map(columns, aliases).items()}
    groups: dict[str, list[str]] = {}
    for old in columns:
        groups.setdefault(wanted[old], []).append(old)
    collisions = {new: olds for new, olds in groups.items() if len(olds) > 1}
    if collisions and policy == "strict":
        raise NameCollision("; ".join(f"{new}: {', '.join(olds)}" for new, olds in sorted(collisions.items())))
    kept, dropped = {}, []
    for new, olds in groups.items():
        kept[olds[0]] = new
        for n, old in enumerate(olds[1:], 1):
            if policy == "suffix":
                kept[old] = f"{new}_dup{n}"
            else:
                dropped.append(old)
    return Renaming({c: kept[c] for c in columns if c in kept}, collisions, dropped)


def canonicalise(df: DataFrame, aliases: dict[str, str] | None = None, policy: str = "strict") -> tuple[DataFrame, Renaming]:
    plan = plan_names(df.columns, aliases, policy)
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in plan.kept.items()]), plan


def merge_equal_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Columns that share a canonical name, numbered copies and a loader's spellings included: an equal copy is dropped, a
    different one renamed `_alt`, `_alt2`, ...

    One aggregation compares all pairs.
    """
    plan = plan_names(df.columns, aliases, "suffix", loader_name)
    pairs = [(olds[0], old) for olds in plan.collisions.values() for old in olds[1:]]
    same = {}
    if pairs:
        row = df.agg(*[F.coalesce(F.bool_and(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))), F.lit(True)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        same = {b: row[i] for i, (_, b) in enumerate(pairs)}
    out, used = [], {}
    for old in df.columns:
        new = plan.kept[old].split("_dup")[0] if old in same else plan.kept[old]
        if same.get(old):
            continue
        if old in same:
            used[new] = used.get(new, 0) + 1
            new = f"{new}_alt" + (str(used[new]) if used[new] > 1 else "")
        out.append(F.col(f"`{old}`").alias(new))
    return df.select(*out)


def add_canonical(df: DataFrame, schema: dict[str, str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Add a canonical copy of aliased columns; `schema` (canonical -> the user's column) comes first."""
    have = {c.lower() for c in df.columns}
    new: dict[str, Column] = {}
    for want, source in (schema or {}).items():
        if source not in df.columns:
            raise MissingColumns(f"{source} (for {want})")
        if want.lower() not in have:
            new[want] = F.col(f"`{source}`")
    for old, want in canonical_map(df.columns, aliases).items():
        if want != old and want.lower() not in have and want not in new:
            new[want] = F.col(f"`{old}`")
    return df.withColumns(new) if new else df


def require(df: DataFrame, columns: tuple[str, ...] = ("symbol", "date", *OHLCV), mode: str = "fail") -> DataFrame:
    """Fail naming what is missing, or (mode fix) drop what is not asked for and add the missing as nulls."""
    missing = [c for c in columns if c not in df.columns]
    if mode == "fail":
        if missing:
            raise MissingColumns("missing columns: " + ", ".join(missing))
        return df
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def _first_per_bar(df: DataFrame, arrival: str | None, tasks: int | None = None) -> DataFrame:
    """One row for each (symbol, date): the first by arrival, or else by its values, so that reruns agree.

    `tasks`: rows are dealt by symbol to so many, and windows over a symbol that come after need no other exchange."""
    df = df.repartition(tasks, "symbol") if tasks else df
    rest = [F.col(c) for c in df.columns if c not in ("symbol", "date", arrival) and isinstance(df.schema[c].dataType, T.AtomicType)]
    w = W.partitionBy("symbol", "date").orderBy(*([F.col(arrival)] if arrival else []), *rest)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def clean_rows(df: DataFrame) -> DataFrame:
    """Upper-case trimmed symbol, whole days, numbers or null (NaN is null), a close at least."""
    date = F.col("date") if isinstance(df.schema["date"].dataType, T.DateType) else S.mixed_date("date")
    out = df.withColumns({"symbol": F.upper(F.trim(F.col("symbol").cast("string"))), "date": date})
    out = out.withColumns({c: S.drop_nan(F.col(c).try_cast("double")) for c in OHLCV if c in df.columns})
    return out.dropna(subset=["symbol", "date", "close"])


def clean_panel(df: DataFrame, arrival: str | None = None, tasks: int | None = None) -> DataFrame:
    """clean_rows(), one row a bar, dealt by symbol to `tasks` where they are given."""
    return _first_per_bar(clean_rows(df), arrival, tasks)


def clean_loaded(df: DataFrame, arrival: str | None = None) -> DataFrame:
    """Loader form: the date's first ten characters must be ISO; rows with a null or negative price or volume go."""
    out = df.withColumn("date", S.iso_day("date")).withColumns({c: S.drop_nan(F.col(c).try_cast("double")) for c in OHLCV if c in df.columns})
    fine = F.col("date").isNotNull()
    for c in OHLCV:
        if c in df.columns:
            fine = fine & S.ge(c, 0.0)
    return _first_per_bar(out.where(fine), arrival)


def clean_provider(df: DataFrame, zone: str = "Europe/Istanbul", arrival: str | None = None) -> DataFrame:
    """Provider form: lower-case names, dates in the provider's zone, numbers like 1.234,5, whole volumes, one row a date.

    A timestamp is UTC. Volume and quantity that are no number count as 0.
    """
    out = df.select(*[F.col(f"`{c}`").alias(c.lower()) for c in df.columns])
    date = out.schema["date"].dataType
    out = out.withColumn("date", F.from_utc_timestamp("date", zone).cast("date") if isinstance(date, T.TimestampType) else S.mixed_date("date"))
    for c in ("open", "high", "low", "close", "volume", "quantity"):
        if c in out.columns:
            number = S.local_number(c) if isinstance(out.schema[c].dataType, T.StringType) else F.col(c).cast("double")
            out = out.withColumn(c, F.coalesce(number, F.lit(0.0)).cast("long") if c in ("volume", "quantity") else number)
    if "symbol" not in out.columns:
        out = out.withColumn("symbol", F.lit(""))
    return _first_per_bar(out.dropna(subset=["date"]), arrival)


def suffix_factors(actions: DataFrame) -> DataFrame:
    """symbol, date, factor -> with cum_factor, the product of this and all later factors of the symbol.

    Several actions of one day multiply. A window over a symbol's few actions.
    """
    day = actions.groupBy("symbol", "date").agg(F.product("factor").alias("factor"))
    w = W.partitionBy("symbol").orderBy(F.col("date").desc()).rowsBetween(W.unboundedPreceding, 0)
    return day.withColumn("cum_factor", F.product("factor").over(w))


def adjust_for_actions(panel: DataFrame, actions: DataFrame) -> DataFrame:
    """Back-adjust: prices before an action's day times the product of all later factors, volume divided by it.

    A strict forward as-of join: actions and bars in one window of the symbol, newest first; a bar takes the last action
    that is later than itself. The window shares the panel's partitioning by symbol; nothing is broadcast.
    """
    marks = suffix_factors(actions).select("symbol", "date", F.col("cum_factor").alias("__cf"), F.lit(True).alias("__mark"))
    rows = panel.withColumns({"__cf": F.lit(None).cast("double"), "__mark": F.lit(False)}).unionByName(marks, allowMissingColumns=True)
    # of one day the bar comes first, so that its own day's action is not later than it
    w = W.partitionBy("symbol").orderBy(F.col("date").desc(), F.col("__mark").asc()).rowsBetween(W.unboundedPreceding, -1)
    f = F.coalesce(F.last("__cf", ignorenulls=True).over(w), F.lit(1.0))
    out = rows.withColumn("__f", f).where("not __mark")
    prices = {c: F.col(c) * F.col("__f") for c in ("open", "high", "low", "close") if c in panel.columns}
    if "volume" in panel.columns:
        prices["volume"] = F.try_divide(F.col("volume"), F.col("__f"))
    return out.withColumns(prices).drop("__cf", "__mark", "__f")


def delay(signals: DataFrame, columns: list[str], bars: int = 1) -> DataFrame:
    """Execution delay: signal columns move `bars` forward on their symbol's own bars; what has no signal yet is false."""
    w = W.partitionBy("symbol").orderBy("date")
    return signals.withColumns({c: S.known(F.lag(c, bars).over(w)) if isinstance(signals.schema[c].dataType, T.BooleanType) else F.lag(c, bars).over(w) for c in columns})
