"""Indicators as window columns, the recursive ones as scans; with cells of time, for symbols of any length."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from .series import BUCKET, Series, by_symbol


def last_n(n: int):
    return by_symbol().rowsBetween(-(n - 1), 0)


def _full(x: Column, n: int, value: Column) -> Column:
    """A rolling value where the window holds n present values."""
    return F.when(F.count(x).over(last_n(n)) == n, value)


def rolling(x: S.Operand, n: int, how: str) -> Column:
    """Rolling mean, max, min, sum, std (one degree of freedom lost) or median of the last n bars; null until n are there.

    The median as a column sorts n values at each bar: add_medians() is for more than some dozen."""
    c = S.as_column(x)
    if how == "median":
        s = F.sort_array(F.collect_list(c).over(last_n(n)))
        return _full(c, n, (F.get(s, F.lit((n - 1) // 2)) + F.get(s, F.lit(n // 2))) / 2)
    f = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_samp}[how]
    return _full(c, n, f(c).over(last_n(n)))


def add_medians(df: DataFrame, wanted: dict[str, tuple[str, int]], cell: Column | None = None, bucket: int = BUCKET, tasks: int | None = None) -> DataFrame:
    """Adds, for out -> (x, n), the median of the last n bars' x, null until n present values are there.

    An order-statistic window: the last n values are kept sorted, a bar puts one in and takes one out in logarithmic time,
    so that the cost of a bar hardly grows with n. Bars go through Arrow by symbol or, with `cell` (see series.Series), by
    buckets that overlap; only x is read there, the other columns pass by as they are.
    """
    names = [c for c in df.columns if c not in wanted]
    kept = df.select(*names)
    s = Series(kept, cell, tasks=tasks)
    return s.windows(max(n for _, n in wanted.values()), lambda rows: _medians(rows, wanted), bucket).result(*wanted) if wanted else df


def _medians(rows: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, *[T.StructField(o, T.DoubleType()) for o in wanted]])
    groups = rows.groupBy("symbol", "__bucket") if "__bucket" in rows.columns else rows.groupBy("symbol")

    def run(bars: pa.Table) -> pa.Table:
        bars = bars.take(pc.sort_indices(bars.column("date")))
        for out, (x, n) in wanted.items():
            values = pd.Series(bars.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False))
            bars = bars.append_column(out, pa.array(values.rolling(n).median(), pa.float64(), from_pandas=True))
        return bars

    return groups.applyInArrow(run, schema)


def sma(n: int, x: S.Operand = "close") -> Column:
    return rolling(x, n, "mean")


def wma(n: int, x: S.Operand = "close") -> Column:
    """Weights 1..n, the newest bar the heaviest."""
    c = S.as_column(x)
    values = F.collect_list(c).over(last_n(n))
    total = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return _full(c, n, total / F.lit(n * (n + 1) / 2))


def momentum(n: int, x: S.Operand = "close") -> Column:
    c = S.as_column(x)
    return c - F.lag(c, n).over(by_symbol())


def change_rate(n: int, x: S.Operand = "close") -> Column:
    """close / close n bars ago - 1."""
    c = S.as_column(x)
    return S.divide(c, F.lag(c, n).over(by_symbol())) - 1


def forward_return(n: int, x: S.Operand = "close") -> Column:
    """close n bars on / close - 1, gaps filled forward."""
    c = F.last(S.as_column(x), ignorenulls=True).over(by_symbol().rowsBetween(W.unboundedPreceding, 0))
    ahead = F.last(S.as_column(x), ignorenulls=True).over(by_symbol().rowsBetween(W.unboundedPreceding, n))
    return F.when(F.lead("date", n).over(by_symbol()).isNotNull(), S.divide(ahead, c) - 1)


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def true_range() -> Column:
    before = F.lag("close").over(by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def bollinger(n: int, k: float, x: S.Operand = "close") -> tuple[Column, Column, Column]:
    """Low, middle and high band, with the population deviation."""
    c = S.as_column(x)
    mid, dev = F.avg(c).over(last_n(n)), F.stddev_pop(c).over(last_n(n))
    return tuple(_full(c, n, v) for v in (mid - dev * k, mid, mid + dev * k))


def add_cci(df: DataFrame, n: int) -> DataFrame:
    """(tp - sma) / (0.015 md), md the rolling mean of |tp - sma| with each bar's own sma: two stacked windows."""
    name = f"cci_{n}"
    step = df.withColumn("__tp", typical()).withColumn("__sma", rolling("__tp", n, "mean")).withColumn("__dev", F.abs(F.col("__tp") - F.col("__sma")))
    return step.withColumn(name, S.divide(F.col("__tp") - F.col("__sma"), rolling("__dev", n, "mean") * 0.015)).drop("__tp", "__sma", "__dev")


def add_atr(df: DataFrame, n: int, name: str | None = None) -> DataFrame:
    """Rolling mean of the true range; null columns where high, low or close are missing."""
    name = name or f"atr_{n}"
    if not {"high", "low", "close"} <= set(df.columns):
        return df.withColumn(name, F.lit(None).cast("double"))
    return df.withColumn("__tr", true_range()).withColumn(name, rolling("__tr", n, "mean")).drop("__tr")


# ------------------------------------------------------------------ recursive indicators


def _some(c: str) -> Column:
    """A column without NaN, which counts as missing."""
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _there(c: Column) -> Column:
    return F.when(c.isNotNull(), 1.0).otherwise(0.0)


def _ratio(a: Column | str, b: Column | str) -> Column:
    """a / b where b is above 0."""
    a, b = S.as_column(a), S.as_column(b)
    return F.when(b > 0, a / b)


def _seeded(s: Series, out: dict[str, int], x: str, count: str, total: str) -> None:
    """Adds EMAs of x with alpha 2/(n+1) whose first value is the mean of the first n present values, n values in; `count`
    and `total` are the count and the sum of present values so far. Missing values move nothing and have no EMA."""
    k, there = F.col(count), F.col(x).isNotNull()
    for name, n in out.items():
        s.add(**{f"__u_{name}": F.when(there & (k == n), F.col(total) / n).when(there & (k > n), F.col(x) * (2 / (n + 1))).otherwise(0.0)})
    s.scan({name: (f"__u_{name}", 1 - 2 / (n + 1)) for name, n in out.items()}, count)
    s.add(**{name: F.when(there & (k >= n), F.col(name)) for name, n in out.items()})


#: kind -> names of its outputs, for given arguments
RECURSIVE = {
    "ema": lambda a: {"": f"ema_{a[0]}"},
    "ewm": lambda a: {"": f"ewm_{a[0]}"},
    "rsi": lambda a: {"": f"rsi_{a[0]}"},
    "stochrsi": lambda a: {p: f"stochrsi_{p}_" + "_".join(map(str, a)) for p in ("k", "d")},
    "macd": lambda a: {"line": "macd_" + "_".join(map(str, a)), "signal": "macd_signal_" + "_".join(map(str, a)), "hist": "macd_hist_" + "_".join(map(str, a))},
    "adx": lambda a: {p: f"{p}_{a[0]}" for p in ("adx", "dmp", "dmn")},
}


def add_recursive(df: DataFrame, wanted: Iterable[tuple[str, tuple[int, ...]]], cell: Column | None = None, tasks: int | None = None) -> DataFrame:
    """Add recursive indicators as scans, all in windows: by symbol, whose exchange they share with the windows before
    them, or, with `cell` (a column that grows with the date, like series.days()), by cells of time, for symbols that are
    too long for a task. A missing close moves no EMA; the other means hold their value there."""
    wanted = list(dict.fromkeys(wanted))
    names = [n for kind, args in wanted for n in RECURSIVE[kind](args).values()]
    if not names:
        return df
    of = {kind: [a for k, a in wanted if k == kind] for kind in RECURSIVE}
    moving, seeded = of["rsi"] + of["stochrsi"] + of["adx"], of["ema"] + of["macd"]
    prices = ["close", *(["high", "low"] if of["adx"] else [])]
    rows = df.drop(*names).withColumns({f"__{c}": _some(c) for c in prices})
    s = Series(rows, cell, [f"__{c}" for c in prices] if moving else [], ["__close"] if seeded else [], tasks)
    s.kept = [c for c in df.columns if c not in names]
    pos, terms = F.col("__pos"), {}
    if of["ewm"]:
        s.add(__x=_zero(F.col("__close")), __p=_there(F.col("__close")))
        for (n,) in of["ewm"]:
            r = 1 - 2 / (n + 1)
            terms |= {f"__ewm_s{n}": ("__x", r), f"__ewm_w{n}": ("__p", r)}
    if of["rsi"] or of["stochrsi"]:
        move = F.col("__close") - s.lag("__close")
        s.add(__up=_zero(F.greatest(move, F.when(move.isNotNull(), 0.0))), __down=_zero(F.greatest(-move, F.when(move.isNotNull(), 0.0))))
        for n in {a[0] for a in of["rsi"] + of["stochrsi"]}:
            terms |= {f"__up_{n}": ("__up", 1 - 1 / n), f"__down_{n}": ("__down", 1 - 1 / n)}
    if of["adx"]:
        up, down, before = F.col("__high") - s.lag("__high"), s.lag("__low") - F.col("__low"), s.lag("__close")
        tr = F.when(pos > 1, F.greatest(F.col("__high") - F.col("__low"), F.abs(F.col("__high") - before), F.abs(F.col("__low") - before)))
        s.add(__dmp=F.when((pos > 1) & (up > down) & (up > 0), up).otherwise(0.0), __dmn=F.when((pos > 1) & (down > up) & (down > 0), down).otherwise(0.0), __dm=F.when(pos > 1, 1.0).otherwise(0.0), __tr=_zero(tr), __trp=_there(tr))
        for (n,) in of["adx"]:
            terms |= {f"{c}_{n}": (c, 1 - 1 / n) for c in ("__dmp", "__dmn", "__dm", "__tr", "__trp")}
    if terms:
        s.scan(terms)
    for (n,) in of["ewm"]:
        s.add(**{f"ewm_{n}": _ratio(f"__ewm_s{n}", f"__ewm_w{n}")})
    for n in {a[0] for a in of["rsi"] + of["stochrsi"]}:
        s.add(**{f"__rsi_{n}": 100 * _ratio(F.col(f"__up_{n}"), F.col(f"__up_{n}") + F.col(f"__down_{n}"))})  # no fall: 100, no move: null
    for (n,) in of["rsi"]:
        s.add(**{f"rsi_{n}": F.when(pos > n, F.col(f"__rsi_{n}"))})
    if of["adx"]:
        for (n,) in of["adx"]:
            base = _ratio(f"__tr_{n}", f"__trp_{n}")
            s.add(**{f"__{c}di_{n}": 100 * _ratio(_ratio(f"__{d}_{n}", f"__dm_{n}"), base) for c, d in (("p", "dmp"), ("m", "dmn"))})
            p, m = F.col(f"__pdi_{n}"), F.col(f"__mdi_{n}")
            s.add(**{f"__dx_{n}": 100 * _ratio(F.abs(p - m), p + m)})
            s.add(**{f"__dx0_{n}": _zero(F.col(f"__dx_{n}")), f"__dxp_{n}": _there(F.col(f"__dx_{n}"))})
        s.scan({f"__{o}_{n}": (f"__{x}_{n}", 1 - 1 / n) for (n,) in of["adx"] for o, x in (("as", "dx0"), ("aw", "dxp"))})
        for (n,) in of["adx"]:
            s.add(**{f"{o}_{n}": F.when(pos > n, c) for o, c in (("adx", _ratio(f"__as_{n}", f"__aw_{n}")), ("dmp", F.col(f"__pdi_{n}")), ("dmn", F.col(f"__mdi_{n}")))})
    if seeded:
        emas = {n for (n,) in of["ema"]} | {n for f, sl, _ in of["macd"] for n in (f, sl)}
        _seeded(s, {f"__ema_{n}": n for n in sorted(emas)}, "__close", "__n___close", "__s___close")
        for (n,) in of["ema"]:
            s.add(**{f"ema_{n}": F.col(f"__ema_{n}")})
    for fast, slow, signal in of["macd"]:
        key = f"{fast}_{slow}_{signal}"
        # the line is there from the slower EMA's first value on
        s.add(__line=F.col(f"__ema_{fast}") - F.col(f"__ema_{slow}"), __k=F.greatest(F.col("__n___close") - (max(fast, slow) - 1), F.lit(0)))
        s.add(__line0=_zero(F.col("__line")))
        s.scan({"__total": ("__line0", 1.0)}, "__k")
        _seeded(s, {"__sig": signal}, "__line", "__k", "__total")
        s.add(**{f"macd_{key}": F.col("__line"), f"macd_signal_{key}": F.col("__sig"), f"macd_hist_{key}": F.col("__line") - F.col("__sig")})
    for n, k, d, smooth in of["stochrsi"]:
        key = f"{n}_{k}_{d}_{smooth}"

        def build(rows: DataFrame, n: int = n, k: int = k, d: int = d, smooth: int = smooth, key: str = key) -> DataFrame:
            rows = rows.withColumns({"__lo": rolling(f"__rsi_{n}", k, "min"), "__hi": rolling(f"__rsi_{n}", k, "max")})
            spread = F.col("__hi") - F.col("__lo")  # of 100; less than 1e-9 is rounding
            rows = rows.withColumn("__stoch", F.when(spread > 1e-9, (F.col(f"__rsi_{n}") - F.col("__lo")) / spread))
            rows = rows.withColumn(f"stochrsi_k_{key}", rolling("__stoch", smooth, "mean"))
            return rows.withColumn(f"stochrsi_d_{key}", rolling(f"stochrsi_k_{key}", d, "mean"))

        s.windows(k + d + smooth, build)
    return s.result(*names)


def ewm_native(x: S.Operand, alpha: float, tail: float = 1e-16) -> Column:
    """Exponentially weighted mean (adjusted) as a bounded window: weights below `tail` are left out. For very long series."""
    import math

    n = max(1, math.ceil(math.log(tail) / math.log(1 - alpha)))
    c = S.as_column(x)
    values = F.collect_list(c).over(last_n(n))
    acc = F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, v: F.struct((a["s"] * (1 - alpha) + v).alias("s"), (a["w"] * (1 - alpha) + 1).alias("w")))
    return F.when(F.count(c).over(last_n(n)) > 0, acc["s"] / acc["w"])


# ------------------------------------------------------------------ by name

_NAME = re.compile(r"(?P<kind>stochrsi|macd|sma|ema|ewm|wma|rsi|mom|roc|cci|adx|dmp|dmn|atr|bbl|bbm|bbh|bbu)_(?P<part>k_|d_|signal_|hist_)?(?P<args>\d+(?:p\d+)?(?:_\d+(?:p\d+)?)*)")


def parse_name(name: str) -> tuple[str, tuple[float, ...]] | None:
    """sma_20 -> (sma, (20,)); None where a name is no indicator."""
    m = _NAME.fullmatch(name)
    if not m:
        return None
    return m["kind"], tuple(float(a.replace("p", ".")) if "p" in a else int(a) for a in m["args"].split("_"))


def add_named(df: DataFrame, names: Iterable[str], cell: Column | None = None, bucket: int = BUCKET, tasks: int | None = None, medians: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Compute the indicators that are asked for and not there, each once, each from its name; other names pass by.

    Windows come first; the recursive ones then share their exchange. With `cell` (see series.Series) no task holds a
    whole symbol: the windows run in buckets of bars, the recursive ones in cells of time. `medians`, as add_medians() takes
    them, run in the same buckets.
    """
    simple: dict[str, tuple] = {}
    recursive: list[tuple[str, tuple[int, ...]]] = []
    cci, atr, reach = [], [], [0]
    for name in dict.fromkeys(names):
        found = parse_name(name)
        if found is None or name in df.columns:
            continue
        kind, a = found
        if kind in ("sma", "wma", "mom", "roc"):
            simple[name] = ({"sma": sma, "wma": wma, "mom": momentum, "roc": change_rate}[kind], int(a[0]))
            reach.append(int(a[0]))
        elif kind in ("bbl", "bbm", "bbh", "bbu"):
            simple[name] = (lambda n, k, i: bollinger(n, k)[i], int(a[0]), float(a[1]) if len(a) > 1 else 2.0, {"bbl": 0, "bbm": 1}.get(kind, 2))
            reach.append(int(a[0]))
        elif kind == "cci":
            cci.append(int(a[0]))
            reach.append(2 * int(a[0]))
        elif kind == "atr":
            atr.append(int(a[0]))
            reach.append(int(a[0]) + 1)
        else:
            recursive.append(("adx" if kind in ("dmp", "dmn") else kind, tuple(int(x) for x in a)))

    medians = {out: m for out, m in (medians or {}).items() if out not in df.columns}
    reach += [n for _, n in medians.values()]

    def build(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({name: f(*a) for name, (f, *a) in simple.items()}) if simple else rows
        for n in cci:
            rows = add_cci(rows, n)
        for n in atr:
            rows = add_atr(rows, n)
        return _medians(rows, medians) if medians else rows

    if cell is None:
        return add_recursive(build(df), recursive)
    out = df
    if max(reach):
        s = Series(df, cell, tasks=tasks).windows(max(reach), build, bucket)
        out = s.df.drop(*[c for c in s.df.columns if c.startswith("__") and c not in df.columns])
    if not (tasks and max(reach) and recursive):
        return add_recursive(out, recursive, cell, tasks)
    # from buckets back to cells
    out = out.withColumn("__cell", cell).repartition(tasks, "symbol", "__cell")
    return add_recursive(out, recursive, F.col("__cell"), tasks).drop(*{"__cell"} - set(df.columns))


def demanded(predicates: Iterable[str]) -> list[str]:
    """Indicator names that the texts of rules mention."""
    words = (w for text in predicates for w in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text))
    return list(dict.fromkeys(w for w in words if parse_name(w)))
