"""Rules over bars: screening a day, scanning a range, audits.

A rule's predicate is a Spark SQL boolean expression or a Column. All rules, all days and all symbols are one pass: a
projection gathers the numbers of the rules that a row meets, one generator emits them, and their codes are looked up.
"""

from __future__ import annotations

import fnmatch
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S

#: Rules in one array expression and in one call of the analyser.
CHUNK = 50


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    code: str
    predicate: str | Column = "true"
    group: str | None = None
    side: str | None = None

    def column(self) -> Column:
        return F.expr(self.predicate) if isinstance(self.predicate, str) else self.predicate


def from_table(rows: Iterable[dict]) -> list[Rule]:
    """Rules of rows {FilterCode, PythonQuery[, Group, Side]}; codes must be present and unique, texts present."""
    out, seen = [], set()
    for row in rows:
        code, text = (row.get("FilterCode") or "").strip(), (row.get("PythonQuery") or "").strip()
        if not code or not text:
            raise RuleError(f"a rule needs a code and a predicate: {row}")
        if code in seen:
            raise RuleError(f"duplicate rule code {code}")
        seen.add(code)
        out.append(Rule(code, text, row.get("Group"), row.get("Side")))
    return out


def select_codes(rules: list[Rule], patterns: Iterable[str]) -> list[Rule]:
    """Rules whose code fits one of the glob patterns."""
    patterns = list(patterns)
    return [r for r in rules if any(fnmatch.fnmatchcase(r.code, p) for p in patterns)]


def tidy(rules: list[Rule]) -> tuple[list[Rule], list[str]]:
    """Rules without the empty ones, and warnings for them and for literal rules."""
    kept, said = [], []
    for r in rules:
        text = r.predicate.strip().lower() if isinstance(r.predicate, str) else None
        if text == "":
            said.append(f"{r.code}: empty, left out")
            continue
        if text in ("true", "false"):
            said.append(f"{r.code}: literal {text}")
        kept.append(r)
    return kept, said


#: The predefined crossing columns (name, direction, series, series or level).
CROSSOVERS: list[tuple[str, str, str, str | float]] = [
    ("sma_10_keser_sma_50_yukari", "up", "sma_10", "sma_50"),
    ("sma_10_keser_sma_50_asagi", "down", "sma_10", "sma_50"),
    ("adx_14_keser_20p0_yukari", "up", "adx_14", 20.0),
    ("adx_14_keser_20p0_asagi", "down", "adx_14", 20.0),
]


def add_crossovers(df: DataFrame, specs: list[tuple[str, str, str, str | float]] | None = None) -> tuple[DataFrame, list[str]]:
    """Add crossing columns; those whose inputs are missing are skipped and named."""
    w = W.partitionBy("symbol").orderBy("date")
    new, skipped = {}, []
    for name, direction, a, b in specs or CROSSOVERS:
        if a not in df.columns or (isinstance(b, str) and b not in df.columns):
            skipped.append(name)
            continue
        new[name] = (S.cross_up if direction == "up" else S.cross_down)(a, b, w)
    return (df.withColumns(new) if new else df), skipped


def mask(df: DataFrame, predicate: str | Column) -> Column:
    """A predicate as a column that is never null; it must be boolean."""
    c = F.expr(predicate) if isinstance(predicate, str) else predicate
    kind = df.select(c.alias("m")).schema["m"].dataType
    if not isinstance(kind, T.BooleanType):
        raise RuleError(f"a predicate must be boolean, not {kind.simpleString()}")
    return S.known(c)


def keep(df: DataFrame, predicate: str | Column) -> DataFrame:
    return df.where(mask(df, predicate))


def _bad_side(side: str | None) -> bool:
    return bool(side and side.strip()) and side.strip().lower() not in ("long", "short")


def _types(panel: DataFrame, rules: list[Rule]) -> list[T.DataType | str]:
    """The type of each rule's predicate on this panel, or what the analyser says against it. A chunk is analysed at once,
    and one by one only where that fails."""
    out: list[T.DataType | str] = []
    for at in range(0, len(rules), CHUNK):
        some = rules[at : at + CHUNK]
        try:
            columns = [r.predicate if isinstance(r.predicate, str) else r.predicate.alias("p") for r in some]
            if all(isinstance(c, str) for c in columns):
                out += [f.dataType for f in panel.selectExpr(*[f"({c}\n) as p{i}" for i, c in enumerate(columns)]).schema.fields]
            else:
                out += [f.dataType for f in panel.select(*[F.expr(c) if isinstance(c, str) else c for c in columns]).schema.fields]
        except AnalysisException as e:
            out += [str(e).split("\n")[0][:300]] if len(some) == 1 else [k for r in some for k in _types(panel, [r])]
    return out


def audit(panel: DataFrame, rules: list[Rule]) -> list[dict]:
    """What is wrong with each rule on this panel: code, ok, reason. Only the analyser works; no job runs."""
    return _audit(rules, _types(panel, rules))


def _audit(rules: list[Rule], kinds: list[T.DataType | str]) -> list[dict]:
    codes = Counter(r.code for r in rules)
    out = []
    for r, kind in zip(rules, kinds, strict=True):
        why = None
        if codes[r.code] > 1:
            why = "duplicate code"
        elif _bad_side(r.side):
            why = f"invalid side {r.side}"
        elif isinstance(r.predicate, str) and future_reference(r.predicate):
            why = "looks ahead"
        elif isinstance(kind, str):
            why = kind
        elif not isinstance(kind, (T.BooleanType, *S.NUMERIC)):
            why = f"not boolean but {kind.simpleString()}"
        out.append({"code": r.code, "ok": why is None, "reason": why})
    return out


#: Marks of looking ahead in a rule's text.
AHEAD = (r"shift\s*\(\s*-", r"\blead\s*\(", r"\bnext_\w+", r"\bt\s*\+\s*\d")


def future_reference(text: str) -> bool:
    return any(re.search(p, text, re.IGNORECASE) for p in AHEAD)


def usable(panel: DataFrame, rules: list[Rule], on_error: str = "skip") -> list[tuple[Rule, T.DataType]]:
    """Rules that the audit passes, with the types of their predicates; others are skipped or raise."""
    kinds = _types(panel, rules)
    found = _audit(rules, kinds)
    bad = {a["code"]: a["reason"] for a in found if not a["ok"]}
    if bad and on_error == "raise":
        raise RuleError("; ".join(f"{c}: {why}" for c, why in bad.items()))
    return [(r, k) for r, k, a in zip(rules, kinds, found, strict=True) if a["ok"]]


def _text(value: str | None) -> str:
    """A string as a SQL literal."""
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(panel: DataFrame, rules: list[Rule], start=None, end=None, on_error: str = "skip", carry: tuple[str, ...] = ()) -> DataFrame:
    """Signals (filter_code, grp, symbol, side, date, and the bar's columns named in `carry`) of all rules on all bars of [start, end], history first.

    One row for each hit, codes being unique and bars too. A rule costs an expression, not a pass over the panel.
    """
    good = usable(panel, rules, on_error)
    if not good:
        none = F.lit(None).cast("string")
        return panel.where("false").select(none.alias("filter_code"), none.alias("grp"), "symbol", none.alias("side"), "date", *carry)
    found = []
    for at in range(0, len(good), CHUNK):
        # texts go to Spark's parser as one expression, so that a rule costs no call of its own
        texts, columns_ = [], []
        for n, (r, kind) in enumerate(good[at : at + CHUNK], at):
            truth = isinstance(kind, T.BooleanType)
            if isinstance(r.predicate, str):
                texts.append(f"if(coalesce(({r.predicate}\n), false), {n}, null)" if truth else f"if(coalesce(({r.predicate}\n), 0) <> 0, {n}, null)")
            else:
                columns_.append(F.when(S.known(r.predicate) if truth else S.nonzero(r.predicate), F.lit(n)))
        if texts:
            found.append(F.expr(f"array_compact(array({', '.join(texts)}))"))
        if columns_:
            found.append(F.array_compact(F.array(*columns_)))
    every = found[0] if len(found) == 1 else F.concat(*found)
    rows = panel.select("symbol", "date", *carry, every.alias("__hits"))  # before the days are cut: rules see all history
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    about = F.expr("array(" + ", ".join(f"named_struct('filter_code', {_text(r.code)}, 'grp', {_text(r.group)}, 'side', {_text(r.side)})" for r, _ in good) + ")")
    hit = rows.select("symbol", "date", *carry, F.explode("__hits").alias("n"))
    return hit.select("symbol", "date", *carry, F.get(about, F.col("n")).alias("r")).select("r.filter_code", "r.grp", "symbol", "r.side", "date", *carry)


def count_hits(panel: DataFrame, rules: list[Rule], by: tuple[str, ...] = (), start=None, end=None, on_error: str = "skip") -> DataFrame:
    """by..., filter_code, hits: how many bars of [start, end] each rule is met by, in all or by the columns `by`; rules
    without a hit are absent.

    A hit is a bit of its bar: no row is made for it. In all, the bits go to Arrow as one bitmap a rule and batch, whose
    set bits are counted; a task hands on a number for each rule. By columns, an aggregate holds a counter for each of
    CHUNK rules, and what is shuffled is a row of counters for each task and group.
    """
    good = usable(panel, rules, on_error)
    if not good:
        return panel.where("false").select(*by, F.lit("").alias("filter_code"), F.lit(0).cast("long").alias("hits"))
    bits = [F.coalesce(r.column(), F.lit(False)) if isinstance(kind, T.BooleanType) else S.nonzero(r.column()) for r, kind in good]
    codes = [r.code for r, _ in good]

    def within(some: range) -> DataFrame:
        rows = panel.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("date").alias("__date"), *[bits[i].alias(f"__b{i}") for i in some])
        if start is not None:
            rows = rows.where(F.col("__date") >= F.lit(start).cast("date"))
        if end is not None:
            rows = rows.where(F.col("__date") <= F.lit(end).cast("date"))
        return rows.drop("__date")

    if not by:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [0] * len(codes)
            for batch in batches:
                total = [n + (c.true_count or 0) for n, c in zip(total, batch.columns, strict=True)]
            met = [i for i, n in enumerate(total) if n]
            yield pa.RecordBatch.from_arrays([pa.array([codes[i] for i in met], pa.string()), pa.array([total[i] for i in met], pa.int64())], names=["filter_code", "hits"])

        return within(range(len(good))).mapInArrow(run, "filter_code string, hits long").groupBy("filter_code").agg(F.sum("hits").alias("hits"))
    counted = None
    for at in range(0, len(good), CHUNK):
        some = range(at, min(at + CHUNK, len(good)))
        sums = within(some).groupBy(*[f"__by{i}" for i in range(len(by))]).agg(*[F.count_if(f"__b{i}").alias(f"__b{i}") for i in some])
        pairs = F.array(*[F.struct(F.lit(codes[i]).alias("filter_code"), F.col(f"__b{i}").alias("hits")) for i in some])
        part = sums.select(*[F.col(f"__by{i}").alias(c) for i, c in enumerate(by)], F.inline(F.filter(pairs, lambda p: p["hits"] > 0)))
        counted = part if counted is None else counted.unionAll(part)
    return counted


def scan_day(panel: DataFrame, rules: list[Rule], day, on_error: str = "skip") -> DataFrame:
    return scan(panel, rules, day, day, on_error)


def scan_range(panel: DataFrame, rules: list[Rule], start, end, on_error: str = "skip", carry: tuple[str, ...] = (), dates: DataFrame | None = None) -> DataFrame:
    """scan(), but a range without a single bar is an error.

    `dates`: a table with the panel's dates that costs less than the panel to make, to look for a bar in."""
    known = (panel if dates is None else dates).select("date")
    if not known.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).take(1):  # looks into one task first, isEmpty() into all
        raise RuleError(f"no bars from {start} to {end}")
    return scan(panel, rules, start, end, on_error, carry)


def rule_audit(panel: DataFrame, rules: list[Rule], days: DataFrame) -> DataFrame:
    """(code, date, hits, skipped, reason) for every rule and day, days without hits included."""
    spark = panel.sparkSession
    found = spark.createDataFrame([(a["code"], not a["ok"], a["reason"]) for a in audit(panel, rules)], "code string, skipped boolean, reason string")
    hits = count_hits(panel, rules, ("date",)).withColumnRenamed("filter_code", "code")
    grid = F.broadcast(found).crossJoin(days.select("date"))  # rules by days, two small tables
    return grid.join(hits, ["code", "date"], "left").select("code", "date", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), "skipped", "reason")
