"""Comparisons, arithmetic and crossings with the semantics of rules: what is missing compares as false."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

Operand = Column | float | int | str | bool


def as_column(x: Operand) -> Column:
    """Numbers become literals, strings name columns."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def known(condition: Column) -> Column:
    """False where a condition is null."""
    return F.coalesce(condition, F.lit(False))


def drop_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def gt(a: Operand, b: Operand) -> Column:
    return known(as_column(a) > as_column(b))


def lt(a: Operand, b: Operand) -> Column:
    return known(as_column(a) < as_column(b))


def ge(a: Operand, b: Operand) -> Column:
    return known(as_column(a) >= as_column(b))


def le(a: Operand, b: Operand) -> Column:
    return known(as_column(a) <= as_column(b))


def eq(a: Operand, b: Operand) -> Column:
    return known(as_column(a) == as_column(b))


def ne(a: Operand, b: Operand) -> Column:
    """Different and both present."""
    return known(as_column(a) != as_column(b))


_COMPARE = {">": gt, "<": lt, ">=": ge, "<=": le, "==": eq, "!=": ne}


def chain(first: Operand, *rest: tuple[str, Operand]) -> Column:
    """chain(a, ("<", b), ("<=", c)) is a < b and b <= c."""
    out, left = None, first
    for op, right in rest:
        one = _COMPARE[op](left, right)
        out, left = one if out is None else out & one, right
    if out is None:
        raise ValueError("a chain needs one comparison at least")
    return out


def nonzero(x: Operand) -> Column:
    """The truth of a number: present and not 0."""
    return F.coalesce(as_column(x), F.lit(0.0)) != 0


def divide(a: Operand, b: Operand) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(as_column(a), as_column(b))


def modulo(a: Operand, b: Operand) -> Column:
    """a modulo b with the sign of b."""
    x, y = as_column(a), as_column(b)
    return x - y * F.floor(F.try_divide(x, y))


def clip(x: Operand, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null."""
    c = as_column(x)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def one_of(x: Operand, values: Iterable) -> Column:
    return known(as_column(x).isin(*values))


def present(x: Operand) -> Column:
    return as_column(x).isNotNull()


def contains_pattern(x: Operand, pattern: str) -> Column:
    return known(F.rlike(as_column(x), F.lit(pattern)))


# ------------------------------------------------------------------ crossings


def previous(x: Operand, w: WindowSpec, n: int = 1) -> Column:
    return F.lag(as_column(x), n).over(w)


def cross_up(a: Operand, b: Operand, w: WindowSpec) -> Column:
    """a was at or below b one bar ago and is above it now."""
    return known((previous(a, w) <= _before(b, w)) & (as_column(a) > as_column(b)))


def cross_down(a: Operand, b: Operand, w: WindowSpec) -> Column:
    """a was at or above b one bar ago and is below it now."""
    return known((previous(a, w) >= _before(b, w)) & (as_column(a) < as_column(b)))


def _before(x: Operand, w: WindowSpec) -> Column:
    """The value a bar ago; a number is always the same."""
    return F.lit(x) if isinstance(x, (int, float)) else previous(x, w)


def cross_over(a: Operand, level: float, w: WindowSpec) -> Column:
    return cross_up(a, float(level), w)


def cross_under(a: Operand, level: float, w: WindowSpec) -> Column:
    return cross_down(a, float(level), w)


def falls_to(a: Operand, level: Operand, w: WindowSpec, symbol: Column | str = "symbol") -> Column:
    """The rule form of a downward crossing: against a constant, or a series that is constant for a symbol, the bar
    before must be strictly above and the bar now at or below; against any other series it is cross_down."""
    if isinstance(level, (int, float)):
        return known((previous(a, w) > F.lit(level)) & (as_column(a) <= F.lit(level)))
    from pyspark.sql import Window

    b = as_column(level)
    whole = Window.partitionBy(symbol)
    constant = F.min(b).over(whole) == F.max(b).over(whole)
    at_level = (previous(a, w) > b) & (as_column(a) <= b)
    return F.when(known(constant), known(at_level)).otherwise(cross_down(a, b, w))


def not_on_last_bar(signal: Column, w: WindowSpec, date: str = "date") -> Column:
    """Masks a signal on each symbol's last bar."""
    return signal & F.lead(date).over(w).isNotNull()


# ------------------------------------------------------------------ numbers, text, dates


def round_even(x: Operand, digits: int) -> Column:
    return F.bround(as_column(x), digits)


def settle(x: Operand, digits: int = 4) -> Column:
    """floor(x * 10^d + 1/2) / 10^d in doubles: the same rounding on any engine. From 2^53 on doubles are whole, and floor(),
    which makes longs, would cut off large values, infinities and NaN."""
    scale = float(10**digits)
    half_up = as_column(x) * F.lit(scale) + F.lit(0.5)
    return F.when(F.abs(half_up) < 2.0**53, F.floor(half_up).cast("double")).otherwise(half_up) / F.lit(scale)


def to_lots(quantity: Operand, lot: int = 1, least: int = 1, how: str = "floor") -> Column:
    """A quantity of `least` or more as whole units (floor, round half to even, or ceil), then down to whole lots."""
    q = F.greatest(as_column(quantity), F.lit(float(least)))
    units = {"floor": F.floor, "round": lambda x: F.bround(x, 0), "ceil": F.ceil}[how](q).cast("long")
    return F.greatest(units - units % lot if lot > 1 else units, F.lit(0)).cast("long")


def is_weekend(day: Operand) -> Column:
    return F.weekday(as_column(day)) >= 5


def month_key(day: Operand) -> Column:
    return F.date_format(as_column(day), "yyyyMM")


def local_number(x: Operand, thousands: str = ".", decimal: str = ",") -> Column:
    """A number written with a thousands mark and a decimal mark, as a double; null where it is none."""
    plain = F.replace(F.replace(F.trim(as_column(x)), F.lit(thousands), F.lit("")), F.lit(decimal), F.lit("."))
    return plain.try_cast("double")


def mixed_date(x: Operand) -> Column:
    """A date written as ISO, or else day first with dots, slashes or dashes; null where it is none."""
    text = F.trim(as_column(x).cast("string"))
    ways = [F.try_to_timestamp(text, F.lit(p)).cast("date") for p in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "dd-MM-yyyy")]
    # a plain cast takes less time than a pattern, and no time zone has a say in it; alone it would accept 2024-1-5 and 2024
    day = F.substring(text, 1, 10)
    return F.coalesce(F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day.try_cast("date")), *ways)


def iso_day(x: Operand) -> Column:
    """The day of the first ten characters; null where they are no ISO date."""
    return F.try_to_timestamp(F.substring(as_column(x).cast("string"), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
