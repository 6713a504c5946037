"""Orders, costs, risk flags, exposure caps and the cash ledger, as columns and aggregates."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from .indicators import add_atr

BPS = 1e-4


@dataclass(frozen=True)
class Sizing:
    mode: str = "risk_per_trade"  # or fixed_fraction, target_weight
    risk_bps: float = 50.0
    atr_period: int = 14
    atr_multiple: float = 2.0
    fraction: float = 0.1
    lot: int = 1
    least: int = 1
    rounding: str = "floor"
    price: str = "close"

    def lots(self, q: Column) -> Column:
        return S.to_lots(q, self.lot, self.least, self.rounding)


def by_risk(price: Column, atr: Column, equity: Column, p: Sizing) -> Column:
    """equity * bps over the stop distance: a multiple of the ATR, or 2 % of the price without one."""
    stop = F.when(S.gt(atr, 0.0), atr * p.atr_multiple).otherwise(price * 0.02)
    return p.lots(equity * (p.risk_bps * BPS) / F.greatest(stop, F.lit(1e-9)))


def by_fraction(price: Column, equity: Column, p: Sizing) -> Column:
    return p.lots(equity * p.fraction / F.greatest(price, F.lit(1e-9)))


def by_weight(price: Column, equity: Column, weight: Column, p: Sizing) -> Column:
    return p.lots(F.abs(equity * weight) / F.greatest(price, F.lit(1e-9)))


def order_table(signals: DataFrame, panel: DataFrame, equity: Column | float, p: Sizing = Sizing()) -> DataFrame:
    """date, symbol, side, price, qty of signals (date, symbol, [entry_long], [exit_long], [target_weight]).

    The ATR comes from the symbol's own bars; a missing flag is false; an EXIT has quantity 0; rows without a finite
    price, and rows that ask for nothing, make no order.
    """
    market = add_atr(panel, p.atr_period, "__atr").select("date", "symbol", F.col(p.price).alias("price"), "__atr")
    rows = signals.join(market, ["date", "symbol"], "left")
    flag = lambda c: S.known(F.col(c)) if c in signals.columns else F.lit(False)
    weight = F.col("target_weight") if "target_weight" in signals.columns else F.lit(None).cast("double")
    cash = S.as_column(equity)
    weighted = (F.lit(p.mode == "target_weight")) & weight.isNotNull()
    side = F.when(weighted, F.when(cash * weight > 0, "BUY").otherwise("SELL")).when(flag("entry_long"), "BUY").when(flag("exit_long"), "EXIT")
    entry = by_risk(F.col("price"), F.col("__atr"), cash, p) if p.mode == "risk_per_trade" else by_fraction(F.col("price"), cash, p)
    qty = F.when(weighted, by_weight(F.col("price"), cash, weight, p)).when(flag("entry_long"), entry).otherwise(F.lit(0).cast("long"))
    finite = F.col("price").isNotNull() & ~F.isnan("price") & (F.abs("price") < float("inf"))
    return rows.where(finite).withColumns({"side": side, "qty": qty}).where("side is not null").select("date", "symbol", "side", "price", "qty")


@dataclass(frozen=True)
class Costs:
    commission: str = "fixed_bps"  # or per_share_flat
    commission_bps: float = 5.0
    commission_least: float = 0.0
    tax_bps: float = 0.0
    spread: str = "half_spread"  # or fixed_bps
    spread_bps: float = 7.0
    slippage: str = "atr_linear"  # or fixed_bps
    bps_per_atr: float = 10.0
    decimals: int = 2


def with_costs(fills: DataFrame, p: Costs = Costs(), price: str = "fill_price", quantity: str = "quantity", atr: str | None = None) -> DataFrame:
    """Adds cost_commission, cost_slippage, cost_taxes, cost_total, notional and net_price (half-even cents).

    Slippage grows with ATR / close (clipped to 0..0.2) where both columns are there.
    """
    notional = F.col(price) * F.col(quantity)
    size = F.abs(notional)
    commission = F.lit(0.0)
    if p.commission == "fixed_bps":
        commission = size * (p.commission_bps * BPS)
        if p.commission_least > 0:
            commission = F.greatest(commission, F.lit(p.commission_least))
    bps = F.lit({"fixed_bps": p.spread_bps, "half_spread": p.spread_bps * 0.5}.get(p.spread, 0.0))
    atr = atr or next((c for c in fills.columns if c.lower() in ("atr_14", "atr")), None)
    if p.slippage == "atr_linear" and atr and "close" in fills.columns:
        bps = bps + F.coalesce(S.clip(S.divide(atr, "close"), 0.0, 0.2), F.lit(0.0)) * p.bps_per_atr
    slip, tax = size * (bps * BPS), size * (p.tax_bps * BPS)
    cents = lambda c: F.bround(c, p.decimals)
    return fills.withColumns({"cost_commission": cents(commission), "cost_slippage": cents(slip), "cost_taxes": cents(tax), "cost_total": cents(commission + slip + tax), "notional": notional, "net_price": S.divide(notional, quantity)})


def day_notional(orders: DataFrame, price: str = "price", qty: str = "qty") -> DataFrame:
    return orders.groupBy("date").agg(F.sum(F.col(price) * F.col(qty)).alias("notional"))


@dataclass(frozen=True)
class Limits:
    max_daily_trades: int | None = None
    max_intraday_dd_bps: float | None = None
    halt_atr_bps: float | None = None
    exposure_pct: float = 1.0  # of equity


def risk_flags(orders: DataFrame, equity: float, limits: Limits, state: DataFrame | None = None, price: str = "fill_price", qty: str = "quantity", atr: str = "atr") -> DataFrame:
    """date, n_orders, notional, action (allow, modify, block) and reasons of each day.

    state: date, intraday_dd_bps. A halt follows from any of the day's orders whose ATR / close is at the limit.
    """
    aggs = [F.count(F.lit(1)).alias("n_orders"), F.sum(F.col(price) * F.col(qty)).alias("notional")]
    wild = limits.halt_atr_bps is not None and {atr, "close"} <= set(orders.columns)
    aggs.append((F.max(S.divide(atr, "close") * 1e4) if wild else F.lit(None).cast("double")).alias("atr_bps"))
    day = orders.groupBy("date").agg(*aggs)
    day = day.join(F.broadcast(state.select("date", "intraday_dd_bps")), "date", "left") if state is not None else day.withColumn("intraday_dd_bps", F.lit(None).cast("double"))
    never = F.lit(False)
    deep = S.le("intraday_dd_bps", -abs(limits.max_intraday_dd_bps)) if limits.max_intraday_dd_bps is not None else never
    many = S.ge("n_orders", limits.max_daily_trades) if limits.max_daily_trades is not None else never
    halt = S.ge("atr_bps", limits.halt_atr_bps) if wild else never
    over = S.gt(F.abs("notional"), equity * limits.exposure_pct)
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in ((deep, "intraday_drawdown"), (many, "max_daily_trades"), (halt, "volatility_halt"), (over, "per_symbol_cap"))]))
    action = F.when(deep | many | halt, "block").when(over, "modify").otherwise("allow")
    return day.select("date", "n_orders", "notional", action.alias("action"), reasons.alias("reasons"))


def cap_exposure(orders: DataFrame, equity: float, pct: float = 1.0, per: tuple[str, ...] = ("date",), price: str = "fill_price", qty: str = "quantity") -> DataFrame:
    """Scale quantities down to whole units where a group's notional exceeds the cap; adds capped.

    Totals are aggregated before they are shuffled and joined back, so a day of very many orders meets in no one task.
    """
    keys = [F.col(c).alias(f"__{c}") for c in per]
    totals = orders.groupBy(*keys).agg(F.abs(F.sum(F.col(price) * F.col(qty))).alias("__n"))
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in per])
    cap = equity * pct
    scaled = F.signum(qty) * F.floor(F.abs(F.col(qty) * (cap / F.greatest(F.col("__n"), F.lit(1e-9)))))
    out = orders.join(totals, same, "left")
    out = out.withColumns({"capped": F.col("__n") > cap, qty: F.when(F.col("__n") > cap, scaled).otherwise(F.col(qty)).cast("double")})
    return out.drop("__n", *[f"__{c}" for c in per])


def apply_risk(orders: DataFrame, flags: DataFrame, equity: float, limits: Limits, dry_run: bool = False, price: str = "fill_price", qty: str = "quantity") -> DataFrame:
    """Orders of blocked days go (unless dry_run), the others are capped."""
    rows = orders.join(flags.select("date", "action"), "date")
    return cap_exposure(rows if dry_run else rows.where("action <> 'block'"), equity, limits.exposure_pct, ("date",), price, qty)


def cash_ledger(fills: DataFrame, initial: float = 1_000_000.0, price: str = "fill_price", qty: str = "quantity") -> DataFrame:
    """date, flow, cash: buys take cash, sells bring it. The running sum is over the table of days."""
    sign = F.when(F.upper("side").startswith("B"), -1.0).otherwise(1.0)
    day = fills.groupBy("date").agg(F.sum(sign * F.col(price) * F.col(qty)).alias("flow"))
    return day.withColumn("cash", F.lit(initial) + F.sum("flow").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
