"""Null-safe numeric columns: defaults, clamping, regimes, buckets, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(column: Column | str, default: float = 0.0) -> Column:
    """Double with NULL and NaN replaced."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(default))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -60.0, 60.0)))


def whole_days(later: Column, earlier: Column) -> Column:
    """Calendar days from one timestamp to another, never negative."""
    return F.greatest(F.datediff(later, earlier), F.lit(0))


def bucket(x: Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """Label of the first edge that x does not exceed."""
    out = None
    for edge, label in edges:
        out = F.when(x <= edge, label) if out is None else out.when(x <= edge, label)
    return out.otherwise(rest)


def horizon_bucket(days: Column) -> Column:
    return bucket(days, [(30, "07_30d"), (60, "31_60d"), (90, "61_90d"), (120, "91_120d")], "121d_plus")


def knowledge_bucket(days: Column) -> Column:
    return bucket(days, [(7, "fresh_0_7d"), (21, "known_8_21d"), (45, "known_22_45d")], "known_46d_plus")


def company_state(products: Column, revenue: Column) -> Column:
    """pre_commercial, commercial_launch or commercialized, by products on the market and revenue."""
    return (
        F.when(revenue >= 500_000_000, "commercialized")
        .when((products > 0) | (revenue >= 75_000_000), "commercial_launch")
        .otherwise("pre_commercial")
    )


def floor_support(cap: Column, cash: Column, debt: Column, revenue: Column) -> Column:
    """Net cash and a share of revenue against market value."""
    net = F.greatest(cash - debt, F.lit(0.0))
    return clamp((net + 0.35 * revenue) / F.greatest(cap, F.lit(1.0)), 0.0, 1.25)


def financing_risk(cap: Column, cash: Column, debt: Column, revenue: Column) -> Column:
    base = F.greatest(cap, F.lit(1.0))
    durable = clamp(F.greatest(cash - debt, F.lit(0.0)) / base + 0.35 * revenue / base, 0.0, 1.0)
    return clamp((1 - durable) * 0.70 + F.least(F.greatest(debt, F.lit(0.0)) / base, F.lit(1.0)) * 0.30, 0.0, 1.0)


def regime(momentum: Column) -> Column:
    return F.when(momentum > 0.05, "positive_momentum").when(momentum < -0.05, "negative_momentum").otherwise("neutral_momentum")


def borrow_cost(risk: Column, volatility: Column) -> Column:
    return 0.002 + 0.008 * risk + 0.003 * clamp(volatility, 0.0, 1.0)


def quarter_step(weight: Column) -> Column:
    """Weight in quarter steps, half to even."""
    return F.bround(F.greatest(weight, F.lit(0.0)) * 4) / 4


def implied_move(volatility: Column, days: Column) -> Column:
    """Expected absolute move over some days from annual volatility."""
    return clamp(volatility * F.sqrt(days / 252.0) * 0.798, 0.0, 1.0)


def round_trip_cost(cap: Column, volatility: Column, catalyst: Column) -> Column:
    """Share of the notional that entry and exit cost: by market value tier, volatility, and for catalyst setups."""
    base = F.when(cap.isNull() | (cap <= 0), 275.0).when(cap < 250_000_000, 425.0).when(cap < 1_000_000_000, 220.0).when(cap < 5_000_000_000, 110.0).otherwise(45.0)
    return (base + F.least(F.greatest(volatility, F.lit(0.0)) * 1000.0, F.lit(125.0)) + F.when(catalyst, 35.0).otherwise(0.0)) / 10_000.0


def notional(weight: Column, equity: Column, confidence: Column | None = None) -> Column:
    """Money behind a target weight in percent of the equity, scaled by confidence where given."""
    whole = F.abs(weight) / 100.0 * F.greatest(equity, F.lit(0.0))
    return whole if confidence is None else whole * clamp(confidence, 0.0, 1.0)
