"""From signals to positions: edge, weights, plans and risk flags as column jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def risk_flags(flags: dict[str, Column]) -> Column:
    """Names of the flags that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in flags.items()]))


def correlated_shares(rows: DataFrame, by: list[str], horizon: str, weight: str, days: int = 21) -> DataFrame:
    """Weights divided by the root of the number of rows within ``days`` of the horizon (range window, no self join)."""
    near = F.count("*").over(Window.partitionBy(*by).orderBy(horizon).rangeBetween(-days, days))
    return rows.withColumns({"neighbours": near - 1, "scaled": F.col(weight) / F.sqrt(near)})


def capped_plan(rows: DataFrame, by: list[str], weight: str, cap: float, gross: float) -> DataFrame:
    """Weights capped one by one, then scaled down together where their sum is above ``gross``."""
    capped = rows.withColumn("capped", F.least(F.col(weight), F.lit(cap)))
    total = F.sum("capped").over(Window.partitionBy(*by))
    return capped.withColumn("target", F.col("capped") * F.least(F.lit(1.0), F.try_divide(F.lit(gross), total)))


def orders(plan: DataFrame, positions: DataFrame, on: list[str], band: float) -> DataFrame:
    """Side and size against current positions: trades inside the band are held, absent targets are sold."""
    both = plan.join(positions, on, "full")
    change = F.coalesce("target", F.lit(0.0)) - F.coalesce("held", F.lit(0.0))
    side = F.when(F.col("target").isNull() & (F.col("held") > 0), "exit").when(F.abs(change) < band, "hold").when(change > 0, "buy").otherwise("sell")
    return both.withColumns({"change": change, "side": side})


def present_value(peak: Column, rate: float, ramp: list[float]) -> Column:
    """Discounted sum of yearly values, a year's share of the peak each."""
    shares = F.array(*[F.lit(x) for x in ramp])
    years = F.sequence(F.lit(1), F.lit(len(ramp)))
    return F.aggregate(years, F.lit(0.0), lambda total, y: total + peak * F.element_at(shares, y) / F.pow(F.lit(1 + rate), y.cast("double")))
