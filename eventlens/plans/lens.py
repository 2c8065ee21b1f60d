"""Expectation lens: what a company is worth by its peers and programs, against its market value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.numeric import clamp
from eventlens.functions.taxonomy import looked_up

# Share of its market that a program of a phase rank may reach.
SHARE_CAPS = ((6, 0.16), (5, 0.12), (4, 0.08), (3, 0.05), (2, 0.03), (1, 0.02), (0, 0.015))
OTHER_SHARE_CAP = 0.02


def program_sales(programs: DataFrame, by: list[str], order: str, top: int = 3) -> DataFrame:
    """Per company: top_market, and program_sales of its ``top`` programs by market before competition: market * share cap * chance.

    ``programs`` has market, phase_rank and pos; ties of the market go by ``order``.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("market"), order)
    best = programs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top)
    sales = F.coalesce("market", F.lit(0.0)) * looked_up(F.col("phase_rank"), SHARE_CAPS, OTHER_SHARE_CAP) * F.coalesce("pos", F.lit(0.0))
    return best.groupBy(*by).agg(F.max("market").alias("top_market"), F.sum(sales).alias("program_sales"))


def risk_adjusted(sales: Column, intensity: Column) -> Column:
    return sales * clamp(1.0 - 0.40 * intensity, 0.35, 0.90)


def expectation_lens(rows: DataFrame) -> DataFrame:
    """``rows`` with peer_anchor_value, internal_value, internal_upside, price_target, peer_gap and asymmetry.

    Columns read: company_state, market_cap, revenue, cash, debt, price, top_market, risk_adjusted_sales, median_multiple and metric
    (market-cap/TAM or EV/revenue), launch_progress, lifecycle, optionality, deployment, exact_event; missing numbers count as 0, a missing
    multiple as its state's default.
    """
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    state, cap, revenue, sales = F.col("company_state"), F.greatest(n("market_cap"), F.lit(1.0)), n("revenue"), n("risk_adjusted_sales")
    net = F.greatest(n("cash") - n("debt"), F.lit(0.0))
    median = n("median_multiple")
    by_market = (state == "pre_commercial") & (F.col("metric") == "market-cap/TAM")
    anchor = F.when(median <= 0, 0.0).when(by_market, n("top_market") * median).when((revenue > 0) & (F.col("metric") == "EV/revenue"), revenue * median).otherwise(0.0)
    rows = rows.withColumn("peer_anchor_value", anchor)
    peer, floor = F.col("peer_anchor_value"), net + 0.15 * revenue
    multiple = lambda default: F.when(median != 0, median).otherwise(default)
    launch = revenue * clamp(multiple(5.0) * (0.80 + 0.30 * n("launch_progress")), 2.5, 9.0)
    launch_line = sales * (1.9 + 0.2 * n("lifecycle"))
    franchise = revenue * clamp(multiple(4.0) * (0.90 + 0.15 * n("deployment")), 2.0, 8.0)
    franchise_line = sales * (1.4 + 0.25 * n("optionality"))
    early = 0.45 * peer + 0.55 * sales * (2.1 + F.when(F.col("exact_event"), 0.15).otherwise(0.0)) + floor
    launching = F.when(peer > 0, 0.50 * peer + 0.35 * launch + 0.15 * launch_line).otherwise(0.65 * launch + 0.35 * launch_line) + floor
    established = F.when(peer > 0, 0.65 * peer + 0.20 * franchise + 0.15 * franchise_line).otherwise(0.70 * franchise + 0.30 * franchise_line) + 0.75 * net
    rows = rows.withColumn("internal_value", F.when(state == "pre_commercial", early).when(state == "commercial_launch", launching).otherwise(established))
    value = F.col("internal_value")
    upside = clamp(value / cap - 1.0, -0.85, 2.50)
    label = F.when(F.col("internal_upside") >= 0.35, "high positive asymmetry").when(F.col("internal_upside") >= 0.15, "moderate positive asymmetry")
    return rows.withColumns({"internal_upside": upside, "price_target": F.when(n("price") > 0, n("price") * value / cap)}).withColumns(
        {
            "peer_gap": F.when(peer > 0, peer / cap - 1.0).otherwise(F.col("internal_upside")),
            "asymmetry": label.when(F.col("internal_upside") > -0.10, "balanced / fairly priced").otherwise("negative asymmetry"),
        }
    )
