"""After the plan: execution feedback, exposure governor, gates, scorecards by rebalance window, sticky holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.numeric import clamp, round_trip_cost
from eventlens.operators.asof import asof_join
from eventlens.operators.greedy import greedy_spacing
from eventlens.operators.rankstats import aggregate_windows, window_summary


def execution_feedback(plans: DataFrame, snapshots: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (10, 30, 90)) -> DataFrame:
    """Plans (plan, symbol, action, entry_at, setup_type) with entry price, signed returns per horizon, gross and net, and marked to the last close.

    Entry and exits are the first closes at or after their times; one forward as-of pass serves all of them. Costs follow the market
    value of the last snapshot at or before the entry. Plans other than buys and sells, or without an entry price, go.
    """
    acted = plans.where(F.col("action").isin("buy", "sell") & F.col("entry_at").isNotNull())
    sized = asof_join(acted, snapshots.withColumnRenamed("as_of", "_snap"), ["symbol"], "entry_at", "_snap", ["market_cap", "volatility"])
    stacked = sized.select("*", F.explode(F.array(*[F.lit(h) for h in (0, *horizons)])).alias("_h")).withColumn("_at", F.col("entry_at") + F.make_dt_interval(F.col("_h")))
    found = asof_join(stacked, prices, ["symbol"], "_at", "date", ["close"], "forward")
    at = lambda h: F.max(F.when(F.col("_h") == h, F.col("close")))
    rows = found.groupBy("plan", "symbol", "action", "entry_at", "setup_type", "market_cap", "volatility").agg(at(0).alias("entry_price"), *[at(h).alias(f"_p{h}") for h in horizons])
    last = prices.groupBy("symbol").agg(F.max_by("close", "date").alias("_last"))
    rows = rows.where("entry_price > 0").join(last, "symbol", "left")
    sign = F.when(F.col("action") == "buy", 1.0).otherwise(-1.0)
    cap = F.when(F.col("market_cap") > 0, F.col("market_cap"))
    cost = round_trip_cost(cap, F.coalesce("volatility", F.lit(0.0)), F.coalesce(F.col("setup_type").isin("hard_catalyst", "soft_catalyst"), F.lit(False)))
    rows = rows.withColumn("round_trip", cost)
    move = lambda c: sign * (F.col(c) / F.col("entry_price") - 1)
    rows = rows.withColumns({**{f"return_{h}d": move(f"_p{h}") for h in horizons}, "mark_to_market": move("_last")})
    net = {f"return_{h}d_net": F.col(f"return_{h}d") - F.col("round_trip") for h in horizons}
    return rows.withColumns({**net, "mark_to_market_net": F.col("mark_to_market") - F.col("round_trip") / 2}).drop("_last", *[f"_p{h}" for h in horizons])


def exposure_governor(rows: DataFrame, by: list[str], benchmark: Column, blocked: Column, max_gross: float = 100.0, max_single: float = 4.0) -> DataFrame:
    """Per key: multiplier, gross cap and regime from median momentum and volatility, the benchmark's return and a blocked validation.

    ``benchmark`` and ``blocked`` are aggregates over the key's rows.
    """
    out = rows.groupBy(*by).agg(F.median("momentum").alias("momentum"), F.median("volatility").alias("volatility"), benchmark.alias("benchmark"), blocked.alias("blocked"))
    step = lambda *tests: F.coalesce(F.when(tests[0][0], tests[0][1]).when(tests[1][0], tests[1][1]), F.lit(1.0))
    b, m, v = F.col("benchmark"), F.col("momentum"), F.col("volatility")
    scale = F.when(F.coalesce("blocked", F.lit(False)), 0.65).otherwise(1.0)
    scale = scale * step((b <= -0.15, 0.55), (b <= -0.08, 0.75)) * step((m <= -0.12, 0.70), (m <= -0.05, 0.85)) * step((v >= 0.60, 0.75), (v >= 0.45, 0.90))
    out = out.withColumn("multiplier", F.round(clamp(scale, 0.25, 1.0), 9))
    regime = F.when(F.col("multiplier") <= 0.60, "risk_off").when(F.col("multiplier") < 1, "caution").otherwise("normal")
    return out.withColumns({"gross_cap": F.least(F.lit(max_gross), F.greatest(F.lit(max_single), max_gross * F.col("multiplier"))), "regime": regime})


def alpha_gate(rows: Column, rank_ic: Column, spread: Column, gate: Column, depth: Column) -> Column:
    """Why the pre-event sleeve may not trade; null where it may."""
    weak = ~((rows >= 25) & (rank_ic >= 0) & (spread > 0))
    return (
        F.when(F.coalesce(rows, F.lit(0)) <= 0, "missing_scorecard").when(~F.coalesce(gate, F.lit(False)), "pre_event_gated")
        .when(depth.isNotNull() & ~depth, "family_depth_gated").when(F.coalesce(weak, F.lit(True)), "weak_pre_event_edge")
    )


def rebalance_windows(rows: DataFrame, by: list[str], at: str, days: int) -> DataFrame:
    """``rows`` with ``window``: the last rebalance date at or before them; the dates are a key's own, ``days`` apart, and its last."""
    bounds = greedy_spacing(rows.select(*by, F.to_date(at).alias("_bound")), by, "_bound", days)
    out = asof_join(rows, bounds, by, at, "_bound", [])
    return out.withColumnRenamed("_bound", "window")


def dimension_scorecards(rows: DataFrame, dimension: str, at: str, key: list[str], days: int, trailing: int) -> DataFrame:
    """Scorecards per value of a dimension over all rebalance windows and over the last ``trailing`` ones (``scope``)."""
    windows = window_summary(rebalance_windows(rows.where(F.col(dimension).isNotNull()), [dimension], at, days), [dimension, "window"], key)
    aged = windows.withColumn("_age", F.row_number().over(Window.partitionBy(dimension).orderBy(F.desc("window"))))
    scopes = F.when(F.col("_age") <= trailing, F.array(F.lit("full"), F.lit("rolling"))).otherwise(F.array(F.lit("full")))
    return aggregate_windows(aged.withColumn("scope", F.explode(scopes)), [dimension, "scope"])


def sticky_top(rows: DataFrame, by: str, date: str, weight: str, floor: float, hold: float = 0.5) -> DataFrame:
    """``rows`` with ``top``: whether a key is in the book of its date, or was on the date before and still weighs ``hold``.

    Holding on is a run: a key stays from a date on which it is in the book for as long as each next date of the table
    has it at ``hold`` or more. So a running maximum inside runs replaces the step from date to date.
    """
    dates = rows.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)))  # one row per date
    numbered = rows.join(F.broadcast(dates), date)
    w = Window.partitionBy(by).orderBy("_i")
    stays = (F.col(weight) >= hold) & (F.lag("_i").over(w) == F.col("_i") - 1)
    runs = numbered.withColumn("_run", F.sum(F.when(F.coalesce(stays, F.lit(False)), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(by, "_run").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("top", F.max(F.col(weight) >= floor).over(inside)).drop("_i", "_run")
