"""Monitoring and reports: triggers, watch lists, rolling scorecards, coverage, integrity flags, blended idea lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.rankstats import average_rank, correlation


def merged_triggers(triggers: DataFrame, active: DataFrame, limit: int, routine: float = 40.0) -> DataFrame:
    """One trigger per symbol, the most urgent (ties by source), the ``limit`` most urgent of all.

    Only where no symbol has a trigger do the ``active`` symbols get a routine one.
    """
    best = triggers.groupBy("symbol").agg(F.min(F.struct((-F.col("priority")).alias("p"), F.col("source"))).alias("t")).select("symbol", (-F.col("t.p")).alias("priority"), "t.source")
    some = triggers.limit(1).select(F.lit(1).alias("_some"))
    rest = active.select("symbol").distinct().join(F.broadcast(some), F.lit(True), "left_anti")  # at most one row
    rest = rest.select("symbol", F.lit(routine).alias("priority"), F.lit("lifecycle").alias("source"))
    return best.unionByName(rest).orderBy(F.desc("priority"), "symbol").limit(limit)


def watch_list(recommendations: DataFrame, limit: int) -> DataFrame:
    """Symbols of the largest absolute weight times confidence among their latest recommendations; long and short ones where there are any."""
    last = recommendations.groupBy("symbol").agg(F.max_by(F.struct("stance", "target_weight", "confidence"), "as_of").alias("r")).select("symbol", "r.*")
    held = F.lower("stance").isin("long", "short")
    any_held = F.max(held.cast("int")).over(Window.partitionBy(F.lit(1)))  # a row per symbol
    rows = last.withColumn("_any", any_held).where(held | (F.col("_any") == 0))
    return rows.select("symbol", F.round(F.abs("target_weight") * F.col("confidence"), 9).alias("watch_score")).orderBy(F.desc("watch_score"), "symbol").limit(limit)


def rolling_scorecards(scored: DataFrame, by: list[str], windows: int, key: str = "symbol") -> DataFrame:
    """Scorecards over the last ``windows`` dates: rows, windows, rank_ic, hit_rate, mean and spread of the halves by expected return."""
    dates = scored.select("as_of").distinct().orderBy(F.desc("as_of")).limit(windows)
    rows = scored.where("return_90d is not null").join(F.broadcast(dates), "as_of", "left_semi")  # ``windows`` rows
    w = Window.partitionBy(*by)
    half = F.greatest(F.floor(F.count("*").over(w) / 2), F.lit(1))
    rows = rows.withColumns(
        {
            "_top": F.row_number().over(w.orderBy(F.desc("expected_return"), "as_of", key)) <= half,
            "_low": F.row_number().over(w.orderBy("expected_return", "as_of", key)) <= half,
            "_x": average_rank("expected_return", by),
            "_y": average_rank("return_90d", by),
        }
    )
    mean = lambda flag: F.avg(F.when(F.col(flag), F.col("return_90d")))
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.countDistinct("as_of").alias("windows"), correlation("_x", "_y").alias("rank_ic"), F.avg((F.col("return_90d") > 0).cast("double")).alias("hit_rate"),
        F.avg("return_90d").alias("mean_return"), F.when(F.count("*") > 1, mean("_top") - mean("_low")).otherwise(0.0).alias("spread"),
    )


def coverage(rows: DataFrame, by: list[str], context: list[str], exact: Column, synthetic: Column, stale: Column) -> DataFrame:
    """Shares of rows with an exact, synthetic or stale event, and with all context columns present."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    whole = F.lit(True)
    for c in context:
        whole = whole & F.col(c).isNotNull()
    return rows.groupBy(*by).agg(rate(exact).alias("exact_rate"), rate(synthetic).alias("synthetic_rate"), rate(stale).alias("stale_rate"), rate(whole).alias("context_coverage"))


def integrity_flags(company: Column, delisted: Column, cap: Column, price: Column, unmapped: Column, placeholder: Column, low_signal: Column) -> Column:
    """Names of what is wrong with an idea's data, in order."""
    none = lambda c: F.coalesce(c, F.lit(0.0)) <= 0
    checks = {
        "delisted_security": delisted, "zero_market_cap": company & none(cap), "missing_live_price": company & none(cap) & none(price), "stale_program_mapping": ~company & unmapped,
        "synthetic_company_program": ~company & placeholder, "low_signal_program": low_signal,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]))


def integrity_status(flags: Column) -> Column:
    """Null without flags; a single program flag marks a research artifact, anything else blocks."""
    program = F.arrays_overlap(flags, F.array(*[F.lit(x) for x in ("low_signal_program", "stale_program_mapping", "synthetic_company_program")]))
    return F.when(F.size(flags) == 0, None).when((F.size(flags) == 1) & program, "research_artifact_program").otherwise("data_integrity_block")


def blended_ideas(ideas: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Company ideas before program ideas, each in ``order``; the first of (symbol, letters and digits of the name, direction); the ``limit`` first."""
    plain = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    rank = [(F.col("level") != "company").cast("int").asc(), *order]
    w = Window.partitionBy("symbol", plain, "direction").orderBy(*rank)
    return ideas.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 and symbol <> ''").drop("_rn").orderBy(*rank).limit(limit)
