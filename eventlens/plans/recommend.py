"""From signals to recommendations: empirical edge, scenario, target weight and its smoothing over time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.numeric import clamp
from eventlens.operators.greedy import streamed
from eventlens.operators.rankstats import average_rank, correlation
from eventlens.operators.rows import once
from eventlens.plans.portfolio import risk_flags

# What a dimension's scorecard counts, scenarios that go short, bonuses and caps by scenario.
EDGE_WEIGHTS = {"state_setup": 0.55, "setup_type": 0.30, "company_state": 0.15}
SHORTS = ("pre-catalyst short", "science-vs-street short", "franchise de-rating short")
BONUS = {"pre-catalyst long": 2.0, "commercial compounder": 1.0, "pairs candidate": 0.25, "pre-catalyst short": 1.75, "science-vs-street short": 1.0, "franchise de-rating short": 0.75}
CAPS = {
    "watchlist only": 1.0, "avoid due to financing": 0.0, "pairs candidate": 2.5, "commercial compounder": 4.0, "pre-catalyst long": 4.0, "pre-catalyst short": 3.5,
    "science-vs-street short": 2.5, "franchise de-rating short": 2.5,
}


def _dimensions() -> Column:
    state, setup = F.coalesce("company_state", F.lit("unknown")), F.coalesce("setup_type", F.lit("unknown"))
    values = {"state_setup": F.concat_ws("|", state, setup), "setup_type": setup, "company_state": state}
    return F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in values.items()])


def prior_scorecards(scored: DataFrame) -> DataFrame:
    """Scorecards by state and setup, setup and state, from signals with ``expected_return`` and the realised ``return_90d``.

    The three dimensions are stacked as rows and aggregated together: rows, windows (dates), rank_ic, hit_rate (share of
    equal signs), spread (mean return of positive less that of other expectations) and mean_return.
    """
    rows = scored.where("expected_return is not null and return_90d is not null").select("as_of", "expected_return", "return_90d", F.inline(_dimensions()))
    by = ["dimension", "value"]
    rows = rows.withColumns({"_x": average_rank("expected_return", by), "_y": average_rank("return_90d", by)})
    up = F.col("expected_return") > 0
    spread = F.coalesce(F.avg(F.when(up, F.col("return_90d"))) - F.avg(F.when(~up, F.col("return_90d"))), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.countDistinct("as_of").alias("windows"), correlation("_x", "_y").alias("rank_ic"),
        F.avg((F.signum("expected_return") == F.signum("return_90d")).cast("double")).alias("hit_rate"), spread.alias("spread"), F.avg("return_90d").alias("mean_return"),
    )


def scorecard_edge(cards: DataFrame) -> DataFrame:
    """``cards`` with ``edge`` and ``reliability`` of each."""
    edge = 0.45 * clamp(F.col("rank_ic"), -0.5, 0.5) + 0.35 * clamp(F.col("hit_rate") - 0.5, -0.35, 0.35) + 0.15 * clamp(F.col("spread"), -0.6, 0.6) + 0.05 * clamp(F.col("mean_return"), -0.35, 0.35)
    sure = F.least(F.col("rows") / 30.0, F.lit(1.0)) * F.least(F.col("windows") / 6.0, F.lit(1.0)) * F.when(F.col("rows") < 8, 0.5).otherwise(1.0)
    return cards.withColumns({"edge": edge, "reliability": sure})


def with_edge(signals: DataFrame, cards: DataFrame) -> DataFrame:
    """``signals`` with edge_score, reliability, edge_tilt, weight_multiplier and weight_bonus from their scorecards.

    The cards are a few rows (states times setups), joined once over the stacked dimensions of each signal.
    """
    keyed = signals.withColumn("_id", F.struct("symbol", "as_of")).select("_id", F.inline(_dimensions()))
    share = F.element_at(F.create_map(*[F.lit(x) for item in EDGE_WEIGHTS.items() for x in item]), F.col("dimension"))
    found = keyed.join(scorecard_edge(cards), ["dimension", "value"]).where("reliability > 0").withColumn("_w", share * F.col("reliability"))
    total = F.sum("_w")
    sums = found.groupBy("_id").agg(F.round(F.sum(F.col("edge") * F.col("_w")) / total, 12).alias("edge_score"), F.round(F.least(total, F.lit(1.0)), 12).alias("reliability"))
    rows = signals.join(sums.select("_id.*", "edge_score", "reliability"), ["symbol", "as_of"], "left").fillna(0.0, ["edge_score", "reliability"])
    both = F.col("edge_score") * F.col("reliability")
    return rows.withColumns({"edge_tilt": both * 0.20, "weight_multiplier": clamp(1 + both * 1.35, 0.75, 1.35), "weight_bonus": clamp(both * 4.5, -0.75, 1.0)})


# The thresholds, weights and caps in the functions below.
def scenario() -> Column:
    """One of nine scenarios; rules are tried in order."""
    er, prob, conf, state, setup = (F.col(c) for c in ("expected_return", "success_prob", "confidence", "company_state", "setup_type"))
    score, tilt = F.col("edge_score"), F.col("edge_tilt")
    up, down, loss = F.greatest(tilt, F.lit(0.0)), F.greatest(-tilt, F.lit(0.0)), F.greatest(-score, F.lit(0.0))
    gap = F.greatest(-F.coalesce("upside", F.lit(0.0)), F.lit(0.0))
    hard = F.col("event_bucket").isin("clinical", "regulatory")
    setup_ok = F.coalesce(setup.isin("hard_catalyst", "soft_catalyst"), F.lit(False)) | (setup.isNull() & hard)
    near = hard & F.col("event_exact") & F.coalesce(F.col("event_days") <= 120, F.lit(False))
    soon = F.col("horizon").isin("30d", "90d") | near
    sold = state.isin("commercial_launch", "commercialized")
    waiting = (state == "pre_commercial") & F.coalesce(setup == "asymmetry_without_near_term_catalyst", F.lit(False))
    asymmetric = (er > F.greatest(F.lit(0.10), 0.12 - up)) & (F.coalesce("floor_support", F.lit(0.0)) > F.greatest(F.lit(0.14), 0.18 - up))
    return (
        F.when(F.col("financing_risk") > 0.80, "avoid due to financing")
        .when(waiting & asymmetric, "pairs candidate")
        .when(waiting, "watchlist only")
        .when(setup_ok & (er < -F.greatest(F.lit(0.10), 0.14 - up)) & (prob < F.least(F.lit(0.48), 0.45 + loss * 0.20)) & (gap >= 0.12) & (conf >= 0.55) & soon, "pre-catalyst short")
        .when(sold & (gap >= 0.50) & (er < 0.14) & (prob < 0.90) & (conf >= 0.72), "science-vs-street short")
        .when(sold & (er < -(0.10 + down * 0.5)) & (gap >= 0.18) & (conf >= 0.58), "franchise de-rating short")
        .when((er < -(0.08 + down * 0.5)) & (gap >= 0.14) & (conf >= 0.55), "science-vs-street short")
        .when(setup_ok & (er > F.greatest(F.lit(0.11), 0.16 - up)) & (prob > F.greatest(F.lit(0.47), 0.52 - F.greatest(score, F.lit(0.0)) * 0.20)) & soon, "pre-catalyst long")
        .when(sold & (er > 0.10 + down) & (prob > 0.55 + loss * 0.20), "commercial compounder")
        .when(er > 0.08 + down * 0.5, "pairs candidate")
        .otherwise("watchlist only")
    )


def signal_flags() -> Column:
    """Names of a signal's risks, in order."""
    er, up, edge, sure = F.col("expected_return"), F.coalesce("upside", F.lit(0.0)), F.col("edge_score"), F.col("reliability")
    return risk_flags(
        {
            "crowded catalyst": F.col("crowding") > 0.65,
            "financing overhang": F.col("financing_risk") > 0.65,
            "low catalyst probability": F.col("success_prob") < 0.40,
            "earnings-driven setup": F.col("event_bucket") == "earnings",
            "no hard catalyst yet": (F.col("company_state") == "pre_commercial") & (F.col("setup_type") == "asymmetry_without_near_term_catalyst"),
            "negative asymmetry": up < 0,
            "science/street mismatch": (er < -0.08) & (up <= -0.12),
            "weak historical archetype edge": (sure >= 0.35) & (edge <= 0.02),
            "strong historical archetype edge": (sure >= 0.55) & (edge >= 0.12),
        }
    )


def raw_recommendations(signals: DataFrame) -> DataFrame:
    """``signals`` with edge columns -> scenario, max_weight, stance, raw_weight (before smoothing), flags and the previous edges."""
    rows = once(signals, {"scenario": scenario()})
    short = F.col("scenario").isin(*SHORTS)
    w = Window.partitionBy("symbol").orderBy("as_of")
    signed = lambda c: F.greatest(F.when(short, -c).otherwise(c), F.lit(0.0))
    before = F.lag("expected_return").over(w)
    rows = rows.withColumns({"_edge": signed(F.col("expected_return")), "_before": F.coalesce(signed(before), F.lit(0.0)), "_known": before.isNotNull(), "_bucket": F.lag("event_bucket").over(w)})
    gap = F.when(short, F.greatest(-F.coalesce("upside", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    persist = F.when(F.col("_before") > 0.08, F.when(F.col("_bucket").eqNullSafe(F.col("event_bucket")), 0.60).otherwise(0.25)).otherwise(0.0)
    clinical = F.when(F.col("event_bucket").isin("clinical", "regulatory"), 0.75).otherwise(0.0)
    base = F.col("_edge") * (0.70 + F.col("confidence")) * 16.0 + F.col("confidence") * 2.0 + clinical + persist + gap * 3.0 - 0.75
    discount = F.col("crowding") * F.when(short, 0.9).otherwise(1.8) + F.col("financing_risk") * 3.5 + F.when(F.col("event_bucket") == "earnings", 0.75).otherwise(0.0)
    of = lambda table: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), F.col("scenario")), F.lit(0.0))
    target = F.least(F.greatest(base * F.col("weight_multiplier") + of(BONUS) + F.col("weight_bonus") - discount, F.lit(0.0)), of(CAPS))
    top = F.when(F.col("crowding") > 0.75, 2.5).when(short, 3.5).otherwise(4.0)
    rows = once(rows, {"_target": F.round(target, 9), "max_weight": F.when(F.col("financing_risk") > 0.75, F.least(top, F.lit(2.0))).otherwise(top)})
    stance = F.when(F.col("_target") <= 0, "avoid").when(short, "short").otherwise("long")
    return rows.withColumns({"raw_weight": F.least("_target", "max_weight"), "stance": stance, "flags": signal_flags()}).drop("_target", "_bucket")


def _smooth(raw: float, stance: str, prior: float | None, prior_stance: str | None, edge: float, before: float, known: bool, confidence: float) -> float:
    """The weight after one step from the last one; quarter steps, half to even."""
    if prior is None or prior_stance != stance:
        value = raw
    elif raw <= 0:
        value = min(prior, 0.75) if known and before > 0.05 and confidence > 0.45 else 0.0
    elif prior >= 1 > raw and known and before > 0.06 and edge > 0.04:
        value = min(max(1.0, prior * 0.60), max(prior, raw))
    else:
        delta = raw - prior
        value = prior + delta * (0.35 if abs(delta) < 0.75 else 0.55 if abs(delta) < 2 else 0.80)
    return round(max(value, 0.0) * 4) / 4


def recommendations(signals: DataFrame) -> DataFrame:
    """Target weight and stance of every signal: raw weights smoothed against the symbol's last recommendation.

    A step depends on the result before it, so a symbol's rows stream through one task in order; three numbers are carried.
    """
    rows = raw_recommendations(signals)
    columns = [c for c in rows.columns if not c.startswith("_")]
    schema = T.StructType([f for f in rows.schema.fields if f.name in columns] + [T.StructField("target_weight", T.DoubleType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = prior = held = None
        for batch in batches:
            weights, stances = [], []
            names = ("symbol", "raw_weight", "stance", "max_weight", "_edge", "_before", "_known", "confidence")
            for s, raw, stance, top, edge, before, known, confidence in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if s != symbol:
                    symbol, prior, held = s, None, None
                prior = min(_smooth(raw, stance, prior, held, edge, before, known, confidence), top)
                held = stance if prior > 0 else "avoid"
                weights.append(prior)
                stances.append(held)
            arrays = [pa.array(stances, pa.string()) if c == "stance" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(weights, pa.float64())], [*columns, "target_weight"])

    return streamed(rows, ["symbol"], [F.col("as_of")]).mapInArrow(fold, schema)


def haircut(signals: DataFrame) -> DataFrame:
    """Special situations: confidence, expected return and success probability scaled by their haircuts below 1, kept under 0.99."""
    cut = lambda c, h: F.when(F.col(h) < 1, F.col(c) * F.col(h)).otherwise(F.col(c))
    capped = lambda c, h: F.when(F.col(h) < 1, clamp(F.col(c) * F.col(h), 0.0, 0.99)).otherwise(F.col(c))
    return signals.withColumns(
        {"confidence": capped("confidence", "confidence_haircut"), "expected_return": cut("expected_return", "return_haircut"), "success_prob": capped("success_prob", "prob_haircut")}
    )
