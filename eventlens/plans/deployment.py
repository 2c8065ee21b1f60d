"""From recommendations to deployment: execution profiles, the validation overlay, promotion of a model, ranked lists of ideas."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.program import execution_score


@dataclass(frozen=True)
class Bars:
    """What a setup must reach to be bought or held, and the largest weight it may have."""

    hold_weight: float = 0.75
    hold_confidence: float = 0.50
    hard_confidence: float = 0.62
    soft_confidence: float = 0.68
    launch_confidence: float = 0.58
    franchise_confidence: float = 0.56
    upside: float = 0.08
    floor: float = 0.10
    hard_cap: float = 4.0
    soft_cap: float = 2.5
    launch_cap: float = 3.0
    franchise_cap: float = 3.0
    floor_cap: float = 1.5
    max_age_days: int = 7
    least_rows: int = 12
    least_windows: int = 4
    least_hit_rate: float = 0.45
    block_spread: float = 0.0
    caution_spread: float = 0.05
    caution_scale: float = 0.5


#: Inputs of a profile and what stands in for null.
DEFAULTS = {
    "special_situation": "", "stance": "", "scenario": "", "company_state": "pre_commercial", "setup_type": "watchful", "expected_return": 0.0, "success_prob": 0.0, "confidence": 0.0, "target_weight": 0.0, "financing_risk": 0.0,
    "crowding": 0.0, "upside": 0.0, "floor_support": 0.0, "held": False,
}


def profile_rules(b: Bars = Bars()) -> list[tuple[str, str, str, float, float]]:
    """The rules in order, as (condition, name, mode, cap, bonus): the first that holds counts; the last one always does."""
    sold = "company_state IN ('commercial_launch', 'commercialized')"
    kept = f"held AND confidence >= {b.hold_confidence}"
    floored = f"{kept} AND floor_support >= {b.floor}"
    franchise = f"{sold} AND confidence >= {b.franchise_confidence}"
    block = lambda when, name: (when, name, "block", 0.0, -2.0)
    hold = lambda when, name, cap, bonus=0.0: (when, name, "hold", cap, bonus - 0.25)
    auto = lambda when, name, cap, bonus=0.0: (when, name, "auto", cap, bonus)
    rules = [
        block("special_situation = 'pending_transaction'", "pending_transaction"),
        block("stance = 'short'", "short_research_only"),
        block("stance <> 'long'", "not_long"),
        block("scenario = 'avoid due to financing' OR financing_risk > 0.82", "financing_blocked"),
        block("scenario = 'watchlist only' AND setup_type NOT IN ('asymmetry_without_near_term_catalyst', 'sentiment_floor')", "watchlist_only"),
        block("upside <= -0.12", "negative_asymmetry"),
        block("expected_return <= 0.0 AND upside <= 0.0", "no_edge"),
        block(f"target_weight < {b.hold_weight} AND NOT held", "subscale"),
        block(f"confidence < {b.hold_confidence} AND NOT held", "low_confidence"),
    ]

    def setup(name: str, *of: tuple) -> None:
        rules.extend((f"setup_type = '{name}' AND ({when})", *rest) for when, *rest in of)

    setup(
        "hard_catalyst",
        auto(f"confidence >= {b.hard_confidence} AND success_prob >= 0.50 AND upside >= -0.02 AND financing_risk <= 0.72", "hard_catalyst", b.hard_cap, 0.45),
        hold(f"{kept} AND success_prob >= 0.45", "hard_catalyst_hold", b.soft_cap, 0.15),
        block("true", "hard_catalyst_blocked"),
    )
    setup(
        "soft_catalyst",
        auto(f"confidence >= {b.soft_confidence} AND success_prob >= 0.55 AND upside >= {b.upside - 0.02:.6g} AND floor_support >= {max(b.floor - 0.02, 0.0):.6g}", "soft_catalyst", b.soft_cap, 0.20),
        hold(f"{kept} AND upside >= {b.upside}", "soft_catalyst_hold", b.soft_cap),
        block("true", "soft_catalyst_blocked"),
    )
    setup(
        "launch_asymmetry",
        auto(f"company_state = 'commercial_launch' AND confidence >= {b.launch_confidence} AND expected_return > 0.08 AND upside >= {b.upside - 0.02:.6g} AND floor_support >= {b.floor} AND financing_risk <= 0.68", "launch_asymmetry", b.launch_cap, 0.30),
        hold(floored, "launch_hold", b.launch_cap),
        block("true", "launch_blocked"),
    )
    for name in ("pipeline_optionality", "capital_allocation"):
        setup(
            name,
            auto(f"{franchise} AND expected_return > 0.05 AND upside >= {b.upside - 0.04:.6g} AND floor_support >= {b.floor}", name, b.franchise_cap, 0.18),
            hold(floored, f"{name}_hold", b.franchise_cap),
            block("true", f"{name}_blocked"),
        )
    setup(
        "sentiment_floor",
        auto(f"{franchise} AND expected_return > 0.04 AND upside >= {b.upside - 0.05:.6g} AND floor_support >= {b.floor + 0.05:.6g}", "sentiment_floor", b.floor_cap, 0.08),
        hold(floored, "sentiment_floor_hold", b.floor_cap),
        block("true", "sentiment_floor_blocked"),
    )
    setup(
        "asymmetry_without_near_term_catalyst",
        hold(f"company_state = 'pre_commercial' AND held AND confidence >= {max(b.hold_confidence, 0.56)} AND upside >= {b.upside} AND floor_support >= {b.floor + 0.06:.6g} AND financing_risk <= 0.60", "precommercial_asymmetry_hold", b.floor_cap, 0.05),
        auto(f"{franchise} AND expected_return > 0.07 AND upside >= {b.upside} AND floor_support >= {b.floor + 0.02:.6g}", "franchise_asymmetry", b.floor_cap),
        block("true", "no_near_term_catalyst"),
    )
    return [*rules, block("crowding > 0.88 AND NOT held", "crowded_setup"), hold(f"{floored} AND upside > 0.0", "default_hold", b.floor_cap), block("true", "watchful")]


def execution_profiles(rows: DataFrame, bars: Bars = Bars()) -> DataFrame:
    """``rows`` with profile, mode (auto, hold, block), weight_cap and score.

    Needs the columns of ``DEFAULTS``, whose values stand in for null. A row's rule is found once; name, mode, cap and score come from it.
    Bought setups other than hard catalysts that are crowded get the smallest cap.
    """
    filled = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()})
    made = lambda r: F.struct(F.lit(r[1]).alias("profile"), F.lit(r[2]).alias("mode"), F.lit(r[3]).alias("weight_cap"), F.lit(r[4]).alias("bonus"))
    rules = profile_rules(bars)
    found = reduce(lambda chain, r: chain.when(F.expr(r[0]), made(r)), rules[1:], F.when(F.expr(rules[0][0]), made(rules[0])))
    out = filled.select("*", F.inline(F.array(found)))
    crowded = (F.col("mode") == "auto") & (F.col("crowding") > 0.80) & (F.col("profile") != "hard_catalyst")
    cap = F.when(crowded, F.least("weight_cap", F.lit(bars.floor_cap))).otherwise(F.col("weight_cap"))
    return out.withColumns({"weight_cap": cap, "score": execution_score(out) + F.col("bonus")}).drop("bonus")


def validation_overlay(profiles: DataFrame, bars: Bars = Bars()) -> DataFrame:
    """``profiles`` with profile, mode, weight_cap and score as the last validation has them.

    Further columns: validation_age (days since the audit; null: its time is unknown), validated (whether there is one), hard_gate (passed or not), and
    the rolling metrics of the row's setup, v_rows, v_windows, v_spread, v_hit_rate, v_rank_ic, v_return (null: none). Blocked rows stay. A
    stale audit, a failed gate or clearly negative metrics turn a purchase into a hold where there is a position, else into a block;
    doubtful metrics halve its cap, down to the smallest one.
    """
    value = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d))
    held, auto = F.coalesce("held", F.lit(False)), F.col("mode") == "auto"
    live = F.coalesce("validated", F.lit(False)) & (F.col("mode") != "block")
    stale = live & F.coalesce(F.col("validation_age") > bars.max_age_days, F.lit(False))
    gated = live & auto & (F.col("setup_type") == "hard_catalyst") & ~F.coalesce("hard_gate", F.lit(True))
    known = live & auto & (value("v_rows", 0.0) >= bars.least_rows) & (value("v_windows", 0.0) >= bars.least_windows)
    spread, hits, ic, gain = value("v_spread", 0.0), value("v_hit_rate", 0.5), value("v_rank_ic", 0.0), value("v_return", 0.0)
    bad = known & ((spread <= bars.block_spread) | (gain < bars.block_spread) | ((hits < bars.least_hit_rate) & (ic < 0)) | (ic < -0.05))
    doubt = known & ((spread < bars.caution_spread) | (hits < 0.50) | (ic < 0))
    cap = F.least("weight_cap", F.greatest(F.lit(bars.floor_cap), F.col("weight_cap") * bars.caution_scale))
    step = F.when(stale, "stale_validation").when(gated | bad, "validation").when(doubt & (cap < F.col("weight_cap")), "caution")
    rows = profiles.select("*", F.inline(F.array(F.struct(step.alias("_step"), cap.alias("_cap")))))
    stop = F.coalesce(F.col("_step").endswith("validation"), F.lit(False))
    suffix = F.concat(F.lit("_"), "_step", F.when(held, "_hold").otherwise("_blocked"))
    return rows.withColumns({
        "profile": F.when(stop, F.concat("profile", suffix)).otherwise(F.col("profile")),
        "mode": F.when(stop, F.when(held, "hold").otherwise("block")).otherwise(F.col("mode")),
        "weight_cap": F.when(stop & held, F.least("weight_cap", F.lit(bars.floor_cap))).when(stop, 0.0).when(F.col("_step") == "caution", F.col("_cap")).otherwise(F.col("weight_cap")),
        "score": F.col("score") - F.when(stop & held, 0.35).when(stop, 1.0).when(F.col("_step") == "caution", 0.15).otherwise(0.0),
    }).drop("_step", "_cap")


def promotions(audits: DataFrame, least_windows: int = 3, least_rows: int = 100) -> DataFrame:
    """``audits`` with decision (promote, paper_trade_ready, do_not_promote) and blockers.

    Columns: windows, rows, rank_ic, strict_rank_ic, spread, exact_rate, synthetic_rate, rank_ic_low, spread_low (lower ends of confidence bands), leakage_passed,
    own_blockers (array of further reasons). Null numbers count as 0, a null synthetic_rate as 1, a null lower end or leakage as failed. Blockers are
    those of the gate that is not met: paper trading first, then the stricter one.
    """
    value = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d))
    why = lambda test, text: F.when(test, text)
    own = F.filter(F.coalesce("own_blockers", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    paper = F.array_compact(F.concat(F.array(why(~F.coalesce("leakage_passed", F.lit(False)), "leakage")), own, F.array(
        why(value("windows") < least_windows, "windows"), why(value("rows") < least_rows, "rows"), why(value("rank_ic") < 0.10, "rank_ic"), why(value("spread") <= 0, "spread"),
        why(value("exact_rate") < 0.75, "exact_events"), why(value("synthetic_rate", 1.0) > 0.20, "synthetic_events"),
    )))
    strict = F.array_compact(F.array(
        why(value("windows") < 24, "windows_24"), why(value("rank_ic") < 0.15, "rank_ic_15"), why(value("strict_rank_ic") < 0.05, "strict_rank_ic"), why(value("spread") < 0.10, "spread_10"),
        why(value("rank_ic_low", -1.0) <= 0, "rank_ic_low"), why(value("spread_low", -1.0) <= 0, "spread_low"),
    ))
    rows = audits.select("*", F.inline(F.array(F.struct(paper.alias("_paper"), strict.alias("_strict")))))
    decision = F.when(F.size("_paper") > 0, "do_not_promote").when(F.size("_strict") > 0, "paper_trade_ready").otherwise("promote")
    return rows.select(*audits.columns, decision.alias("decision"), F.when(F.size("_paper") > 0, F.col("_paper")).otherwise(F.col("_strict")).alias("blockers"))


def catalyst_idea_score(exact: Column, setup: Column, bucket: Column, success: Column, confidence: Column, expected: Column, weight: Column, importance: Column, days: Column) -> Column:
    """Score of an upcoming event as an idea; null where neither its setup nor its bucket is one of a catalyst."""
    named = F.when(setup == "hard_catalyst", 1.25).when(setup == "soft_catalyst", 0.5)
    fits = F.coalesce(named.isNotNull() | bucket.isin("clinical", "regulatory", "strategic"), F.lit(False))
    score = (
        F.when(exact, 2.5).otherwise(0.0) + F.coalesce(named, F.lit(0.0)) + F.when(bucket == "strategic", 0.75).otherwise(0.0) + 0.80 * success + 0.55 * confidence + 0.35 * expected + 0.12 * weight + 0.05 * importance
        - 0.01 * F.greatest(days, F.lit(0))
    )
    return F.when(fits, score)


def qualifies(rows: DataFrame) -> Column:
    """Whether a row of ``execution_profiles`` is a top idea, long or short."""
    large, sure = F.col("target_weight") >= 1.0, F.col("confidence") >= 0.55
    long = (F.col("stance") == "long") & (F.col("expected_return") > 0.05) & ~F.col("scenario").isin("watchlist only", "avoid due to financing")
    short = (F.col("stance") == "short") & (F.col("expected_return") < -0.05) & (F.col("upside") <= -0.10)
    return large & sure & (F.col("special_situation") != "pending_transaction") & (long | short)
