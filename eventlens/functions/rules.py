"""Rule scores over feature columns, blends and composite metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.numeric import sigmoid, value
from eventlens.operators.rankstats import average_rank, correlation

# Weight and default of each feature in the expected return and in the success probability.
RETURN_TERMS = (
    ("program_quality_pos_prior", 0.18, 0.15), ("program_quality_phase_score", 0.12, 0.20), ("program_quality_endpoint_score", 0.10, 0.25), ("program_quality_tam_to_cap", 0.08, 0.0),
    ("catalyst_timing_expected_value", 0.15, 0.10), ("catalyst_timing_event_phase3_readout", 0.06, 0.0), ("catalyst_timing_event_phase2_readout", 0.04, 0.0), ("catalyst_timing_event_pdufa", 0.05, 0.0),
    ("commercial_execution_revenue_to_cap", 0.04, -1.0), ("balance_sheet_cash_to_cap", 0.07, 0.0), ("market_flow_momentum_3mo", 0.03, 0.0), ("program_quality_modality_risk", -0.09, 0.50),
    ("catalyst_timing_crowdedness", -0.08, 0.30), ("balance_sheet_financing_pressure", -0.07, 0.0), ("market_flow_volatility", -0.04, 0.0), ("catalyst_timing_company_event_earnings", -0.05, 0.0),
)
SUCCESS_TERMS = (
    ("program_quality_pos_prior", 1.4, 0.15), ("program_quality_phase_score", 0.7, 0.20), ("program_quality_endpoint_score", 0.4, 0.25), ("catalyst_timing_probability", 0.4, 0.35),
    ("catalyst_timing_clinical_focus", 0.5, 0.0), ("catalyst_timing_event_pdufa", 0.2, 0.0), ("catalyst_timing_event_phase3_readout", 0.2, 0.0), ("program_quality_modality_risk", -0.6, 0.50),
    ("catalyst_timing_company_event_earnings", -0.3, 0.0),
)


def rule_scores(rows: DataFrame) -> DataFrame:
    """``rows`` with rule_return and rule_success from whatever feature columns they have; others count by their defaults."""
    have = set(rows.columns)
    get = lambda name, default, other=None: value(name, default) if name in have else get(other, default) if other else F.lit(float(default))
    state = lambda name, default=0.0, other=None: get(f"state_profile_{name}", default, other)
    early, launch, mature = state("pre_commercial"), state("commercial_launch"), state("commercialized")
    rivals, hard = state("competition_intensity", 0.55), state("hard_catalyst_presence")
    progress = state("launch_progress_pct", 0.0, "commercial_execution_launch_progress_pct")
    lifecycle = state("lifecycle_management_score", 0.0, "commercial_execution_lifecycle_management_score")
    optional = state("pipeline_optionality_score")
    deployed = state("capital_deployment_score", 0.0, "balance_sheet_capital_deployment_score")
    linear = lambda terms: sum((w * get(n, d) for n, w, d in terms), F.lit(0.0))
    crossed = (
        0.08 * early * state("precommercial_value_gap") + 0.06 * launch * progress + 0.06 * launch * lifecycle + 0.05 * mature * optional + 0.05 * mature * deployed
        + 0.04 * state("floor_support_pct") + 0.03 * hard - 0.08 * early * rivals * (1 - hard) - 0.03 * rivals
    )
    priced = get("catalyst_timing_iv_implied_move", 0.0)
    logit = linear(SUCCESS_TERMS) + 0.15 * hard + 0.08 * launch * progress + 0.06 * mature * optional - 0.25 * early * rivals * (1 - hard)
    rows = rows.withColumn("rule_return", linear(RETURN_TERMS) + crossed)
    # a move that the options market prices above the expected one is discounted by a quarter of the excess
    excess = F.when(priced > 0, F.greatest(priced - F.abs("rule_return"), F.lit(0.0))).otherwise(0.0)
    return rows.withColumns({"rule_return": F.col("rule_return") - 0.25 * excess, "rule_success": sigmoid(logit)})


def blended(rule: Column, model: Column, share: float = 0.6) -> Column:
    """Rule and model score together; the rule alone where there is no model score."""
    return F.coalesce((1 - share) * rule + share * model, rule)


def composite_metric(rows: DataFrame, by: list[str], predicted: str, actual: str) -> DataFrame:
    """Per key: rank correlation, share of right directions, mean absolute error and the valuation error of all three (99 below 3 rows)."""
    used = rows.where(f"{predicted} is not null and {actual} is not null").withColumns({"_x": average_rank(predicted, by), "_y": average_rank(actual, by)})
    n = F.count("*")
    out = used.groupBy(*by).agg(
        n.alias("scored"), correlation("_x", "_y").alias("rank_correlation"), F.avg((F.signum(predicted) == F.signum(actual)).cast("double")).alias("direction"), F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("mae")
    )
    whole = 0.50 * (F.col("rank_correlation") + 1) / 2 + 0.30 * F.col("direction") + 0.20 * F.greatest(1 - F.col("mae"), F.lit(0.0))
    return out.withColumn("valuation_error", F.when(F.col("scored") >= 3, 1 - whole).otherwise(99.0))
