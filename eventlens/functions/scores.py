"""Event scores from family priors, source, state and context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.functions.numeric import clamp
from eventlens.functions.taxonomy import CLINICAL_TYPES, looked_up

# Fixed values.
SOURCE_PRIORITY = (
    ("company_calendar", 5), ("sec", 5), ("biopharmcatalyst", 4), ("eodhd_news", 3), ("eodhd_earnings", 3),
    ("estimated_calendar", 2), ("internal_inference", 1),
)
SOURCE_BONUS = (("company_calendar", 0.15), ("sec", 0.14), ("biopharmcatalyst", 0.12), ("eodhd_news", 0.09), ("eodhd_earnings", 0.05))
FAMILY_PRIOR = (
    ("pdufa", 0.72), ("phase3_readout", 0.67), ("phase2_readout", 0.56), ("phase1_readout", 0.48), ("clinical_readout", 0.52),
    ("adcom", 0.61), ("label_expansion", 0.63), ("regulatory_update", 0.59),
)
SCHEDULE_SOURCES = ("company_calendar", "sec", "biopharmcatalyst", "eodhd_news", "eodhd_earnings")


def event_scores(family: Column, state: Column, floor: Column, risk: Column, crowd: Column, days: Column, source: Column, strict: Column, corroborated: Column) -> dict[str, Column]:
    """pre_event_score, confidence_proxy and success_probability_proxy."""
    prior = looked_up(family, FAMILY_PRIOR, 0.50)
    near = 1 - F.least(F.abs(days.cast("double") - 35.0) / 55.0, F.lit(1.0))
    by_state = (
        F.when((state == "commercialized") & family.isin("pdufa", "label_expansion", "regulatory_update"), 0.05)
        .when((state == "pre_commercial") & family.isin(*CLINICAL_TYPES), 0.04)
        .when(state == "commercial_launch", 0.03)
        .otherwise(0.0)
    )
    pick = lambda flag, yes, no: F.when(flag, yes).otherwise(no)
    score = (
        prior + looked_up(source, SOURCE_BONUS, 0.02) + pick(strict, 0.08, -0.06) + pick(corroborated, 0.06, 0.0) + 0.10 * near + by_state
        + 0.10 * clamp(floor, 0.0, 0.50) - 0.18 * clamp(risk, 0.0, 1.0) - 0.08 * clamp(crowd, 0.0, 1.0)
    )
    confidence = 0.38 + 0.25 * prior + pick(strict, 0.12, -0.08) + pick(corroborated, 0.08, 0.0) + 0.06 * near - 0.12 * risk - 0.06 * crowd
    success = prior + pick(strict, 0.08, -0.05) + pick(corroborated, 0.05, 0.0) - 0.10 * risk - 0.05 * crowd
    return {
        "pre_event_score": clamp(score, -1.0, 1.5),
        "confidence_proxy": clamp(confidence, 0.0, 1.0),
        "success_probability_proxy": clamp(success, 0.0, 1.0),
    }


def source_label(source: Column) -> Column:
    return (
        F.when(source.isin("company_calendar", "sec"), "company_exact")
        .when(source == "biopharmcatalyst", "biopharmcatalyst_exact")
        .when(source.isin("eodhd_news", "eodhd_earnings"), "news_exact")
        .when(source == "estimated_calendar", "estimated_calendar")
        .otherwise("synthetic")
    )
