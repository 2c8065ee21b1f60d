"""Success or failure of an event from its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.operators.markers import has_bit, marker_bits

# Phrase lists.
CLINICAL_GOOD = (
    "positive topline", "positive top-line", "met the primary endpoint", "met primary endpoint", "met its primary endpoint",
    "achieved the primary endpoint", "achieved primary endpoint", "achieved its primary endpoint",
    "statistically significant improvement in the primary endpoint", "statistically significant improvement on the primary endpoint",
)
CLINICAL_BAD = (
    "missed the primary endpoint", "did not meet the primary endpoint", "did not meet its primary endpoint",
    "failed to meet the primary endpoint", "failed to meet its primary endpoint", "failed one of two primary endpoints",
    "missed one of two primary endpoints", "missed a co-primary endpoint", "failed a co-primary endpoint",
    "did not meet the co-primary endpoint", "not statistically significant on the primary endpoint",
)
SAFETY_BAD = (
    "clinical hold", "dose limiting toxicity", "dose-limiting toxicity", "serious adverse event", "serious adverse events", "safety signal",
    "safety concern", "treatment-related death", "treatment related death", "fatal adverse event", "fatal adverse events", "hepatotoxicity",
)
DECISION_GOOD = (
    "received fda approval", "fda approved", "approved by the fda", "granted approval", "approval granted", "marketing authorization granted",
)
DECISION_BAD = ("complete response", "complete response letter", "crl", "refuse to file", "rtf letter", "not approve", "rejected")
PROGRESS_GOOD = (
    "accepted for review", "filing accepted", "acceptance for review", "priority review", "breakthrough therapy designation", "fast track designation",
)
PANEL_GOOD = (
    "advisory committee voted in favor", "advisory committee recommends approval", "panel voted in favor", "votes in favor", "voted in favor",
)
PANEL_BAD = (
    "advisory committee voted against", "advisory committee recommends against approval", "panel voted against", "votes against", "voted against",
)
MIXED = ("business update", "corporate progress", "operational highlights", "quarterly results", "financial results")


#: The lists that one pass over an event's text looks for.
_LISTS = (SAFETY_BAD, CLINICAL_BAD, CLINICAL_GOOD, PANEL_BAD, PANEL_GOOD, DECISION_BAD, DECISION_GOOD, PROGRESS_GOOD, MIXED)
_SAFETY, _CLINICAL, _PANEL, _DECISION, _PROGRESS, _MIXED = 0, 1, 3, 5, 7, 8


def outcome_rule(kind: Column, bucket: Column, title: Column, status: Column, details: Column | None = None) -> Column:
    """Struct (label, source) of an event from its text; ``kind`` and ``bucket`` are the normalised type and its bucket.

    label: 1 success, 0 failure, null unknown. source: which rule told, null where none did.
    """
    blank = F.lit("")
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, blank) for c in (title, status, details if details is not None else blank)]))
    bits = marker_bits(text, _LISTS)
    told = lambda label, source: F.struct(F.lit(label).alias("label"), F.lit(source).alias("source"))
    pair = lambda at, source: F.when(has_bit(bits, at), told(0, source)).when(has_bit(bits, at + 1), told(1, source))
    decision = pair(_DECISION, "regulatory_text").when((kind == "regulatory_update") & has_bit(bits, _PROGRESS), told(1, "regulatory_progress"))
    decisive = bits.bitwiseAND(F.lit((1 << _MIXED) - 1)) != 0
    return (
        F.when(~bucket.isin("clinical", "regulatory"), None)
        .when(has_bit(bits, _MIXED) & ~decisive, None)
        .when(has_bit(bits, _SAFETY), told(0, "safety_text"))
        .when(bucket == "clinical", pair(_CLINICAL, "clinical_text"))
        .when(kind == "adcom", pair(_PANEL, "panel_text"))
        .otherwise(decision)
    )


def outcome(kind: Column, bucket: Column, title: Column, status: Column, details: Column | None = None) -> Column:
    """1 success, 0 failure, null unknown."""
    return outcome_rule(kind, bucket, title, status, details)["label"]
