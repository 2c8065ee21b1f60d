"""Event types from text, and the timing flags of events.

All matching is by substring in lower case; the first family with a marker in the text is inferred, and
beats an explicit type only where its priority is higher.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.operators.markers import first_of, marker_bits

# Type, priority, bucket.
EVENT_TYPES = (
    ("pdufa", 6, "regulatory"),
    ("adcom", 5, "regulatory"),
    ("phase3_readout", 5, "clinical"),
    ("strategic_transaction", 4, "strategic"),
    ("phase2_readout", 4, "clinical"),
    ("label_expansion", 4, "strategic"),
    ("regulatory_update", 4, "regulatory"),
    ("portfolio_repositioning", 3, "strategic"),
    ("capital_allocation", 3, "strategic"),
    ("phase1_readout", 3, "clinical"),
    ("clinical_readout", 3, "clinical"),
    ("commercial_update", 2, "commercial"),
    ("earnings", 1, "earnings"),
    ("expected_financing", 0, "financing"),
    ("recent_offering_filing", 0, "financing"),
)

# Inferred type and its markers, in the order they are tried.
MARKERS = (
    ("label_expansion", ("label expansion", "expanded indication", "supplemental nda", "snda", "new indication")),
    (
        "strategic_transaction",
        ("acquisition", "acquire ", "acquires", "acquiring", "merger", "merge ", "merges", "buyout", "takeover", "definitive agreement", "m&a"),
    ),
    (
        "portfolio_repositioning",
        (
            "withdraw", "withdrawal", "withdraws", "discontinue", "discontinued", "discontinuation", "terminated", "termination",
            "divest", "divestiture", "strategic review", "out-license", "outlicense", "reprioritize", "deprioritize",
        ),
    ),
    (
        "capital_allocation",
        ("share repurchase", "buyback", "repurchase", "capital allocation", "deleveraging", "special dividend", "dividend increase"),
    ),
    ("adcom", ("adcom", "advisory committee")),
    ("pdufa", ("pdufa", "target action date", "action date")),
    (
        "regulatory_update",
        (
            "regulatory", "approval", "approved", "fda", "complete response", "crl", "priority review", "accepted for review",
            "acceptance for review", "filing accepted", "refuse to file", "rtf", "nda", "bla",
        ),
    ),
    ("phase3_readout", ("phase 3", "phase iii", "registrational", "pivotal")),
    ("phase2_readout", ("phase 2", "phase ii")),
    ("phase1_readout", ("phase 1", "phase i")),
    ("clinical_readout", ("topline", "top-line", "readout", "clinical data", "interim data")),
    ("commercial_update", ("commercial", "launch", "revenue")),
    ("earnings", ("earnings", "quarter")),
)

# Fixed values.
SYNTHETIC_STATUSES = ("phase_timing_estimate", "calendar_estimate", "estimated_from_revenue", "stale_synthetic")
EXACT_STATUSES = ("exact_sec_filing", "exact_company_calendar", "exact_press_release")
SYNTHETIC_TITLES = ("next milestone", "estimated quarterly update", "quarterly commercial update", "reported commercial update")
EVENT_FAMILIES = ("phase1_readout", "phase2_readout", "phase3_readout", "clinical_readout", "pdufa", "adcom", "label_expansion", "regulatory_update")
CLINICAL_TYPES = ("pdufa", "adcom", "phase3_readout", "phase2_readout", "phase1_readout", "clinical_readout")

PRIORITY = {name: p for name, p, _ in EVENT_TYPES}
BUCKET = {name: b for name, _, b in EVENT_TYPES}


def has_any(text: Column, markers) -> Column:
    """Whether any marker occurs in the text: for one short list, and inside array functions; see ``operators.markers`` for many."""
    return text.rlike("|".join(re.escape(m) for m in markers))


def looked_up(key: Column, pairs, default) -> Column:
    """Value of a small literal table by key."""
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(table[key], F.lit(default))


_LISTS = tuple(m for _, m in MARKERS)


def inferred_type(text: Column) -> Column:
    """Type of the first family whose marker occurs in a lower-case text, else null."""
    return first_of(marker_bits(text, _LISTS), [name for name, _ in MARKERS])


def type_priority(kind: Column) -> Column:
    return F.when(kind.isNull() | (kind == ""), -1).otherwise(looked_up(kind, PRIORITY.items(), 0))


def lower_title(title: Column, details: Column | None = None) -> Column:
    """Title and details as one lower-case text."""
    blank = F.lit("")
    return F.lower(F.concat(F.coalesce(title, blank), F.lit(" "), F.coalesce(details, blank) if details is not None else blank))


def event_type(kind: Column, title: Column, details: Column | None = None) -> Column:
    """The explicit type, if it is a known one, unless the text tells of a type of higher priority."""
    bits = marker_bits(lower_title(title, details), _LISTS)
    plain = F.replace(F.lower(F.trim(kind)), F.lit(" "), F.lit("_"))
    told = F.coalesce(first_of(bits, [PRIORITY[name] for name, _ in MARKERS]), F.lit(-1))
    own = looked_up(plain, PRIORITY.items(), -1)
    return F.when(told > own, first_of(bits, [name for name, _ in MARKERS])).when(own >= 0, plain)


def type_bucket(kind: Column) -> Column:
    return F.when(kind.isNull(), "none").otherwise(looked_up(kind, BUCKET.items(), "other"))


def is_synthetic(status: Column, title: Column) -> Column:
    blank = F.lit("")
    return F.lower(F.coalesce(status, blank)).isin(*SYNTHETIC_STATUSES) | has_any(F.lower(F.coalesce(title, blank)), SYNTHETIC_TITLES)


def is_exact_timing(status: Column, expected: Column, title: Column) -> Column:
    exact = F.lower(F.coalesce(status, F.lit(""))).isin(*EXACT_STATUSES)
    return expected.isNotNull() & (exact | ~is_synthetic(status, title))


#: The values of ``timing_priority`` of what has a date.
DATED_PRIORITIES = (2, 0)


def timing_priority(status: Column, expected: Column, title: Column) -> Column:
    """2 exact, 0 synthetic with a date, -1 without a date."""
    return F.when(is_exact_timing(status, expected, title), 2).when(expected.isNotNull(), 0).otherwise(-1)
