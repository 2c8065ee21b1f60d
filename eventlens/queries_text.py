"""Registered queries on filings and program texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import oracle as q
from eventlens.adapters import SQL_EVENTS, SQL_SNAPSHOTS, event_tape, snapshots, table
from eventlens.functions import filings as fl
from eventlens.queries import query

_FORMS = ("8-K", "10-Q", "S-3", "6-K", "S-1", "DEF 14A", "10-K")
_TEXT = "lower(title)"
_FOUND = q.inferred(_TEXT)
_CASCADE = [(f"form IN {fl.FINANCING_FORMS} OR {q.any_of(_TEXT, fl.OFFERING)}", ("recent_offering_filing", 0.55, 0.20))]
_CASCADE += [(q.any_of(_TEXT, markers), (name, i, c)) for name, i, c, markers in fl.FILING_CASCADE]
_CASCADE += [(f"form IN {fl.EARNINGS_FORMS} OR {q.any_of(_TEXT, fl.RESULTS)}", ("earnings", 0.55, 0.35))]


def _filing(k: int, last: str) -> str:
    value = lambda x: f"'{x}'" if isinstance(x, str) else repr(x)
    return f"CASE WHEN form NOT IN {fl.EVENT_FORMS} THEN NULL " + " ".join(f"WHEN {test} THEN {value(v[k])}" for test, v in _CASCADE) + f" ELSE {last} END"


_OPEN = f"coalesce(({_FOUND}), CASE WHEN form IN ('8-K', '6-K') THEN 'commercial_update' END)"
_KNOWN = f"(form IN ('8-K', '6-K') OR {_OPEN} IN {tuple(n for n, *_ in fl.INFERRED)})"


@query(
    f"""WITH {SQL_EVENTS}, f AS (SELECT ([{', '.join(f"'{x}'" for x in _FORMS)}])[symbol % {len(_FORMS)} + 1] AS form, title FROM events_all)
    SELECT form, {_filing(0, f"CASE WHEN {_KNOWN} THEN {_OPEN} END")} AS event_type,
      {_filing(1, f"CASE WHEN {_KNOWN} THEN {q.lookup(_OPEN, [(n, i) for n, i, _ in fl.INFERRED], 0.45)} END")}::DOUBLE AS importance,
      {_filing(2, f"CASE WHEN {_KNOWN} THEN {q.lookup(_OPEN, [(n, c) for n, _, c in fl.INFERRED], 0.35)} END")}::DOUBLE AS crowdedness, count(*) AS n
    FROM f GROUP BY ALL"""
)
def filing_events(spark, sf):
    """Filings classified by form and text."""
    form = F.element_at(F.array(*[F.lit(x) for x in _FORMS]), (F.col("symbol") % len(_FORMS) + 1).cast("int"))
    rows = event_tape(spark, sf).select(form.alias("form"), "title").withColumn("x", fl.filing_event(F.col("form"), F.col("title")))
    return rows.groupBy("form", "x.event_type", "x.importance", "x.crowdedness").agg(F.count("*").alias("n"))


_MODALITY = "CASE " + " ".join(f"WHEN {q.any_of('lower(text)', m)} THEN '{name}'" for name, m in fl.MODALITIES) + " ELSE 'platform' END"


@query(f"SELECT doc_id, {_MODALITY} AS modality FROM documents")
def modality(spark, sf):
    """Modality of every text by ordered keywords."""
    return table(spark, sf, "documents").select("doc_id", fl.modality(F.col("text")).alias("modality"))


@query(
    f"""WITH {SQL_SNAPSHOTS}, b AS (SELECT *, 18000000 + products * 8000000 AS gross FROM snapshots),
    c AS (SELECT *, gross - least(greatest(revenue * 0.04, 0.0), gross * 0.55) AS burn, CASE WHEN revenue > 500000000 THEN 120000000 WHEN revenue > 100000000 THEN 75000000 WHEN revenue > 25000000 THEN 40000000 ELSE 15000000 END AS lowest FROM b)
    SELECT symbol, as_of, round(CASE WHEN cash - debt <= 0 THEN 0.0 ELSE least((cash - debt) / greatest(burn, lowest) * 12.0, 120.0) END, 6) AS months FROM c"""
)
def runway(spark, sf):
    """Months of cash of every snapshot."""
    return snapshots(spark, sf).select("symbol", "as_of", F.round(fl.runway_months(F.col("revenue"), F.col("cash"), F.col("debt"), F.col("products")), 6).alias("months"))
