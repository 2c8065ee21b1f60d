"""Registered queries on rules by marker: families, landscapes and markets, curation, outcome sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import oracle as q
from eventlens.adapters import SQL_EVENTS, event_tape, table
from eventlens.functions import landscape as ls
from eventlens.functions.outcomes import outcome_rule
from eventlens.functions.taxonomy import event_type, type_bucket
from eventlens.operators.markers import first_rules
from eventlens.queries import query


@query(
    f"""WITH {SQL_EVENTS} SELECT event_id, title, CASE {' '.join(f"WHEN {q.any_of('lower(title)', m)} THEN '{n}'" for n, m in ls.TEXT_FAMILIES)} END AS family FROM events_all"""
)
def text_families(spark, sf):
    """Event family of every tape title by plain markers."""
    return event_tape(spark, sf).select("event_id", "title", ls.text_family(F.col("title")).alias("family"))


_CATS = [q.any_of("t", (x[0], *x[4])) for x in ls.CATEGORIES]


@query(
    f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
    SELECT doc_id, CASE {' '.join(f"WHEN {q.any_of('t', x[0])} THEN '{x[1]}'" for x in ls.LANDSCAPES)} ELSE '{ls.NO_LANDSCAPE[1]}' END AS label,
      CASE {' '.join(f"WHEN {q.any_of('t', x[0])} THEN {x[2]}" for x in ls.LANDSCAPES)} ELSE {ls.NO_LANDSCAPE[2]} END::DOUBLE AS intensity,
      CASE {' '.join(f"WHEN {q.any_of('t', x[0])} THEN '{' '.join(x[3])}'" for x in ls.LANDSCAPES)} ELSE '' END AS leaders,
      coalesce(greatest({', '.join(f"CASE WHEN contains(t, '{m}') THEN {v}.0 END" for m, v in ls.INDICATION_TAMS)}),
        greatest({', '.join(f'CASE WHEN {c} THEN {x[1]}.0 END' for c, x in zip(_CATS, ls.CATEGORIES))}), {ls.DEFAULT_TAM}.0)::DOUBLE AS market,
      array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{x[0]}' END" for c, x in zip(_CATS, ls.CATEGORIES))}], lambda x: x IS NOT NULL), ',') AS categories,
      round(coalesce(list_avg(list_filter([{', '.join(f'CASE WHEN {c} THEN {x[2]} END' for c, x in zip(_CATS, ls.CATEGORIES))}], lambda x: x IS NOT NULL)::DOUBLE[]), {ls.DEFAULT_PENETRATION}), 9) AS penetration,
      coalesce(greatest({', '.join(f'CASE WHEN {c} THEN {x[3]} END' for c, x in zip(_CATS, ls.CATEGORIES))}), 1.0)::DOUBLE AS multiplier FROM d"""
)
def landscapes(spark, sf):
    """Landscape, addressable market, categories, penetration and multiplier of every document, from one pass over its text."""
    text = F.col("text")
    land = ls.landscape(text)
    return table(spark, sf, "documents").select(
        "doc_id", land["label"].alias("label"), land["competition_intensity"].alias("intensity"), F.array_join(land["leaders"], " ").alias("leaders"), ls.addressable_market(text).alias("market"),
        F.array_join(ls.categories(text), ",").alias("categories"), F.round(ls.penetration(text), 9).alias("penetration"), ls.disease_multiplier(text).alias("multiplier"),
    )


@query(
    """WITH r AS (SELECT item_id % 4 AS k, item_id AS rule_no, list_filter(string_split(lower(text), ' '), lambda x: length(x) >= 9)[1:4] AS markers, item_id % 5 = 0 AS excluded FROM benchmark),
    e AS (SELECT k, rule_no, excluded, unnest(markers) AS m FROM r),
    d AS (SELECT doc_id, doc_id % 4 AS k, lower(coalesce(text, '')) AS t FROM documents),
    h AS (SELECT doc_id, min(rule_no) AS rule_no FROM d JOIN e USING (k) WHERE contains(t, m) GROUP BY 1)
    SELECT doc_id, h.rule_no, excluded FROM d LEFT JOIN h USING (doc_id) LEFT JOIN r ON r.rule_no = h.rule_no"""
)
def curation_rules(spark, sf):
    """The first curation rule of each document's key whose markers its text holds; rules are the benchmark's long words."""
    words = F.filter(F.split(F.lower("text"), " ", -1), lambda x: F.length(x) >= 9)
    rules = table(spark, sf, "benchmark").select((F.col("item_id") % 4).alias("k"), F.col("item_id").alias("rule_no"), F.slice(words, 1, 4).alias("markers"), (F.col("item_id") % 5 == 0).alias("excluded"))
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 4).alias("k"), "text")
    return first_rules(docs, "k", "text", rules).select("doc_id", "rule.rule_no", "rule.excluded")


@query(
    f"""WITH {SQL_EVENTS}, f AS (SELECT *, {q.family('event_type', 'title')} AS fam FROM events_all), o AS (SELECT *, {q.bucket('fam')} AS b, {q.outcome('fam', q.bucket('fam'), 'title', 'status')} AS label FROM f)
    SELECT event_id, label, CASE WHEN label IS NULL THEN NULL WHEN {q.any_of("lower(title || ' ' || status)", q.o.SAFETY_BAD)} THEN 'safety_text' WHEN b = 'clinical' THEN 'clinical_text' WHEN fam = 'adcom' THEN 'panel_text'
      WHEN {q.any_of("lower(title || ' ' || status)", (*q.o.DECISION_BAD, *q.o.DECISION_GOOD))} THEN 'regulatory_text' ELSE 'regulatory_progress' END AS source FROM o"""
)
def outcome_sources(spark, sf):
    """Outcome of every tape event and the rule that told it."""
    rows = event_tape(spark, sf).withColumn("family", event_type(F.col("event_type"), F.col("title")))
    rows = rows.withColumn("told", outcome_rule(F.col("family"), type_bucket(F.col("family")), F.col("title"), F.col("status")))
    return rows.select("event_id", "told.label", "told.source")
