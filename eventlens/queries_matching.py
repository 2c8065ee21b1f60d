"""Registered queries on matches by shared words."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import oracle as q
from eventlens.adapters import SQL_CATALYSTS, dated_events, table
from eventlens.functions.numeric import whole_days
from eventlens.plans import matching
from eventlens.queries import query

_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+')), lambda t: length(t) >= 3)"
_STALE = "list_filter(list_distinct(list_transform(regexp_split_to_array(lower(coalesce({}, '')), '\\s+'), lambda w: trim(w, '(),.-'))), lambda w: length(w) >= 4)"


@query(
    f"""WITH p AS (SELECT p_size % 5 AS company, p_partkey AS program_id, {_WORDS.format('p_name')} AS names, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key, {_WORDS.format('p_type')} AS conds, p_brand AS phase FROM part),
    i AS (SELECT p_size % 5 AS company, p_partkey AS idea_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 1 END AS entity_id,
      CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN upper(replace(p_name, ' ', '-')) WHEN 2 THEN 'new ' || split_part(p_name, ' ', 2) || ' mk2' ELSE split_part(p_name, ' ', 1) || ' unit' END AS nm, p_type AS ind, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS phase FROM part),
    t AS (SELECT *, {_WORDS.format('nm')} AS names, {_WORDS.format('ind')} AS conds FROM i),
    one AS (SELECT idea_id, program_id FROM t JOIN p ON t.company = p.company AND t.entity_id = p.program_id WHERE nm = '' OR list_has_any(t.names, p.names) OR t.phase = p.phase),
    two AS (SELECT idea_id, min(program_id) AS program_id FROM t JOIN p ON t.company = p.company AND regexp_replace(lower(nm), '[^a-z0-9]+', '', 'g') = p.key AND key <> '' WHERE idea_id NOT IN (SELECT idea_id FROM one) GROUP BY 1),
    three AS (SELECT idea_id, program_id FROM (SELECT *, row_number() OVER (PARTITION BY idea_id ORDER BY score DESC, program_id) AS rn FROM (SELECT idea_id, program_id, n, same, 3.0 * n + 2.0 * c + 1.5 * same AS score
      FROM (SELECT idea_id, program_id, len(list_intersect(t.names, p.names)) AS n, len(list_intersect(t.conds, p.conds)) AS c, CASE WHEN t.phase = p.phase THEN 1 ELSE 0 END AS same FROM t JOIN p ON t.company = p.company
        WHERE idea_id NOT IN (SELECT idea_id FROM one) AND idea_id NOT IN (SELECT idea_id FROM two))) WHERE (n > 0 OR same > 0) AND score >= 2.0) WHERE rn = 1),
    m AS (SELECT *, 1 AS tier FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three)
    SELECT idea_id, program_id AS matched, tier FROM i LEFT JOIN m USING (idea_id)"""
)
def idea_matches(spark, sf):
    """Parts under changed names matched with the parts of their group: by id, by exact name, by the best score of shared words."""
    part = table(spark, sf, "part")
    programs = part.select((F.col("p_size") % 5).alias("company"), F.col("p_partkey").alias("program_id"), F.col("p_name").alias("name"), F.col("p_type").alias("conditions"), F.col("p_brand").alias("phase"))
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    kind = F.col("p_partkey") % 4
    name = F.when(kind == 0, "").when(kind == 1, F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))).when(kind == 2, F.concat(F.lit("new "), word(2), F.lit(" mk2"))).otherwise(F.concat(word(1), F.lit(" unit")))
    ideas = part.select(
        (F.col("p_size") % 5).alias("company"), F.col("p_partkey").alias("idea_id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") + 1).alias("entity_id"), name.alias("program_name"), F.col("p_type").alias("indication"),
        F.when(F.col("p_partkey") % 7 > 0, F.col("p_brand")).alias("phase"),
    )
    return matching.matched_ideas(ideas, programs, "company").select("idea_id", "matched", "tier")


@query(
    f"""WITH {SQL_CATALYSTS}, e AS (SELECT symbol, event_id, as_of, title, status, greatest(date_diff('day', as_of, expected_date), 0) AS horizon FROM catalysts),
    ft AS (SELECT DISTINCT title AS told FROM events_all WHERE {q.any_of('lower(title)', matching.READOUT_KEYWORDS)}),
    ok AS (SELECT DISTINCT e.title, told FROM (SELECT DISTINCT title FROM e) e, ft WHERE len(list_filter({_STALE.format('e.title')}, lambda w: contains(lower(told), w))) > 0),
    f AS (SELECT DISTINCT symbol, happened, title AS told FROM events_all JOIN ft ON told = title),
    h AS (SELECT DISTINCT event_id FROM e JOIN ok USING (title) JOIN f ON f.symbol = e.symbol AND f.told = ok.told AND happened <= as_of AND happened >= as_of - INTERVAL 180 DAY
      WHERE status NOT IN ('exact_sec_filing', 'exact_company_calendar', 'exact_press_release') AND horizon > 30)
    SELECT event_id, h.event_id IS NOT NULL AS stale, CASE WHEN h.event_id IS NOT NULL THEN 'stale_synthetic' ELSE status END AS status, CASE WHEN h.event_id IS NOT NULL THEN 365 ELSE horizon END AS horizon_days FROM e LEFT JOIN h USING (event_id)"""
)
def stale_flags(spark, sf):
    """Upcoming events whose words stand in a readout filing of the last 180 days."""
    day = lambda c: F.to_timestamp(c).alias("_at")
    event = F.struct(F.lit(True).alias("_event"), day("as_of"), "event_id", "title", "status", whole_days(F.col("expected_date"), F.col("as_of")).alias("horizon_days"), F.lit(None).cast("string").alias("_text"))
    filing = F.struct(F.lit(False).alias("_event"), day("at"), *[F.lit(None).cast("string").alias(c) for c in ("event_id", "title", "status")], F.lit(None).cast("int").alias("horizon_days"), F.col("title").alias("_text"))
    # every line is a filing, and where it was announced before its quarter an event too
    rows = dated_events(spark, sf).select(F.col("symbol").alias("company"), F.inline(F.array_compact(F.array(filing, F.when(F.col("expected_date").isNotNull(), event)))))
    return matching.judged_stale(rows.withColumn("names", F.lit("")), ["event_id", "status", "horizon_days"]).select("event_id", "stale", "status", "horizon_days")
