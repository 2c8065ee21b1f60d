"""Registered queries on registry studies and the programs, events and financing needs that follow from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from eventlens import oracle as q
from eventlens.adapters import SQL_SNAPSHOTS, snapshots, table
from eventlens.functions import filings as fl
from eventlens.functions import landscape as ls
from eventlens.functions import program as pg
from eventlens.functions import trials as tr
from eventlens.operators.asof import latest
from eventlens.plans import graph
from eventlens.queries import query
from eventlens.sources import registry

CONDITIONS = ("sickle cell disease", "lymphoma", "obesity", "rare ataxia", "type 2 diabetes", "psoriasis")
OUTCOMES = ("Overall survival", "Objective response rate", "Safety and tolerability", "FEV1 change", "Feasibility survey")
STATUSES = ("RECRUITING", "COMPLETED", "TERMINATED", "Active not recruiting", "Odd", "")
PHASES = ((), ("PHASE1",), ("PHASE1", "PHASE2"), ("PHASE3",), ("PHASE4",), ("EARLY_PHASE1",))
PLACES = ((("Mayo Clinic", "Rochester", "MN", "United States"), ("University Hospital", "Oslo", None, "Norway")), (("Community Center", "Lyon", None, "France"),), (), (("Stanford", "Palo Alto", "CA", None), ("Clinic", "Austin", "TX", None), ("Charité", "Berlin", None, "Germany")))


def _documents(spark, sf):
    """A JSON study document per line item: drug names from the part, codes from its key, the rest from keys and priorities."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_size")
    rows = table(spark, sf, "lineitem").join(part, "l_partkey").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    pick = lambda i, values: reduce(lambda chain, n: chain.when(i % len(values) == n, values[n]), range(1, len(values)), F.when(i % len(values) == 0, values[0]))  # noqa: E731  only the one picked is built
    names = lambda *xs: F.array(*[F.struct(x.alias("name")) for x in xs])
    name, key, line = F.col("p_name"), F.col("l_partkey"), F.col("l_linenumber")
    code = F.concat(F.upper(F.substring("p_name", 1, 3)), F.lit("-"), (key % 40).cast("string"))
    title = pick(key, [F.concat(F.lit("Pivotal study of "), name), F.lit("Natural history registry"), F.concat(F.lit("Extension study of "), code), F.concat(name, F.lit(" follow-up")), F.concat(F.lit("Trial of "), code), F.lit("")])
    drugs = pick(line, [names(F.concat(F.lit("Placebo for  "), name)), names(F.lit("placebo"), name), names(F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit("-"), (key % 10).cast("string"), F.lit("A 10 mg")), F.lit("Standard of care")), names(F.lit("Placebo"), F.lit(" "))])
    place = lambda p: F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("facility", "city", "state", "country"), p)])
    none = F.array().cast("array<struct<facility: string, city: string, state: string, country: string>>")
    places = pick(F.col("l_orderkey"), [F.array(*[place(p) for p in ps]) if ps else none for ps in PLACES])
    outcome = pick(F.substring("o_orderpriority", 1, 1).cast("int"), [F.lit(o) for o in OUTCOMES])
    section = F.struct(
        F.struct(F.concat_ws("-", F.lit("NCT"), "l_orderkey", "l_linenumber", "l_partkey").alias("nctId"), title.alias("briefTitle")).alias("identificationModule"),
        F.struct(pick(F.col("l_orderkey") + line, [F.lit(s) for s in STATUSES]).alias("overallStatus")).alias("statusModule"),
        F.struct(pick(F.col("p_size") + line, [F.array(*[F.lit(x) for x in p]).cast("array<string>") for p in PHASES]).alias("phases"), F.struct((F.col("l_quantity") * 10).cast("bigint").alias("count")).alias("enrollmentInfo")).alias("designModule"),
        F.struct(F.array(F.lower("p_type"), pick(key + F.col("l_suppkey"), [F.lit(c) for c in CONDITIONS])).alias("conditions")).alias("conditionsModule"),
        F.struct(drugs.alias("interventions")).alias("armsInterventionsModule"),
        F.struct(F.array(F.struct(outcome.alias("measure")), F.struct(F.lit("Adverse events").alias("measure"))).alias("primaryOutcomes")).alias("outcomesModule"),
        F.struct(places.alias("locations")).alias("contactsLocationsModule"),
    )
    number = (F.col("l_orderkey") * 8 + line) * 67108864 + key
    return rows.select(F.col("l_suppkey").alias("symbol"), number.alias("trial_no"), F.to_json(F.struct(section.alias("protocolSection"))).alias("text"))


def _rules(spark, sf):
    """Curation rules of a symbol: a drug that is none, one of two names, an indication at a fixed phase."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"))
    rule = lambda no, markers, where, exclude=False, name=None, phase=None, conditions=(): s.where(where).select(
        "symbol", F.lit(no).alias("rule_no"), F.array(*[F.lit(m) for m in markers]).alias("markers"), F.lit(exclude).alias("exclude"), F.lit(name).cast("string").alias("name"), F.lit(phase).cast("string").alias("phase"),
        F.array(*[F.lit(c) for c in conditions]).cast("array<string>").alias("conditions"),
    )
    return rule(1, ["bolt"], "symbol % 4 = 0", exclude=True).unionByName(rule(2, ["Gear", "ring"], "symbol % 2 = 0", name="Rotor")).unionByName(rule(3, ["obesity"], "true", phase="PHASE2", conditions=["obesity"]))


def _companies(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg((F.count("*") % 20).alias("n_trials"))
    rows = latest(snapshots(spark, sf), ["symbol"], [F.desc("as_of")]).join(counts, "symbol", "left")
    return rows.select("symbol", F.to_date("as_of").alias("as_of"), F.col("revenue") / 100, "cash", "debt", "n_trials", F.when(F.col("products") > 0, F.concat(F.lit("Brand "), "symbol")).alias("product"), F.when(F.col("symbol") % 3 == 0, "antibody maker").alias("description")).withColumnRenamed("(revenue / 100)", "revenue")


_LIST = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"
_PLACE = lambda p: "'" + ", ".join(v for v in p if v) + "'"
_CODE = lambda x: f"nullif(regexp_extract(upper({x}), '{tr.ASSET_CODE}', 0), '')"
_GENERIC = f"(lower(v) IN {tr.GENERIC} OR {q.any_of('lower(v)', ('placebo', 'standard of care'))})"
_CODES = lambda xs: f"list_filter(list_transform({xs}, lambda v: {_CODE('v')}), lambda c: c IS NOT NULL)[1]"
_TEXT = lambda *xs: f"lower(trim(regexp_replace(array_to_string(list_filter([{', '.join(xs)}], lambda v: v <> ''), ' '), '\\s+', ' ', 'g')))"
_RULE = lambda text: f"CASE WHEN symbol % 4 = 0 AND contains({text}, 'bolt') THEN 1 WHEN symbol % 2 = 0 AND (contains({text}, 'gear') OR contains({text}, 'ring')) THEN 2 WHEN contains({text}, 'obesity') THEN 3 END"
_STUDIES = f"""st0 AS (SELECT l_suppkey AS symbol, (l_orderkey * 8 + l_linenumber) * 67108864 + l_partkey AS trial_no, concat_ws('-', 'NCT', l_orderkey, l_linenumber, l_partkey) AS trial_id, upper(p_name[1:3]) || '-' || l_partkey % 40 AS code,
    l_partkey, l_linenumber AS line, p_name, {_LIST(STATUSES)}[(l_orderkey + l_linenumber) % 6 + 1] AS status, [{', '.join(_LIST(p) + '::VARCHAR[]' for p in PHASES)}][(p_size + l_linenumber) % 6 + 1] AS phases,
    CAST(l_quantity * 10 AS BIGINT) AS enrollment, [lower(p_type), {_LIST(CONDITIONS)}[(l_partkey + l_suppkey) % 6 + 1]] AS conditions, [{_LIST(OUTCOMES)}[CAST(o_orderpriority[1] AS INTEGER) % 5 + 1], 'Adverse events'] AS outcomes,
    [{', '.join('[' + ', '.join(_PLACE(p) for p in ps) + ']::VARCHAR[]' for ps in PLACES)}][l_orderkey % 4 + 1] AS locations FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
  st AS (SELECT * EXCLUDE (code, p_name, l_partkey, line), ['Pivotal study of ' || p_name, 'Natural history registry', 'Extension study of ' || code, p_name || ' follow-up', 'Trial of ' || code, ''][l_partkey % 6 + 1] AS title,
    CASE line % 4 WHEN 0 THEN [p_name] WHEN 1 THEN ['placebo', p_name] WHEN 2 THEN [upper(split_part(p_name, ' ', 2)) || '-' || l_partkey % 10 || 'A 10 mg', 'Standard of care'] ELSE ['Placebo'] END AS ivs FROM st0),
  named AS (SELECT *, coalesce({_CODES('list_append(ivs, title)')}, list_filter(ivs, lambda v: NOT {_GENERIC} AND length(v) <= 80)[1], nullif(title, ''), '{tr.UNMAPPED}') AS own_name,
    array_to_string(phases, ' ') AS ph FROM st),
  ruled AS (SELECT *, {_RULE(_TEXT('own_name', 'title', "array_to_string(ivs, ' ')", "array_to_string(conditions, ' ')"))} AS rule FROM named),
  cur AS (SELECT * REPLACE (CASE WHEN rule = 3 THEN ['obesity'] ELSE conditions END AS conditions, CASE WHEN status = '' THEN 'UNKNOWN' ELSE status END AS status), CASE WHEN rule = 2 THEN 'Rotor' ELSE own_name END AS program_name,
    CASE WHEN rule = 3 THEN 'PHASE2' WHEN contains(ph, 'PHASE4') THEN 'APPROVED' WHEN contains(ph, 'PHASE3') THEN 'PHASE3' WHEN contains(ph, 'PHASE2') THEN 'PHASE2' ELSE 'PHASE1' END AS phase FROM ruled WHERE rule IS DISTINCT FROM 1),
  full_text AS (SELECT * REPLACE (CASE WHEN title = '' THEN program_name ELSE title END AS title) FROM cur),
  trials AS (SELECT * FROM full_text WHERE NOT ({q.any_of("lower(concat_ws(' ', title, array_to_string(conditions, ' '), array_to_string(ivs, ' '), array_to_string(outcomes, ' ')))", tr.LOW_SIGNAL)} OR (
    len(list_filter(ivs, lambda v: NOT {_GENERIC})) = 0 AND {_CODES("[title, array_to_string(ivs, ' ')]")} IS NULL AND ({q.any_of("lower(array_to_string(outcomes, ' '))", tr.OBSERVED_OUTCOMES)} OR {q.any_of('lower(title)', tr.OBSERVING_TITLES)}))))"""
_BASE = lambda phase, default=0.01: q.lookup(phase, tr.PHASE_BASE, default).replace(" ELSE", "::DOUBLE ELSE") + "::DOUBLE"
_MARKET = (
    "coalesce(greatest(" + ", ".join(f"CASE WHEN contains(ct, '{m}') THEN {float(v)} END" for m, v in ls.INDICATION_TAMS) + "), greatest(" + ", ".join(f"CASE WHEN {q.any_of('ct', (x[0], *x[4]))} THEN {float(x[1])} END" for x in ls.CATEGORIES) + f"), {float(ls.DEFAULT_TAM)})"
)
_LOC = "list_transform(locations, lambda v: lower(v))"
_GRAPH = f"""{SQL_SNAPSHOTS}, {_STUDIES},
  co AS (SELECT symbol, CAST(as_of AS DATE) AS as_of, revenue / 100 AS revenue, cash, debt, (SELECT count(*) FROM lineitem WHERE l_suppkey = s.symbol) % 20 AS n_trials, CASE WHEN products > 0 THEN 'Brand ' || symbol END AS product,
    CASE WHEN symbol % 3 = 0 THEN 'antibody maker' END AS description FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC) AS rn FROM snapshots) s WHERE rn = 1),
  sites AS (SELECT *, greatest(enrollment, 1)::DOUBLE AS w, {_BASE('phase')} AS base, len(locations) AS n_loc, len(list_filter({_LOC}, lambda v: {q.any_of('v', tr.FIRST_TIER)})) AS ones,
    len(list_filter({_LOC}, lambda v: NOT {q.any_of('v', tr.FIRST_TIER)} AND {q.any_of('v', tr.SECOND_TIER)})) AS twos, len(list_filter({_LOC}, lambda v: NOT {q.any_of('v', tr.UNITED_STATES)})) AS abroad,
    CASE {' '.join(f"WHEN {q.any_of('lower(array_to_string(outcomes, chr(32)))', ms)} THEN {s}" for s, ms in tr.ENDPOINT_PRIORITY)} ELSE 0.42 END AS endpoint,
    round({_BASE('phase')} + CASE WHEN contains(lower(title), 'pivotal') THEN 0.08 ELSE 0.0 END + CASE WHEN contains(lower(title), 'extension') OR contains(lower(title), 'follow-up') THEN -0.12 ELSE 0.0 END, 9) AS moved,
    {q.lookup('upper(status)', tr.STATUS_PRIORITY, 0.45)} AS st FROM trials),
  g AS (SELECT symbol, program_name, count(*) AS trials, sum(enrollment) AS enrollment, min(trial_no) AS first, max_by(phase, base) AS phase, list_sort(list_distinct(flatten(list(conditions)))) AS conditions,
    sum(w * least(ones * 2 + twos, 8) / 8.0) / sum(w) AS amc, sum(w * least(n_loc / 10.0, 1.0)) / sum(w) AS n_sites, sum(w * CASE WHEN n_loc > 0 THEN abroad / n_loc ELSE 0.0 END) / sum(w) AS intl FROM sites GROUP BY 1, 2),
  n AS (SELECT *, symbol || ':' || row_number() OVER (PARTITION BY symbol ORDER BY first, program_name) AS program_id FROM g),
  r AS (SELECT *, {_RULE(_TEXT('program_name', "array_to_string(conditions, ' ')"))} AS rule FROM n),
  p0 AS (SELECT * REPLACE (CASE WHEN rule = 3 THEN 'PHASE2' ELSE phase END AS phase, CASE WHEN rule = 3 THEN ['obesity'] ELSE conditions END AS conditions) FROM r WHERE rule IS DISTINCT FROM 1),
  leads AS (SELECT program_id, trial_id AS lead_id, title AS lead_title, array_to_string(ivs, ' ') AS lead_ivs FROM (SELECT program_id, s.*, row_number() OVER (PARTITION BY program_id ORDER BY abs(s.base - {_BASE('p0.phase')}), moved DESC, st DESC, endpoint DESC, s.enrollment DESC, s.trial_no) AS rn
    FROM p0 JOIN sites s ON s.symbol = p0.symbol AND s.program_name = p0.program_name) WHERE rn = 1),
  p1 AS (SELECT *, lower(array_to_string(conditions, chr(10))) AS ct, lower(concat_ws(' ', program_name, array_to_string(conditions, ' '), description)) AS mt, {_RULE(_TEXT('program_name', "array_to_string(conditions, ' ')", 'lead_title', 'lead_ivs'))} AS overlay,
    least(0.99, {_BASE('phase', 0.07)} + least(trials * 0.03::DOUBLE, 0.12::DOUBLE)) AS pos_prior FROM p0 JOIN leads USING (program_id) JOIN co USING (symbol)),
  p2 AS (SELECT *, CAST({_MARKET} AS DOUBLE) AS market, CASE {' '.join(f"WHEN {q.any_of('mt', ms)} THEN '{m}'" for m, ms in fl.MODALITIES)} ELSE 'platform' END AS modality,
    coalesce(CASE WHEN overlay = 1 THEN program_name WHEN overlay = 2 THEN 'Rotor' END, {_CODE('program_name')}, {_CODES('[lead_title, lead_ivs]')}, program_name) AS canonical_name,
    coalesce(overlay = 1, false) OR lower(program_name) IN {(tr.UNMAPPED, *tr.GENERIC)} OR starts_with(lower(program_name), 'study ') OR (regexp_matches(lower(program_name), '{tr.DOSAGE_FORM}') AND {_CODE('program_name')} IS NULL) OR {q.any_of('lower(program_name)', tr.LOW_SIGNAL_PROGRAM)} AS low_signal FROM p1),
  programs AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {_BASE('phase', 0.0)} DESC, market DESC, pos_prior DESC, trials DESC, enrollment DESC, program_name) AS position FROM p2)"""


def _graph(spark, sf):
    return graph.company_graph(_companies(spark, sf), registry.study_rows(_documents(spark, sf), "text"), _rules(spark, sf), "symbol")


@query(f"WITH {_STUDIES} SELECT symbol, trial_id, program_name, title, phase, status, array_to_string(conditions, '|') AS conditions, array_to_string(ivs, '|') AS interventions FROM trials")
def registry_trials(spark, sf):
    """Studies of registry documents under their program names; curated, without those that tell nothing of a drug."""
    studies = registry.study_rows(_documents(spark, sf), "text", ["trial_id", "title", "status", "phases", "conditions", "interventions", "outcomes"])
    rows = graph.graph_trials(studies, _rules(spark, sf), "symbol")
    return rows.select("symbol", "trial_id", "program_name", "title", "phase", "status", F.array_join("conditions", "|").alias("conditions"), F.array_join("interventions", "|").alias("interventions"))


@query(
    f"""WITH {_GRAPH} SELECT symbol, program_id, program_name, canonical_name, low_signal, position, phase, array_to_string(conditions, '|') AS conditions, modality, round(pos_prior, 6) AS pos_prior, market, trials, CAST(enrollment AS BIGINT) AS enrollment,
    lead_id, round(amc + 1e-9, 6) AS amc_site_score, round(n_sites + 1e-9, 6) AS site_count_score, round(intl + 1e-9, 6) AS international_score FROM programs"""
)
def program_graph(spark, sf):
    """Programs of the companies: phase, prior, market, lead study, site scores (shifted by 1e-9, so that halves round up whatever the order of the sums), order."""
    rows = _graph(spark, sf)["programs"]
    return rows.select(
        "symbol", "program_id", "program_name", "canonical_name", "low_signal", "position", "phase", F.array_join("conditions", "|").alias("conditions"), "modality", F.round("pos_prior", 6).alias("pos_prior"), "market", "trials", "enrollment",
        F.col("lead.trial_id").alias("lead_id"), *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("amc_site_score", "site_count_score", "international_score")],
    )


@query(
    f"""WITH {_GRAPH}, e AS (SELECT symbol, as_of, program_id, {q.lookup('phase', graph.EVENTS, 'clinical_readout')} AS event_type, program_name || ' ' || {q.lookup('phase', graph.LABELS, 'clinical update')} || CASE WHEN len(conditions) > 0 THEN ' in ' || conditions[1] ELSE '' END AS title,
      {q.lookup('phase', graph.HORIZONS, 180)} AS horizon_days, 0.45::DOUBLE + least(pos_prior * 0.4::DOUBLE, 0.35::DOUBLE) AS probability, 0.55::DOUBLE + least(market / 10000000000, 0.35::DOUBLE) AS importance, CASE WHEN modality = 'gene editing' THEN 0.2 ELSE 0.35 END::DOUBLE AS crowdedness, 'phase_timing_estimate' AS status FROM programs
    UNION ALL SELECT symbol, as_of, NULL, 'commercial_update', coalesce(product, CAST(symbol AS VARCHAR)) || ' estimated commercial update', 45, 0.78, 0.60, 0.45, 'estimated_from_revenue' FROM co WHERE revenue > 10000000)
    SELECT symbol, coalesce(program_id, 'company') || ':' || event_type || ':' || horizon_days AS event_id, event_type, title, CAST(as_of + horizon_days AS DATE) AS expected_date, round(probability, 6) AS probability, round(importance, 6) AS importance, crowdedness, status FROM e"""
)
def graph_catalysts(spark, sf):
    """Events that the programs' phases and the companies' sales let expect."""
    rows = _graph(spark, sf)["catalysts"]
    return rows.select("symbol", "event_id", "event_type", "title", "expected_date", F.round("probability", 6).alias("probability"), F.round("importance", 6).alias("importance"), "crowdedness", "status")


@query(
    f"""WITH {SQL_SNAPSHOTS}, co AS (SELECT symbol, revenue / 100 AS revenue, cash, debt, (SELECT count(*) FROM lineitem WHERE l_suppkey = s.symbol) % 20 AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC) AS rn FROM snapshots) s WHERE rn = 1),
    b AS (SELECT *, 18000000 + n * 8000000 AS gross FROM co), m AS (SELECT symbol, CASE WHEN cash - debt <= 0 THEN 0.0::DOUBLE ELSE least((cash - debt) / greatest(gross - least(greatest(revenue * 0.04, 0.0), gross * 0.55::DOUBLE),
      CASE WHEN revenue > 500000000 THEN 120000000 WHEN revenue > 100000000 THEN 75000000 WHEN revenue > 25000000 THEN 40000000 ELSE 15000000 END) * 12.0, 120.0) END AS months FROM b)
    SELECT symbol, symbol || ':financing' AS event_id, CASE WHEN months < 12 THEN 0.8 ELSE 0.45 END::DOUBLE AS probability, CASE WHEN months < 12 THEN 90 ELSE 180 END AS horizon_days, CASE WHEN months < 12 THEN 0.18 ELSE 0.08 END::DOUBLE AS expected_dilution_pct, round(months, 6) AS runway_months FROM m WHERE months < 18"""
)
def graph_financing(spark, sf):
    """Companies that have to raise money soon."""
    return graph.financing_needs(_companies(spark, sf), "symbol").select("symbol", "event_id", "probability", "horizon_days", "expected_dilution_pct", F.round("runway_months", 6).alias("runway_months"))


_ON = f"upper(replace(status, ' ', '_')) IN {('', *tr.ACTIVE_STATUSES)}"
_PH = "CASE WHEN contains(ph, 'PHASE4') THEN 'APPROVED' WHEN contains(ph, 'PHASE3') THEN 'PHASE3' WHEN contains(ph, 'PHASE2') THEN 'PHASE2' ELSE 'PHASE1' END"


@query(
    f"""WITH {_STUDIES}, x AS (SELECT *, {_ON} AS active, {_PH} AS p FROM named)
    SELECT symbol, count(*) FILTER (WHERE active) AS n_trials, count(*) AS n_total, count(*) FILTER (WHERE NOT active) AS n_inactive, CAST(coalesce(sum(enrollment) FILTER (WHERE active), 0) AS BIGINT) AS total_enrollment, coalesce(max(enrollment) FILTER (WHERE active), 0) AS max_enrollment,
      CAST(coalesce(sum(enrollment) FILTER (WHERE active AND p = 'PHASE3'), 0) AS BIGINT) AS phase3_enrollment, count(*) FILTER (WHERE active AND p = 'PHASE1') AS phase1_trials, coalesce(max_by(p, {q.lookup('p', pg.PHASE_RANK, 0)}) FILTER (WHERE active), 'PHASE1') AS best_phase,
      len(list_distinct(list_filter(list_transform(flatten(list(ivs) FILTER (WHERE active)), lambda v: split_part(v, ' ', 1)), lambda v: length(v) > 2))) AS drug_names, len(list_distinct(flatten(list(conditions) FILTER (WHERE active)))) AS conditions FROM x GROUP BY 1"""
)
def company_roll_ups(spark, sf):
    """Companies rolled up from their studies."""
    studies = registry.study_rows(_documents(spark, sf), "text", ["status", "phases", "conditions", "interventions", "enrollment"]).withColumn("interventions", tr.interventions_of(F.col("interventions")))
    rows = registry.company_roll_up(studies, ["symbol"])
    at = lambda c, k: F.coalesce(F.col(c)[k], F.lit(0))
    return rows.select("symbol", "n_trials", "n_total", "n_inactive", "total_enrollment", "max_enrollment", at("phase_enrollment", "PHASE3").alias("phase3_enrollment"), at("phase_trials", "PHASE1").alias("phase1_trials"), "best_phase", F.size("drug_names").alias("drug_names"), F.size("conditions").alias("conditions"))


@query(
    r"""SELECT doc_id, CAST(doc_id AS VARCHAR) AS pmid, 'Report ' || doc_id AS title, length(regexp_replace(text, '[<>&]', ' ', 'g')) + 1 + length('Source ' || coalesce(source, '-')) AS n, sha256(regexp_replace(text, '[<>&]', ' ', 'g') || ' Source ' || coalesce(source, '-')) AS abstract FROM documents WHERE doc_id % 7 > 0"""
)
def abstracts(spark, sf):
    """Articles in XML, made of documents: abstracts in two parts; one in seven has no title."""
    part = lambda x: F.concat(F.lit("<AbstractText>"), x, F.lit("</AbstractText>"))
    title = F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("<ArticleTitle>Report "), "doc_id", F.lit("</ArticleTitle>"))).otherwise("")
    body = F.concat(F.lit("<PubmedArticle><PMID>"), F.col("doc_id"), F.lit("</PMID>"), title, part(F.regexp_replace("text", "[<>&]", " ")), part(F.concat(F.lit("Source "), F.coalesce("source", F.lit("-")))), F.lit("</PubmedArticle>"))
    rows = registry.abstract_rows(table(spark, sf, "documents").select("doc_id", body.alias("xml")), "xml")
    return rows.select("doc_id", "pmid", "title", F.length("abstract").alias("n"), F.sha2("abstract", 256).alias("abstract"))
