"""Registered queries on snapshot documents, rule scores and composite metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import oracle as q
from eventlens.adapters import SQL_CATALYSTS, SQL_SNAPSHOTS, catalysts, prices, snapshots, table
from eventlens.functions import rules
from eventlens.operators.rows import once
from eventlens.plans import labels as lb
from eventlens.queries import _RETURNS, query
from eventlens.queries_recommend import _SIGNALS, _signals
from eventlens.sources import snapshots as sn


def _documents(spark, sf, name):
    """A JSON document per symbol and order quarter, rebuilt from its text as far as the table ``name`` reads it: programs with trials, products, and the quarter's events, each twice."""
    event = F.struct(
        F.col("program_id").cast("string").alias("program_id"), "event_id", "event_type", "title", F.date_format("expected_date", "yyyy-MM-dd").alias("expected_date"),
        F.datediff("expected_date", "as_of").cast("bigint").alias("horizon_days"), F.lit(0.5).alias("probability"), F.col("importance").cast("double").alias("importance"),
        F.col("crowdedness").cast("double").alias("crowdedness"), "status",
    )
    # rows are shuffled once, to their document; programs are cut from its events
    rows = catalysts(spark, sf).withColumn("quarter", F.date_format(F.date_trunc("quarter", "as_of"), "yyyy-MM-dd")).repartition("symbol", "quarter")
    events = rows.groupBy("symbol", "quarter").agg(F.sort_array(F.collect_list(event)).alias("once"))
    trial = lambda e: F.struct(
        e["event_id"].alias("trial_id"), e["title"].alias("title"), e["event_type"].alias("phase"), e["status"].alias("status"), F.split(e["title"], " ").alias("conditions"), F.array(e["event_type"]).alias("interventions"), e["horizon_days"].alias("enrollment"), F.array(e["title"], e["status"]).alias("primary_outcomes")
    )
    best = lambda own, c: F.array_max(F.transform(own, lambda e: e[c]))
    program = lambda g: F.struct(
        g["id"].alias("program_id"), F.concat(F.lit("P"), g["id"]).alias("name"), F.lit("antibody").alias("modality"), best(g["own"], "event_type").alias("phase"), F.array(best(g["own"], "event_type"), F.size(g["own"]).cast("string")).alias("conditions"),
        (best(g["own"], "importance") / 2).alias("pos_prior"), (F.size(g["own"]) * 1e8).alias("tam_estimate"), F.transform(g["own"], trial).alias("trials"),
    )
    own = lambda i: F.struct(i.alias("id"), F.filter("once", lambda e: e["program_id"].eqNullSafe(i)).alias("own"))
    events = once(events, {"_groups": F.transform(F.array_distinct(F.transform("once", lambda e: e["program_id"])), own)})
    events = events.select("symbol", "quarter", F.concat("once", "once").alias("catalyst_events"), "once", F.transform("_groups", program).alias("programs"))
    product = F.transform(F.filter("catalyst_events", lambda e, i: (i % 3 == 0) & (e["importance"] >= 0.7)), lambda e: F.struct(e["event_id"].alias("product_id"), F.lit("Sold").alias("name"), e["title"].alias("indication"), (e["crowdedness"] * 1e8).alias("annual_revenue")))
    financing = F.transform(F.filter("once", lambda e: e["status"] == "phase_timing_estimate"), lambda e: F.struct(e["event_id"].alias("event_id"), e["event_type"].alias("event_type"), e["probability"].alias("probability"), e["horizon_days"].alias("horizon_days"), e["crowdedness"].alias("expected_dilution_pct"), e["title"].alias("summary")))
    money = snapshots(spark, sf).select("symbol", F.date_format("as_of", "yyyy-MM-dd").alias("quarter"), "market_cap", "revenue", "cash", "debt")
    docs = events.join(money, ["symbol", "quarter"], "left").select(
        F.col("symbol").cast("string").alias("ticker"), F.concat(F.lit("Company "), "symbol").alias("company_name"), F.col("quarter").alias("as_of"), "market_cap", "revenue", "cash", "debt", "programs", product.alias("approved_products"), "catalyst_events", financing.alias("financing_events"),
        F.create_map(F.lit("is_delisted"), F.when(F.col("symbol") % 2 == 0, "True").otherwise("false")).alias("metadata"),
    )
    text = docs.select(F.to_json(F.struct(*docs.columns)).alias("text"))
    return sn.rebuilt_rows(text, "text", sn.READ[name])


_DOCS = f"{SQL_CATALYSTS}, d AS (SELECT *, CAST(symbol AS VARCHAR) AS ticker, strftime(date_trunc('quarter', as_of), '%Y-%m-%d') AS quarter, strftime(expected_date, '%Y-%m-%d') AS day FROM catalysts)"


@query(
    f"""WITH {_DOCS}, o AS (SELECT *, row_number() OVER (PARTITION BY ticker, quarter ORDER BY CAST(program_id AS VARCHAR), event_id) AS rn, count(*) OVER (PARTITION BY ticker, quarter) AS n FROM d),
    s AS (SELECT ticker, quarter, event_id, title, crowdedness FROM o WHERE (rn - 1) % 3 = 0 AND importance >= 0.7 UNION ALL SELECT ticker, quarter, event_id, title, crowdedness FROM o WHERE (n + rn - 1) % 3 = 0 AND importance >= 0.7)
    SELECT ticker, quarter AS as_of, CAST(program_id AS VARCHAR) AS program_id, max(event_type) AS phase, '["' || max(event_type) || '","' || count(*) || '"]' AS conditions, max(importance) / 2 AS pos_prior, count(*) * 1e8 AS tam_estimate FROM d GROUP BY ticker, quarter, program_id
    UNION ALL SELECT ticker, quarter, event_id, 'APPROVED', '["' || title || '"]', 1.0, crowdedness * 1e8 FROM s"""
)
def snapshot_programs(spark, sf):
    """Programs and approved products of snapshot documents."""
    return sn.snapshot_tables(_documents(spark, sf, "programs"))["programs"].select("ticker", "as_of", "program_id", "phase", "conditions", "pos_prior", "tam_estimate")


@query(f"WITH {_DOCS}, {SQL_SNAPSHOTS} SELECT ticker, any_value('Company ' || symbol) AS company_name, quarter AS as_of, any_value(s.market_cap) AS market_cap, any_value(s.revenue) AS revenue, any_value(s.cash) AS cash, any_value(s.debt) AS debt FROM d LEFT JOIN (SELECT symbol AS k, strftime(as_of, '%Y-%m-%d') AS t, market_cap, revenue, cash, debt FROM snapshots) s ON k = symbol AND t = quarter GROUP BY ticker, quarter")
def snapshot_companies(spark, sf):
    """Company rows of snapshot documents."""
    return sn.snapshot_tables(_documents(spark, sf, "company_snapshots"))["company_snapshots"]


@query(f"WITH {_DOCS} SELECT ticker, quarter AS as_of, CAST(program_id AS VARCHAR) AS program_id, event_id, event_type, title, day AS expected_date, date_diff('day', as_of, expected_date) AS horizon_days, 0.5::DOUBLE AS probability, importance, crowdedness, status FROM d GROUP BY ALL")
def snapshot_catalysts(spark, sf):
    """Catalysts of snapshot documents, each event once."""
    return sn.snapshot_tables(_documents(spark, sf, "catalysts"))["catalysts"]


@query(f"WITH {_DOCS} SELECT ticker, quarter AS as_of, event_id, event_type, 0.5::DOUBLE AS probability, date_diff('day', as_of, expected_date) AS horizon_days, crowdedness AS expected_dilution_pct, title AS summary FROM d WHERE status = 'phase_timing_estimate'")
def snapshot_financing(spark, sf):
    """Financing events of snapshot documents."""
    return sn.snapshot_tables(_documents(spark, sf, "financing_events"))["financing_events"]


@query(f"WITH {_DOCS} SELECT ticker, quarter AS as_of, event_id, day AS event_timestamp, {q.exact('status', 'title')} AS timing_exact, {q.synthetic('status', 'title')} AS timing_synthetic FROM d GROUP BY ALL")
def snapshot_tape(spark, sf):
    """Event tape of snapshot documents: each event once, with its timing flags."""
    return sn.snapshot_tables(_documents(spark, sf, "event_tape"))["event_tape"].select("ticker", "as_of", "event_id", "event_timestamp", "timing_exact", "timing_synthetic")


@query(f"WITH {_DOCS} SELECT ticker, quarter AS as_of, CAST(program_id AS VARCHAR) AS program_id, event_id AS trial_id, date_diff('day', as_of, expected_date) AS enrollment, event_type AS phase, to_json(string_split(title, ' '))::VARCHAR AS conditions, to_json([title, status])::VARCHAR AS primary_outcomes FROM d")
def snapshot_trials(spark, sf):
    """Trials of the programs of snapshot documents."""
    return sn.snapshot_tables(_documents(spark, sf, "trials"))["trials"].select("ticker", "as_of", "program_id", "trial_id", "enrollment", "phase", "conditions", "primary_outcomes")


@query(
    f"""WITH {_DOCS} SELECT ticker, quarter AS as_of, 'snapshot_archive' AS membership_source, any_value(symbol) % 2 = 0 AS is_delisted, bool_or({q.exact('status', 'title')}) AS has_exact_event FROM d GROUP BY 1, 2"""
)
def snapshot_membership(spark, sf):
    """Universe membership of snapshot documents."""
    return sn.snapshot_tables(_documents(spark, sf, "universe_membership"))["universe_membership"].select("ticker", "as_of", "membership_source", "is_delisted", "has_exact_event")


_FEATURES = {
    "program_quality_pos_prior": ("p_partkey % 10", 0.1), "program_quality_phase_score": ("p_size % 5", 0.2), "catalyst_timing_expected_value": ("p_partkey % 7", 0.1), "program_quality_modality_risk": ("p_size % 3", 0.3),
    "state_profile_pre_commercial": ("p_partkey % 2", 1.0), "state_profile_commercial_launch": ("(p_partkey + 1) % 2", 1.0), "commercial_execution_launch_progress_pct": ("p_size % 4", 0.25),
    "state_profile_hard_catalyst_presence": ("p_partkey % 3 % 2", 1.0), "catalyst_timing_iv_implied_move": ("p_size % 6", 0.15), "catalyst_timing_company_event_earnings": ("p_partkey % 5 % 2", 1.0),
}
_TERMS = lambda terms: " + ".join(f"({w}::DOUBLE * {n if n in _FEATURES else f'{d}::DOUBLE'})" for n, w, d in terms)


@query(
    f"""WITH f AS (SELECT p_partkey, {', '.join(f'({e}) * {s}::DOUBLE AS {n}' for n, (e, s) in _FEATURES.items())} FROM part),
    r AS (SELECT *, {_TERMS(rules.RETURN_TERMS)} + 0.06::DOUBLE * state_profile_commercial_launch * commercial_execution_launch_progress_pct + 0.03::DOUBLE * state_profile_hard_catalyst_presence
      - 0.08::DOUBLE * state_profile_pre_commercial * 0.55::DOUBLE * (1 - state_profile_hard_catalyst_presence) - 0.03::DOUBLE * 0.55::DOUBLE AS er,
      {_TERMS(rules.SUCCESS_TERMS)} + 0.15::DOUBLE * state_profile_hard_catalyst_presence + 0.08::DOUBLE * state_profile_commercial_launch * commercial_execution_launch_progress_pct
      - 0.25::DOUBLE * state_profile_pre_commercial * 0.55::DOUBLE * (1 - state_profile_hard_catalyst_presence) AS z FROM f),
    d AS (SELECT *, er - CASE WHEN catalyst_timing_iv_implied_move > 0 THEN 0.25 * greatest(catalyst_timing_iv_implied_move - abs(er), 0.0) ELSE 0.0 END AS rule FROM r)
    SELECT p_partkey, round(rule, 6) AS rule_return, round(1 / (1 + exp(-z)), 6) AS rule_success, round(CASE WHEN p_partkey % 4 = 0 THEN rule ELSE 0.4 * rule + 0.6 * (p_partkey % 9) * 0.02::DOUBLE END, 6) AS blend FROM d"""
)
def rule_scores(spark, sf):
    """Rule scores of feature rows, blended with a model score where there is one."""
    rows = table(spark, sf, "part").select("p_partkey", *[(F.expr(e) * s).alias(n) for n, (e, s) in _FEATURES.items()])
    rows = rules.rule_scores(rows)
    model = F.when(F.col("p_partkey") % 4 != 0, (F.col("p_partkey") % 9) * 0.02)
    return rows.select("p_partkey", F.round("rule_return", 6).alias("rule_return"), F.round("rule_success", 6).alias("rule_success"), F.round(rules.blended(F.col("rule_return"), model), 6).alias("blend"))


@query(
    f"""WITH {_RETURNS}, {_SIGNALS}, x AS (SELECT symbol % 3 = 0 AS holdout, er AS p, return_90d AS y FROM signals JOIN returns USING (symbol, as_of) WHERE return_90d IS NOT NULL),
    r AS (SELECT *, rank() OVER (PARTITION BY holdout ORDER BY p) + (count(*) OVER (PARTITION BY holdout, p) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY holdout ORDER BY y) + (count(*) OVER (PARTITION BY holdout, y) - 1) / 2.0 AS ry FROM x),
    m AS (SELECT holdout, count(*) AS scored, corr(rx, ry) AS rc, avg(CASE WHEN sign(p) = sign(y) THEN 1.0 ELSE 0.0 END) AS direction, avg(abs(p - y)) AS mae FROM r GROUP BY 1)
    SELECT holdout, scored, round(rc, 6) AS rank_correlation, round(direction, 6) AS direction, round(mae, 6) AS mae, round(1 - (0.50 * (rc + 1) / 2 + 0.30 * direction + 0.20 * greatest(1 - mae, 0.0)), 6) AS valuation_error FROM m"""
)
def composite_metrics(spark, sf):
    """Composite metric of training and held-out symbols."""
    rows = _signals(spark, sf).join(lb.forward_returns(snapshots(spark, sf), prices(spark, sf)), ["symbol", "as_of"]).withColumn("holdout", F.col("symbol") % 3 == 0)
    out = rules.composite_metric(rows, ["holdout"], "expected_return", "return_90d")
    return out.select("holdout", "scored", *[F.round(c, 6).alias(c) for c in ("rank_correlation", "direction", "mae", "valuation_error")])
