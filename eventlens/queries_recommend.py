"""Registered queries on recommendations, program columns and execution."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.adapters import SQL_SNAPSHOTS, prices, snapshots, table
from eventlens.functions import program as pg
from eventlens.functions.numeric import company_state, floor_support
from eventlens.operators.asof import latest
from eventlens.plans import labels as lb
from eventlens.plans import recommend as rc
from eventlens.queries import _RETURNS, query

BUCKETS = ("clinical", "regulatory", "earnings", "none")
SETUPS = ("hard_catalyst", "asymmetry_without_near_term_catalyst", "launch_asymmetry", "soft_catalyst", "watchful")


def _signals(spark, sf):
    """Snapshots as signals: every number comes from one key of symbol, date and products."""
    k = F.col("symbol") * 7 + F.month("as_of") * 5 + F.col("products") * 3 + F.year("as_of")
    pick = lambda names, m: F.get(F.array(*[F.lit(n) for n in names]), (k % m).cast("int"))
    rows = snapshots(spark, sf).withColumn("k", k)
    return rows.select(
        "symbol", "as_of", company_state(F.col("products"), F.col("revenue")).alias("company_state"), floor_support(*[F.col(c) for c in ("market_cap", "cash", "debt", "revenue")]).alias("floor_support"),
        pick(SETUPS, 6).alias("setup_type"), pick(BUCKETS, 4).alias("event_bucket"), (k % 2 == 0).alias("event_exact"), (k % 200).alias("event_days"), pick(("30d", "90d", "180d"), 3).alias("horizon"),
        ((k % 9 - 4) * 0.05).alias("expected_return"), (0.40 + (k % 7) * 0.08).alias("confidence"), (0.30 + (k % 8) * 0.08).alias("success_prob"), ((k % 5 - 3) * 0.20).alias("upside"),
        ((k % 11) * 0.09).alias("crowding"), ((k % 13) * 0.07).alias("financing_risk"),
    )


_CASE = lambda names, m: f"CASE k % {m} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
_SIGNALS = f"""keyed AS (SELECT *, CAST(symbol * 7 + month(as_of) * 5 + products * 3 + year(as_of) AS BIGINT) AS k FROM snapshots),
  signals AS (SELECT symbol, as_of, CASE WHEN revenue >= 500000000 THEN 'commercialized' WHEN products > 0 OR revenue >= 75000000 THEN 'commercial_launch' ELSE 'pre_commercial' END AS state,
    least(greatest((greatest(cash - debt, 0.0) + 0.35 * revenue) / greatest(market_cap, 1.0), 0.0), 1.25) AS floor, {_CASE(SETUPS, 6)} AS setup, {_CASE(BUCKETS, 4)} AS bucket, k % 2 = 0 AS exact, k % 200 AS days,
    {_CASE(("30d", "90d", "180d"), 3)} AS horizon, CAST(k % 9 - 4 AS DOUBLE) * 0.05::DOUBLE AS er, 0.40::DOUBLE + (k % 7) * 0.08::DOUBLE AS conf, 0.30::DOUBLE + (k % 8) * 0.08::DOUBLE AS prob, (k % 5 - 3) * 0.20::DOUBLE AS upside,
    (k % 11) * 0.09::DOUBLE AS crowd, (k % 13) * 0.07::DOUBLE AS fin FROM keyed)"""
_CARDS = f"""stacked AS (SELECT s.as_of, er, return_90d AS y, unnest([{{'dimension': 'state_setup', 'value': state || '|' || coalesce(setup, 'unknown')}}, {{'dimension': 'setup_type', 'value': coalesce(setup, 'unknown')}}, {{'dimension': 'company_state', 'value': state}}]) AS d
    FROM signals s JOIN returns r USING (symbol, as_of) WHERE return_90d IS NOT NULL),
  dims AS (SELECT as_of, er, y, d.dimension AS dimension, d.value AS value FROM stacked),
  ranked AS (SELECT *, rank() OVER (PARTITION BY dimension, value ORDER BY er) + (count(*) OVER (PARTITION BY dimension, value, er) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY dimension, value ORDER BY y) + (count(*) OVER (PARTITION BY dimension, value, y) - 1) / 2.0 AS ry FROM dims),
  cards AS (SELECT dimension, value, count(*) AS rows, count(DISTINCT as_of) AS windows, CASE WHEN count(*) < 3 OR corr(rx, ry) IS NULL OR isnan(corr(rx, ry)) THEN 0.0 ELSE corr(rx, ry) END AS rank_ic,
    avg(CASE WHEN sign(er) = sign(y) THEN 1.0 ELSE 0.0 END) AS hit_rate, coalesce(avg(y) FILTER (WHERE er > 0) - avg(y) FILTER (WHERE er <= 0), 0.0) AS spread, avg(y) AS mean_return FROM ranked GROUP BY 1, 2)"""


@query(
    f"""WITH {_RETURNS}, {_SIGNALS}, {_CARDS} SELECT dimension, value, rows, windows, round(rank_ic, 6) AS rank_ic, round(hit_rate, 6) AS hit_rate, round(spread, 6) AS spread, round(mean_return, 6) AS mean_return FROM cards"""
)
def prior_scorecards(spark, sf):
    """Prior scorecards by state, setup and both."""
    cards = rc.prior_scorecards(_signals(spark, sf).join(lb.forward_returns(snapshots(spark, sf), prices(spark, sf)), ["symbol", "as_of"]))
    return cards.select("dimension", "value", "rows", "windows", *[F.round(c, 6).alias(c) for c in cards.columns[4:]])


_OF = lambda table: "CASE scenario " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0.0 END"
_EDGED = f"""edges AS (SELECT dimension, value, 0.45 * least(greatest(rank_ic, -0.5), 0.5) + 0.35 * least(greatest(hit_rate - 0.5, -0.35), 0.35) + 0.15 * least(greatest(spread, -0.6), 0.6) + 0.05 * least(greatest(mean_return, -0.35), 0.35) AS edge,
    least(rows / 30.0, 1.0) * least(windows / 6.0, 1.0) * CASE WHEN rows < 8 THEN 0.5 ELSE 1.0 END * CASE dimension WHEN 'state_setup' THEN 0.55 WHEN 'setup_type' THEN 0.30 ELSE 0.15 END AS w FROM cards),
  edged AS (SELECT s.*, round(coalesce(e.edge, 0.0), 12) AS edge, round(coalesce(least(e.w, 1.0), 0.0), 12) AS sure FROM signals s LEFT JOIN (SELECT symbol, as_of, sum(edge * w) / sum(w) AS edge, sum(w) AS w FROM signals JOIN edges
    ON (dimension = 'state_setup' AND value = state || '|' || coalesce(setup, 'unknown')) OR (dimension = 'setup_type' AND value = coalesce(setup, 'unknown')) OR (dimension = 'company_state' AND value = state) WHERE w > 0 GROUP BY 1, 2) e USING (symbol, as_of)),
  tilted AS (SELECT *, edge * sure * 0.2 AS tilt, greatest(edge * sure * 0.2, 0.0) AS up, greatest(-(edge * sure * 0.2), 0.0) AS down, greatest(-edge, 0.0) AS loss, greatest(-upside, 0.0) AS gap, bucket IN ('clinical', 'regulatory') AS hard,
    coalesce(setup IN ('hard_catalyst', 'soft_catalyst'), bucket IN ('clinical', 'regulatory')) AS ready, horizon IN ('30d', '90d') OR (bucket IN ('clinical', 'regulatory') AND exact AND days <= 120) AS soon,
    state IN ('commercial_launch', 'commercialized') AS sold FROM edged),
  named AS (SELECT *, CASE WHEN fin > 0.80 THEN 'avoid due to financing'
    WHEN state = 'pre_commercial' AND setup = 'asymmetry_without_near_term_catalyst' THEN CASE WHEN er > greatest(0.10, 0.12 - up) AND floor > greatest(0.14, 0.18 - up) THEN 'pairs candidate' ELSE 'watchlist only' END
    WHEN ready AND er < -greatest(0.10, 0.14 - up) AND prob < least(0.48, 0.45 + loss * 0.20) AND gap >= 0.12 AND conf >= 0.55 AND soon THEN 'pre-catalyst short'
    WHEN sold AND gap >= 0.50 AND er < 0.14 AND prob < 0.90 AND conf >= 0.72 THEN 'science-vs-street short'
    WHEN sold AND er < -(0.10 + down * 0.5) AND gap >= 0.18 AND conf >= 0.58 THEN 'franchise de-rating short'
    WHEN er < -(0.08 + down * 0.5) AND gap >= 0.14 AND conf >= 0.55 THEN 'science-vs-street short'
    WHEN ready AND er > greatest(0.11, 0.16 - up) AND prob > greatest(0.47, 0.52 - greatest(edge, 0.0) * 0.20) AND soon THEN 'pre-catalyst long'
    WHEN sold AND er > 0.10 + down AND prob > 0.55 + loss * 0.20 THEN 'commercial compounder' WHEN er > 0.08 + down * 0.5 THEN 'pairs candidate' ELSE 'watchlist only' END AS scenario FROM tilted),
  lagged AS (SELECT *, scenario IN {rc.SHORTS} AS short, lag(er) OVER w AS er0, lag(bucket) OVER w AS bucket0, row_number() OVER w AS rn FROM named WINDOW w AS (PARTITION BY symbol ORDER BY as_of)),
  sided AS (SELECT *, greatest(CASE WHEN short THEN -er ELSE er END, 0.0) AS now, coalesce(greatest(CASE WHEN short THEN -er0 ELSE er0 END, 0.0), 0.0) AS before,
    CASE WHEN crowd > 0.75 THEN 2.5 WHEN short THEN 3.5 ELSE 4.0 END AS ceiling FROM lagged),
  aimed AS (SELECT *, CASE WHEN fin > 0.75 THEN least(ceiling, 2.0) ELSE ceiling END AS max_weight,
    round(least(greatest((now * (0.70 + conf) * 16.0 + conf * 2.0 + CASE WHEN hard THEN 0.75 ELSE 0.0 END + CASE WHEN before > 0.08 THEN CASE WHEN bucket0 = bucket THEN 0.60 ELSE 0.25 END ELSE 0.0 END + CASE WHEN short THEN gap ELSE 0.0 END * 3.0 - 0.75)
      * least(greatest(1 + edge * sure * 1.35, 0.75), 1.35) + {_OF(rc.BONUS)} + least(greatest(edge * sure * 4.5, -0.75), 1.0) - (crowd * CASE WHEN short THEN 0.9 ELSE 1.8 END + fin * 3.5 + CASE WHEN bucket = 'earnings' THEN 0.75 ELSE 0.0 END), 0.0), {_OF(rc.CAPS)}), 9) AS target FROM sided),
  steps AS MATERIALIZED (SELECT *, least(target, max_weight) AS raw, CASE WHEN target <= 0 THEN 'avoid' WHEN short THEN 'short' ELSE 'long' END AS want FROM aimed)"""
_QUARTER = lambda x: f"least(round_even(greatest({x}, 0.0) * 4, 0) / 4, s.max_weight)"


@query(
    f"""WITH RECURSIVE {_RETURNS}, {_SIGNALS}, {_CARDS}, {_EDGED},
    path AS (SELECT symbol, rn, {_QUARTER('raw')} AS weight, CASE WHEN {_QUARTER('raw')} > 0 THEN want ELSE 'avoid' END AS stance FROM steps s WHERE rn = 1
      UNION ALL SELECT symbol, rn, weight, CASE WHEN weight > 0 THEN want ELSE 'avoid' END FROM (SELECT s.symbol, s.rn, s.want, CASE WHEN p.stance <> s.want THEN {_QUARTER('s.raw')}
        WHEN s.raw <= 0 THEN CASE WHEN s.before > 0.05 AND s.conf > 0.45 THEN {_QUARTER('least(p.weight, 0.75)')} ELSE 0.0 END
        WHEN p.weight >= 1 AND s.raw < 1 AND s.before > 0.06 AND s.now > 0.04 THEN {_QUARTER('least(greatest(1.0, p.weight * 0.60), greatest(p.weight, s.raw))')}
        ELSE {_QUARTER('p.weight + (s.raw - p.weight) * CASE WHEN abs(s.raw - p.weight) < 0.75 THEN 0.35 WHEN abs(s.raw - p.weight) < 2.0 THEN 0.55 ELSE 0.80 END')} END AS weight
        FROM path p JOIN steps s ON s.symbol = p.symbol AND s.rn = p.rn + 1))
    SELECT s.symbol, s.as_of, s.scenario, p.stance, round(s.raw, 6) AS raw_weight, CAST(p.weight AS DOUBLE) AS target_weight, CAST(s.max_weight AS DOUBLE) AS max_weight FROM steps s JOIN path p USING (symbol, rn)"""
)
def recommendations(spark, sf):
    """Scenario, stance and smoothed weight of every signal, with the empirical edge of its archetype."""
    signals = _signals(spark, sf)
    cards = rc.prior_scorecards(signals.join(lb.forward_returns(snapshots(spark, sf), prices(spark, sf)), ["symbol", "as_of"]))
    rows = rc.recommendations(rc.with_edge(signals, cards))
    return rows.select("symbol", "as_of", "scenario", "stance", F.round("raw_weight", 6).alias("raw_weight"), "target_weight", "max_weight")


@query(
    f"""WITH {SQL_SNAPSHOTS}, {_SIGNALS} SELECT symbol, as_of, array_to_string(list_filter([CASE WHEN crowd > 0.65 THEN 'crowded catalyst' END, CASE WHEN fin > 0.65 THEN 'financing overhang' END, CASE WHEN prob < 0.40 THEN 'low catalyst probability' END,
    CASE WHEN bucket = 'earnings' THEN 'earnings-driven setup' END, CASE WHEN state = 'pre_commercial' AND setup = 'asymmetry_without_near_term_catalyst' THEN 'no hard catalyst yet' END, CASE WHEN upside < 0 THEN 'negative asymmetry' END,
    CASE WHEN er < -0.08 AND upside <= -0.12 THEN 'science/street mismatch' END], lambda x: x IS NOT NULL), ', ') AS flags, round(least(greatest(conf * 0.9::DOUBLE, 0.0), 0.99), 9) AS cut_confidence, round(er * 0.8::DOUBLE, 9) AS cut_return FROM signals"""
)
def signal_risks(spark, sf):
    """Risk flags of signals without history, and their haircuts."""
    rows = _signals(spark, sf).withColumns({"edge_score": F.lit(0.0), "reliability": F.lit(0.0)}).withColumn("flags", F.array_join(rc.signal_flags(), ", "))
    rows = rc.haircut(rows.withColumns({"confidence_haircut": F.lit(0.9), "return_haircut": F.lit(0.8), "prob_haircut": F.lit(1.0)}))
    return rows.select("symbol", "as_of", "flags", F.round("confidence", 9).alias("cut_confidence"), (F.round("expected_return", 9) + 0.0).alias("cut_return"))


_PHASES = ("Phase 1", "PHASE2|PHASE3", "Early Phase 1", "Phase 1/Phase 2", "PHASE4", "N/A", "Phase 3")
_ENDPOINTS = ("Overall survival at 12 months", "Objective response rate", "Number of adverse events", "PFS", "Change in FEV1", "HbA1c", "Pharmacokinetic profile", "Walk test", "MACE")


def _pick(names, column, shift=0):
    return F.get(F.array(*[F.lit(n) for n in names]), ((F.col(column) + shift) % len(names)).cast("int"))


_AT = lambda names, column, shift=0: f"([{', '.join(repr(n) for n in names)}])[({column} + {shift}) % {len(names)} + 1]"
_ONE = lambda x: f"CASE WHEN contains(lower({x}), 'overall survival') THEN 0.90 WHEN lower({x}) = 'pfs' THEN 0.75 WHEN contains(lower({x}), 'fev1') THEN 0.75 WHEN lower({x}) = 'mace' THEN 0.80 WHEN contains(lower({x}), 'objective response') THEN 0.55 WHEN contains(lower({x}), 'hba1c') THEN 0.60 WHEN contains(lower({x}), 'pharmacokinetic') THEN 0.30 WHEN contains(lower({x}), 'adverse') THEN 0.25 ELSE 0.40 END"


@query(
    f"""WITH x AS (SELECT p_partkey, {_AT(_PHASES, 'p_partkey')} AS phase, {_AT(_ENDPOINTS, 'p_partkey')} AS a, {_AT(_ENDPOINTS, 'p_size')} AS b, p_partkey % 160 AS days FROM part),
    s AS (SELECT *, {_ONE('a')} AS sa, {_ONE('b')} AS sb, CASE WHEN phase = 'PHASE4' THEN 'APPROVED' WHEN regexp_matches(upper(phase), 'PHASE ?3') THEN 'PHASE3' WHEN regexp_matches(upper(phase), 'PHASE ?2') THEN 'PHASE2' ELSE 'PHASE1' END AS norm FROM x)
    SELECT p_partkey, norm AS phase, CASE norm WHEN 'PHASE1' THEN 2 WHEN 'PHASE2' THEN 3 WHEN 'PHASE3' THEN 4 ELSE 6 END AS rank, CAST(CASE norm WHEN 'PHASE1' THEN 0.2 WHEN 'PHASE2' THEN 0.45 WHEN 'PHASE3' THEN 0.75 ELSE 1.0 END AS DOUBLE) AS score,
      CAST(round(least(greatest(0.65 * least(sa, sb) + 0.35 * greatest(sa, sb), 0.25), 0.90), 6) AS DOUBLE) AS endpoint, CASE WHEN days <= 45 THEN '30d' WHEN days <= 120 THEN '90d' ELSE '180d' END AS horizon FROM s"""
)
def program_columns(spark, sf):
    """Phase, endpoint quality and horizon of programs."""
    rows = table(spark, sf, "part").withColumn("phase", pg.phase(F.array(_pick(_PHASES, "p_partkey"))))
    quality = pg.endpoint_score(F.array(_pick(_ENDPOINTS, "p_partkey"), _pick(_ENDPOINTS, "p_size")))
    return rows.select("p_partkey", "phase", pg.phase_rank(F.col("phase")).alias("rank"), pg.phase_score(F.col("phase")).alias("score"), F.round(quality, 6).alias("endpoint"), pg.horizon_label(F.col("p_partkey") % 160).alias("horizon"))


@query(
    """WITH x AS (SELECT o_orderkey, o_totalprice / 10 AS wanted, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 100000000 WHEN 2 THEN 500000000 WHEN 3 THEN 2000000000 ELSE 9000000000 END AS cap, o_orderkey % 2 = 0 AS hard FROM orders),
    c AS (SELECT *, CASE WHEN cap <= 0 THEN 1000.0 WHEN cap < 250000000 THEN 1250.0 WHEN cap < 1000000000 THEN 4000.0 WHEN cap < 5000000000 THEN 10000.0 ELSE 25000.0 END * CASE WHEN hard THEN 0.7 ELSE 1.0 END AS room FROM x),
    f AS (SELECT *, least(1.0, room / greatest(wanted, 1.0)) AS fill FROM c)
    SELECT o_orderkey, round(fill, 6) AS fill, CASE WHEN fill < 0.25 THEN 'liquidity_cap' END AS rejected, fill >= 0.25 AND fill < 0.999 AS partial, round(CASE WHEN fill < 0.25 THEN 0.0 ELSE wanted * fill END, 4) AS executable FROM f"""
)
def liquidity_fills(spark, sf):
    """Share of each order that its market value's liquidity allows."""
    cap = F.get(F.array(*[F.lit(x) for x in (0, 100_000_000, 500_000_000, 2_000_000_000, 9_000_000_000)]), (F.col("o_orderkey") % 5).cast("int"))
    rows = pg.liquidity_fill(table(spark, sf, "orders"), F.col("o_totalprice") / 10, cap, F.col("o_orderkey") % 2 == 0)
    return rows.select("o_orderkey", F.round("fill", 6).alias("fill"), "rejected", "partial", F.round("executable", 4).alias("executable"))


@query(
    """WITH x AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS source FROM events)
    SELECT user_id, rank FROM (SELECT user_id, row_number() OVER (ORDER BY source, user_id) AS rank FROM (SELECT user_id, min(source) AS source FROM x GROUP BY 1)) WHERE rank <= 40"""
)
def ordered_union(spark, sf):
    """Users of several sources in the order of the first source that names them; the first forty (the report's size)."""
    source = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    firsts = table(spark, sf, "events").groupBy("user_id").agg(F.min(source).alias("source"))
    top = firsts.orderBy("source", "user_id").limit(40)
    from pyspark.sql import Window

    return top.select("user_id", F.row_number().over(Window.orderBy("source", "user_id")).cast("long").alias("rank"))  # forty rows


@query(
    """WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS tier FROM orders)
    SELECT o_custkey, o_orderkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY tier, o_orderdate, o_totalprice DESC, o_orderkey) AS rn FROM x) WHERE rn = 1"""
)
def tiered_primary(spark, sf):
    """The leading row of the best tier that a key has."""
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = table(spark, sf, "orders").withColumn("tier", tier)
    return latest(rows, ["o_custkey"], [F.asc("tier"), F.asc("o_orderdate"), F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "tier")
