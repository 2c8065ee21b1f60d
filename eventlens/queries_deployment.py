"""Registered queries on execution profiles, the validation overlay, promotion and ranked ideas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlens.adapters import SQL_SNAPSHOTS, prices, snapshots
from eventlens.plans import deployment as dp
from eventlens.plans import labels as lb
from eventlens.plans import recommend as rc
from eventlens.queries import _RETURNS, query
from eventlens.queries_recommend import _CARDS, _SIGNALS, _signals

SCENARIOS = ("pre-catalyst long", "commercial compounder", "watchlist only", "pairs candidate", "avoid due to financing", "franchise de-rating short", "commercial compounder")
ALL_SETUPS = ("hard_catalyst", "soft_catalyst", "launch_asymmetry", "pipeline_optionality", "capital_allocation", "sentiment_floor", "asymmetry_without_near_term_catalyst", "watchful")
#: What the signals lack, from their days to the event; the same text for both engines.
INPUTS = {
    "scenario": "CASE event_days % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SCENARIOS)) + " END",
    "stance": "CASE WHEN event_days % 7 = 5 THEN 'short' WHEN event_days % 11 = 3 THEN 'avoid' ELSE 'long' END",
    "special_situation": "CASE WHEN event_days % 17 = 4 THEN 'pending_transaction' END",
    "target_weight": "CAST(event_days % 9 AS DOUBLE) / 2",
    "held": "event_days % 3 = 0",
}


def _profiled(spark, sf):
    rows = _signals(spark, sf).withColumns({name: F.expr(e) for name, e in INPUTS.items()})
    setup = F.get(F.array(*[F.lit(s) for s in ALL_SETUPS]), (F.col("event_days") % 8).cast("int"))
    return dp.execution_profiles(rows.withColumn("setup_type", F.coalesce("setup_type", setup)))


_IN = f"""{SQL_SNAPSHOTS}, {_SIGNALS}, sig AS (SELECT symbol, as_of, state AS company_state, coalesce(setup, CASE days % 8 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(ALL_SETUPS))} END) AS setup_type, bucket, exact, days AS event_days, er AS expected_return, conf AS confidence,
    prob AS success_prob, upside, crowd AS crowding, fin AS financing_risk, floor AS floor_support FROM signals),
  inp AS (SELECT *, {', '.join(f"coalesce({e}, '')" + f' AS {n}' if n == 'special_situation' else f'{e} AS {n}' for n, e in INPUTS.items())} FROM sig),
  picked AS (SELECT *, CASE {' '.join(f'WHEN {r[0]} THEN {i}' for i, r in enumerate(dp.profile_rules()))} END AS rule FROM inp),
  prof AS (SELECT *, [{', '.join(f"'{r[1]}'" for r in dp.profile_rules())}][rule + 1] AS profile, [{', '.join(f"'{r[2]}'" for r in dp.profile_rules())}][rule + 1] AS mode, [{', '.join(f'{r[3]}::DOUBLE' for r in dp.profile_rules())}][rule + 1] AS cap0,
    [{', '.join(f'{r[4]}::DOUBLE' for r in dp.profile_rules())}][rule + 1] AS bonus FROM picked),
  profiles AS (SELECT *, CASE WHEN mode = 'auto' AND crowding > 0.80 AND profile <> 'hard_catalyst' THEN least(cap0, 1.5::DOUBLE) ELSE cap0 END AS weight_cap,
    greatest(expected_return, 0.0) * 4.0 + confidence * 1.5 + target_weight * 0.22 + greatest(success_prob - 0.50, 0.0) * 1.2 + greatest(upside, 0.0) * 0.02 + greatest(floor_support, 0.0) * 0.05 - crowding * 0.8 - financing_risk * 1.2 + bonus AS score FROM prof)"""


@query(f"WITH {_IN} SELECT symbol, as_of, profile, mode, weight_cap, round(score, 6) AS score FROM profiles")
def execution_profile(spark, sf):
    """Execution profiles of signals: bought, held or blocked, with the largest weight and the order of trades."""
    return _profiled(spark, sf).select("symbol", "as_of", "profile", "mode", "weight_cap", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_IN}, {_RETURNS.replace(SQL_SNAPSHOTS + ', ', '')}, {_CARDS},
    v AS (SELECT p.*, symbol % 5 > 0 AS validated, symbol % 9 AS age, symbol % 4 > 0 AS gate, c.rows AS n, c.windows AS w, round(c.spread, 6) AS sp, round(c.hit_rate, 6) AS h, round(c.rank_ic, 6) AS ic, round(c.mean_return, 6) AS mr
      FROM profiles p LEFT JOIN cards c ON c.dimension = 'setup_type' AND c.value = p.setup_type),
    k AS (SELECT *, validated AND mode <> 'block' AS live, validated AND mode = 'auto' AND coalesce(n >= 12 AND w >= 4, false) AS known FROM v),
    s AS (SELECT *, CASE WHEN live AND age > 7 THEN 'stale_validation' WHEN live AND mode = 'auto' AND setup_type = 'hard_catalyst' AND NOT gate THEN 'validation' WHEN known AND (sp <= 0 OR mr < 0 OR (h < 0.45 AND ic < 0) OR ic < -0.05) THEN 'validation'
      WHEN known AND (sp < 0.05 OR h < 0.5 OR ic < 0) AND weight_cap > 1.5 THEN 'caution' ELSE '' END AS step FROM k)
    SELECT symbol, as_of, CASE WHEN step LIKE '%validation' THEN profile || '_' || step || CASE WHEN held THEN '_hold' ELSE '_blocked' END ELSE profile END AS profile, CASE WHEN step LIKE '%validation' THEN CASE WHEN held THEN 'hold' ELSE 'block' END ELSE mode END AS mode,
      CASE WHEN step LIKE '%validation' THEN CASE WHEN held THEN least(weight_cap, 1.5::DOUBLE) ELSE 0.0 END WHEN step = 'caution' THEN greatest(1.5::DOUBLE, weight_cap * 0.5::DOUBLE) ELSE weight_cap END AS weight_cap,
      round(score - CASE WHEN step LIKE '%validation' THEN CASE WHEN held THEN 0.35 ELSE 1.0 END WHEN step = 'caution' THEN 0.15 ELSE 0.0 END, 6) AS score FROM s"""
)
def validated_profiles(spark, sf):
    """Profiles under the overlay of the last validation, with prior scorecards of their setups."""
    rows = _profiled(spark, sf).withColumns({"validated": F.col("symbol") % 5 > 0, "validation_age": F.col("symbol") % 9, "hard_gate": F.col("symbol") % 4 > 0})
    cards = rc.prior_scorecards(_signals(spark, sf).join(lb.forward_returns(snapshots(spark, sf), prices(spark, sf)), ["symbol", "as_of"])).where("dimension = 'setup_type'")
    six = lambda c: F.round(c, 6)
    cards = cards.select(F.col("value").alias("setup_type"), F.col("rows").alias("v_rows"), F.col("windows").alias("v_windows"), six("spread").alias("v_spread"), six("hit_rate").alias("v_hit_rate"), six("rank_ic").alias("v_rank_ic"), six("mean_return").alias("v_return"))
    out = dp.validation_overlay(rows.join(cards, "setup_type", "left"))
    return out.select("symbol", "as_of", "profile", "mode", "weight_cap", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_IN}, x AS (SELECT *, CASE WHEN setup_type = 'hard_catalyst' THEN 1.25 WHEN setup_type = 'soft_catalyst' THEN 0.5 END AS named FROM profiles),
    y AS (SELECT symbol, as_of, round(CASE WHEN exact THEN 2.5 ELSE 0.0 END + coalesce(named, 0.0) + 0.80::DOUBLE * success_prob + 0.55 * confidence + 0.35 * expected_return + 0.12 * target_weight - 0.01::DOUBLE * event_days, 6) AS score,
      target_weight >= 1 AND confidence >= 0.55 AND special_situation <> 'pending_transaction' AND ((stance = 'long' AND expected_return > 0.05 AND scenario NOT IN ('watchlist only', 'avoid due to financing')) OR (stance = 'short' AND expected_return < -0.05 AND upside <= -0.1)) AS top
      FROM x WHERE named IS NOT NULL OR bucket IN ('clinical', 'regulatory', 'strategic'))
    SELECT symbol, as_of, score, top FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, symbol) AS rn FROM y) WHERE rn <= 10"""
)
def ranked_ideas(spark, sf):
    """The ten best catalyst ideas of each date, and whether they qualify as top ideas."""
    rows = _profiled(spark, sf)
    score = dp.catalyst_idea_score(*[F.col(c) for c in ("event_exact", "setup_type", "event_bucket", "success_prob", "confidence", "expected_return", "target_weight")], F.lit(0.0), F.col("event_days"))
    rows = rows.select("symbol", "as_of", F.round(score, 6).alias("score"), dp.qualifies(rows).alias("top")).where("score is not null")
    best = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("score"), "symbol"))
    return rows.withColumn("_rn", best).where("_rn <= 10").drop("_rn")


@query(
    f"""WITH {_IN}, {_RETURNS.replace(SQL_SNAPSHOTS + ', ', '')}, {_CARDS},
    a AS (SELECT dimension, value, rows, windows, round(rank_ic, 6) AS ic, round(spread, 6) AS sp, round(hit_rate, 6) AS ex, round(1 - hit_rate, 6) AS sy, rows % 3 > 0 AS leak FROM cards),
    b AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT leak THEN 'leakage' END, CASE WHEN rows % 5 = 0 THEN 'reviewed' END, CASE WHEN windows < 3 THEN 'windows' END, CASE WHEN rows < 100 THEN 'rows' END, CASE WHEN ic < 0.10 THEN 'rank_ic' END, CASE WHEN sp <= 0 THEN 'spread' END,
        CASE WHEN ex < 0.4 THEN 'exact_events' END, CASE WHEN sy > 0.6 THEN 'synthetic_events' END], lambda v: v IS NOT NULL), '|') AS paper,
      array_to_string(list_filter([CASE WHEN windows < 24 THEN 'windows_24' END, CASE WHEN ic < 0.15 THEN 'rank_ic_15' END, CASE WHEN ic / 2 < 0.05 THEN 'strict_rank_ic' END, CASE WHEN sp < 0.10 THEN 'spread_10' END, CASE WHEN ic - 0.01 <= 0 THEN 'rank_ic_low' END, CASE WHEN sp - 0.01 <= 0 THEN 'spread_low' END], lambda v: v IS NOT NULL), '|') AS strict FROM a)
    SELECT dimension, value, CASE WHEN paper <> '' THEN 'do_not_promote' WHEN strict <> '' THEN 'paper_trade_ready' ELSE 'promote' END AS decision, CASE WHEN paper <> '' THEN paper ELSE strict END AS blockers FROM b"""
)
def promotion_decisions(spark, sf):
    """Promotion of a model per slice of the prior scorecards; hit rates, moved to the scale of coverage, stand for the share of exact events."""
    cards = rc.prior_scorecards(_signals(spark, sf).join(lb.forward_returns(snapshots(spark, sf), prices(spark, sf)), ["symbol", "as_of"]))
    six = lambda c: F.round(c, 6)
    moved = lambda x, at, to: F.when(x, to).otherwise(at)
    audits = cards.select("dimension", "value", "rows", "windows", six("rank_ic").alias("rank_ic"), six("spread").alias("spread"), six("hit_rate").alias("h")).withColumns({
        "strict_rank_ic": F.col("rank_ic") / 2, "rank_ic_low": F.col("rank_ic") - 0.01, "spread_low": F.col("spread") - 0.01, "leakage_passed": F.col("rows") % 3 > 0, "own_blockers": F.array(F.when(F.col("rows") % 5 == 0, "reviewed").otherwise(" ")),
        "exact_rate": moved(F.col("h") < 0.4, 0.8, 0.5), "synthetic_rate": moved(six(1 - F.col("h")) > 0.6, 0.1, 0.5),
    })
    return dp.promotions(audits).select("dimension", "value", "decision", F.array_join("blockers", "|").alias("blockers"))
