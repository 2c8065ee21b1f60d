"""Registered queries on execution and evaluation windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.adapters import SQL_PRICES, SQL_SNAPSHOTS, prices, snapshots
from eventlens.plans import execution as ex
from eventlens.plans import labels as lb
from eventlens.queries import _RETURNS, query
from eventlens.queries_recommend import _SIGNALS, _signals

_PLANS = "plans AS (SELECT symbol || ':' || strftime(as_of, '%Y-%m-%d') AS plan, symbol, CASE WHEN er > 0 THEN 'buy' WHEN er < 0 THEN 'sell' ELSE 'hold' END AS action, as_of + INTERVAL 3 DAY AS entry_at, setup FROM signals)"
_SIDE = "CASE WHEN action = 'buy' THEN 1.0 ELSE -1.0 END"


@query(
    f"""WITH {SQL_PRICES}, {SQL_SNAPSHOTS}, {_SIGNALS}, {_PLANS}, s AS (SELECT p.*, k.market_cap AS cap, k.products AS sold FROM plans p ASOF LEFT JOIN snapshots k ON p.symbol = k.symbol AND p.entry_at >= k.as_of WHERE action <> 'hold'),
    h AS (SELECT *, entry_at + INTERVAL 10 DAY AS t10, entry_at + INTERVAL 30 DAY AS t30, entry_at + INTERVAL 90 DAY AS t90 FROM s),
    f AS (SELECT h.*, a.close AS p0, b.close AS p10, c.close AS p30, d.close AS p90 FROM h ASOF LEFT JOIN prices a ON h.symbol = a.symbol AND h.entry_at <= a.date ASOF LEFT JOIN prices b ON h.symbol = b.symbol AND h.t10 <= b.date
      ASOF LEFT JOIN prices c ON h.symbol = c.symbol AND h.t30 <= c.date ASOF LEFT JOIN prices d ON h.symbol = d.symbol AND h.t90 <= d.date),
    l AS (SELECT symbol, arg_max(close, date) AS newest FROM prices GROUP BY 1),
    r AS (SELECT f.*, newest, (CASE WHEN cap IS NULL OR cap <= 0 THEN 275.0 WHEN cap < 250000000 THEN 425.0 WHEN cap < 1000000000 THEN 220.0 WHEN cap < 5000000000 THEN 110.0 ELSE 45.0 END + least(coalesce(sold, 0) / 100 * 1000.0, 125.0) + CASE WHEN setup IN ('hard_catalyst', 'soft_catalyst') THEN 35.0 ELSE 0.0 END) / 10000.0 AS cost
      FROM f LEFT JOIN l USING (symbol) WHERE p0 > 0)
    SELECT plan, action, round({_SIDE} * (p10 / p0 - 1), 8) + 0.0 AS return_10d, round({_SIDE} * (p30 / p0 - 1) - cost, 8) + 0.0 AS return_30d_net, round({_SIDE} * (p90 / p0 - 1) - cost, 8) + 0.0 AS return_90d_net,
      round({_SIDE} * (newest / p0 - 1) - cost / 2, 8) + 0.0 AS mark_to_market_net FROM r"""
)
def execution_feedback(spark, sf):
    """Signed returns of plans, gross and net, and marked to the last close."""
    signals = _signals(spark, sf)
    action = F.when(F.col("expected_return") > 0, "buy").when(F.col("expected_return") < 0, "sell").otherwise("hold")
    plans = signals.select(F.concat_ws(":", "symbol", F.date_format("as_of", "yyyy-MM-dd")).alias("plan"), "symbol", action.alias("action"), (F.col("as_of") + F.expr("INTERVAL 3 DAYS")).alias("entry_at"), "setup_type")
    out = ex.execution_feedback(plans, snapshots(spark, sf).withColumn("volatility", F.col("products") / 100), prices(spark, sf))
    return out.select("plan", "action", *[(F.round(c, 8) + 0.0).alias(c) for c in ("return_10d", "return_30d_net", "return_90d_net", "mark_to_market_net")])


@query(
    f"""WITH {SQL_SNAPSHOTS}, {_SIGNALS}, g AS (SELECT as_of, median(er) AS m, median(crowd) AS v, avg(upside) AS b, bool_or(fin > 0.80) AS blocked FROM signals GROUP BY 1),
    x AS (SELECT as_of, round(least(greatest(CASE WHEN blocked THEN 0.65 ELSE 1.0 END * CASE WHEN b <= -0.15 THEN 0.55 WHEN b <= -0.08 THEN 0.75 ELSE 1.0 END * CASE WHEN m <= -0.12 THEN 0.70 WHEN m <= -0.05 THEN 0.85 ELSE 1.0 END
      * CASE WHEN v >= 0.60 THEN 0.75 WHEN v >= 0.45 THEN 0.90 ELSE 1.0 END, 0.25), 1.0), 9) AS multiplier FROM g)
    SELECT as_of, CAST(multiplier AS DOUBLE) AS multiplier, CAST(round(least(100.0, greatest(4.0, 100.0 * multiplier)), 6) AS DOUBLE) AS gross_cap, CASE WHEN multiplier <= 0.60 THEN 'risk_off' WHEN multiplier < 1 THEN 'caution' ELSE 'normal' END AS regime FROM x"""
)
def exposure_governor(spark, sf):
    """Exposure multiplier and regime per date."""
    rows = _signals(spark, sf).select("as_of", F.col("expected_return").alias("momentum"), F.col("crowding").alias("volatility"), "upside", "financing_risk")
    out = ex.exposure_governor(rows, ["as_of"], F.avg("upside"), F.bool_or(F.col("financing_risk") > 0.80))
    return out.select("as_of", "multiplier", F.round("gross_cap", 6).alias("gross_cap"), "regime")


@query(
    f"""WITH RECURSIVE {_RETURNS}, {_SIGNALS}, u AS (SELECT setup, symbol, as_of, round(er, 9) AS score, return_90d AS gross, return_90d - 0.01 AS net FROM signals JOIN returns USING (symbol, as_of) WHERE setup IS NOT NULL AND return_90d IS NOT NULL),
    days AS MATERIALIZED (SELECT DISTINCT setup, CAST(as_of AS DATE) AS day FROM u), spaced AS (SELECT setup, min(day) AS day FROM days GROUP BY 1 UNION ALL SELECT s.setup, min(d.day) FROM spaced s JOIN days d ON d.setup = s.setup AND d.day >= s.day + 200 GROUP BY s.setup, s.day),
    bounds AS (SELECT setup, day FROM spaced UNION SELECT setup, max(day) FROM days GROUP BY 1), w AS (SELECT u.*, b.day AS win FROM u ASOF JOIN bounds b ON u.setup = b.setup AND u.as_of >= b.day),
    rk AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY setup, win ORDER BY score DESC, symbol, as_of) AS hi, row_number() OVER (PARTITION BY setup, win ORDER BY score, symbol, as_of) AS lo, median(score) OVER g AS med,
      rank() OVER (PARTITION BY setup, win ORDER BY score) + (count(*) OVER (PARTITION BY setup, win, score) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY setup, win ORDER BY gross) + (count(*) OVER (PARTITION BY setup, win, gross) - 1) / 2.0 AS ry FROM w WINDOW g AS (PARTITION BY setup, win)),
    b AS (SELECT setup, win, count(*) AS rows, CASE WHEN count(*) < 3 OR corr(rx, ry) IS NULL OR isnan(corr(rx, ry)) THEN 0.0 ELSE corr(rx, ry) END AS rank_ic,
      CASE WHEN count(*) > 1 THEN avg(net) FILTER (WHERE hi <= greatest(1, n // 5)) - avg(net) FILTER (WHERE lo <= greatest(1, n // 5)) ELSE 0.0 END AS net_spread FROM rk GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY setup ORDER BY win DESC) AS age FROM b), s AS (SELECT *, 'full' AS scope FROM p UNION ALL SELECT *, 'rolling' FROM p WHERE age <= 6)
    SELECT setup, scope, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS windows, round(avg(rank_ic), 6) AS rank_ic, round(avg(net_spread), 6) AS net_spread FROM s GROUP BY 1, 2"""
)
def dimension_scorecards(spark, sf):
    """Scorecards per setup over rebalance windows, all and the last six."""
    rows = _signals(spark, sf).join(lb.forward_returns(snapshots(spark, sf), prices(spark, sf)), ["symbol", "as_of"])
    rows = rows.select(F.col("setup_type").alias("setup"), "symbol", "as_of", F.round("expected_return", 9).alias("score"), F.col("return_90d").alias("gross_return"), (F.col("return_90d") - 0.01).alias("cost_adjusted_return"))
    out = ex.dimension_scorecards(rows.where("gross_return is not null"), "setup", "as_of", ["symbol", "as_of"], 200, 6)
    return out.select("setup", "scope", "rows", "windows", F.round("rank_ic", 6).alias("rank_ic"), F.round("net_spread", 6).alias("net_spread"))


@query(
    f"""WITH RECURSIVE {SQL_SNAPSHOTS}, {_SIGNALS}, i AS MATERIALIZED (SELECT symbol, as_of, conf AS w, dense_rank() OVER (ORDER BY as_of) AS n FROM signals),
    t AS (SELECT symbol, n, w >= 0.80 AS top FROM i WHERE n = 1 UNION ALL SELECT x.symbol, x.n, x.w >= 0.80 OR (coalesce(y.top, false) AND x.w >= 0.5) FROM (SELECT DISTINCT n FROM t) c JOIN i x ON x.n = c.n + 1 LEFT JOIN t y ON y.symbol = x.symbol)
    SELECT symbol, as_of, top FROM t JOIN i USING (symbol, n)"""
)
def sticky_holds(spark, sf):
    """Names of the book, and those that stay from the date before."""
    out = ex.sticky_top(_signals(spark, sf).select("symbol", "as_of", "confidence"), "symbol", "as_of", "confidence", 0.80)
    return out.select("symbol", "as_of", "top")
