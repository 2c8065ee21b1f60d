"""Registered queries on rebuilt history, nearest peers, the expectation lens and overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.adapters import SQL_CATALYSTS, SQL_PRICES, SQL_SNAPSHOTS, catalysts, prices, snapshots, table
from eventlens.functions.numeric import company_state
from eventlens.operators.asof import latest
from eventlens.operators.intervals import active_interval
from eventlens.operators.rankstats import nearest_peers, posture, with_peers
from eventlens.operators.rows import cut
from eventlens.plans import history, lens
from eventlens.queries import query


def _history_inputs(spark, sf):
    """Line items as filings and facts: their kind by part key, ended on the ship date and filed some days later."""
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("end"), "l_returnflag", "l_quantity", "l_extendedprice", "l_partkey")
    form = F.when(F.col("l_returnflag") == "A", "10-Q").when(F.col("l_returnflag") == "N", "10-K").otherwise("8-K")
    filings = lines.select("symbol", F.col("end").alias("filed"), form.alias("form"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("cash", "debt", "shares", "revenue")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    start = F.when(name == "revenue", F.date_sub("end", F.when(F.col("symbol") % 2 == 0, 365).otherwise(91)))
    value = F.when(name == "shares", F.col("l_quantity") * 1000).otherwise(F.col("l_extendedprice"))
    facts = lines.select("symbol", name.alias("name"), start.alias("start"), "end", F.date_add("end", (10 + F.col("l_quantity") % 50).cast("int")).alias("filed"), value.alias("val"))
    facts = facts.where((F.col("name") != "shares") | (F.col("symbol") % 3 != 0))
    closes = prices(spark, sf)
    now = latest(snapshots(spark, sf), ["symbol"], [F.desc("as_of")]).join(closes.groupBy("symbol").agg(F.max_by("close", "date").alias("price")), "symbol", "left")
    return filings, facts, closes, now


@query(
    f"""WITH RECURSIVE {SQL_PRICES}, {SQL_SNAPSHOTS},
    cur AS (SELECT s.*, p.price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC) AS rn FROM snapshots) s LEFT JOIN (SELECT symbol, arg_max(close, date) AS price FROM prices GROUP BY 1) p USING (symbol) WHERE rn = 1),
    d AS (SELECT DISTINCT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN cur ON l_suppkey = symbol WHERE l_returnflag <> 'R' AND CAST(l_shipdate AS DATE) < CAST(as_of AS DATE)),
    k AS (SELECT symbol, min(day) AS day FROM d GROUP BY 1 UNION ALL SELECT k.symbol, min(d.day) FROM k JOIN d ON d.symbol = k.symbol AND d.day >= k.day + 45 GROUP BY k.symbol, k.day),
    a AS (SELECT symbol, CAST(day AS DATE) AS as_of FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM k) WHERE rn <= 8),
    f AS (SELECT l_suppkey AS symbol, (['cash', 'debt', 'shares', 'revenue'])[l_partkey % 4 + 1] AS name, CAST(l_shipdate AS DATE) AS until, CAST(l_shipdate AS DATE) + CAST(10 + l_quantity % 50 AS INTEGER) AS filed,
      CASE WHEN l_partkey % 4 = 2 THEN l_quantity * 1000 ELSE l_extendedprice END AS val FROM lineitem WHERE l_partkey % 4 <> 2 OR l_suppkey % 3 <> 0),
    kf AS (SELECT a.as_of, f.* FROM a JOIN f USING (symbol) WHERE until <= as_of AND filed <= as_of),
    i AS (SELECT symbol, as_of, max(ROW(until, filed, val)) FILTER (WHERE name = 'cash') AS c, max(ROW(until, filed, val)) FILTER (WHERE name = 'debt') AS de, max(ROW(until, filed, val)) FILTER (WHERE name = 'shares') AS sh,
      max(ROW(until, filed, val)) FILTER (WHERE name = 'revenue') AS yr FROM kf GROUP BY 1, 2),
    qs AS (SELECT symbol, as_of, until, min(val) AS val FROM kf WHERE name = 'revenue' GROUP BY ALL),
    q AS (SELECT symbol, as_of, sum(val) * (365.0 / sum(91)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY symbol, as_of ORDER BY until DESC) AS rn FROM qs) WHERE rn <= 4 GROUP BY 1, 2),
    px AS (SELECT symbol, as_of, max(close) FILTER (WHERE n = 0) AS p0, max(close) FILTER (WHERE n = 90) AS p90, max(close) FILTER (WHERE n = 180) AS p180
      FROM (SELECT w.symbol, w.as_of, w.n, p.close FROM (SELECT symbol, as_of, n, as_of - n AS t FROM a, (SELECT unnest([0, 90, 180]) AS n)) w ASOF JOIN prices p ON w.symbol = p.symbol AND w.t >= p.date) GROUP BY 1, 2),
    vol AS (SELECT symbol, as_of, CASE WHEN count(r) >= 10 THEN stddev_samp(r) END AS v FROM (SELECT a.symbol, a.as_of, close / lag(close) OVER (PARTITION BY a.symbol, a.as_of ORDER BY date) - 1 AS r
      FROM a JOIN prices p ON p.symbol = a.symbol AND p.date BETWEEN a.as_of - 63 AND a.as_of) GROUP BY 1, 2),
    j AS (SELECT a.symbol, a.as_of, p0, p90, p180, vol.v AS volatility, coalesce(i.c[3], cur.cash, 0) AS cash, coalesce(i.de[3], cur.debt, 0) AS debt, coalesce(CASE WHEN a.symbol % 2 = 0 THEN i.yr[3] ELSE q.v END, 0) AS revenue,
      coalesce(i.sh[3], cur.market_cap / cur.price) AS shares, CASE WHEN i.sh[3] IS NOT NULL THEN 'filed' ELSE 'estimated_current' END AS shares_source
      FROM a JOIN px USING (symbol, as_of) LEFT JOIN vol USING (symbol, as_of) LEFT JOIN i USING (symbol, as_of) LEFT JOIN q USING (symbol, as_of) LEFT JOIN cur USING (symbol) WHERE p0 > 0)
    SELECT symbol, as_of, round(p0, 6) AS price, round(shares, 3) AS shares, shares_source, round(p0 * shares, 2) AS market_cap, round(greatest(p0 * shares + debt - cash, 0), 2) AS enterprise_value, round(revenue, 2) AS revenue,
      round(cash, 2) AS cash, round(debt, 2) AS debt, round(p0 / p90 - 1, 6) AS momentum_3mo, round(p0 / p180 - 1, 6) AS trailing_6mo_return, round(volatility, 6) AS volatility FROM j"""
)
def rebuilt_history(spark, sf):
    """Snapshots of every symbol at its last eight filing anchors, from facts ended and filed by then."""
    filings, facts, closes, now = _history_inputs(spark, sf)
    now = cut(now)  # a row per symbol; the anchors are eight at most: both are read by several joins
    rows = history.rebuilt_snapshots(cut(history.history_anchors(filings, now)), facts, closes, now)
    digits = {"price": 6, "shares": 3, "market_cap": 2, "enterprise_value": 2, "revenue": 2, "cash": 2, "debt": 2, "momentum_3mo": 6, "trailing_6mo_return": 6, "volatility": 6}
    return rows.withColumns({c: F.round(c, d) for c, d in digits.items()})


_LENS = f"""{SQL_CATALYSTS}, {SQL_SNAPSHOTS},
    c AS (SELECT symbol, as_of, market_cap * 5 AS market_cap, revenue * (symbol % 4) * 5 AS revenue, cash, debt, CASE WHEN symbol % 3 = 0 THEN 0 ELSE products END AS products FROM snapshots),
    p AS (SELECT symbol, date_trunc('quarter', as_of) AS as_of, program_id, count(*) * 1e8 AS market, program_id + 2 AS phase_rank, max(importance) / 2 AS pos FROM catalysts GROUP BY ALL),
    s AS (SELECT symbol, as_of, max(market) AS top_market, sum(market * CASE phase_rank WHEN 2 THEN 0.03 WHEN 3 THEN 0.05 WHEN 4 THEN 0.08 WHEN 5 THEN 0.12 END * pos) AS program_sales
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol, as_of ORDER BY market DESC, program_id) AS rn FROM p) WHERE rn <= 3 GROUP BY 1, 2),
    x AS (SELECT c.*, coalesce(top_market, 0) AS top_market, coalesce(program_sales, 0) AS program_sales,
      CASE WHEN revenue >= 500000000 THEN 'commercialized' WHEN products > 0 OR revenue >= 75000000 THEN 'commercial_launch' ELSE 'pre_commercial' END AS state FROM c LEFT JOIN s USING (symbol, as_of)),
    m AS (SELECT *, CASE WHEN state = 'pre_commercial' THEN 'market-cap/TAM' ELSE 'EV/revenue' END AS metric,
      CASE WHEN state = 'pre_commercial' THEN market_cap / greatest(top_market, 1.0) ELSE greatest(market_cap + debt - cash, 0) / greatest(revenue, 1.0) END AS multiple FROM x),
    o AS (SELECT *, row_number() OVER (PARTITION BY as_of, metric ORDER BY multiple, symbol) AS rn FROM m)"""


def _lens_rows(spark, sf):
    """Companies by quarter with state, programs' market, and the multiple that compares them."""
    c = snapshots(spark, sf).select("symbol", "as_of", (F.col("market_cap") * 5).alias("market_cap"), (F.col("revenue") * (F.col("symbol") % 4) * 5).alias("revenue"), "cash", "debt", F.when(F.col("symbol") % 3 == 0, 0).otherwise(F.col("products")).alias("products"))
    p = catalysts(spark, sf).groupBy("symbol", F.date_trunc("quarter", "as_of").alias("as_of"), "program_id").agg((F.count("*") * 1e8).alias("market"), (F.max("importance") / 2).alias("pos"))
    sales = lens.program_sales(p.withColumn("phase_rank", (F.col("program_id") + 2).cast("int")), ["symbol", "as_of"], "program_id")
    rows = c.join(sales, ["symbol", "as_of"], "left").na.fill(0.0, ["top_market", "program_sales"]).withColumn("company_state", company_state(F.col("products"), F.col("revenue")))
    early = F.col("company_state") == "pre_commercial"
    value = F.greatest(F.col("market_cap") + F.col("debt") - F.col("cash"), F.lit(0.0))
    return rows.withColumns({"metric": F.when(early, "market-cap/TAM").otherwise("EV/revenue"), "multiple": F.when(early, F.col("market_cap") / F.greatest("top_market", F.lit(1.0))).otherwise(value / F.greatest("revenue", F.lit(1.0)))})


@query(
    f"""WITH {_LENS}, n AS (SELECT a.symbol, a.as_of, b.symbol AS peer, row_number() OVER (PARTITION BY a.symbol, a.as_of ORDER BY abs(b.multiple - a.multiple), abs(b.rn - a.rn), b.rn) AS k
      FROM o a JOIN o b ON a.as_of = b.as_of AND a.metric = b.metric AND a.symbol <> b.symbol AND abs(a.rn - b.rn) <= 3)
    SELECT symbol, as_of, coalesce(peers, '') AS peers FROM m LEFT JOIN (SELECT symbol, as_of, string_agg(peer, ' ' ORDER BY k) AS peers FROM n WHERE k <= 3 GROUP BY 1, 2) USING (symbol, as_of)"""
)
def closest_peers(spark, sf):
    """The three peers of the same metric and quarter with the nearest multiples."""
    rows = nearest_peers(_lens_rows(spark, sf), ["as_of", "metric"], "symbol", "multiple")
    return rows.select("symbol", "as_of", F.array_join(F.col("nearest").cast("array<string>"), " ").alias("peers"))


@query(
    f"""WITH {_LENS}, md AS (SELECT a.symbol, a.as_of, median(b.multiple) AS median_multiple FROM m a JOIN m b ON a.as_of = b.as_of AND a.metric = b.metric AND a.symbol <> b.symbol GROUP BY 1, 2),
    y AS (SELECT m.*, median_multiple, coalesce(median_multiple, 0) AS med, program_sales * least(greatest(1.0 - 0.40 * 0.82, 0.35), 0.90) AS sales, greatest(market_cap, 1.0) AS cap, greatest(cash - debt, 0.0) AS net FROM m LEFT JOIN md USING (symbol, as_of)),
    z AS (SELECT *, CASE WHEN med <= 0 THEN 0.0 WHEN state = 'pre_commercial' THEN top_market * med WHEN revenue > 0 THEN revenue * med ELSE 0.0 END AS peer FROM y),
    v AS (SELECT *, CASE WHEN state = 'pre_commercial' THEN 0.45 * peer + 0.55 * sales * (2.1 + CASE WHEN symbol % 5 = 0 THEN 0.15 ELSE 0.0 END) + net + 0.15 * revenue
      WHEN state = 'commercial_launch' THEN net + 0.15 * revenue + CASE WHEN peer > 0 THEN 0.50 * peer + 0.35 * revenue * least(greatest(CASE WHEN med <> 0 THEN med ELSE 5.0 END * 0.95, 2.5), 9.0) + 0.15 * sales * 2.0
        ELSE 0.65 * revenue * least(greatest(CASE WHEN med <> 0 THEN med ELSE 5.0 END * 0.95, 2.5), 9.0) + 0.35 * sales * 2.0 END
      ELSE 0.75 * net + CASE WHEN peer > 0 THEN 0.65 * peer + 0.20 * revenue * least(greatest(CASE WHEN med <> 0 THEN med ELSE 4.0 END * 0.975, 2.0), 8.0) + 0.15 * sales * 1.525
        ELSE 0.70 * revenue * least(greatest(CASE WHEN med <> 0 THEN med ELSE 4.0 END * 0.975, 2.0), 8.0) + 0.30 * sales * 1.525 END END AS internal FROM z),
    u AS (SELECT *, least(greatest(internal / cap - 1.0, -0.85), 2.5) AS up FROM v)
    SELECT symbol, as_of, state AS company_state, round(internal, 4) AS internal_value, round(up, 6) AS internal_upside, round(10 * internal / cap, 4) AS price_target, round(CASE WHEN peer > 0 THEN peer / cap - 1.0 ELSE up END, 6) AS peer_gap,
      CASE WHEN median_multiple IS NULL THEN 'unknown' WHEN multiple > median_multiple * 1.15 THEN 'rich' WHEN multiple < median_multiple * 0.85 THEN 'discounted' ELSE 'near peer median' END AS posture,
      CASE WHEN up >= 0.35 THEN 'high positive asymmetry' WHEN up >= 0.15 THEN 'moderate positive asymmetry' WHEN up > -0.10 THEN 'balanced / fairly priced' ELSE 'negative asymmetry' END AS asymmetry FROM u"""
)
def expectation_lens(spark, sf):
    """Peer-anchored value, upside, target price and posture of every company and quarter."""
    rows = with_peers(_lens_rows(spark, sf), ["as_of", "metric"], "symbol", "multiple").withColumnRenamed("peer_median", "median_multiple")
    rows = rows.withColumns(
        {
            "risk_adjusted_sales": lens.risk_adjusted(F.col("program_sales"), F.lit(0.82)), "price": F.lit(10.0), "launch_progress": F.lit(0.5), "lifecycle": F.lit(0.5), "optionality": F.lit(0.5), "deployment": F.lit(0.5),
            "exact_event": F.col("symbol") % 5 == 0,
        }
    )
    out = lens.expectation_lens(rows).withColumn("posture", posture(F.col("multiple"), F.col("median_multiple")))
    digits = {"internal_value": 4, "internal_upside": 6, "price_target": 4, "peer_gap": 6}
    return out.select("symbol", "as_of", "company_state", *[F.round(c, d).alias(c) for c, d in digits.items()], "posture", "asymmetry")


@query(
    """WITH o AS (SELECT event_id AS override_id, user_id, ts AS effective_on, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + to_days(CAST(1 + event_id % 40 AS INTEGER)) END AS expires_on, value FROM events WHERE event_type = 'error'),
    r AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'error')
    SELECT event_id, override_id, value FROM (SELECT r.event_id, o.override_id, o.value, row_number() OVER (PARTITION BY r.event_id ORDER BY effective_on DESC, override_id DESC) AS rn
      FROM r LEFT JOIN o ON o.user_id = r.user_id AND o.effective_on <= r.ts AND (o.expires_on IS NULL OR o.expires_on >= r.ts)) WHERE rn = 1"""
)
def active_overrides(spark, sf):
    """The override in force at each event of a user: errors open intervals that overlap, some without an end."""
    rows = table(spark, sf, "events")
    ends = F.when(F.col("event_id") % 4 != 0, F.col("ts") + F.make_dt_interval((1 + F.col("event_id") % 40).cast("int")))
    overrides = rows.where("event_type = 'error'").select(F.col("event_id").alias("override_id"), "user_id", F.col("ts").alias("effective_on"), ends.alias("expires_on"), "value")
    events = rows.where("event_type <> 'error'").select("event_id", "user_id", "ts")
    return active_interval(events, overrides, ["user_id"], "ts", "effective_on", "expires_on", "override_id").select("event_id", "active.override_id", "active.value")
