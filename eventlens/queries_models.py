"""Registered queries on models, gates and matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlens import oracle as q
from eventlens.adapters import SQL_SNAPSHOTS, prices, snapshots, table
from eventlens.operators.asof import latest, nearest_join
from eventlens.operators.isotonic import isotonic_blocks
from eventlens.operators.rows import cut
from eventlens.plans import labels as lb
from eventlens.plans import models
from eventlens.queries import _RETURNS, query


_FRAME = f"""{_RETURNS}, rows AS (SELECT symbol, as_of, return_30d, return_90d, log10(market_cap + 1) AS cap, coalesce(revenue / nullif(market_cap, 0), 0.0) AS turn, coalesce((cash - debt) / nullif(market_cap, 0), 0.0) AS net, CAST(products AS DOUBLE) AS products
    FROM returns JOIN snapshots USING (symbol, as_of)), dates AS (SELECT DISTINCT as_of AS d FROM rows), train AS (SELECT d, r.* FROM dates JOIN rows r ON r.as_of <= d - INTERVAL 90 DAY)"""
_FEATURES = ["cap", "turn", "net", "products"]


def _frame(spark, sf):
    """Snapshots with four features and forward returns; written once, as models read them in several jobs."""
    base = snapshots(spark, sf)
    rows = lb.forward_returns(base, prices(spark, sf)).join(base, ["symbol", "as_of"])
    ratio = lambda x: F.coalesce(F.try_divide(x, F.col("market_cap")), F.lit(0.0))
    return cut(rows.select("symbol", "as_of", "return_30d", "return_90d", F.log10(F.col("market_cap") + 1).alias("cap"), ratio(F.col("revenue")).alias("turn"), ratio(F.col("cash") - F.col("debt")).alias("net"), F.col("products").cast("double").alias("products")))


@query(
    f"""WITH {_FRAME}, {q.ridge('fit', 'train', 'dates', _FEATURES, 'return_90d', 1.5)}
    SELECT symbol, as_of, round(coalesce(bias + b0 * cap + b1 * turn + b2 * net + b3 * products, 0.0), 6) AS prediction, round(return_90d, 6) AS return_90d FROM rows LEFT JOIN fit ON fit.d = as_of"""
)
def ridge_walk_forward(spark, sf):
    """Predictions of ridge models fitted walk-forward over all quarters, without look-ahead."""
    out = models.walk_forward(_frame(spark, sf), "as_of", _FEATURES, "return_90d")
    return out.select("symbol", "as_of", F.round("prediction", 6).alias("prediction"), F.round("return_90d", 6).alias("return_90d"))


_FAMILIES = {"size": ["cap"], "balance": ["turn", "net"], "products": ["products"]}
_LOST = {"size": "b1 * turn + b2 * net + b3 * products", "balance": "b0 * cap + b3 * products", "products": "b0 * cap + b1 * turn + b2 * net"}
_AVERAGE_RANK = "rank() OVER (PARTITION BY d, family ORDER BY {0}) + (count(*) OVER (PARTITION BY d, family, {0}) - 1) / 2.0"
_CORR = "CASE WHEN count(*) < 3 OR stddev_pop({0}) = 0 OR stddev_pop({1}) = 0 THEN 0.0 ELSE covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"


@query(
    f"""WITH {_FRAME}, {q.ridge('fit', 'train', 'dates', _FEATURES, 'return_90d', 1.5)},
    p AS (SELECT symbol, as_of AS d, return_90d AS y, round(coalesce(bias + b0 * cap + b1 * turn + b2 * net + b3 * products, 0.0), 9) AS base, {', '.join(f"round(coalesce(bias + {e}, 0.0), 9) AS {n}" for n, e in _LOST.items())}
      FROM rows LEFT JOIN fit ON fit.d = as_of WHERE return_90d IS NOT NULL),
    s AS ({' UNION ALL '.join(f"SELECT symbol, d, y, base, {n} AS ablated, '{n}' AS family FROM p" for n in _FAMILIES)}),
    r AS (SELECT *, {_AVERAGE_RANK.format('base')} AS r0, {_AVERAGE_RANK.format('ablated')} AS r1, {_AVERAGE_RANK.format('y')} AS ry, greatest(count(*) OVER (PARTITION BY d, family) // 5, 1) AS k,
      {', '.join(f"row_number() OVER (PARTITION BY d, family ORDER BY {c} {o}, symbol) AS {n}" for n, c, o in (('t0', 'base', 'DESC'), ('l0', 'base', 'ASC'), ('t1', 'ablated', 'DESC'), ('l1', 'ablated', 'ASC')))} FROM s)
    SELECT d AS as_of, family, count(*) AS rows, round({_CORR.format('r0', 'ry')} - {_CORR.format('r1', 'ry')}, 6) AS rank_ic_delta,
      round((avg(y) FILTER (WHERE t0 <= k) - avg(y) FILTER (WHERE l0 <= k)) - (avg(y) FILTER (WHERE t1 <= k) - avg(y) FILTER (WHERE l1 <= k)), 6) AS spread_delta, round({_CORR.format('r0', 'r1')}, 6) AS signal_correlation FROM r GROUP BY 1, 2"""
)
def ablation_deltas(spark, sf):
    """What the walk-forward model loses per quarter without each family of features."""
    rows = models.walk_forward(_frame(spark, sf), "as_of", _FEATURES, "return_90d", families=_FAMILIES)
    names = ["prediction", *[f"prediction_{f}" for f in _FAMILIES]]
    out = models.ablation_deltas(rows.withColumns({n: F.round(n, 9) for n in names}), "as_of", ["symbol"], list(_FAMILIES), "return_90d")
    return out.withColumns({c: F.round(c, 6) for c in ("rank_ic_delta", "spread_delta", "signal_correlation")})


@query(
    f"""WITH RECURSIVE points AS (SELECT floor(o_totalprice / 2000) AS x, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders), {q.isotonic('iso', 'points', 'x', 'y')}
    SELECT min(x) AS low, max(x) AS high, round(value, 9) AS value FROM iso GROUP BY value"""
)
def isotonic_steps(spark, sf):
    """The non-decreasing fit of an order's status over its price."""
    rows = table(spark, sf, "orders").select(F.floor(F.col("o_totalprice") / 2000).alias("x"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    return isotonic_blocks(rows, "x", "y").select("low", "high", F.round("value", 9).alias("value"))


_INPUTS = ["cap", "turn", "net", "market_flow_volatility"]
_LINE = "{0}.bias + {0}.b0 * cap + {0}.b1 * turn + {0}.b2 * net + {0}.b3 * market_flow_volatility"


@query(
    f"""WITH {_FRAME}, one AS (SELECT 0 AS d), f AS (SELECT 0 AS d, *, (products % 7) / 10 AS market_flow_volatility, CASE WHEN symbol % 20 > 0 THEN return_90d - return_30d END AS alpha, CASE WHEN return_30d > 0 THEN 1 WHEN return_30d IS NOT NULL THEN 0 END AS win,
      0.3 + 0.4 * products / (products + 10) AS rule FROM rows),
    u AS (SELECT *, alpha / CASE WHEN market_flow_volatility > 0.01 THEN market_flow_volatility ELSE 1.0 END AS y, CASE WHEN win > 0 THEN 2.0 ELSE -2.0 END AS c FROM f WHERE return_90d IS NOT NULL AND win IS NOT NULL AND alpha IS NOT NULL),
    {q.ridge('rg', 'u', 'one', _INPUTS, 'y', 1.5)}, {q.ridge('cl', 'u', 'one', _INPUTS, 'c', 2.0)},
    scored AS (SELECT f.*, round({_LINE.format('rg')}, 6) AS expected, round(0.4 * rule + 0.6 / (1 + exp(-least(greatest({_LINE.format('cl')}, -60), 60))), 5) AS blend FROM f, rg, cl),
    fitted AS (SELECT blend, win FROM scored WHERE return_90d IS NOT NULL AND win IS NOT NULL AND alpha IS NOT NULL), {q.isotonic('iso', 'fitted', 'blend', 'win')},
    l AS (SELECT s.symbol, s.as_of, s.expected, s.blend, lo.x AS x0, lo.value AS v0 FROM scored s ASOF LEFT JOIN iso lo ON s.blend >= lo.x), b AS (SELECT l.*, hi.x AS x1, hi.value AS v1 FROM l ASOF LEFT JOIN iso hi ON l.blend <= hi.x)
    SELECT symbol, as_of, expected, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR x1 = x0 THEN v0 ELSE v0 + (v1 - v0) * (blend - x0) / (x1 - x0) END, 6) AS probability FROM b"""
)
def training_flow(spark, sf):
    """Expected returns and calibrated chances of an ensemble trained on all snapshots with known outcomes."""
    rows = _frame(spark, sf).withColumns(
        {
            "market_flow_volatility": F.col("products") % 7 / 10, "target_return_90d": F.col("return_90d"), "target_alpha_90d": F.when(F.col("symbol") % 20 > 0, F.col("return_90d") - F.col("return_30d")),
            "target_catalyst_success": (F.col("return_30d") > 0).cast("int"), "rule": 0.3 + 0.4 * F.col("products") / (F.col("products") + 10),
        }
    )
    model = models.train_ensemble(rows, _INPUTS, F.col("rule"))
    return rows.select("symbol", "as_of", F.round(model.returns.predict(), 6).alias("expected"), F.round(model.probability(F.col("rule")), 6).alias("probability"))


@query(
    """WITH p AS (SELECT user_id, event_id AS buy, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, event_id AS click, ts AS moment FROM events WHERE event_type = 'click')
    SELECT buy, click FROM (SELECT buy, click, row_number() OVER (PARTITION BY buy ORDER BY abs(epoch_us(moment) - epoch_us(ts)), click) AS rn FROM p JOIN c USING (user_id)) WHERE rn = 1"""
)
def nearest_match(spark, sf):
    """Nearest click in time to every purchase of the same user."""
    rows = table(spark, sf, "events")
    buys = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy"), "ts")
    clicks = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("at"))
    return nearest_join(buys, clicks, ["user_id"], "ts", "at", "click").where("click is not null").select("buy", "click")


@query(
    """WITH a AS (SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_acctbal > 0), b AS (SELECT c_custkey AS k, c_name AS name FROM customer)
    SELECT n_nationkey, coalesce(a.name, b.name, 'unknown') AS name FROM nation LEFT JOIN a ON a.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey + 10"""
)
def coalesced_lookup(spark, sf):
    """Lookup by one key, else by another, else a default."""
    a = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ka"), F.col("s_name").alias("a"))
    b = table(spark, sf, "customer").select((F.col("c_custkey") - 10).alias("kb"), F.col("c_name").alias("b"))
    rows = table(spark, sf, "nation").join(a, F.col("n_nationkey") == F.col("ka"), "left").join(b, F.col("n_nationkey") == F.col("kb"), "left")
    return rows.select("n_nationkey", F.coalesce("a", "b", F.lit("unknown")).alias("name"))


@query(
    f"""WITH {SQL_SNAPSHOTS}, w AS (SELECT as_of, products // 5 AS stage, avg(revenue / nullif(market_cap, 0)) - 0.57 AS edge, count(*) AS n FROM snapshots GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY as_of DESC) AS rn FROM w)
    SELECT stage, count(*) AS windows, count(*) FILTER (WHERE rn <= 6 AND edge >= 0) AS good, CAST(sum(n) FILTER (WHERE rn <= 6) AS BIGINT) AS rows,
      count(*) FILTER (WHERE rn <= 4 AND edge >= 0) >= 3 AND sum(n) FILTER (WHERE rn <= 6) >= 20 AS gate FROM r GROUP BY 1"""
)
def trailing_gates(spark, sf):
    """Trailing windows per stage, how many are not negative, and the gate on them."""
    edge = F.avg(F.try_divide("revenue", F.col("market_cap"))) - 0.57
    w = snapshots(spark, sf).groupBy("as_of", F.floor(F.col("products") / 5).alias("stage")).agg(edge.alias("edge"), F.count("*").alias("n"))
    r = w.withColumn("rn", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("as_of"))))
    recent = F.sum(F.when(F.col("rn") <= 6, F.col("n")))
    return r.groupBy("stage").agg(
        F.count("*").alias("windows"), F.count_if((F.col("rn") <= 6) & (F.col("edge") >= 0)).alias("good"), recent.alias("rows"),
        ((F.count_if((F.col("rn") <= 4) & (F.col("edge") >= 0)) >= 3) & (recent >= 20)).alias("gate"),
    )


@query(
    """WITH x AS (SELECT s_suppkey, s_nationkey, s_acctbal, s_acctbal > 5000 AS held FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey, held ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM x)
    SELECT s_suppkey, held FROM r WHERE held OR rn <= 2"""
)
def slot_selection(spark, sf):
    """All held positions and the best two new ones per group."""
    rows = table(spark, sf, "supplier").withColumn("held", F.col("s_acctbal") > 5000)
    rank = F.row_number().over(Window.partitionBy("s_nationkey", "held").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return rows.withColumn("rn", rank).where("held or rn <= 2").select("s_suppkey", "held")


@query(
    """WITH x AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS n, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS kinds FROM orders GROUP BY 1)
    SELECT o_custkey, done, n, cents, kinds FROM x"""
)
def feedback_scorecards(spark, sf):
    """Counts, hit counts, totals and the distinct labels per profile."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100)).cast("bigint").alias("cents"),
        F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("kinds"),
    )


@query(
    """WITH t AS (SELECT s_suppkey AS k, s_nationkey % 2 = 0 AS ok FROM supplier)
    SELECT l_linestatus, count(*) FILTER (WHERE ok) AS matched, count(*) FILTER (WHERE NOT ok) AS unmatched, round(sum(abs(l_extendedprice)), 0) AS gross FROM lineitem JOIN t ON k = l_suppkey GROUP BY 1"""
)
def reconciliation(spark, sf):
    """Status counts and gross exposure of positions against a list."""
    listed = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 2 == 0).alias("ok"))
    rows = table(spark, sf, "lineitem").join(listed, F.col("l_suppkey") == F.col("k"))
    return rows.groupBy("l_linestatus").agg(F.count_if("ok").alias("matched"), F.count_if(~F.col("ok")).alias("unmatched"), F.round(F.sum(F.abs("l_extendedprice")), 0).alias("gross"))


@query(
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(avg(round(l_extendedprice * l_quantity)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS 19 PRECEDING), 4) AS volume FROM lineitem"""
)
def rolling_volume(spark, sf):
    """Mean value traded over the last twenty rows."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").rowsBetween(-19, 0)
    return table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.round(F.avg(F.round(F.col("l_extendedprice") * F.col("l_quantity"))).over(w), 4).alias("volume"))


@query(
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, role, n, regexp_matches(lower(text), 'th|an') AS marked FROM x WHERE rn = 1"""
)
def latest_turn(spark, sf):
    """Last turn of every conversation with its number of turns and a keyword flag."""
    rows = table(spark, sf, "conversations").withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    return latest(rows, ["conv_id"], [F.desc("turn"), F.asc("text")]).select("conv_id", "role", "n", F.lower("text").rlike("th|an").alias("marked"))
