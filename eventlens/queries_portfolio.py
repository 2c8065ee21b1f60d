"""Registered queries on sources, portfolios and monitoring; added to the registry of ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlens.adapters import SQL_PRICES, SQL_SNAPSHOTS, prices, snapshots, table
from eventlens.operators.asof import carried_forward, latest
from eventlens.plans import portfolio as pf
from eventlens.queries import query
from eventlens.sources import filings, tables


@query(
    """WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), b AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
    SELECT * FROM b EXCEPT SELECT * FROM a"""
)
def append_distinct(spark, sf):
    """Rows to append: incoming rows that the table does not hold."""
    rows = table(spark, sf, "orders")
    cut = F.lit("1998-01-01").cast("timestamp")
    return tables.new_rows(rows.where(F.col("o_orderdate") < cut).select("o_custkey", "o_orderstatus"), rows.where(F.col("o_orderdate") >= cut).select("o_custkey", "o_orderstatus"))


@query(
    """SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS kind FROM customer WHERE c_mktsegment <> 'BUILDING' UNION SELECT s_nationkey, 'BUILDING' FROM supplier"""
)
def partial_overwrite(spark, sf):
    """One provenance replaced, the others kept."""
    held = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("kind"))
    fresh = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("BUILDING").alias("kind"))
    return tables.partial_overwrite(held, fresh, F.col("kind") == "BUILDING")


@query(
    """WITH a AS (SELECT l_partkey AS k, count(*) AS n, 'returned' AS source FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n, 'all' AS source FROM lineitem GROUP BY 1)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)"""
)
def source_fallback(spark, sf):
    """First source with rows wins per key."""
    lines = table(spark, sf, "lineitem")
    count = lambda df, name: df.groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n")).withColumn("source", F.lit(name))
    return tables.first_source([count(lines.where("l_returnflag = 'R'"), "returned"), count(lines, "all")], "k")


@query(
    """WITH x AS (SELECT o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey)[1:2] AS amounts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT o_orderkey, unnest(parts) AS part, unnest(list_resize(amounts, len(parts))) AS amount FROM x"""
)
def ragged_arrays(spark, sf):
    """Parallel arrays of different length to rows, padded with nulls."""
    item = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    docs = lines.groupBy("o_orderkey").agg(item.alias("x")).select("o_orderkey", F.col("x.l_partkey").alias("part"), F.slice("x.l_quantity", 1, 2).alias("amount"))
    return filings.filing_rows(docs, "o_orderkey", ["part", "amount"])


def _facts(spark, sf):
    """Orders as quarterly and yearly duration facts of a customer's nation, filed 30 days after their end."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    def spans(unit: str, months: int):
        start = F.date_trunc(unit, "o_orderdate").cast("date")
        rows = orders.groupBy(F.col("c_nationkey").alias("k"), start.alias("start")).agg(F.round(F.sum("o_totalprice"), 2).alias("val"))
        end = F.date_sub(F.add_months("start", months), 1)
        return rows.select("k", "start", end.alias("end"), F.date_add(end, 30).alias("filed"), "val")
    dates = spark.range(8).select(F.add_months(F.lit("1996-05-15").cast("date"), (F.col("id") * 7).cast("int")).alias("as_of"))
    return spans("quarter", 3).unionByName(spans("year", 12)).join(F.broadcast(dates))


_FACTS = """f AS (SELECT c_nationkey AS k, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS start, 3 AS m, round(sum(o_totalprice), 2) AS val FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
  UNION ALL SELECT c_nationkey, CAST(date_trunc('year', o_orderdate) AS DATE), 12, round(sum(o_totalprice), 2) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  d AS (SELECT CAST(DATE '1996-05-15' + to_months(CAST(i * 7 AS INTEGER)) AS DATE) AS as_of FROM range(8) t(i)),
  x AS (SELECT k, start, CAST(start + to_months(m) AS DATE) - 1 AS until, val, as_of, m FROM f, d WHERE CAST(start + to_months(m) AS DATE) + 29 <= as_of)"""


@query(
    f"""WITH {_FACTS}, a AS (SELECT k, as_of, arg_max(val, until) AS annual FROM x WHERE m = 12 GROUP BY 1, 2),
    q AS (SELECT k, as_of, sum(val) * (365.0 / sum(until - start)) AS quarters FROM (SELECT *, row_number() OVER (PARTITION BY k, as_of ORDER BY until DESC) AS rn FROM x WHERE m = 3) WHERE rn <= 4 GROUP BY 1, 2)
    SELECT k, as_of, round(coalesce(annual, quarters), 2) AS value FROM a FULL JOIN q USING (k, as_of)"""
)
def trailing_year(spark, sf):
    """Trailing-year value as known at several dates."""
    return filings.trailing_value(_facts(spark, sf), ["k", "as_of"], "as_of").withColumn("value", F.round("value", 2))


@query(f"WITH {_FACTS} SELECT k, as_of, arg_max(val, until) AS value FROM x WHERE m = 3 GROUP BY 1, 2")
def instant_value(spark, sf):
    """Latest quarterly value filed by a date."""
    return filings.instant_value(_facts(spark, sf).where(F.datediff("end", "start") < 120), ["k", "as_of"], "as_of")


@query(
    f"""WITH {SQL_PRICES}, m AS (SELECT symbol, count(*) AS n, first(close ORDER BY date) AS opening, last(close ORDER BY date) AS closing, list(close ORDER BY date) AS c FROM prices GROUP BY 1)
    SELECT symbol, round(closing / opening - 1, 6) AS whole, round(closing / c[n // 2 + 1] - 1, 6) AS second_half FROM m"""
)
def momentum(spark, sf):
    """Return of the whole tape and of its second half."""
    n, place = F.count("*").over(Window.partitionBy("symbol")), F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    rows = prices(spark, sf).withColumns({"n": n, "place": place}).groupBy("symbol").agg(
        F.max(F.when(F.col("place") == 1, F.col("close"))).alias("first"), F.max(F.when(F.col("place") == F.col("n"), F.col("close"))).alias("last"),
        F.max(F.when(F.col("place") == F.floor(F.col("n") / 2) + 1, F.col("close"))).alias("middle"),
    )
    return rows.select("symbol", F.round(F.col("last") / F.col("first") - 1, 6).alias("whole"), F.round(F.col("last") / F.col("middle") - 1, 6).alias("second_half"))


@query(
    """WITH x AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate, max(l_shipdate) OVER (PARTITION BY l_suppkey) AS latest FROM lineitem)
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM x WHERE l_shipdate >= latest - INTERVAL 10 DAY"""
)
def latest_cluster(spark, sf):
    """Rows near the latest one of their key."""
    newest = F.max("l_shipdate").over(Window.partitionBy("l_suppkey"))
    rows = table(spark, sf, "lineitem").withColumn("latest", newest).where("l_shipdate >= latest - INTERVAL 10 DAYS")
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query(
    f"""WITH {SQL_SNAPSHOTS}, t AS (SELECT DISTINCT as_of + INTERVAL 40 DAY AS test FROM snapshots),
    r AS (SELECT test, symbol, s.as_of, market_cap, row_number() OVER (PARTITION BY test, symbol ORDER BY s.as_of DESC) AS rn FROM t JOIN snapshots s ON s.as_of <= test AND s.as_of >= test - INTERVAL 120 DAY)
    SELECT test, symbol, as_of, market_cap FROM r WHERE rn = 1"""
)
def carry_forward(spark, sf):
    """Per test date and symbol the latest snapshot within 120 days."""
    base = snapshots(spark, sf)
    tests = base.select((F.col("as_of") + F.expr("INTERVAL 40 DAYS")).alias("test")).distinct()
    return carried_forward(base, tests, ["symbol"], "as_of", "test", 120).select("test", "symbol", "as_of", "market_cap")


@query(
    f"""WITH {SQL_SNAPSHOTS}, n AS (SELECT *, count(*) OVER (PARTITION BY as_of ORDER BY products RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM snapshots),
    w AS (SELECT symbol, as_of, near, least(revenue / nullif(market_cap, 0) / sqrt(near), 0.4) AS c FROM n)
    SELECT symbol, as_of, near - 1 AS neighbours, round(c * least(1.0, 2.0 / sum(c) OVER (PARTITION BY as_of)), 6) AS target FROM w"""
)
def sized_plan(spark, sf):
    """Capped weights scaled to a gross limit, with the number of correlated rows."""
    rows = snapshots(spark, sf).withColumn("w", F.try_divide("revenue", F.col("market_cap")))
    rows = pf.capped_plan(pf.correlated_shares(rows, ["as_of"], "products", "w", 3), ["as_of"], "scaled", 0.4, 2.0)
    return rows.select("symbol", "as_of", "neighbours", F.round("target", 6).alias("target"))


@query(
    """WITH p AS (SELECT c_nationkey AS k, round(sum(c_acctbal) / 1e6, 4) AS target FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1), h AS (SELECT s_nationkey AS k, round(sum(s_acctbal) / 1e5, 4) AS held FROM supplier GROUP BY 1)
    SELECT k, round(coalesce(target, 0) - coalesce(held, 0), 4) AS change, CASE WHEN target IS NULL AND held > 0 THEN 'exit' WHEN abs(coalesce(target, 0) - coalesce(held, 0)) < 0.05 THEN 'hold' WHEN coalesce(target, 0) > coalesce(held, 0) THEN 'buy' ELSE 'sell' END AS side
    FROM p FULL JOIN h USING (k)"""
)
def order_plan(spark, sf):
    """Sides and sizes of a plan against positions."""
    plan = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal") / 1e6, 4).alias("target"))
    held = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.sum("s_acctbal") / 1e5, 4).alias("held"))
    return pf.orders(plan, held, ["k"], 0.05).select("k", F.round("change", 4).alias("change"), "side")


@query(
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END, CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' END], lambda x: x IS NOT NULL), ',') AS flags,
    round(list_sum(list_transform(range(1, 13), lambda y: p_retailprice * least(y / 5.0, 1.0) / pow(1.1, y))), 4) AS value FROM part"""
)
def flags_and_value(spark, sf):
    """Risk flags as a list and a discounted twelve-year sum, without exploding years."""
    flags = pf.risk_flags({"large": F.col("p_size") > 40, "dear": F.col("p_retailprice") > 1500, "brass": F.col("p_type").contains("BRASS")})
    ramp = [min(y / 5.0, 1.0) for y in range(1, 13)]
    return table(spark, sf, "part").select("p_partkey", F.array_join(flags, ",").alias("flags"), F.round(pf.present_value(F.col("p_retailprice"), 0.1, ramp), 4).alias("value"))


@query(
    """WITH x AS (SELECT n_regionkey AS r, c_custkey, 1 - least(greatest(c_acctbal, 0) / 10000, 1) AS fail, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT r, round(1 - product(fail), 6) AS success FROM x WHERE rn <= 3 GROUP BY 1"""
)
def joint_success(spark, sf):
    """One less the product of failures of the three best rows."""
    rows = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("c_acctbal"), "c_custkey"))).where("rn <= 3")
    fail = 1 - F.least(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 10000, F.lit(1.0))
    return rows.groupBy(F.col("n_regionkey").alias("r")).agg(F.round(1 - F.product(fail), 6).alias("success"))


@query(
    """WITH x AS (SELECT user_id, event_type, count(*) AS n, max(length(props)) AS l FROM events GROUP BY 1, 2)
    SELECT user_id, arg_min(event_type, struct_pack(a := -n, b := -l, c := event_type)) AS mode FROM x GROUP BY 1"""
)
def modal_value(spark, sf):
    """Most frequent value per key, ties to the longest text, then by name."""
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max(F.length("props")).alias("l"))
    return counts.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), -F.col("l"), F.col("event_type"))).alias("mode"))


@query(
    """WITH c AS (SELECT max(ts) AS t FROM events), a AS (SELECT DISTINCT user_id FROM events, c WHERE event_type = 'purchase' AND ts >= t - INTERVAL 240 HOUR),
    s AS (SELECT user_id, max(ts) AS seen FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT a.user_id, date_diff('minute', seen, t) // 60 AS stale_hours FROM a JOIN s USING (user_id), c WHERE seen < t - INTERVAL 18 HOUR"""
)
def stale_triggers(spark, sf):
    """Active users whose last view is older than 18 hours."""
    rows = table(spark, sf, "events")
    clock = rows.agg(F.max("ts").alias("t"))
    active = rows.where("event_type = 'purchase'").join(F.broadcast(clock), F.col("ts") >= F.col("t") - F.expr("INTERVAL 240 HOURS")).select("user_id").distinct()
    seen = rows.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("seen")).join(active, "user_id", "left_semi")
    minutes = F.floor(F.unix_timestamp("t") / 60) - F.floor(F.unix_timestamp("seen") / 60)
    return seen.join(F.broadcast(clock), F.col("seen") < F.col("t") - F.expr("INTERVAL 18 HOURS")).select("user_id", F.floor(minutes / 60).alias("stale_hours"))


@query(
    """WITH x AS (SELECT event_id % 500 AS k, event_id, ts, event_type FROM events)
    SELECT k, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (event_type = 'purchase') DESC, ts, event_id) AS rn FROM x) WHERE rn = 1"""
)
def ingest_dedupe(spark, sf):
    """One row per key, exact rows before others, then the first to arrive."""
    rows = table(spark, sf, "events").withColumn("k", F.col("event_id") % 500)
    return latest(rows, ["k"], [F.desc(F.col("event_type") == "purchase"), F.asc("ts"), F.asc("event_id")]).select("k", "event_id", "event_type")
