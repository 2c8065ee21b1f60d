"""Registered queries on books and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.adapters import SQL_SNAPSHOTS, snapshots, table
from eventlens.plans import books
from eventlens.queries import query

_RANKS = (("click", 3), ("purchase", 2), ("view", 1))


@query(
    """WITH p AS (SELECT user_id, event_id AS plan, ts AS planned FROM events WHERE event_type = 'view'), s AS (SELECT user_id, event_id AS order_id, ts AS submitted FROM events WHERE event_type = 'purchase'),
    m AS (SELECT plan, order_id, submitted, row_number() OVER (PARTITION BY plan ORDER BY abs(epoch_us(submitted) - epoch_us(planned)), submitted, order_id) AS rn FROM p JOIN s USING (user_id) WHERE submitted BETWEEN planned - INTERVAL 2 MINUTE AND planned + INTERVAL 2 DAY)
    SELECT p.plan, order_id, submitted FROM p LEFT JOIN (SELECT * FROM m WHERE rn = 1) m USING (plan)"""
)
def submission_match(spark, sf):
    """Views matched with the nearest purchase of the user in the days after."""
    rows = table(spark, sf, "events")
    plans = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("plan"), F.col("ts").alias("planned"))
    sent = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("order_id"), F.col("ts").alias("submitted"))
    return books.matched_submissions(plans, sent, "user_id", "planned", "submitted", "plan", ["order_id"]).select("plan", "order_id", "submitted")


@query(
    """WITH x AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS k FROM orders)
    SELECT o_orderkey, k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM x WHERE k IS NOT NULL) WHERE rn = 1 UNION ALL SELECT o_orderkey, k FROM x WHERE k IS NULL"""
)
def trade_dedupe(spark, sf):
    """Latest order per customer, and all without one."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("k"))
    return books.latest_trades(rows, "k", "o_orderdate", ["o_orderkey"]).select("o_orderkey", "k")


@query(
    """WITH x AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'click' THEN 3 WHEN 'purchase' THEN 2 WHEN 'view' THEN 1 ELSE 0 END DESC, ts DESC) AS rn FROM x)
    SELECT user_id, event_type, ts FROM r WHERE rn = 1"""
)
def listing_choice(spark, sf):
    """The row of the best source per key, then the newest."""
    rows = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    return books.best_listing(rows, "user_id", "event_type", _RANKS, "ts")


@query(
    """SELECT p_partkey AS symbol, coalesce(s_name, c_name, CAST(p_partkey AS VARCHAR)) AS company_name FROM part LEFT JOIN supplier ON s_suppkey = p_partkey LEFT JOIN customer ON c_custkey = p_partkey"""
)
def name_resolution(spark, sf):
    """Names from one table (suppliers), else another (customers), else the key: there are more parts than customers, and more customers than suppliers."""
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("company_name"), F.col("s_acctbal").alias("as_of"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("company_name"), F.col("c_acctbal").alias("as_of"))
    return books.resolved_names(table(spark, sf, "part").select(F.col("p_partkey").alias("symbol")), a, b)


@query(
    """WITH r AS (SELECT CAST(p_size AS VARCHAR) AS ticker, p_partkey, p_name FROM part), c AS (SELECT CAST(s_suppkey % 50 AS VARCHAR) AS ticker, sum(s_acctbal) AS revenue FROM supplier GROUP BY 1)
    SELECT ticker, ticker || ':approved:' || row_number() OVER (PARTITION BY ticker ORDER BY p_partkey) AS product_id, round(greatest(revenue, 0) / count(*) OVER (PARTITION BY ticker), 4) AS annual_revenue FROM c JOIN r USING (ticker)"""
)
def registry_products(spark, sf):
    """Revenue of each company split over its registered products."""
    registry = table(spark, sf, "part").select(F.col("p_size").cast("string").alias("ticker"), F.col("p_partkey").alias("position"), F.col("p_name").alias("name"))
    companies = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 50).cast("string").alias("ticker")).agg(F.sum("s_acctbal").alias("revenue"))
    out = books.product_revenue(companies, registry)
    return out.select("ticker", "product_id", F.round("annual_revenue", 4).alias("annual_revenue"))


@query(
    """WITH r AS (SELECT user_id, ts, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events WHERE event_type <> 'error')
    SELECT user_id, max(ts) AS ts, arg_max(k, ts) AS k, coalesce(arg_max(value, ts), -1.0) AS value FROM r WHERE event_type = 'click' GROUP BY 1"""
)
def last_payload(spark, sf):
    """Payload of the last click of each user, with a default for what it lacks."""
    from pyspark.sql import types as T

    payload = F.struct(F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))["k"].alias("k"), F.col("value"))
    runs = table(spark, sf, "events").select("user_id", "ts", "event_type", payload.alias("p"))
    out = books.last_success(runs, ["user_id"], "ts", F.col("event_type") == "click", "p")
    older = F.struct(F.lit(-1).cast("bigint").alias("k"), F.lit(-1.0).alias("value"))
    return out.select("user_id", "ts", books.merged_payload(F.col("p"), older, ["k", "value"]).alias("m")).select("user_id", "ts", "m.k", "m.value")


@query(
    f"""WITH {SQL_SNAPSHOTS}, x AS (SELECT *, CASE WHEN products % 2 = 0 THEN market_cap / 2 END AS newer FROM snapshots)
    SELECT as_of, round(median(coalesce(newer, market_cap)), 2) AS median_market_cap, round(median(revenue), 2) AS median_revenue FROM x GROUP BY 1"""
)
def overlay_medians(spark, sf):
    """Newer values put over older ones, and the medians of the result."""
    rows = books.overlaid(snapshots(spark, sf).withColumn("latest_market_cap", F.when(F.col("products") % 2 == 0, F.col("market_cap") / 2)))
    out = books.exposure_medians(rows, ["as_of"], ["market_cap", "revenue"])
    return out.select("as_of", *[F.round(c, 2).alias(c) for c in ("median_market_cap", "median_revenue")])


@query(
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%dT06:00:00') END AS t FROM orders)
    SELECT o_orderkey, coalesce(CASE WHEN length(t) = 10 THEN CAST(t AS DATE) >= DATE '1997-01-01' ELSE CAST(t AS TIMESTAMP) >= TIMESTAMP '1997-01-01 12:00:00' END, false) AS upcoming FROM x"""
)
def upcoming_dates(spark, sf):
    """Whether date texts lie ahead of a clock, bare dates by day."""
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'06:00:00"))
    return table(spark, sf, "orders").select("o_orderkey", books.is_upcoming(text, F.lit("1997-01-01 12:00:00").cast("timestamp")).alias("upcoming"))
