"""Registered queries on feeds, monitoring and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import oracle as q
from eventlens.adapters import SQL_PRICES, SQL_SNAPSHOTS, TITLES, prices, snapshots, table
from eventlens.functions import taxonomy as t
from eventlens.functions.landscape import TEXT_FAMILIES
from eventlens.plans import labels as lb
from eventlens.plans import monitor as mo
from eventlens.queries import _RETURNS, query
from eventlens.queries_recommend import _SIGNALS, _signals
from eventlens.sources import feeds
from eventlens.sources.calendars import calendar_events, document_fields
from eventlens.sources.listings import OFFERING_FORMS, filing_summaries, listings, recent_news_events

HEADLINES = (
    "Company announces definitive agreement, closing expected in Q3 2029",
    "Company to withdraw its application in the second half of 1996",
    "Board announces share repurchase through first quarter 31",
    "Company reports positive topline phase 3 data",
    "A quiet day on the market",
    "Company announces proposed public offering",
    "Company receives supplemental NDA approval, launch in 2H-2030",
    "Reports financial results for the year",
    "FDA advisory committee votes in favor",
)
_HEAD = f"([{', '.join(repr(t) for t in HEADLINES)}])[o_orderkey % {len(HEADLINES)} + 1]"
_NEWS_CASE = "CASE " + " ".join(f"WHEN {q.any_of('h', m)} THEN '{n}'" for n, _, m in feeds.NEWS_TYPES) + f" ELSE {q.inferred('h')} END"


@query(
    f"""WITH n AS (SELECT o_orderkey, o_orderdate AS published, lower({_HEAD}) || ' ' AS h, o_custkey % 3 = 0 AS other FROM orders),
    c AS (SELECT *, {_NEWS_CASE} AS kind FROM n WHERE NOT other AND {q.any_of('h', feeds.NEWS_VERBS)}),
    g AS (SELECT *, CASE WHEN contains(h, 'q3 2029') THEN DATE '2029-09-30' WHEN contains(h, 'quarter 31') THEN DATE '2031-03-31' WHEN contains(h, '2h-2030') THEN DATE '2030-12-31' END AS period FROM c),
    e AS (SELECT *, CASE WHEN kind IN {feeds.GUIDED_TYPES} AND period >= CAST(published AS DATE) THEN CAST(period AS TIMESTAMP) END AS guided FROM g)
    SELECT o_orderkey, kind AS event_type, CAST({q.lookup('kind', [(n, i) for n, i, _ in feeds.NEWS_TYPES] + list(feeds.INFERRED_IMPORTANCE), -1.0)} AS DOUBLE) AS importance, coalesce(guided, published) AS expected_date,
      CASE WHEN guided IS NULL THEN 'exact_press_release' ELSE 'guided_company_event' END AS status FROM e
    WHERE kind IN {tuple([n for n, _, _ in feeds.NEWS_TYPES] + [n for n, _ in feeds.INFERRED_IMPORTANCE])}"""
)
def news_feed(spark, sf):
    """News rows as events with their guided dates."""
    headline = F.get(F.array(*[F.lit(t) for t in HEADLINES]), (F.col("o_orderkey") % len(HEADLINES)).cast("int"))
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.lit("ABC").alias("symbol"), F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("XYZ"))).otherwise(F.array(F.lit("abc"), F.lit("XYZ"))).alias("symbols"),
        headline.alias("title"), F.lit("").alias("content"), F.array().cast("array<string>").alias("tags"), F.col("o_orderdate").alias("date"),
    )
    return feeds.news_events(rows).select("o_orderkey", "event_type", "importance", F.col("expected_date").cast("timestamp_ntz").alias("expected_date"), "status")


@query(
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(CASE o_orderkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 12 END) AS expected_date, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0.60 ELSE 0.55 END AS DOUBLE) AS importance,
    CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 90 END ELSE CAST(o_orderdate AS DATE) + 85 END AS next_report FROM orders"""
)
def report_calendar(spark, sf):
    """Earnings rows with the hour of their session, and when the next report is due."""
    session = F.get(F.array(F.lit("BeforeMarket"), F.lit("AfterMarket"), F.lit(None)), (F.col("o_orderkey") % 3).cast("int"))
    day = F.to_date("o_orderdate")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("symbol"), day.cast("string").alias("report_date"), session.alias("before_after_market"), F.when(F.col("o_orderkey") % 2 == 0, 1.0).alias("percent")
    )
    events = feeds.earnings_events(rows).select(F.col("symbol").cast("bigint").alias("o_orderkey"), F.col("expected_date").cast("timestamp_ntz").alias("expected_date"), F.col("importance").cast("double").alias("importance"))
    due = feeds.estimated_report(F.when(F.col("o_orderkey") % 5 != 0, day), F.when(F.col("o_orderkey") % 2 == 0, day))
    return events.join(table(spark, sf, "orders").select("o_orderkey", due.alias("next_report")), "o_orderkey")


@query(
    """SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, round(CASE WHEN l_linenumber % 3 = 0 THEN l_extendedprice ELSE l_extendedprice / 2 END, 4) AS close FROM lineitem WHERE NOT (l_linenumber % 3 <> 0 AND l_linenumber % 4 = 1)"""
)
def price_payload(spark, sf):
    """Price payload rows as a tape: adjusted close first, bad rows out."""
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.when(n % 3 == 0, F.col("l_extendedprice").cast("string")).otherwise("n/a").alias("adjusted_close"),
        F.when(n % 4 != 1, F.col("l_extendedprice") / 2).alias("close"),
    )
    return feeds.price_series(rows).withColumn("close", F.round("close", 4))


@query(
    """WITH t AS (SELECT user_id AS symbol, CASE event_type WHEN 'purchase' THEN 95.0 WHEN 'click' THEN 88.0 ELSE 82.0 END AS priority, event_type AS source FROM events)
    SELECT symbol, CAST(priority AS DOUBLE) AS priority, source FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY priority DESC, source) AS rn FROM t) WHERE rn = 1 ORDER BY priority DESC, symbol LIMIT 25"""
)
def trigger_merge(spark, sf):
    """The most urgent trigger per symbol, the twenty-five most urgent (a cycle's size)."""
    events = table(spark, sf, "events")
    priority = F.when(F.col("event_type") == "purchase", 95.0).when(F.col("event_type") == "click", 88.0).otherwise(82.0)
    rows = events.select(F.col("user_id").alias("symbol"), priority.alias("priority"), F.col("event_type").alias("source"))
    return mo.merged_triggers(rows, rows, 25)


@query("SELECT symbol, 40.0::DOUBLE AS priority, 'lifecycle' AS source FROM (SELECT DISTINCT user_id AS symbol FROM events) ORDER BY symbol LIMIT 25")
def routine_triggers(spark, sf):
    """A cycle without any trigger: active symbols get a routine one (no event of the table has the type ``halt``)."""
    events = table(spark, sf, "events").withColumnRenamed("user_id", "symbol")
    rows = events.where("event_type = 'halt'").select("symbol", F.lit(95.0).alias("priority"), F.col("event_type").alias("source"))
    return mo.merged_triggers(rows, events.select("symbol"), 25)


@query(
    f"""WITH {_RETURNS}, {_SIGNALS}, d AS (SELECT DISTINCT as_of FROM signals ORDER BY as_of DESC LIMIT 12),
    x AS (SELECT s.as_of, symbol, er, return_90d AS y, coalesce(setup, 'watchful') AS setup, CASE WHEN k.products % 3 = 0 THEN 'up' ELSE 'down' END AS regime FROM signals s JOIN returns r USING (symbol, as_of) JOIN snapshots k USING (symbol, as_of) WHERE return_90d IS NOT NULL AND s.as_of IN (SELECT as_of FROM d)),
    r AS (SELECT *, count(*) OVER (PARTITION BY setup, regime) AS n, row_number() OVER (PARTITION BY setup, regime ORDER BY er DESC, as_of, symbol) AS hi, row_number() OVER (PARTITION BY setup, regime ORDER BY er, as_of, symbol) AS lo,
      rank() OVER (PARTITION BY setup, regime ORDER BY er) + (count(*) OVER (PARTITION BY setup, regime, er) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY setup, regime ORDER BY y) + (count(*) OVER (PARTITION BY setup, regime, y) - 1) / 2.0 AS ry FROM x)
    SELECT setup, regime, count(*) AS rows, count(DISTINCT as_of) AS windows, round(CASE WHEN count(*) < 3 OR corr(rx, ry) IS NULL OR isnan(corr(rx, ry)) THEN 0.0 ELSE corr(rx, ry) END, 6) AS rank_ic, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
      round(avg(y), 6) AS mean_return, round(CASE WHEN count(*) > 1 THEN avg(y) FILTER (WHERE hi <= greatest(1, n // 2)) - avg(y) FILTER (WHERE lo <= greatest(1, n // 2)) ELSE 0.0 END, 6) AS spread FROM r GROUP BY 1, 2"""
)
def rolling_scorecards(spark, sf):
    """Scorecards by setup and regime over the last twelve dates."""
    base = snapshots(spark, sf)
    regime = base.select("symbol", "as_of", F.when(F.col("products") % 3 == 0, "up").otherwise("down").alias("regime"))
    rows = _signals(spark, sf).join(regime, ["symbol", "as_of"]).join(lb.forward_returns(base, prices(spark, sf)), ["symbol", "as_of"], "left")
    rows = rows.withColumn("setup", F.coalesce("setup_type", F.lit("watchful")))
    out = mo.rolling_scorecards(rows, ["setup", "regime"], 12)
    return out.select("setup", "regime", "rows", "windows", *[F.round(c, 6).alias(c) for c in out.columns[4:]])


@query(
    f"""WITH {SQL_SNAPSHOTS}, {_SIGNALS} SELECT as_of, round(avg(CASE WHEN exact THEN 1.0 ELSE 0.0 END), 6) AS exact_rate, round(avg(CASE WHEN days > 150 THEN 1.0 ELSE 0.0 END), 6) AS synthetic_rate, round(avg(CASE WHEN days > 190 THEN 1.0 ELSE 0.0 END), 6) AS stale_rate,
    round(avg(CASE WHEN setup IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS context_coverage FROM signals GROUP BY 1"""
)
def coverage_rates(spark, sf):
    """Shares of exact, synthetic and stale events and of whole contexts per date."""
    out = mo.coverage(_signals(spark, sf), ["as_of"], ["company_state", "setup_type", "upside", "floor_support"], F.col("event_exact"), F.col("event_days") > 150, F.col("event_days") > 190)
    return out.select("as_of", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(
    """WITH x AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS company, s_suppkey % 7 = 0 AS delisted, greatest(s_acctbal, 0) AS cap, CASE WHEN s_suppkey % 3 = 0 THEN 10.0 ELSE 0.0 END AS price, s_suppkey % 5 = 0 AS unmapped, s_suppkey % 11 = 0 AS placeholder, s_suppkey % 13 = 0 AS low FROM supplier),
    f AS (SELECT s_suppkey, list_filter([CASE WHEN delisted THEN 'delisted_security' END, CASE WHEN company AND cap <= 0 THEN 'zero_market_cap' END, CASE WHEN company AND cap <= 0 AND price <= 0 THEN 'missing_live_price' END, CASE WHEN NOT company AND unmapped THEN 'stale_program_mapping' END,
      CASE WHEN NOT company AND placeholder THEN 'synthetic_company_program' END, CASE WHEN low THEN 'low_signal_program' END], lambda x: x IS NOT NULL) AS flags FROM x)
    SELECT s_suppkey, array_to_string(flags, ',') AS flags, CASE WHEN len(flags) = 0 THEN NULL WHEN len(flags) = 1 AND flags[1] IN ('low_signal_program', 'stale_program_mapping', 'synthetic_company_program') THEN 'research_artifact_program' ELSE 'data_integrity_block' END AS status FROM f"""
)
def integrity(spark, sf):
    """Integrity flags of ideas and what follows from them."""
    k = F.col("s_suppkey")
    flags = mo.integrity_flags(k % 2 == 0, k % 7 == 0, F.greatest("s_acctbal", F.lit(0.0)), F.when(k % 3 == 0, 10.0).otherwise(0.0), k % 5 == 0, k % 11 == 0, k % 13 == 0)
    rows = table(spark, sf, "supplier").select("s_suppkey", flags.alias("f"))
    return rows.select("s_suppkey", F.array_join("f", ",").alias("flags"), mo.integrity_status(F.col("f")).alias("status"))


@query(
    """WITH i AS (SELECT CAST(c_nationkey AS VARCHAR) AS symbol, CASE WHEN c_custkey % 3 = 0 THEN 'company' ELSE 'program' END AS level, c_mktsegment AS name, CASE WHEN c_acctbal >= 0 THEN 'long' ELSE 'short' END AS direction, c_acctbal AS weight, c_custkey FROM customer),
    r AS (SELECT *, row_number() OVER (PARTITION BY symbol, regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), direction ORDER BY (level <> 'company'), weight DESC, c_custkey) AS rn FROM i)
    SELECT symbol, level, direction, c_custkey FROM r WHERE rn = 1 ORDER BY (level <> 'company'), weight DESC, c_custkey LIMIT 12"""
)
def idea_blend(spark, sf):
    """The twelve first ideas, company before program ideas, one per symbol, name and direction."""
    rows = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("symbol"), F.when(F.col("c_custkey") % 3 == 0, "company").otherwise("program").alias("level"), F.col("c_mktsegment").alias("name"),
        F.when(F.col("c_acctbal") >= 0, "long").otherwise("short").alias("direction"), F.col("c_acctbal").alias("weight"), "c_custkey",
    )
    return mo.blended_ideas(rows, [F.desc("weight"), F.asc("c_custkey")], 12).select("symbol", "level", "direction", "c_custkey")


_CALENDAR = f"""e AS (SELECT *, ([{', '.join(f"'{t}'" for t in TITLES)}])[event_id % {len(TITLES)} + 1] AS title, CASE event_id % 5 WHEN 0 THEN 'pdufa' WHEN 1 THEN 'Phase3 readout' ELSE NULL END AS kind FROM events)"""


@query(
    f"""WITH {_CALENDAR}, t AS (SELECT *, CASE WHEN {q.inferred('lower(title)')} IS NULL THEN -1 ELSE {q.lookup('(' + q.inferred('lower(title)') + ')', t.PRIORITY.items(), 0)} END AS told, {q.inferred('lower(title)')} AS seen,
      CASE WHEN kind IS NULL THEN -1 ELSE CASE replace(lower(kind), ' ', '_') WHEN 'pdufa' THEN 6 ELSE 5 END END AS own FROM e),
    f AS (SELECT *, coalesce(CASE WHEN told > own THEN seen WHEN own >= 0 THEN replace(lower(kind), ' ', '_') END, CASE {' '.join(f"WHEN {q.any_of('lower(title)', m)} THEN '{n}'" for n, m in TEXT_FAMILIES)} END) AS family FROM t)
    SELECT upper('u' || user_id) AS ticker, coalesce(CASE WHEN event_id % 3 > 0 THEN CAST(event_id AS VARCHAR) END, 'calendar:' || upper('u' || user_id) || ':' || family || ':' || strftime(ts, '%Y-%m-%d')) AS event_id, family AS event_type, title,
      CAST(date_trunc('day', ts) AS TIMESTAMP) AS expected_date, CASE WHEN event_id % 2 = 0 THEN value ELSE 0.6 END AS importance
    FROM f WHERE family IN {t.EVENT_FAMILIES} AND (event_id % 7 > 0 OR ts - INTERVAL 1 DAY <= TIMESTAMP '2024-01-10')"""
)
def calendar_documents(spark, sf):
    """Events of users from JSON calendars of three shapes, with columns under changing names, broken documents among them."""
    title = F.element_at(F.array(*[F.lit(x) for x in TITLES]), (F.col("event_id") % len(TITLES) + 1).cast("int"))
    kind = F.when(F.col("event_id") % 5 == 0, "pdufa").when(F.col("event_id") % 5 == 1, "Phase3 readout")
    rows = table(spark, sf, "events").withColumn("shape", F.col("user_id") % 3)
    named = lambda options: [F.when(F.col("shape") == i, own).alias(n) for i, (n, own) in enumerate(options)]
    ticker = F.concat(F.lit("u"), "user_id")
    day = lambda f: F.date_format("ts", f)
    known = F.when(F.col("event_id") % 7 == 0, F.date_format(F.col("ts") - F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    item = F.struct(
        *named([("ticker", ticker), ("symbol", ticker), ("Symbol", ticker)]), *named([("expected_date", day("yyyy-MM-dd")), ("date", day("MM/dd/yyyy")), ("catalyst_date", day("yyyy/MM/dd"))]),
        *named([("title", title), ("event", title), ("description", title)]), kind.alias("category"), F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("id"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("importance"), known.alias("published_at"),
    )
    lists = rows.groupBy("user_id", "shape").agg(F.collect_list(item).alias("x"))
    text = F.when(F.col("shape") == 0, F.to_json("x")).when(F.col("shape") == 1, F.to_json(F.struct(F.col("x").alias("events")))).otherwise(F.to_json(F.struct(F.array().cast("array<int>").alias("events"), F.lit(3).alias("rows"), F.col("x").alias("data"))))
    docs = lists.select(text.alias("text")).unionByName(lists.select(F.lit('{"events": [1, "x", null').alias("text"))).unionByName(lists.select(F.lit("[1, null, []]").alias("text")))
    events = calendar_events(document_fields(docs, "text"), F.lit("2024-01-10").cast("timestamp"))
    return events.select("ticker", "event_id", "event_type", "title", F.col("expected_date").cast("timestamp_ntz").alias("expected_date"), "importance")


_TOPICS = ("a definitive agreement", "a share repurchase", "a new indication", "to discontinue a program", "a pivotal study")
_NAMED = ("first", "2nd", "third", "4th")
_GUIDED = f"""n AS (SELECT o_orderkey, o_orderdate AS published, ([{', '.join(repr(x) for x in _TOPICS)}])[o_orderkey % 5 + 1] AS topic, 1 + o_custkey % 4 AS part, 1999 + o_custkey % 9 AS y FROM orders),
    h AS (SELECT *, lower('Company announces ' || topic || ', expected in ' || CASE o_orderkey % 4 WHEN 0 THEN 'Q' || part || ' ' || y WHEN 1 THEN ([{', '.join(repr(x) for x in _NAMED)}])[part] || ' quarter of ' || y
      WHEN 2 THEN (1 + part % 2) || 'H-' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') ELSE ([{', '.join(repr(x) for x in _NAMED)}])[1 + part % 2] || ' half ' || y END) || ' ' AS h FROM n)"""
_PERIODS = ((r"\bq([1-4])[\s''-]*(\d{2,4})\b", 3), (r"\b(first|1st|second|2nd|third|3rd|fourth|4th)\s+quarter(?:\s+of)?\s+(\d{2,4})\b", 3), (r"\b([12])h[\s''-]*(\d{2,4})\b", 6), (r"\b(first|1st|second|2nd)\s+half(?:\s+of)?\s+(\d{2,4})\b", 6))
_NUMBER = "CASE {0} WHEN 'first' THEN 1 WHEN '1st' THEN 1 WHEN 'second' THEN 2 WHEN '2nd' THEN 2 WHEN 'third' THEN 3 WHEN '3rd' THEN 3 WHEN 'fourth' THEN 4 WHEN '4th' THEN 4 ELSE TRY_CAST({0} AS INTEGER) END"
_YEAR = "CASE WHEN TRY_CAST({0} AS INTEGER) < 100 THEN TRY_CAST({0} AS INTEGER) + 2000 WHEN TRY_CAST({0} AS INTEGER) >= 2000 THEN TRY_CAST({0} AS INTEGER) END"
_ENDS = ", ".join(f"""CASE WHEN last_day(make_date({_YEAR.format(f"regexp_extract(h, '{p}', 2)")}, {_NUMBER.format(f"regexp_extract(h, '{p}', 1)")} * {m}, 1)) >= CAST(published AS DATE)
      THEN last_day(make_date({_YEAR.format(f"regexp_extract(h, '{p}', 2)")}, {_NUMBER.format(f"regexp_extract(h, '{p}', 1)")} * {m}, 1)) END""" for p, m in _PERIODS)


@query(
    f"""WITH {_GUIDED}, k AS (SELECT *, {_NEWS_CASE} AS kind, coalesce({_ENDS}) AS period FROM h), e AS (SELECT *, CASE WHEN kind IN {feeds.GUIDED_TYPES} THEN CAST(period AS TIMESTAMP) END AS guided FROM k)
    SELECT o_orderkey, kind AS event_type, coalesce(guided, published) AS expected_date, CASE WHEN guided IS NULL THEN 'exact_press_release' ELSE 'guided_company_event' END AS status FROM e"""
)
def guided_news(spark, sf):
    """Headlines that name a quarter or half-year of their order's making, in four forms: events on its last day, unless it is over by then."""
    return feeds.news_events(_headlines(spark, sf)).select("o_orderkey", "event_type", F.col("expected_date").cast("timestamp_ntz").alias("expected_date"), "status")


@query(
    f"""WITH {_GUIDED}, k AS (SELECT *, {_NEWS_CASE} AS kind, coalesce({_ENDS}) AS period FROM h WHERE CAST(published AS DATE) >= DATE '1999-12-04'), e AS (SELECT *, CASE WHEN kind IN {feeds.GUIDED_TYPES} THEN CAST(period AS TIMESTAMP) END AS guided FROM k),
    x AS (SELECT o_orderkey, published, kind AS event_type, h, coalesce(guided, published) AS expected_date, CASE WHEN guided IS NULL THEN 'exact_press_release' ELSE 'guided_company_event' END AS status FROM e),
    f AS (SELECT * FROM x WHERE CAST(expected_date AS DATE) <= DATE '2000-09-29' AND NOT (status = 'exact_press_release' AND CAST(expected_date AS DATE) < DATE '2000-05-02'))
    SELECT o_orderkey, event_type, expected_date, status FROM (SELECT *, row_number() OVER (PARTITION BY event_type, expected_date, status, h ORDER BY published DESC, o_orderkey) AS rn FROM f) WHERE rn = 1"""
)
def recent_news(spark, sf):
    """What the news of the half-year before a day still tells on it, each event once."""
    out = recent_news_events(_headlines(spark, sf), F.lit("2000-06-01").cast("timestamp"), [F.desc("date"), F.asc("o_orderkey")])
    return out.select("o_orderkey", "event_type", F.col("expected_date").cast("timestamp_ntz").alias("expected_date"), "status")


def _headlines(spark, sf):
    part, year = (1 + F.col("o_custkey") % 4).cast("int"), (1999 + F.col("o_custkey") % 9).cast("int")
    named = lambda i: F.element_at(F.array(*[F.lit(x) for x in _NAMED]), i)
    kind = F.col("o_orderkey") % 4
    period = F.when(kind == 0, F.concat(F.lit("Q"), part, F.lit(" "), year)).when(kind == 1, F.concat(named(part), F.lit(" quarter of "), year))
    period = period.when(kind == 2, F.concat(1 + part % 2, F.lit("H-"), F.lpad((year % 100).cast("string"), 2, "0"))).otherwise(F.concat(named(1 + part % 2), F.lit(" half "), year))
    topic = F.element_at(F.array(*[F.lit(x) for x in _TOPICS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.lit("ABC").alias("symbol"), F.array().cast("array<string>").alias("symbols"), F.concat(F.lit("Company announces "), topic, F.lit(", expected in "), period).alias("title"), F.lit("").alias("content"),
        F.array().cast("array<string>").alias("tags"), F.col("o_orderdate").alias("date"),
    )


@query(
    """WITH r AS (SELECT s_suppkey AS i, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE lower(s_name) || '.' || s_nationkey END AS code, CASE WHEN s_suppkey % 5 = 0 THEN 'X' || s_nationkey % 2 ELSE 'E' || s_nationkey % 4 END AS exchange, s_suppkey % 3 = 0 OR s_suppkey % 7 = 0 AS gone, s_name FROM supplier
      UNION ALL SELECT s_suppkey + 1000000, lower(s_name) || '.' || s_nationkey || '.b', 'E' || s_nationkey % 4, s_suppkey % 2 = 0, s_name FROM supplier)
    SELECT upper(split_part(code, '.', 1)) AS ticker, exchange, gone AS is_delisted, code AS listing_symbol, CASE WHEN i < 1000000 THEN s_name ELSE code END AS company_name, CASE WHEN i < 1000000 THEN 'ADR' ELSE 'Common Stock' END AS security_type
    FROM (SELECT *, row_number() OVER (PARTITION BY upper(split_part(code, '.', 1)), exchange, gone ORDER BY i) AS rn FROM r WHERE code IS NOT NULL) WHERE rn = 1"""
)
def exchange_listings(spark, sf):
    """Listings of two feeds with different column names, once per ticker, exchange and state."""
    rows = table(spark, sf, "supplier")
    code = F.concat(F.lower("s_name"), F.lit("."), "s_nationkey")
    own = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("X"), F.col("s_nationkey") % 2))
    place = F.concat(F.lit("E"), F.col("s_nationkey") % 4)
    one = F.create_map(F.lit("Code"), F.when(F.col("s_suppkey") % 11 != 0, code), F.lit("Name"), F.col("s_name"), F.lit("Type"), F.lit("ADR"), F.lit("Exchange"), own, F.lit("IsDelisted"), F.when(F.col("s_suppkey") % 7 == 0, "true").otherwise("false"))
    two = F.create_map(F.lit("symbol"), F.concat(code, F.lit(".b")), F.lit("name"), F.lit(""))
    a = rows.select(F.col("s_suppkey").alias("i"), one.alias("fields"), place.alias("exchange"), (F.col("s_suppkey") % 3 == 0).alias("delisted"))
    b = rows.select((F.col("s_suppkey") + 1_000_000).alias("i"), two.alias("fields"), place.alias("exchange"), (F.col("s_suppkey") % 2 == 0).alias("delisted"))
    return listings(a.unionByName(b), ["i"]).select("ticker", "exchange", "is_delisted", "listing_symbol", "company_name", "security_type")


_FORMS = ("10-Q", "10-K", "8-K", "S-3", "424B5", "4")


@query(
    f"""WITH o AS (SELECT o_custkey, ([{', '.join(repr(f) for f in _FORMS)}])[o_orderkey % 6 + 1] AS form, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders),
    r AS (SELECT o_custkey, count(*) AS recent_filings, arg_min(day, rn) FILTER (WHERE form = '10-Q') AS last_10q_date, arg_min(day, rn) FILTER (WHERE form = '10-K') AS last_10k_date, count(*) FILTER (WHERE form IN {OFFERING_FORMS}) AS offerings FROM o WHERE rn <= 25 GROUP BY 1),
    v AS (SELECT o_custkey, coalesce(arg_max(o_totalprice, ROW(day, -rn)) FILTER (WHERE form = '8-K' AND o_custkey % 2 = 0), arg_max(o_totalprice, ROW(day, -rn)) FILTER (WHERE form = '10-K')) AS revenue_ttm, arg_max(o_totalprice, ROW(day, -rn)) FILTER (WHERE form = '10-Q') AS cash_latest FROM o GROUP BY 1)
    SELECT * FROM r JOIN v USING (o_custkey)"""
)
def company_filings(spark, sf):
    """Last reports, offerings, revenue and cash of each customer's document of filings and facts."""
    form = F.element_at(F.array(*[F.lit(f) for f in _FORMS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    entry = F.struct((-F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("at"), "o_orderkey", form.alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"))
    docs = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(entry)).alias("x"))
    named = lambda kind: F.struct(F.create_map(F.lit("USD"), F.transform(F.filter("x", lambda e: e["form"] == kind), lambda e: F.struct(e["end"].alias("end"), e["val"].alias("val")))).alias("units"))
    none = F.struct(F.create_map(F.lit("USD"), F.array().cast("array<struct<end:string,val:double>>")).alias("units"))
    facts = F.create_map(F.lit("Revenues"), F.when(F.col("o_custkey") % 2 == 0, named("8-K")).otherwise(none), F.lit("SalesRevenueNet"), named("10-K"), F.lit("CashAndCashEquivalentsAtCarryingValue"), named("10-Q"))
    docs = docs.select("o_custkey", F.col("x.form").alias("form"), F.col("x.end").alias("filing_date"), F.to_json(facts).alias("facts"))
    return filing_summaries(docs).select("o_custkey", "recent_filings", "last_10q_date", "last_10k_date", F.size("offerings").alias("offerings"), "revenue_ttm", "cash_latest")
