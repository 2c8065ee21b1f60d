"""Registered queries: operators bound to the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens import oracle as q
from eventlens.adapters import SQL_CATALYSTS, SQL_EVENTS, SQL_PRICES, SQL_SNAPSHOTS, catalysts, event_tape, prices, snapshots, table
from eventlens.functions.numeric import bucket, company_state, financing_risk, floor_support, quarter_step, sigmoid
from eventlens.functions.outcomes import outcome
from eventlens.functions.scores import FAMILY_PRIOR, SCHEDULE_SOURCES, SOURCE_BONUS, SOURCE_PRIORITY
from eventlens.functions.evidence import EVIDENCE_STOPS, EVIDENCE_WEIGHTS, best_evidence, tokens
from eventlens.functions.taxonomy import event_type, is_exact_timing, type_bucket, type_priority
from eventlens.operators.asof import asof_join, asof_join_split, latest
from eventlens.operators.greedy import greedy_intervals, greedy_spacing
from eventlens.operators.rankstats import aggregate_windows, average_rank, peer_summary, spearman, window_summary
from eventlens.plans import events as ev
from eventlens.plans import labels as lb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Text functions.


@query(
    f"""WITH {SQL_EVENTS}, c AS (SELECT *, {q.family('event_type', 'title')} AS family FROM events_all)
    SELECT family, {q.bucket('family')} AS bucket, {q.exact('status', 'title')} AS exact_timing, {q.outcome('family', q.bucket('family'), 'title', 'status')} AS outcome,
      CASE WHEN family IS NULL THEN -1 ELSE {q.lookup('family', q.t.PRIORITY.items(), 0)} END AS priority, count(*) AS n
    FROM c GROUP BY ALL"""
)
def event_taxonomy(spark, sf):
    """Type cascade, bucket, timing and outcome of every tape event, counted."""
    rows = event_tape(spark, sf).withColumn("family", event_type(F.col("event_type"), F.col("title")))
    rows = rows.withColumn("bucket", type_bucket(F.col("family")))
    return rows.groupBy(
        "family", "bucket", is_exact_timing(F.col("status"), F.col("event_timestamp"), F.col("title")).alias("exact_timing"),
        outcome(F.col("family"), F.col("bucket"), F.col("title"), F.col("status")).alias("outcome"), type_priority(F.col("family")).alias("priority"),
    ).agg(F.count("*").alias("n"))


_TOKENS = f"""list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]+'), lambda x: rtrim(x, '-')), lambda x: NOT list_contains({list(EVIDENCE_STOPS)}, x) AND (len(x) >= 4 OR regexp_matches(x, '[0-9]'))))"""


@query(f"SELECT doc_id, len(w) AS n_tokens, array_to_string(list_sort(w)[1:3], ' ') AS first_tokens FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)")
def evidence_tokens(spark, sf):
    """Distinct evidence tokens of a text: no stop words, four characters or more, or with a digit."""
    kept = F.array_sort(tokens(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.size(kept).cast("long").alias("n_tokens"), F.concat_ws(" ", F.slice(kept, 1, 3)).alias("first_tokens"))


@query(
    f"""WITH b AS (SELECT item_id, {_TOKENS} AS w, regexp_extract(lower(text), '[a-z0-9]+') AS name FROM benchmark),
    i AS (SELECT item_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT item_id, list_sort(w) AS w FROM b)),
    d AS (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents),
    s AS (SELECT item_id, doc_id, sum(CASE pos % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 ELSE 1.5 END) AS shared FROM i JOIN d USING (t) GROUP BY ALL),
    n AS (SELECT s.item_id, s.doc_id, shared + CASE WHEN length(name) > 0 AND contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), name) THEN 4.0 ELSE 0.0 END AS score FROM s JOIN b USING (item_id) JOIN documents USING (doc_id))
    SELECT item_id, doc_id, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM n) WHERE rank <= 5"""
)
def evidence_match(spark, sf):
    """Weighted token overlap: the five documents of the highest score for each benchmark text, its tokens in three weight classes."""
    items = table(spark, sf, "benchmark").select("item_id", F.regexp_extract(F.lower("text"), "[a-z0-9]+", 0).alias("name"), F.posexplode(F.array_sort(tokens(F.col("text")))).alias("at", "token"))
    items = items.select("item_id", "name", "token", F.element_at(F.array(*[F.lit(w) for w in EVIDENCE_WEIGHTS]), F.when(F.col("at") % 3 == 2, 1).when(F.col("at") % 3 == 0, 2).otherwise(3)).alias("weight"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return best_evidence(items, docs, ["item_id"], "doc_id", 5)


# Scalar columns.


@query(
    f"""WITH {SQL_SNAPSHOTS}, x AS (SELECT *, greatest(market_cap, 1.0) AS base, greatest(cash - debt, 0.0) AS net FROM snapshots)
    SELECT symbol, as_of,
      CASE WHEN revenue >= 500000000 THEN 'commercialized' WHEN products > 0 OR revenue >= 75000000 THEN 'commercial_launch' ELSE 'pre_commercial' END AS state,
      round(least(greatest((net + 0.35 * revenue) / base, 0.0), 1.25), 6) AS floor_support,
      round(least(greatest((1 - least(greatest(net / base + 0.35 * revenue / base, 0.0), 1.0)) * 0.70 + least(debt / base, 1.0) * 0.30, 0.0), 1.0), 6) AS risk,
      CASE WHEN market_cap <= 250000000 THEN 'micro' WHEN market_cap <= 500000000 THEN 'small' WHEN market_cap <= 1000000000 THEN 'mid' ELSE 'large' END AS tier,
      round(round_even(greatest(cash / base, 0.0) * 4, 0) / 4, 6) AS weight_step, round(1 / (1 + exp(-((cash - debt) / base))), 6) AS logistic
    FROM x"""
)
def snapshot_columns(spark, sf):
    """State, floor, risk, size tier, quantised weight and logistic of each snapshot."""
    cap, cash, debt, rev = (F.col(c) for c in ("market_cap", "cash", "debt", "revenue"))
    base = F.greatest(cap, F.lit(1.0))
    return snapshots(spark, sf).select(
        "symbol", "as_of", company_state(F.col("products"), rev).alias("state"),
        F.round(floor_support(cap, cash, debt, rev), 6).alias("floor_support"), F.round(financing_risk(cap, cash, debt, rev), 6).alias("risk"),
        bucket(cap, [(250_000_000, "micro"), (500_000_000, "small"), (1_000_000_000, "mid")], "large").alias("tier"),
        F.round(quarter_step(cash / base), 6).alias("weight_step"), F.round(sigmoid((cash - debt) / base), 6).alias("logistic"),
    )


# Joins.


@query(f"WITH {SQL_PRICES}, {SQL_SNAPSHOTS} SELECT s.symbol, s.as_of, p.date, p.close FROM snapshots s ASOF LEFT JOIN prices p ON s.symbol = p.symbol AND s.as_of > p.date")
def asof_stretches(spark, sf):
    """Last close before each snapshot, every symbol cut into stretches of 60 days."""
    return asof_join_split(snapshots(spark, sf), prices(spark, sf), ["symbol"], "as_of", "date", ["close"], 60, strict=True).select("symbol", "as_of", "date", "close")


@query(
    f"""WITH {SQL_PRICES}, {SQL_SNAPSHOTS}
    SELECT s.symbol, s.as_of, b.date AS back_date, b.close AS back_close, f.date AS ahead_date, f.close AS ahead_close
    FROM snapshots s ASOF LEFT JOIN prices b ON s.symbol = b.symbol AND s.as_of >= b.date ASOF LEFT JOIN prices f ON s.symbol = f.symbol AND s.as_of <= f.date"""
)
def asof_prices(spark, sf):
    """Last close at or before and first close at or after each snapshot."""
    tape = prices(spark, sf)
    rows = asof_join(snapshots(spark, sf), tape, ["symbol"], "as_of", "date", ["close"], prefix="back_")
    rows = asof_join(rows, tape, ["symbol"], "as_of", "date", ["close"], "forward", prefix="ahead_")
    return rows.select("symbol", "as_of", "back_date", "back_close", "ahead_date", "ahead_close")


@query(
    f"""WITH {SQL_SNAPSHOTS}, {SQL_EVENTS}
    SELECT e.event_id, s.as_of AS snapshot_at, coalesce(s.market_cap, 0.0) AS market_cap FROM events_all e ASOF LEFT JOIN snapshots s ON e.symbol = s.symbol AND e.as_of > s.as_of"""
)
def context_asof(spark, sf):
    """Latest snapshot strictly before an event becomes known, with defaults."""
    known = catalysts_all(spark, sf)
    rows = asof_join(known, snapshots(spark, sf).withColumnRenamed("as_of", "snapshot_at"), ["symbol"], "as_of", "snapshot_at", ["market_cap"], strict=True)
    return rows.select("event_id", "snapshot_at", F.coalesce("market_cap", F.lit(0.0)).alias("market_cap"))


def catalysts_all(spark, sf):
    """Every line as an announced event, also those that ship before their order."""
    from eventlens.adapters import _events

    return _events(spark, sf)


@query(
    f"""WITH {SQL_SNAPSHOTS} SELECT symbol, as_of, market_cap, lag(market_cap) OVER w AS before, market_cap - lag(market_cap) OVER w AS change
    FROM snapshots WINDOW w AS (PARTITION BY symbol ORDER BY as_of)"""
)
def previous_row(spark, sf):
    """Previous snapshot of the same symbol."""
    before = F.lag("market_cap").over(Window.partitionBy("symbol").orderBy("as_of"))
    return snapshots(spark, sf).select("symbol", "as_of", "market_cap", before.alias("before"), (F.col("market_cap") - before).alias("change"))


@query(
    f"""WITH {SQL_SNAPSHOTS} SELECT symbol, as_of, count(*) OVER (PARTITION BY as_of ORDER BY products RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) - 1 AS neighbours FROM snapshots"""
)
def neighbour_count(spark, sf):
    """Rows of the same date within two products, by a range window instead of a self join."""
    near = F.count("*").over(Window.partitionBy("as_of").orderBy("products").rangeBetween(-2, 2)) - 1
    return snapshots(spark, sf).select("symbol", "as_of", near.alias("neighbours"))


@query(
    """SELECT o_orderkey, o_custkey, 'none' AS kind FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    UNION ALL SELECT o_orderkey, o_custkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
)
def anti_and_semi(spark, sf):
    """Orders without lines (anti join) and urgent orders of customers in debt (semi join)."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = table(spark, sf, "lineitem").select("l_orderkey")
    debtors = table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")
    none = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey", F.lit("none").alias("kind"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").join(debtors, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey", F.lit("urgent").alias("kind"))
    return none.unionByName(urgent)


@query(
    f"""WITH {SQL_SNAPSHOTS}, p AS (SELECT *, market_cap / greatest(revenue, 1.0) AS multiple, ntile_key FROM (SELECT *, products // 3 AS ntile_key FROM snapshots))
    SELECT a.symbol, a.as_of, count(b.symbol) AS peers, round(median(b.multiple), 6) AS peer_median, round(avg(CASE WHEN b.multiple <= a.multiple THEN 1.0 ELSE 0.0 END), 6) AS share_below
    FROM p a JOIN p b ON a.as_of = b.as_of AND a.ntile_key = b.ntile_key AND a.symbol <> b.symbol GROUP BY 1, 2"""
)
def peer_stats(spark, sf):
    """Peers of the same stage and date: median multiple and share of peers at or below one's own."""
    rows = snapshots(spark, sf).select("symbol", "as_of", F.floor(F.col("products") / 3).alias("stage"), (F.col("market_cap") / F.greatest("revenue", F.lit(1.0))).alias("multiple"))
    out = peer_summary(rows, ["as_of", "stage"], "symbol", "multiple")
    return out.select("symbol", "as_of", "peers", F.round("peer_median", 6).alias("peer_median"), F.round("share_below", 6).alias("share_below"))


# Dedup and top rows.


@query(f"WITH {SQL_SNAPSHOTS} SELECT symbol, max(as_of) AS as_of, arg_max(market_cap, as_of) AS market_cap, arg_max(products, as_of) AS products FROM snapshots GROUP BY 1")
def latest_per_key(spark, sf):
    """Latest snapshot per symbol in one aggregation."""
    last = F.max_by(F.struct("as_of", "market_cap", "products"), "as_of").alias("x")
    return snapshots(spark, sf).groupBy("symbol").agg(last).select("symbol", "x.as_of", "x.market_cap", "x.products")


@query(
    """SELECT user_id, day, event_id, event_type FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type,
      row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def same_day_collapse(spark, sf):
    """Last event per user and day."""
    rows = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return latest(rows, ["user_id", "day"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "day", "event_id", "event_type")


@query(
    f"""WITH {SQL_CATALYSTS}, c AS (SELECT *, {q.exact('status', 'title')} AS exact, {q.lookup("coalesce(source, '')", SOURCE_PRIORITY, 0)} AS sp FROM catalysts)
    SELECT symbol, as_of, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY symbol, as_of ORDER BY exact DESC, sp DESC, expected_date, importance DESC, event_id) AS rn FROM c) WHERE rn = 1"""
)
def primary_event(spark, sf):
    """One leading event per symbol and date: exact, best source, soonest, most important."""
    from eventlens.functions.taxonomy import looked_up

    exact = is_exact_timing(F.col("status"), F.col("expected_date"), F.col("title"))
    order = [F.desc(exact), F.desc(looked_up(F.coalesce("source", F.lit("")), SOURCE_PRIORITY, 0)), F.asc("expected_date"), F.desc("importance"), F.asc("event_id")]
    return latest(catalysts(spark, sf), ["symbol", "as_of"], order).select("symbol", "as_of", "event_id", "event_type")


@query(
    f"""WITH {SQL_SNAPSHOTS}, r AS (SELECT *, count(*) OVER (PARTITION BY as_of) AS n, row_number() OVER (PARTITION BY as_of ORDER BY revenue DESC, symbol) AS hi,
      row_number() OVER (PARTITION BY as_of ORDER BY revenue, symbol) AS lo FROM snapshots)
    SELECT as_of, symbol, CASE WHEN hi <= greatest(1, n // 5) THEN 'top' ELSE 'bottom' END AS side FROM r WHERE hi <= greatest(1, n // 5) OR lo <= greatest(1, n // 5)"""
)
def extreme_fifths(spark, sf):
    """Largest and smallest fifth of a date by revenue, at least one row each."""
    w = Window.partitionBy("as_of")
    k = F.greatest(F.floor(F.count("*").over(w) / 5), F.lit(1))
    rows = snapshots(spark, sf).withColumns({"k": k, "hi": F.row_number().over(w.orderBy(F.desc("revenue"), "symbol")), "lo": F.row_number().over(w.orderBy("revenue", "symbol"))})
    return rows.where("hi <= k or lo <= k").select("as_of", "symbol", F.when(F.col("hi") <= F.col("k"), "top").otherwise("bottom").alias("side"))


@query(
    """WITH x AS (SELECT c_custkey, c_acctbal, c_nationkey, round(c_acctbal / 1000, 0) AS k FROM customer)
    SELECT c_custkey, round((rank() OVER (PARTITION BY c_nationkey ORDER BY k) + (count(*) OVER (PARTITION BY c_nationkey, k) - 1) / 2.0) / count(*) OVER (PARTITION BY c_nationkey), 9) AS pct FROM x"""
)
def percent_ranks(spark, sf):
    """Average percent rank per nation, ties sharing their mean."""
    rows = table(spark, sf, "customer").withColumn("k", F.round(F.col("c_acctbal") / 1000, 0))
    n = F.count("*").over(Window.partitionBy("c_nationkey"))
    return rows.select("c_custkey", F.round(average_rank("k", ["c_nationkey"]) / n, 9).alias("pct"))


# Time series.

_RETURNS = f"""{SQL_PRICES}, {SQL_SNAPSHOTS}, based AS (SELECT s.symbol, s.as_of, p.close AS base FROM snapshots s ASOF JOIN prices p ON s.symbol = p.symbol AND s.as_of >= p.date),
  st AS (SELECT *, unnest([30, 90, 180]) AS h FROM based), tg AS (SELECT symbol, as_of, base, h, as_of + to_days(h) AS target FROM st),
  fw AS (SELECT t.*, p.close FROM tg t ASOF LEFT JOIN prices p ON t.symbol = p.symbol AND t.target <= p.date),
  returns AS (SELECT symbol, as_of, max(CASE WHEN h = 30 THEN close / base - 1 END) AS return_30d, max(CASE WHEN h = 90 THEN close / base - 1 END) AS return_90d,
    max(CASE WHEN h = 180 THEN close / base - 1 END) AS return_180d FROM fw GROUP BY 1, 2)"""


@query(f"WITH {_RETURNS} SELECT * FROM returns")
def forward_returns(spark, sf):
    """30, 90 and 180 day returns of every snapshot."""
    return lb.forward_returns(snapshots(spark, sf), prices(spark, sf))


@query(
    f"""WITH {_RETURNS} SELECT r.symbol, r.as_of, coalesce(r.return_90d - b.return_90d, r.return_90d) AS alpha
    FROM returns r LEFT JOIN returns b ON b.symbol = 1 AND b.as_of = r.as_of WHERE r.return_90d IS NOT NULL"""
)
def benchmark_alpha(spark, sf):
    """90 day return less that of symbol 1."""
    return lb.benchmark_alpha(lb.forward_returns(snapshots(spark, sf), prices(spark, sf)), 1, 90)


@query(
    f"""WITH {SQL_PRICES}, {SQL_CATALYSTS}, e AS (SELECT event_id, symbol, expected_date - INTERVAL 5 DAY AS a, expected_date + INTERVAL 5 DAY AS b FROM catalysts)
    SELECT e.event_id, CASE WHEN x.close > 0 THEN y.close / x.close - 1 END AS window_return
    FROM e ASOF LEFT JOIN prices x ON e.symbol = x.symbol AND e.a >= x.date ASOF LEFT JOIN prices y ON e.symbol = y.symbol AND e.b <= y.date"""
)
def event_window_return(spark, sf):
    """Move from five days before to five days after an expected date."""
    return lb.event_window_return(catalysts(spark, sf), prices(spark, sf), "expected_date").select("event_id", "window_return")


@query(
    f"""WITH {SQL_PRICES}, c AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS change FROM prices),
    l AS (SELECT symbol, date, list(change ORDER BY date) OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 63 DAY PRECEDING AND CURRENT ROW) AS inside FROM c)
    SELECT symbol, date, round(CASE WHEN len(inside) > 10 THEN list_stddev_samp(inside[2:]) END, 8) AS volatility FROM l"""
)
def rolling_volatility(spark, sf):
    """Sample deviation of the changes inside the last 63 days."""
    return lb.volatility(prices(spark, sf)).withColumn("volatility", F.round("volatility", 8))


@query(
    f"""WITH {SQL_PRICES}, {SQL_SNAPSHOTS}, b AS (SELECT symbol, as_of, as_of - INTERVAL 60 DAY AS earlier FROM snapshots)
    SELECT b.symbol, b.as_of, round(CASE WHEN y.close > 0 THEN x.close / y.close - 1 END, 9) AS trailing_return FROM b ASOF LEFT JOIN prices x ON b.symbol = x.symbol AND b.as_of >= x.date
    ASOF LEFT JOIN prices y ON b.symbol = y.symbol AND b.earlier >= y.date"""
)
def trailing_returns(spark, sf):
    """Return over the sixty days before each snapshot."""
    rows = lb.trailing_return(snapshots(spark, sf).select("symbol", "as_of"), prices(spark, sf), "as_of", 60)
    return rows.select("symbol", "as_of", F.round("trailing_return", 9).alias("trailing_return"))


_PRIMARY = f"""lead_events AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, as_of ORDER BY CASE WHEN {q.exact('status', 'title')} THEN 2 ELSE 0 END DESC, {q.lookup('event_type', q.t.PRIORITY.items(), 0)} DESC,
    importance DESC, expected_date, crowdedness, event_id) AS rn FROM quarterly) WHERE rn = 1)"""
_QUARTERLY = "quarterly AS (SELECT * REPLACE (date_trunc('quarter', as_of) AS as_of) FROM catalysts)"


def _quarterly(spark, sf):
    """Announced events as the snapshot of their quarter lists them."""
    return catalysts(spark, sf).withColumn("as_of", F.date_trunc("quarter", "as_of"))


@query(
    f"""WITH {SQL_CATALYSTS}, {_QUARTERLY}, {_PRIMARY} SELECT symbol, as_of, event_id, event_type, expected_date FROM lead_events"""
)
def upcoming_primary(spark, sf):
    """The leading upcoming event of each symbol and snapshot."""
    return lb.primary_events(_quarterly(spark, sf)).select("symbol", "as_of", "event_id", "event_type", "expected_date")


@query(
    f"""WITH {_RETURNS}, {SQL_CATALYSTS}, {_QUARTERLY}, {_PRIMARY},
    told AS (SELECT DISTINCT ON (symbol, event_id, happened, source) symbol, event_id, happened, event_type, {q.bucket('f')} AS bucket, {q.outcome('f', q.bucket('f'), 'title', 'status')} AS label,
      CASE WHEN {q.exact('status', 'title')} THEN 2 ELSE 0 END AS tp FROM (SELECT *, {q.family('event_type', 'title')} AS f FROM events_all) ORDER BY symbol, event_id, happened, source, title),
    cand AS (SELECT l.symbol, l.as_of, o.label, row_number() OVER (PARTITION BY l.symbol, l.as_of ORDER BY o.event_type = l.event_type DESC, tp DESC, abs(epoch(happened) - epoch(expected_date)), o.event_id) AS rn
      FROM lead_events l JOIN told o ON l.symbol = o.symbol AND o.bucket = {q.bucket('l.event_type')} AND o.label IS NOT NULL AND happened >= l.as_of AND happened BETWEEN expected_date - INTERVAL 2 DAY AND expected_date + INTERVAL 21 DAY
      WHERE {q.bucket('l.event_type')} IN ('clinical', 'regulatory')),
    moved AS (SELECT l.symbol, l.as_of, l.event_id, CASE WHEN x.close > 0 THEN y.close / x.close - 1 END AS reaction FROM (SELECT *, expected_date - INTERVAL 5 DAY AS a, expected_date + INTERVAL 5 DAY AS b FROM lead_events) l
      ASOF LEFT JOIN prices x ON l.symbol = x.symbol AND l.a >= x.date ASOF LEFT JOIN prices y ON l.symbol = y.symbol AND l.b <= y.date)
    SELECT r.symbol, r.as_of, m.event_id, round(m.reaction, 9) AS window_return, c.label AS outcome, round(r.return_90d, 9) AS return_90d,
      CASE WHEN m.event_id IS NULL THEN CAST(coalesce(r.return_90d > 0.08, false) AS INTEGER) ELSE coalesce(c.label, CAST(coalesce(m.reaction > 0.05, false) AS INTEGER)) END AS success,
      CASE WHEN m.event_id IS NULL THEN 'return_90d_fallback' WHEN c.label IS NOT NULL THEN 'outcome' ELSE 'event_price_reaction' END AS success_source
    FROM returns r LEFT JOIN moved m USING (symbol, as_of) LEFT JOIN (SELECT * FROM cand WHERE rn = 1) c USING (symbol, as_of)"""
)
def success_labels(spark, sf):
    """Label frame: returns, primary event, reaction, outcome and the success label with its source."""
    rows = lb.success_labels(snapshots(spark, sf), _quarterly(spark, sf), ev.outcome_master(event_tape(spark, sf)), prices(spark, sf))
    return rows.select("symbol", "as_of", "event_id", F.round("window_return", 9).alias("window_return"), "outcome", F.round("return_90d", 9).alias("return_90d"), "success", "success_source")


@query(
    f"""WITH {SQL_PRICES}, m AS (SELECT symbol, date_trunc('month', date) AS month, arg_max(close, date) AS close FROM prices GROUP BY 1, 2),
    c AS (SELECT symbol, month, coalesce(close / lag(close) OVER w - 1, 0) AS r FROM m WINDOW w AS (PARTITION BY symbol ORDER BY month)),
    k AS (SELECT symbol, month, exp(sum(ln(1 + greatest(r, -0.999999))) OVER (PARTITION BY symbol ORDER BY month)) AS curve FROM c),
    f AS (SELECT symbol, curve / greatest(max(curve) OVER (PARTITION BY symbol ORDER BY month), 1.0) - 1 AS fall FROM k)
    SELECT symbol, round(min(fall), 6) AS max_drawdown, count(*) AS n FROM f GROUP BY 1"""
)
def drawdown(spark, sf):
    """Deepest fall of each symbol's monthly curve."""
    months = prices(spark, sf).groupBy("symbol", F.date_trunc("month", "date").alias("month")).agg(F.max_by("close", "date").alias("close"))
    w = Window.partitionBy("symbol").orderBy("month")
    changes = months.withColumn("r", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))
    return lb.drawdown(changes, ["symbol"], ["month"], "r").withColumn("max_drawdown", F.round("max_drawdown", 6))


@query(
    """WITH RECURSIVE d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
    k AS (SELECT o_custkey, min(day) AS day FROM d GROUP BY 1 UNION ALL SELECT k.o_custkey, min(d.day) FROM k JOIN d ON d.o_custkey = k.o_custkey AND d.day >= k.day + 45 GROUP BY k.o_custkey, k.day)
    SELECT o_custkey, CAST(day AS DATE) AS day FROM k UNION SELECT o_custkey, max(day) FROM d GROUP BY 1"""
)
def anchor_spacing(spark, sf):
    """Order dates of each customer at least 45 days apart, and the last."""
    return greedy_spacing(table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate")), ["o_custkey"], "day", 45)


_SPANS = """spans AS (SELECT l_suppkey AS symbol, l_orderkey, l_linenumber, l_partkey, l_shipdate AS opened, l_shipdate + INTERVAL 5 DAY AS closed FROM lineitem)"""


@query(
    f"""WITH RECURSIVE {_SPANS}, {q.greedy('spans', 'symbol', 'opened, l_orderkey, l_linenumber, l_partkey', 'opened', 'closed')},
    b AS (SELECT o.*, (SELECT max(k.rn) FROM kept k WHERE k.symbol = o.symbol AND k.rn <= o.rn) AS blocker FROM ordered o)
    SELECT b.symbol, b.l_orderkey, b.l_linenumber, b.l_partkey, b.rn = b.blocker AS active, CASE WHEN b.rn <> b.blocker THEN o.l_orderkey END AS blocked_by
    FROM b JOIN ordered o ON o.symbol = b.symbol AND o.rn = b.blocker"""
)
def greedy_windows(spark, sf):
    """Five-day windows per supplier, greedily kept without overlap, with the blocker of every other one."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("at"))
    order = [F.col(c) for c in ("at", "l_orderkey", "l_linenumber", "l_partkey")]
    out = greedy_intervals(rows, ["symbol"], order, F.col("at"), F.col("at") + F.expr("INTERVAL 5 DAYS"), "l_orderkey")
    return out.select("symbol", "l_orderkey", "l_linenumber", "l_partkey", "active", "blocked_by")


# Event stack.


_TOLD = ("company_state", "event_family", "floor_support", "financing_risk", "pre_event_score", "confidence_proxy", "success_probability_proxy", "matched_label", "matched_at", "latest_event_id")


def _master(spark, sf, columns=_TOLD):
    return ev.event_master(catalysts(spark, sf), snapshots(spark, sf), event_tape(spark, sf), columns=columns)


_INSTANCES = f"""{SQL_CATALYSTS}, c AS (SELECT *, {q.family('event_type', 'title')} AS family, {q.exact('status', 'title')} AS exact, {q.lookup("coalesce(source, '')", SOURCE_PRIORITY, 0)} AS sp FROM catalysts),
  m AS (SELECT *, {q.bucket('family')} AS bucket, concat_ws('|', symbol, program_id, family, strftime(expected_date, '%Y-%m-%d')) AS id FROM c WHERE {q.bucket('family')} IN ('clinical', 'regulatory') AND family IN {q.t.EVENT_FAMILIES}),
  g AS (SELECT *, min(as_of) OVER w AS first_seen, max(as_of) OVER w AS last_seen, count(*) OVER w AS mentions FROM m WINDOW w AS (PARTITION BY id)),
  s AS (SELECT id, count(*) FILTER (WHERE as_of = first_seen) AS fm, count(DISTINCT source) FILTER (WHERE exact AND as_of = first_seen) AS fx FROM g GROUP BY 1),
  newest AS (SELECT id, event_id AS latest_event_id, source AS latest_source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY exact DESC, sp DESC, importance DESC, event_id) AS rn FROM g WHERE as_of = last_seen) WHERE rn = 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY exact DESC, sp DESC, importance DESC, event_id) AS rn FROM g WHERE as_of = first_seen),
  instances AS MATERIALIZED (SELECT r.* EXCLUDE (rn), latest_event_id, latest_source, exact AND coalesce(source, '') IN {SCHEDULE_SOURCES} AS strict,
    fx >= 2 OR (fx >= 1 AND fm >= 2 AND source <> 'internal_inference') AS corroborated, greatest(date_diff('day', CAST(first_seen AS DATE), CAST(expected_date AS DATE)), 0) AS days_until
    FROM r JOIN s USING (id) JOIN newest USING (id) WHERE rn = 1)"""


@query(
    f"""WITH {_INSTANCES} SELECT id AS event_instance_id, event_id, family AS event_family, source, exact AS timing_exact, first_seen, last_seen, mentions, corroborated, days_until, latest_event_id, latest_source FROM instances"""
)
def canonical_events(spark, sf):
    """One row per event instance as first seen, with mentions, corroboration and the latest view."""
    columns = ["event_instance_id", "event_id", "event_family", "source", "timing_exact", "first_seen", "last_seen", "mentions", "corroborated"]
    return ev.canonical_events(catalysts(spark, sf)).select(*columns, F.col("days_until").cast("long").alias("days_until"), "latest_event_id", "latest_source")


_MATCHED = f"""tape AS (SELECT *, {q.bucket('f')} AS bucket FROM (SELECT *, {q.family('event_type', 'title')} AS f FROM events_all)),
  told AS (SELECT DISTINCT ON (symbol, event_id, happened, source) symbol, event_id, happened, event_type, bucket, {q.outcome('f', q.bucket('f'), 'title', 'status')} AS label,
    CASE WHEN {q.exact('status', 'title')} THEN 2 ELSE 0 END AS tp FROM tape ORDER BY symbol, event_id, happened, source, title),
  pairs AS (SELECT i.id, o.event_id AS matched_id, o.happened AS matched_at, o.label AS matched_label, o.event_type = i.family AS same, o.tp, abs(epoch(o.happened) - epoch(i.expected_date)) AS away,
    CASE WHEN exact AND happened BETWEEN greatest(first_seen, expected_date - INTERVAL 2 DAY) AND expected_date + INTERVAL 10 DAY THEN 0
      WHEN happened BETWEEN greatest(first_seen, expected_date - INTERVAL 5 DAY) AND expected_date + INTERVAL 21 DAY THEN 1
      WHEN NOT exact AND happened BETWEEN greatest(first_seen, expected_date - INTERVAL 14 DAY) AND expected_date + INTERVAL 30 DAY THEN 2 END AS band
    FROM instances i JOIN told o ON i.symbol = o.symbol AND i.bucket = o.bucket AND o.label IS NOT NULL),
  matched AS MATERIALIZED (SELECT * FROM instances LEFT JOIN (SELECT * EXCLUDE (same, tp, away, rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY band, same DESC, tp DESC, away, matched_id, matched_at) AS rn FROM pairs WHERE band IS NOT NULL) WHERE rn = 1) USING (id))"""


@query(
    f"""WITH {_INSTANCES}, {_MATCHED} SELECT id AS event_instance_id, matched_id, matched_at, matched_label, CASE band WHEN 0 THEN 'tight' WHEN 1 THEN 'standard' WHEN 2 THEN 'wide' END AS matched_window FROM matched"""
)
def matched_outcomes(spark, sf):
    """Events with their best labelled outcome in the band."""
    matched = ev.match_outcomes(ev.canonical_events(catalysts(spark, sf)), ev.outcome_master(event_tape(spark, sf)))
    return matched.select("event_instance_id", "matched_id", "matched_at", "matched_label", "matched_window")


_PRIOR = q.lookup("family", FAMILY_PRIOR, 0.50)
_SCORES = f"""context AS (SELECT m.*, s.as_of AS snapshot_at, coalesce(s.market_cap, 0) AS cap, coalesce(s.cash, 0) AS cash, coalesce(s.debt, 0) AS debt, coalesce(s.revenue, 0) AS revenue, coalesce(s.products, 0) AS products
    FROM matched m ASOF LEFT JOIN snapshots s ON m.symbol = s.symbol AND m.first_seen >= s.as_of),
  parts AS (SELECT *, {_PRIOR} AS prior, greatest(cap, 1.0) AS base, greatest(cash - debt, 0.0) AS spare,
    CASE WHEN revenue >= 500000000 THEN 'commercialized' WHEN products > 0 OR revenue >= 75000000 THEN 'commercial_launch' ELSE 'pre_commercial' END AS state,
    1 - least(abs(days_until - 35.0) / 55.0, 1.0) AS near FROM context),
  risks AS (SELECT *, least(greatest((spare + 0.35 * revenue) / base, 0.0), 1.25) AS floor,
    CASE WHEN snapshot_at IS NULL THEN 0.65 ELSE least(greatest((1 - least(greatest(spare / base + 0.35 * revenue / base, 0.0), 1.0)) * 0.70 + least(debt / base, 1.0) * 0.30, 0.0), 1.0) END AS risk FROM parts),
  scored AS MATERIALIZED (SELECT *, round(least(greatest(prior + {q.lookup("coalesce(source, '')", SOURCE_BONUS, 0.02)} + CASE WHEN strict THEN 0.08 ELSE -0.06 END + CASE WHEN corroborated THEN 0.06 ELSE 0.0 END + 0.10 * near
      + CASE WHEN state = 'commercialized' AND family IN ('pdufa', 'label_expansion', 'regulatory_update') THEN 0.05 WHEN state = 'pre_commercial' AND family IN {q.t.CLINICAL_TYPES} THEN 0.04 WHEN state = 'commercial_launch' THEN 0.03 ELSE 0.0 END
      + 0.10 * least(greatest(floor, 0.0), 0.5) - 0.18 * least(greatest(risk, 0.0), 1.0) - 0.08 * least(greatest(crowdedness, 0.0), 1.0), -1.0), 1.5), 9) AS pre_event_score,
    round(least(greatest(0.38 + 0.25 * prior + CASE WHEN strict THEN 0.12 ELSE -0.08 END + CASE WHEN corroborated THEN 0.08 ELSE 0.0 END + 0.06 * near - 0.12 * risk - 0.06 * crowdedness, 0.0), 1.0), 9) AS confidence,
    round(least(greatest(prior + CASE WHEN strict THEN 0.08 ELSE -0.05 END + CASE WHEN corroborated THEN 0.05 ELSE 0.0 END - 0.10 * risk - 0.05 * crowdedness, 0.0), 1.0), 9) AS success FROM risks)"""
_CLUSTERED = q.greedy(
    "scored", "symbol", "greatest(first_seen, expected_date - INTERVAL 20 DAY), NOT strict, sp DESC, pre_event_score DESC, importance DESC, expected_date, id",
    "greatest(first_seen, expected_date - INTERVAL 20 DAY)", "coalesce(matched_at, expected_date) + INTERVAL 6 DAY",
)
_MASTER = f"""{SQL_SNAPSHOTS}, {_INSTANCES}, {_MATCHED}, {_SCORES}, {_CLUSTERED},
  placed AS (SELECT o.*, max(k.rn) OVER (PARTITION BY o.symbol ORDER BY o.rn) AS blocker FROM ordered o LEFT JOIN kept k ON k.symbol = o.symbol AND k.rn = o.rn),
  master AS MATERIALIZED (SELECT p.*, p.rn = p.blocker AS active, CASE WHEN p.rn <> p.blocker THEN b.id END AS blocked_by FROM placed p JOIN ordered b ON b.symbol = p.symbol AND b.rn = p.blocker)"""


@query(
    f"""WITH RECURSIVE {_MASTER} SELECT id AS event_instance_id, symbol, family AS event_family, state AS company_state, round(floor, 9) AS floor_support, round(risk, 9) AS financing_risk, pre_event_score, confidence AS confidence_proxy,
    success AS success_probability_proxy, matched_label, matched_at, latest_event_id, active, blocked_by, CASE WHEN NOT active THEN 'overlapping_active_event_window' END AS cluster_reason,
    strict AND days_until BETWEEN 7 AND 90 AND active AS deployable FROM master"""
)
def event_master(spark, sf):
    """The event master: context, scores, matched outcome, cluster control."""
    rows = _master(spark, sf).withColumns({c: F.round(c, 9) for c in ("floor_support", "financing_risk")})
    return rows.select(
        "event_instance_id", "symbol", "event_family", "company_state", "floor_support", "financing_risk", "pre_event_score", "confidence_proxy", "success_probability_proxy",
        "matched_label", "matched_at", "latest_event_id", "active", "blocked_by", "cluster_reason", "deployable",
    )


def _trades(spark, sf):
    return ev.trades(_master(spark, sf, ev.TRADED), prices(spark, sf))


_TRADES = f"""{SQL_PRICES}, {_MASTER},
  wanted AS (SELECT *, expected_date - to_days(CAST(n AS INTEGER)) AS entry_at, expected_date + INTERVAL 1 DAY AS exit_at, 'pre_event_long' AS sleeve, 'pre_' || n || 'd_plus1d' AS variant
      FROM (SELECT *, unnest([20, 10, 5]) AS n FROM master WHERE active AND strict) WHERE first_seen <= expected_date - to_days(CAST(n AS INTEGER))
    UNION ALL SELECT *, 0, matched_at + INTERVAL 1 DAY, matched_at + INTERVAL 6 DAY, CASE WHEN matched_label = 1 THEN 'post_event_reaction_long' ELSE 'event_short_or_pairs' END,
      CASE WHEN matched_label = 1 THEN 'post_next_bar_plus5d' ELSE 'short_next_bar_plus5d' END FROM master WHERE active AND matched_label IS NOT NULL),
  priced AS (SELECT w.* EXCLUDE (rn, s, e), a.close AS entry, b.close AS exit, c.close AS anchor FROM wanted w ASOF LEFT JOIN prices a ON w.symbol = a.symbol AND w.entry_at <= a.date
    ASOF LEFT JOIN prices b ON w.symbol = b.symbol AND w.exit_at <= b.date ASOF LEFT JOIN prices c ON w.symbol = c.symbol AND w.matched_at >= c.date),
  paid AS MATERIALIZED (SELECT *, (exit / entry - 1) * CASE WHEN sleeve = 'event_short_or_pairs' THEN -1 ELSE 1 END AS gross,
    (CASE WHEN cap <= 0 THEN 275.0 WHEN cap < 250000000 THEN 425.0 WHEN cap < 1000000000 THEN 220.0 WHEN cap < 5000000000 THEN 110.0 ELSE 45.0 END + 125.0 + 35.0) / 10000.0
      + CASE WHEN sleeve = 'event_short_or_pairs' THEN 0.002 + 0.008 * risk + 0.003 * 0.35 ELSE 0.0 END AS cost,
    round(CASE sleeve WHEN 'event_short_or_pairs' THEN prior + 0.20 * confidence - 0.15 * risk WHEN 'post_event_reaction_long' THEN prior + 0.25 * confidence - 0.12 * least(greatest(entry / anchor - 1, 0.0), 0.6) ELSE pre_event_score END, 9) AS score
    FROM priced WHERE entry > 0 AND exit IS NOT NULL AND (sleeve <> 'post_event_reaction_long' OR anchor > 0)),
  {q.greedy("paid", "sleeve, variant, symbol", "entry_at, NOT exact, score DESC, id", "entry_at", "exit_at").replace("ordered", "lined").replace("kept", "held")},
  trades AS (SELECT l.* FROM lined l JOIN held h ON l.sleeve = h.sleeve AND l.variant = h.variant AND l.symbol = h.symbol AND l.rn = h.rn)"""


@query(
    f"""WITH RECURSIVE {_TRADES} SELECT sleeve, variant, symbol, id AS event_instance_id, family AS event_family, entry_at, exit_at, round(gross, 9) + 0.0 AS gross_return, round(gross - cost, 9) + 0.0 AS cost_adjusted_return, round(score, 6) AS score,
    CASE WHEN days_until <= 30 THEN '07_30d' WHEN days_until <= 60 THEN '31_60d' WHEN days_until <= 90 THEN '61_90d' WHEN days_until <= 120 THEN '91_120d' ELSE '121d_plus' END AS horizon_bucket, exact AS timing_exact FROM trades"""
)
def trade_labels(spark, sf):
    """Non-overlapping trades of the three sleeves."""
    return _trades(spark, sf).drop("knowledge_bucket").withColumn("score", F.round("score", 6))


@query(
    f"""WITH RECURSIVE {_TRADES}, usable AS (SELECT sleeve, variant, date_trunc('quarter', entry_at) AS win, id AS key, score, round(gross, 9) AS gross, round(gross - cost, 9) AS net FROM trades),
    rk AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY sleeve, variant, win ORDER BY score DESC, key) AS hi, row_number() OVER (PARTITION BY sleeve, variant, win ORDER BY score, key) AS lo,
      median(score) OVER w AS med, rank() OVER (PARTITION BY sleeve, variant, win ORDER BY score) + (count(*) OVER (PARTITION BY sleeve, variant, win, score) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY sleeve, variant, win ORDER BY gross) + (count(*) OVER (PARTITION BY sleeve, variant, win, gross) - 1) / 2.0 AS ry FROM usable WINDOW w AS (PARTITION BY sleeve, variant, win)),
    bundle AS (SELECT sleeve, variant, win, count(*) AS rows, CASE WHEN count(*) < 3 OR corr(rx, ry) IS NULL OR isnan(corr(rx, ry)) THEN 0.0 ELSE corr(rx, ry) END AS rank_ic,
      avg(CASE WHEN (score >= med) = (net > 0) THEN 1.0 ELSE 0.0 END) AS hit_rate,
      CASE WHEN count(*) > 1 THEN avg(gross) FILTER (WHERE hi <= greatest(1, n // 5)) - avg(gross) FILTER (WHERE lo <= greatest(1, n // 5)) ELSE 0.0 END AS spread,
      CASE WHEN count(*) > 1 THEN avg(net) FILTER (WHERE hi <= greatest(1, n // 5)) - avg(net) FILTER (WHERE lo <= greatest(1, n // 5)) ELSE 0.0 END AS net_spread,
      avg(net) FILTER (WHERE hi <= greatest(1, n // 5)) AS top_net FROM rk GROUP BY 1, 2, 3)
    SELECT sleeve, variant, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS windows, round(avg(rank_ic), 6) AS rank_ic, round(avg(hit_rate), 6) AS hit_rate, round(avg(spread), 6) AS spread, round(avg(net_spread), 6) AS net_spread,
      round(avg(top_net), 6) AS top_net, round(quantile_cont(net_spread, 0.1), 6) AS ci_low, round(quantile_cont(net_spread, 0.9), 6) AS ci_high FROM bundle GROUP BY 1, 2"""
)
def sleeve_scorecards(spark, sf):
    """Window bundles per sleeve, variant and quarter, then aggregated with confidence bounds."""
    rows = _trades(spark, sf).withColumn("window", F.date_trunc("quarter", "entry_at"))
    windows = window_summary(rows, ["sleeve", "variant", "window"], ["event_instance_id"])
    out = aggregate_windows(windows, ["sleeve", "variant"])
    return out.select("sleeve", "variant", "rows", "windows", *[F.round(c, 6).alias(c) for c in out.columns[4:]])


# Statistics.


@query(
    f"""WITH {_RETURNS}, x AS (SELECT r.as_of, s.revenue / greatest(s.market_cap, 1.0) AS score, r.return_90d AS y FROM returns r JOIN snapshots s USING (symbol, as_of)),
    k AS (SELECT *, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY as_of, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY as_of, score) - 1) / 2.0 END AS rx,
      CASE WHEN y IS NOT NULL THEN rank() OVER (PARTITION BY as_of, y IS NULL ORDER BY y) + (count(*) OVER (PARTITION BY as_of, y) - 1) / 2.0 END AS ry FROM x)
    SELECT as_of, count(*) AS n, round(CASE WHEN count(*) < 3 OR corr(rx, ry) IS NULL OR isnan(corr(rx, ry)) THEN 0.0 ELSE corr(rx, ry) END, 6) AS rank_ic FROM k WHERE rx IS NOT NULL AND ry IS NOT NULL GROUP BY 1"""
)
def rank_ic(spark, sf):
    """Spearman coefficient of revenue yield and 90 day return per quarter."""
    base = snapshots(spark, sf)
    rows = lb.forward_returns(base, prices(spark, sf)).join(base, ["symbol", "as_of"])
    rows = rows.select("as_of", (F.col("revenue") / F.greatest("market_cap", F.lit(1.0))).alias("score"), F.col("return_90d").alias("y"))
    return spearman(rows, ["as_of"], "score", "y").withColumn("rank_ic", F.round("rank_ic", 6))


_SCORED = f"""{_RETURNS}, usable AS (SELECT r.as_of, r.symbol, round(s.revenue / greatest(s.market_cap, 1.0), 9) AS score, r.return_90d AS gross, r.return_90d - 0.01 AS net
    FROM returns r JOIN snapshots s USING (symbol, as_of) WHERE r.return_90d IS NOT NULL),
  rk AS (SELECT *, count(*) OVER (PARTITION BY as_of) AS n, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, symbol) AS hi, row_number() OVER (PARTITION BY as_of ORDER BY score, symbol) AS lo,
    median(score) OVER (PARTITION BY as_of) AS med, rank() OVER (PARTITION BY as_of ORDER BY score) + (count(*) OVER (PARTITION BY as_of, score) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY as_of ORDER BY gross) + (count(*) OVER (PARTITION BY as_of, gross) - 1) / 2.0 AS ry FROM usable),
  win AS (SELECT as_of, count(*) AS rows, CASE WHEN count(*) < 3 OR corr(rx, ry) IS NULL OR isnan(corr(rx, ry)) THEN 0.0 ELSE corr(rx, ry) END AS rank_ic,
    avg(CASE WHEN (score >= med) = (net > 0) THEN 1.0 ELSE 0.0 END) AS hit_rate,
    CASE WHEN count(*) > 1 THEN avg(gross) FILTER (WHERE hi <= greatest(1, n // 5)) - avg(gross) FILTER (WHERE lo <= greatest(1, n // 5)) ELSE 0.0 END AS spread,
    CASE WHEN count(*) > 1 THEN avg(net) FILTER (WHERE hi <= greatest(1, n // 5)) - avg(net) FILTER (WHERE lo <= greatest(1, n // 5)) ELSE 0.0 END AS net_spread,
    avg(net) FILTER (WHERE hi <= greatest(1, n // 5)) AS top_net FROM rk GROUP BY 1)"""


def _windows(spark, sf):
    base = snapshots(spark, sf)
    rows = lb.forward_returns(base, prices(spark, sf)).join(base, ["symbol", "as_of"]).where("return_90d is not null")
    score = F.round(F.col("revenue") / F.greatest("market_cap", F.lit(1.0)), 9)
    rows = rows.select("as_of", "symbol", score.alias("score"), F.col("return_90d").alias("gross_return"), (F.col("return_90d") - 0.01).alias("cost_adjusted_return"))
    return window_summary(rows, ["as_of"], ["symbol"])


@query(
    f"""WITH {_SCORED} SELECT as_of, rows, round(rank_ic, 6) AS rank_ic, round(hit_rate, 6) AS hit_rate, round(spread, 6) AS spread, round(net_spread, 6) AS net_spread, round(top_net, 6) AS top_net FROM win"""
)
def window_bundle(spark, sf):
    """Rank coefficient, hit rate and spreads per quarter."""
    rows = _windows(spark, sf)
    return rows.select("as_of", "rows", *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


@query(
    f"""WITH {_SCORED} SELECT year(as_of) AS year, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS windows, round(avg(rank_ic), 6) AS rank_ic, round(avg(hit_rate), 6) AS hit_rate, round(avg(spread), 6) AS spread,
    round(avg(net_spread), 6) AS net_spread, round(avg(top_net), 6) AS top_net, round(quantile_cont(net_spread, 0.1), 6) AS ci_low, round(quantile_cont(net_spread, 0.9), 6) AS ci_high FROM win GROUP BY 1"""
)
def window_aggregate(spark, sf):
    """Yearly totals and means of the quarterly bundles with interpolated percent points."""
    rows = aggregate_windows(_windows(spark, sf).withColumn("year", F.year("as_of").cast("long")), ["year"])
    return rows.select("year", "rows", "windows", *[F.round(c, 6).alias(c) for c in rows.columns[3:]])


@query(
    """WITH x AS (SELECT l_discount AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, l_returnflag, l_linestatus, l_quantity FROM lineitem),
    d AS (SELECT 'flag' AS dim, l_returnflag AS value, p, y, l_quantity FROM x UNION ALL SELECT 'status', l_linestatus, p, y, l_quantity FROM x UNION ALL SELECT 'flag x status', l_returnflag || '|' || l_linestatus, p, y, l_quantity FROM x)
    SELECT dim, value, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(l_quantity), 6) AS mean_quantity, round(stddev_pop(l_quantity), 6) AS spread FROM d GROUP BY 1, 2"""
)
def stacked_scorecards(spark, sf):
    """Scorecards of several dimensions in one pass: dimensions stacked as rows, one aggregation."""
    dims = F.array(
        F.struct(F.lit("flag").alias("dim"), F.col("l_returnflag").alias("value")),
        F.struct(F.lit("status").alias("dim"), F.col("l_linestatus").alias("value")),
        F.struct(F.lit("flag x status").alias("dim"), F.concat_ws("|", "l_returnflag", "l_linestatus").alias("value")),
    )
    y = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    rows = table(spark, sf, "lineitem").select(F.inline(dims), F.pow(F.col("l_discount") - y, 2).alias("e"), "l_quantity")
    return rows.groupBy("dim", "value").agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("brier"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.round(F.stddev_pop("l_quantity"), 6).alias("spread"))


@query(
    f"""WITH {SQL_EVENTS}, x AS (SELECT source, event_type, {q.exact('status', 'title')} AS exact, {q.outcome('event_type', q.bucket('event_type'), 'title', 'status')} AS o FROM events_all)
    SELECT source, event_type, count(*) AS n, round(avg(CASE WHEN exact THEN 1.0 ELSE 0.0 END), 6) AS exact_rate, round(avg(CASE WHEN o IS NULL THEN 0.0 ELSE 1.0 END), 6) AS labelled_rate FROM x GROUP BY ROLLUP (source, event_type)"""
)
def exactness_rollup(spark, sf):
    """Exact-timing and labelled rates per source and type, with pooled rows."""
    rows = event_tape(spark, sf).withColumns(
        {
            "exact": is_exact_timing(F.col("status"), F.col("event_timestamp"), F.col("title")).cast("double"),
            "labelled": outcome(F.col("event_type"), type_bucket(F.col("event_type")), F.col("title"), F.col("status")).isNotNull().cast("double"),
        }
    )
    return rows.rollup("source", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("exact"), 6).alias("exact_rate"), F.round(F.avg("labelled"), 6).alias("labelled_rate"))


@query(
    """WITH x AS (SELECT l_suppkey, date_trunc('quarter', l_shipdate) AS quarter, l_discount AS w, l_extendedprice AS v, l_tax, l_returnflag, l_linestatus FROM lineitem),
    m AS (SELECT l_suppkey, quarter, l_returnflag, sum(w) AS sw FROM x GROUP BY ALL),
    t AS (SELECT l_suppkey, quarter, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, quarter ORDER BY round(sw, 6) DESC, l_returnflag) AS rn FROM m) WHERE rn = 1)
    SELECT x.l_suppkey, x.quarter, round(sum(w * v) / nullif(sum(w), 0), 0) AS weighted, max(l_tax) AS worst, max(l_linestatus) AS horizon, any_value(t.l_returnflag) AS mode FROM x JOIN t USING (l_suppkey, quarter) GROUP BY 1, 2"""
)
def weighted_signal(spark, sf):
    """Confidence-weighted mean, worst risk and weighted mode per supplier and quarter."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.date_trunc("quarter", "l_shipdate").alias("quarter"), F.col("l_discount").alias("w"), F.col("l_extendedprice").alias("v"), "l_tax", "l_returnflag", "l_linestatus")
    # one shuffle: partial sums per flag first, then combined per key
    parts = rows.groupBy("l_suppkey", "quarter", "l_returnflag").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("v")).alias("swv"), F.max("l_tax").alias("tax"), F.max("l_linestatus").alias("status"))
    mode = F.min_by("l_returnflag", F.struct(-F.round("sw", 6), F.col("l_returnflag")))
    return parts.groupBy("l_suppkey", "quarter").agg(
        F.round(F.sum("swv") / F.nullif(F.sum("sw"), F.lit(0.0)), 0).alias("weighted"), F.max("tax").alias("worst"), F.max("status").alias("horizon"), mode.alias("mode")
    )


@query(
    f"""WITH {SQL_SNAPSHOTS}, r AS (SELECT as_of, symbol, row_number() OVER (PARTITION BY as_of ORDER BY revenue DESC, symbol) AS rn FROM snapshots),
    s AS (SELECT as_of, list(symbol) AS top FROM r WHERE rn <= 10 GROUP BY 1), l AS (SELECT as_of, top, lag(top) OVER (ORDER BY as_of) AS before FROM s)
    SELECT as_of, round(1 - len(list_intersect(top, before)) * 1.0 / len(list_distinct(list_concat(top, before))), 6) AS turnover FROM l WHERE before IS NOT NULL"""
)
def turnover(spark, sf):
    """One less the overlap of consecutive top sets."""
    rank = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("revenue"), "symbol"))
    tops = snapshots(spark, sf).withColumn("rn", rank).where("rn <= 10").groupBy("as_of").agg(F.collect_set("symbol").alias("top"))
    before = F.lag("top").over(Window.orderBy("as_of"))  # one row per date
    rows = tops.withColumn("before", before).where("before is not null")
    return rows.select("as_of", F.round(1 - F.size(F.array_intersect("top", "before")) / F.size(F.array_union("top", "before")), 6).alias("turnover"))


@query(
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS high, round(avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END), 6) AS covered,
    round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share, max(ts) AS latest FROM events GROUP BY 1"""
)
def universe_audit(spark, sf):
    """Counts, coverage and concentration per event type."""
    rows = table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high"),
        F.round(F.avg(F.col("value").isNotNull().cast("double")), 6).alias("covered"), F.max("ts").alias("latest"),
    )
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


# JSON, pivots, sets.


@query(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), -1) AS missing FROM events"""
)
def json_fields(spark, sf):
    """Fields of a JSON text, with a default for absent ones."""
    props = F.from_json("props", T.StructType([T.StructField("k", T.LongType()), T.StructField("missing", T.LongType())]))
    return table(spark, sf, "events").select("event_id", props["k"].alias("k"), F.coalesce(props["missing"], F.lit(-1)).alias("missing"))


@query(
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS "view", count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1"""
)
def pivot_wide(spark, sf):
    """Long counts to wide columns."""
    kinds = ["click", "view", "purchase"]
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", kinds).count().select("user_id", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in kinds])


@query(
    """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
    SELECT 'both' AS side, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'customers', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'suppliers', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)"""
)
def set_operations(spark, sf):
    """Intersection and both differences of two key sets."""
    a = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    parts = {"both": a.intersect(b), "customers": a.exceptAll(b), "suppliers": b.exceptAll(a)}
    out = None
    for side, df in parts.items():
        df = df.select(F.lit(side).alias("side"), "k")
        out = df if out is None else out.unionByName(df)
    return out


# Monitoring.


@query(
    """WITH now AS (SELECT max(ts) - INTERVAL 1 DAY AS t FROM events), x AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 95 WHEN event_type = 'purchase' THEN 88 ELSE 82 END AS priority
      FROM events, now WHERE ts BETWEEN t - INTERVAL 24 HOUR AND t + INTERVAL 12 HOUR)
    SELECT user_id, event_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, ts DESC, event_id) AS rn FROM x) WHERE rn = 1"""
)
def recent_triggers(spark, sf):
    """The most urgent event per user in a window around a clock."""
    rows = table(spark, sf, "events")
    now = rows.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("t"))
    near = rows.join(F.broadcast(now), (F.col("ts") >= F.col("t") - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= F.col("t") + F.expr("INTERVAL 12 HOURS")))
    priority = F.when(F.col("event_type") == "error", 95).when(F.col("event_type") == "purchase", 88).otherwise(82)
    return latest(near.withColumn("priority", priority), ["user_id"], [F.desc("priority"), F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id", "priority")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    """Hourly counts per type (the batch form of the streaming job)."""
    from eventlens.streaming.windows import tumbling

    return tumbling(table(spark, sf, "events"), "1 hour")


@query(
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def sessions(spark, sf):
    """Sessions of a user with gaps below half an hour."""
    w = F.session_window("ts", "30 minutes")
    return table(spark, sf, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


from eventlens import queries_models, queries_portfolio, queries_recommend, queries_text, queries_feeds, queries_documents, queries_books, queries_execution, queries_rules, queries_history, queries_matching, queries_features, queries_graph, queries_deployment  # noqa: E402, F401  they register their queries
