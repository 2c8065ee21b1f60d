"""The driver's tables as domain views: prices, snapshots, catalysts, event tape.

Line items are a market: suppliers are symbols, unit prices on ship dates are closes, an order's line is an
event announced on the order date and expected on the ship date. (l_orderkey, l_linenumber) is not
unique, so event ids hold all four keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Titles that stand for the feeds' texts, picked by part key.
TITLES = (
    "FDA approved the supplemental NDA for a new indication",
    "Positive topline phase 3 data: met the primary endpoint",
    "Phase 2 trial missed the primary endpoint",
    "Complete response letter received",
    "Definitive agreement for an acquisition",
    "Share repurchase program",
    "Advisory committee voted in favor",
    "PDUFA target action date set",
    "Quarterly results and business update",
    "Clinical hold in phase 1 trial",
    "Commercial launch update",
    "Filing accepted with priority review",
    "Interim data readout",
    "Next milestone",
    "Company to withdraw its application",
    "Pivotal study enrollment complete",
)

#: Explicit types by order priority, statuses by order status, sources by return flag.
KINDS = {"1-URGENT": "pdufa", "2-HIGH": "phase3_readout", "3-MEDIUM": "phase2_readout", "4-NOT SPECIFIED": "clinical_readout", "5-LOW": "adcom"}
STATUSES = {"O": "exact_company_calendar", "F": "exact_press_release", "P": "phase_timing_estimate"}
SOURCES = {"A": "sec", "N": "eodhd_news", "R": "internal_inference"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column: str, pairs: dict[str, str]):
    out = None
    for k, v in pairs.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, close: the highest unit price of the day (exact, whatever the order of the rows)."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    return rows.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, as_of (quarter start), market_cap, revenue, cash, debt, products; one row per symbol and quarter."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.date_trunc("quarter", "l_shipdate").alias("as_of")).agg(
        F.round(F.sum("l_extendedprice") * 100, 0).alias("market_cap"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) * 60, 0).alias("revenue"),
        F.count_if(F.col("l_returnflag") == "A").alias("products"),
    )
    balance = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), "s_acctbal")
    return lines.join(balance, "symbol", "left").select(
        "symbol", "as_of", "market_cap", "revenue",
        (F.greatest(F.coalesce("s_acctbal", F.lit(0.0)), F.lit(0.0)) * 10_000).alias("cash"),
        (F.greatest(-F.coalesce("s_acctbal", F.lit(0.0)), F.lit(0.0)) * 100_000).alias("debt"),
        "products",
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("l_partkey") % len(TITLES) + 1).cast("int"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("symbol"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("event_id"),
        F.col("o_orderdate").alias("as_of"),
        F.col("l_shipdate").alias("at"),
        (F.col("l_partkey") % 4).alias("program_id"),
        _mapped("o_orderpriority", KINDS).alias("event_type"),
        title.alias("title"),
        _mapped("o_orderstatus", STATUSES).alias("status"),
        _mapped("l_returnflag", SOURCES).alias("source"),
        F.round(F.col("l_discount") * 10, 2).alias("importance"),
        F.round(F.col("l_tax") * 10, 2).alias("crowdedness"),
    )


def catalysts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced events: as_of is when they became known, expected_date when they should happen."""
    rows = _events(spark, sf_dir).where("at >= as_of")
    return rows.withColumn("expected_date", F.date_trunc("quarter", "at")).where("expected_date >= as_of").drop("at")


def dated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``event_tape`` (at ``at``) with as_of, and the expected_date of those that are ``catalysts`` too (else null)."""
    quarter = F.date_trunc("quarter", "at")
    return _events(spark, sf_dir).withColumn("expected_date", F.when((F.col("at") >= F.col("as_of")) & (quarter >= F.col("as_of")), quarter))


def event_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened: every line as an event at its ship date."""
    return _events(spark, sf_dir).withColumnRenamed("at", "event_timestamp").drop("as_of", "importance", "crowdedness")


#: The same views for the SQL oracle.
SQL_PRICES = """prices AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS close
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)"""
SQL_SNAPSHOTS = """snapshots AS (
  SELECT l.symbol, l.as_of, market_cap, revenue, greatest(coalesce(s_acctbal, 0.0), 0.0) * 10000 AS cash,
    greatest(-coalesce(s_acctbal, 0.0), 0.0) * 100000 AS debt, products
  FROM (SELECT l_suppkey AS symbol, date_trunc('quarter', l_shipdate) AS as_of, round(sum(l_extendedprice) * 100, 0) AS market_cap,
      round(sum(l_extendedprice * (1 - l_discount)) * 60, 0) AS revenue, count(*) FILTER (WHERE l_returnflag = 'A') AS products
    FROM lineitem GROUP BY 1, 2) l LEFT JOIN supplier ON s_suppkey = l.symbol)"""


def _case(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


SQL_EVENTS = f"""events_all AS (
  SELECT l_suppkey AS symbol, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey) AS event_id, o_orderdate AS as_of, l_shipdate AS happened,
    l_partkey % 4 AS program_id, {_case('o_orderpriority', KINDS)} AS event_type,
    ([{', '.join(f"'{t}'" for t in TITLES)}])[l_partkey % {len(TITLES)} + 1] AS title,
    {_case('o_orderstatus', STATUSES)} AS status, {_case('l_returnflag', SOURCES)} AS source,
    round(l_discount * 10, 2) AS importance, round(l_tax * 10, 2) AS crowdedness
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SQL_CATALYSTS = SQL_EVENTS + """, catalysts AS (
  SELECT * EXCLUDE (happened), date_trunc('quarter', happened) AS expected_date FROM events_all WHERE happened >= as_of AND date_trunc('quarter', happened) >= as_of)"""
