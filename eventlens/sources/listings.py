"""Exchange listings, filing summaries of companies, and what recent news still tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.operators.asof import latest
from eventlens.sources.feeds import news_events

# Names of a listing's columns in the order they are tried, its default type, offering forms and fact names.
LISTING_NAMES = {
    "code": ("Code", "code", "Symbol", "symbol"),
    "date_listed": ("IPODate", "ipoDate", "ListingDate", "listingDate"),
    "date_delisted": ("DelistedAt", "delistedAt", "DelistedDate", "delistedDate"),
    "name": ("Name", "name"),
    "security_type": ("Type", "type"),
    "exchange": ("Exchange", "exchange"),
    "gone": ("IsDelisted", "isDelisted"),
}
SECURITY_TYPE = "Common Stock"
OFFERING_FORMS = ("S-3", "424B5", "424B3", "F-3", "S-1")
REVENUE_FACTS = ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet")
CASH_FACTS = ("CashAndCashEquivalentsAtCarryingValue",)
CASH_FLOW_FACTS = ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations")


def listings(rows: DataFrame, order: list[str]) -> DataFrame:
    """Listings of rows (fields: map of text, exchange, delisted): once per (ticker, exchange, is_delisted), the first by ``order``.

    The ticker is the code up to its first dot. Rows without a code go; empty values count as missing.
    """
    first = lambda n: F.coalesce(*[F.nullif(F.col("fields")[a], F.lit("")) for a in LISTING_NAMES[n]])
    code = first("code")
    gone = F.coalesce("delisted", F.lit(False)) | ~F.lower(F.coalesce(first("gone"), F.lit("false"))).isin("false", "0")
    out = rows.select(
        *order, F.upper(F.split_part(code, F.lit("."), F.lit(1))).alias("ticker"), F.coalesce(first("name"), code).alias("company_name"), F.coalesce(first("exchange"), F.col("exchange")).alias("exchange"),
        F.coalesce(first("security_type"), F.lit(SECURITY_TYPE)).alias("security_type"), code.alias("listing_symbol"), first("date_listed").alias("date_listed"), first("date_delisted").alias("date_delisted"), gone.alias("is_delisted"),
    )
    return latest(out.where("listing_symbol is not null"), ["ticker", "exchange", "is_delisted"], [F.asc(o) for o in order]).drop(*order)


_FACT = T.StructType([T.StructField("end", T.StringType()), T.StructField("fy", T.LongType()), T.StructField("val", T.DoubleType())])
_UNITS = T.MapType(T.StringType(), T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(_FACT)))]))


def latest_fact(facts: Column, names: tuple[str, ...], unit: str = "USD") -> Column:
    """Value of the latest entry by (end, fy) of the first name that has any in the unit; of equal ones the first in the document."""

    def one(name: str) -> Column:
        entries = F.transform(facts[name]["units"][unit], lambda e, i: F.struct(F.coalesce(e["end"], F.lit("")).alias("end"), F.coalesce(e["fy"], F.lit(0)).alias("fy"), (-i).alias("place"), e["val"].alias("val")))
        return F.array_max(F.filter(entries, lambda e: e["val"].isNotNull()))["val"]

    return F.coalesce(*[one(n) for n in names])


def filing_summaries(docs: DataFrame, first: int = 25) -> DataFrame:
    """Per document (key columns, form, filing_date: parallel arrays, newest first; facts: JSON of name to units): last reports, offerings and values.

    The ``first`` filings that both arrays tell of count. All is worked out in the row: documents need no shuffle.
    """
    both = F.slice(F.arrays_zip("form", "filing_date"), 1, F.least(F.lit(first), F.size("form"), F.size("filing_date")))
    rows = docs.withColumns({"_f": F.coalesce(both, F.array().cast("array<struct<form:string,filing_date:string>>")), "_v": F.from_json("facts", _UNITS)})
    last = lambda kind: F.get(F.filter("_f", lambda f: f["form"] == kind), F.lit(0))["filing_date"]
    others = [c for c in docs.columns if c not in ("form", "filing_date", "facts")]
    return rows.select(
        *others, F.size("_f").alias("recent_filings"), last("10-Q").alias("last_10q_date"), last("10-K").alias("last_10k_date"), F.filter("_f", lambda f: f["form"].isin(*OFFERING_FORMS)).alias("offerings"),
        latest_fact(F.col("_v"), REVENUE_FACTS).alias("revenue_ttm"), latest_fact(F.col("_v"), CASH_FACTS).alias("cash_latest"), latest_fact(F.col("_v"), CASH_FLOW_FACTS).alias("operating_cashflow"),
    )


def merged_events(events: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Events once per key, type, date, status and title: the first in ``order``."""
    return latest(events, [*by, "event_type", "expected_date", "status", "title"], order)


def recent_news_events(news: DataFrame, as_of: Column, order: list[Column], ahead: int = 120, back: int = 180, grace: int = 30) -> DataFrame:
    """Events of cached news that still count at ``as_of``, once each.

    News of more than ``back`` days before goes, and events expected more than ``ahead`` days after; exact ones may be over for ``grace`` days.
    """
    day = F.to_date(as_of)
    events = news_events(news.where(F.col("date").isNull() | (F.to_date("date") >= F.date_sub(day, back))))
    at = F.to_date("expected_date")
    over = F.col("status").startswith("exact") & (at < F.date_sub(day, grace))
    return merged_events(events.where((at <= F.date_add(day, ahead)) & ~over), ["symbol"], order)
