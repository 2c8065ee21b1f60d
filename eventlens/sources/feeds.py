"""Vendor feeds as events: news, earnings calendars, estimated calendars, price payloads, filing links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.taxonomy import event_type, has_any, looked_up
from eventlens.operators.rows import once

# Verbs that announce something, news types with importance and markers in the order they are tried, importance of inferred types.
NEWS_VERBS = (
    "announce", "announces", "reported", "reports", "provide", "provides", "receive", "receives", "filed", "files", "granted", "vote", "votes", "voted", "recommend",
    "recommends", "acquire", "acquires", "withdraw", "withdraws", "discontinue", "divest", "expand", "repurchase",
)
NEWS_TYPES = (
    ("strategic_transaction", 0.84, ("acquisition", "acquire ", "acquires", "acquiring", "merger", "definitive agreement", "buyout", "m&a")),
    (
        "portfolio_repositioning",
        0.76,
        (
            "withdraw", "withdrawal", "withdraws", "discontinue", "discontinuation", "divest", "divestiture", "strategic review", "out-license", "outlicense",
            "reprioritize", "deprioritize",
        ),
    ),
    ("label_expansion", 0.79, ("label expansion", "expanded indication", "supplemental nda", "snda", "new indication")),
    ("capital_allocation", 0.68, ("share repurchase", "buyback", "repurchase", "capital allocation", "special dividend", "deleveraging")),
    ("recent_offering_filing", 0.57, ("offering", "atm", "shelf", "registered direct", "private placement")),
    ("earnings", 0.58, ("earnings", "financial results", "quarterly results", "annual results")),
)
NEWS_TAGS = ("financial results", "quarterly results", "earnings release", "earnings results")
INFERRED_IMPORTANCE = (
    ("phase3_readout", 0.84), ("phase2_readout", 0.81), ("phase1_readout", 0.74), ("clinical_readout", 0.78), ("pdufa", 0.88), ("adcom", 0.85),
    ("regulatory_update", 0.80), ("commercial_update", 0.62),
)
GUIDED_TYPES = ("strategic_transaction", "portfolio_repositioning", "label_expansion", "capital_allocation")
_ORDINALS = (("first", 1), ("1st", 1), ("second", 2), ("2nd", 2), ("third", 3), ("3rd", 3), ("fourth", 4), ("4th", 4))


def guided_date(text: Column, published: Column) -> Column:
    """End of the first period that a text names: Q3 2026, third quarter of 2026, 2H 26, second half 2026.

    The four forms are tried in this order; a period that ends before the day of publication does not count.
    """
    low = F.lower(text)

    def end(pattern: str, months: int, named: bool) -> Column:
        part, year = F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)
        number = looked_up(part, _ORDINALS, 0) if named else F.coalesce(part.try_cast("int"), F.lit(0))
        y = year.try_cast("int")
        y = F.when(y < 100, y + 2000).when(y >= 2000, y)
        at = F.when((number > 0) & y.isNotNull(), F.last_day(F.make_date(y, number * months, F.lit(1))))
        return F.when(at >= F.coalesce(F.to_date(published), at), at)

    # The four patterns.
    return F.coalesce(
        end(r"\bq([1-4])[\s'-]*(\d{2,4})\b", 3, False),
        end(r"\b(first|1st|second|2nd|third|3rd|fourth|4th)\s+quarter(?:\s+of)?\s+(\d{2,4})\b", 3, True),
        end(r"\b([12])h[\s'-]*(\d{2,4})\b", 6, False),
        end(r"\b(first|1st|second|2nd)\s+half(?:\s+of)?\s+(\d{2,4})\b", 6, True),
    )


def news_events(news: DataFrame) -> DataFrame:
    """Events of news rows (symbol, symbols, title, content, tags, date): one per row that announces something of a known type.

    Rows that name symbols without the asked one, say nothing by their verbs, or have no date or type go.
    """
    blank = F.lit("")
    title, content = F.coalesce("title", blank), F.coalesce("content", blank)
    headline = F.lower(F.concat(title, F.lit(" "), F.substring(content, 1, 400)))
    named = F.filter(F.coalesce("symbols", F.array().cast("array<string>")), lambda s: F.coalesce(s, blank) != "")
    ours = (F.size(named) == 0) | F.array_contains(F.transform(named, lambda s: F.upper(s)), F.upper("symbol"))
    tagged = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t).isin(*NEWS_TAGS))
    rules = [(n, i, has_any(headline, m) | (F.coalesce(tagged, F.lit(False)) if n == "earnings" else F.lit(False))) for n, i, m in NEWS_TYPES]
    told = reduce(lambda chain, r: chain.when(r[2], F.struct(F.lit(r[0]).alias("type"), F.lit(r[1]).alias("importance"))), rules[1:], F.when(rules[0][2], F.struct(F.lit(rules[0][0]).alias("type"), F.lit(rules[0][1]).alias("importance"))))
    rows = news.where(ours & has_any(headline, NEWS_VERBS) & F.col("date").isNotNull())
    rows = rows.select("*", headline.alias("_head"), F.inline(F.array(F.struct(told.alias("_told"), event_type(F.lit(None).cast("string"), title, content).alias("_seen")))))
    weight = looked_up(F.col("_seen"), INFERRED_IMPORTANCE, -1.0)
    rows = rows.withColumns({"event_type": F.coalesce("_told.type", F.when(weight > 0, F.col("_seen"))), "importance": F.coalesce("_told.importance", weight)}).where("event_type is not null")
    guided = F.when(F.col("event_type").isin(*GUIDED_TYPES), guided_date(F.col("_head"), F.col("date")).cast("timestamp"))
    rows = once(rows, {"_guided": guided})
    rows = rows.withColumns({"expected_date": F.coalesce("_guided", F.col("date").cast("timestamp")), "status": F.when(F.col("_guided").isNotNull(), "guided_company_event").otherwise("exact_press_release")})
    return rows.withColumns({"title": F.substring(title, 1, 180), "crowdedness": F.lit(0.35), "source": F.lit("eodhd_news")}).drop("_head", "_told", "_seen", "_guided")


def earnings_events(rows: DataFrame) -> DataFrame:
    """Earnings calendar rows (symbol, report_date, before_after_market, percent) as exact events; a date gets the hour of its session."""
    session = F.lower(F.coalesce("before_after_market", F.lit("")))
    hour = F.when(session == "beforemarket", 8).when(session == "aftermarket", 16).otherwise(12)
    stamp, text = F.try_to_timestamp("report_date"), F.col("report_date")
    whole = (F.date_trunc("day", stamp) == stamp) & ~F.contains(text, F.lit("T"))
    at = F.when(whole, stamp + F.make_dt_interval(F.lit(0), hour)).otherwise(stamp)
    return rows.select(
        "symbol", F.lit("earnings").alias("event_type"), F.concat("symbol", F.lit(" earnings report")).alias("title"), at.alias("expected_date"), F.lit("exact_company_calendar").alias("status"),
        F.when(F.col("percent").isNotNull(), 0.60).otherwise(0.55).alias("importance"), F.lit(0.35).alias("crowdedness"), F.lit("eodhd_earnings").alias("source"),
    ).where("expected_date is not null")


def estimated_report(quarterly: Column, yearly: Column) -> Column:
    """When the next report is due: 85 days after the last quarterly one, else 90 after the last yearly one."""
    return F.coalesce(F.date_add(quarterly, 85), F.date_add(yearly, 90))


def price_series(payload: DataFrame) -> DataFrame:
    """Price rows (symbol, date, close, adjusted_close as texts or numbers) as a tape: the adjusted close where there is one; bad rows go."""
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    rows = payload.select("symbol", F.to_date(F.try_to_timestamp(F.col("date").cast("string"))).alias("date"), F.coalesce(number("adjusted_close"), number("close")).alias("close"))
    return rows.where("symbol is not null and date is not null and close is not null")


def filing_link(base: str, company: Column, accession: Column, document: Column) -> Column:
    """Where a filing's document lies: base, company number without leading zeros, accession without dashes, document."""
    clean = F.nullif(F.replace(accession, F.lit("-"), F.lit("")), F.lit(""))
    return F.concat_ws("/", F.lit(base), company.cast("bigint").cast("string"), clean, document) if base else F.concat_ws("/", company.cast("string"), clean, document)
