"""Company snapshots rebuilt at past filings, from facts as they were known then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.asof import asof_join
from eventlens.operators.greedy import greedy_spacing
from eventlens.sources.filings import trailing_value

# Forms that anchor a snapshot.
ANCHOR_FORMS = ("10-Q", "10-Q/A", "10-K", "10-K/A", "20-F", "20-F/A", "6-K")


def history_anchors(filings: DataFrame, latest: DataFrame, forms=ANCHOR_FORMS, days: int = 45, most: int = 8) -> DataFrame:
    """symbol, as_of: filing dates of the anchoring forms before the symbol's latest snapshot, ``days`` apart, the last ``most``."""
    cutoff = latest.select("symbol", F.to_date("as_of").alias("_cut"))
    early = filings.where(F.col("form").isin(*forms)).join(cutoff, "symbol").where(F.to_date("filed") < F.col("_cut"))
    kept = greedy_spacing(early.select("symbol", F.to_date("filed").alias("as_of")), ["symbol"], "as_of", days, keep_last=False, latest=most)
    return kept.select("symbol", "as_of")


def instants_asof(rows: DataFrame, facts: DataFrame, by: str, at: str, names: list[str]) -> DataFrame:
    """``rows`` with, per name, the value of the latest fact by (end, filed) of those ended and filed by ``at``.

    A fact is known from the later of its two dates on. Facts and rows are stacked and sorted once per key, and the running largest
    (end, filed, value) of every name is carried along: all names in one pass, whatever their number, and no pair of row and fact.
    Facts without end, filed or value are left out.
    """
    known = facts.where(F.col("name").isin(*names) & F.col("end").isNotNull() & F.col("filed").isNotNull() & F.col("val").isNotNull())
    entry = F.struct("end", "filed", "val")
    one = rows.select(by, F.to_date(at).alias("_t"), F.struct("*").alias("_row"))
    two = known.select(by, F.greatest("end", "filed").alias("_t"), "name", entry.alias("_fact"))
    both = one.unionByName(two, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("_t", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = {f"_b{i}": F.max(F.when(F.col("name") == n, F.col("_fact"))).over(w) for i, n in enumerate(names)}
    out = both.withColumns(best).where(F.col("_row").isNotNull())
    return out.select("_row.*", *[F.when(F.col("_t").isNotNull(), F.col(f"_b{i}.val")).alias(n) for i, n in enumerate(names)])


def closes_before(rows: DataFrame, prices: DataFrame, at: str, days: tuple[int, ...]) -> DataFrame:
    """symbol, ``at`` and ``close_<n>``: the last close at or before each of so many days before; one as-of pass for all of them."""
    stack = rows.select("symbol", at, F.explode(F.array(*[F.lit(d) for d in days])).alias("_d")).withColumn("_w", F.date_sub(F.to_date(at), F.col("_d")))
    found = asof_join(stack, prices, ["symbol"], "_w", "date", ["close"])
    return found.groupBy("symbol", at).agg(*[F.max(F.when(F.col("_d") == d, F.col("close"))).alias(f"close_{d}") for d in days])


def volatility_at(rows: DataFrame, prices: DataFrame, at: str, days: int = 63, least: int = 10) -> DataFrame:
    """symbol, ``at``, volatility: sample deviation of the changes between closes of the ``days`` up to the date, with enough of them."""
    w = Window.partitionBy("symbol").orderBy("date")
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01"))
    moves = prices.select("symbol", day("date").alias("_day"), (F.col("close") / F.lag("close").over(w) - 1).alias("_r"), F.lit(True).alias("_price"))
    both = moves.unionByName(rows.select("symbol", at, day(at).alias("_day")), allowMissingColumns=True)
    span = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-days, 0)
    # the change into the first close of the window does not count; a symbol's very first close has none
    into = F.coalesce(F.first(F.when(F.col("_price"), F.struct("_r")), ignorenulls=True).over(span)["_r"], F.lit(0.0))
    sums = both.select("symbol", at, "_price", (F.count("_price").over(span) - 1).alias("n"), (F.sum("_r").over(span) - into).alias("s"), (F.sum(F.col("_r") * F.col("_r")).over(span) - into * into).alias("q"))
    spread = F.sqrt(F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1))
    return sums.where("_price is null").select("symbol", at, F.when(F.col("n") >= least, spread).alias("volatility"))


def rebuilt_snapshots(anchors: DataFrame, facts: DataFrame, prices: DataFrame, latest: DataFrame) -> DataFrame:
    """One snapshot per anchor (symbol, as_of) with a price: value, debt, returns and volatility as known on its date.

    ``facts`` has symbol, name (cash, debt, shares, revenue), start, end, filed, val; ``latest`` the symbol's current as_of,
    market_cap, cash, debt and price, which stand in where nothing was filed. A symbol has few anchors, so only revenue (a trailing
    sum over several facts) meets them as pairs.
    """
    rows = instants_asof(anchors, facts, "symbol", "as_of", ["cash", "debt", "shares"])
    revenue = trailing_value(facts.where("name = 'revenue'").join(anchors, "symbol"), ["symbol", "as_of"], "as_of")
    rows = rows.join(closes_before(anchors, prices, "as_of", (0, 90, 180)), ["symbol", "as_of"]).join(volatility_at(anchors, prices, "as_of"), ["symbol", "as_of"])
    rows = rows.join(revenue.withColumnRenamed("value", "revenue"), ["symbol", "as_of"], "left").where("close_0 > 0")
    now = latest.select("symbol", *[F.col(c).alias(f"_{c}") for c in ("market_cap", "cash", "debt", "price")])
    rows = rows.join(now, "symbol", "left")
    or_now = lambda c: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.col(f"_{c}"), F.lit(0.0))
    filed = F.col("shares") > 0
    guess = F.when((F.col("_market_cap") > 0) & (F.col("_price") > 0), F.col("_market_cap") / F.col("_price"))
    rows = rows.withColumns({"cash": or_now("cash"), "debt": or_now("debt"), "revenue": F.coalesce("revenue", F.lit(0.0)), "shares": F.coalesce(F.when(filed, F.col("shares")), guess, F.lit(0.0)), "shares_source": F.when(filed, "filed").when(guess.isNotNull(), "estimated_current").otherwise("unavailable")})
    cap = F.when(F.col("shares") > 0, F.col("close_0") * F.col("shares")).otherwise(F.coalesce("_market_cap", F.lit(0.0)))
    rows = rows.withColumn("market_cap", cap)
    change = lambda d: F.when(F.col(f"close_{d}") > 0, F.col("close_0") / F.col(f"close_{d}") - 1)
    return rows.select(
        "symbol", "as_of", F.col("close_0").alias("price"), "shares", "shares_source", "market_cap",
        F.greatest(F.col("market_cap") + F.col("debt") - F.col("cash"), F.lit(0.0)).alias("enterprise_value"),
        "revenue", "cash", "debt", change(90).alias("momentum_3mo"), change(180).alias("trailing_6mo_return"), "volatility",
    )
