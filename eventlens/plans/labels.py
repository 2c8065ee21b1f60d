"""Point-in-time labels from the price tape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.taxonomy import timing_priority, type_bucket, type_priority
from eventlens.operators.asof import asof_join, latest


def forward_returns(snapshots: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (30, 90, 180)) -> DataFrame:
    """symbol, as_of and return_<h>d: last close at or before as_of to the first at or after as_of + h days.

    The horizons are stacked as rows, so one forward as-of join serves them all.
    """
    snapshots, prices = snapshots.repartition("symbol"), prices.repartition("symbol")  # both joins and the sums stay by symbol
    based = asof_join(snapshots, prices, ["symbol"], "as_of", "date", ["close"]).where("close > 0").withColumnRenamed("close", "base").drop("date")
    stacked = based.select("symbol", "as_of", "base", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("h"))
    stacked = stacked.withColumn("target", F.col("as_of") + F.make_dt_interval(F.col("h")))
    found = asof_join(stacked, prices, ["symbol"], "target", "date", ["close"], "forward")
    value = F.col("close") / F.col("base") - 1
    return found.groupBy("symbol", "as_of").agg(*[F.max(F.when(F.col("h") == h, value)).alias(f"return_{h}d") for h in horizons])


def benchmark_alpha(returns: DataFrame, benchmark: int, horizon: int) -> DataFrame:
    """Return less the benchmark symbol's at the same as_of; the raw return where the benchmark has none."""
    name = f"return_{horizon}d"
    other = returns.where(F.col("symbol") == benchmark).select("as_of", F.col(name).alias("benchmark"))
    return returns.where(f"{name} is not null").join(other, "as_of", "left").select("symbol", "as_of", F.coalesce(F.col(name) - F.col("benchmark"), F.col(name)).alias("alpha"))


def event_window_return(events: DataFrame, prices: DataFrame, at: str, days: int = 5) -> DataFrame:
    """Move from the last close at or before ``days`` before the event to the first at or after ``days`` after it."""
    step = F.expr(f"INTERVAL {days} DAYS")
    events, prices = events.repartition("symbol"), prices.repartition("symbol")
    rows = events.withColumns({"_from": F.col(at) - step, "_to": F.col(at) + step})
    rows = asof_join(rows, prices, ["symbol"], "_from", "date", ["close"], prefix="before_")
    rows = asof_join(rows, prices, ["symbol"], "_to", "date", ["close"], "forward", prefix="after_")
    return rows.withColumn("window_return", F.when(F.col("before_close") > 0, F.col("after_close") / F.col("before_close") - 1)).drop("_from", "_to")


def volatility(prices: DataFrame, days: int = 63, least: int = 10) -> DataFrame:
    """Sample deviation of the close-to-close changes inside the last ``days`` calendar days, with enough of them.

    Changes count between closes of the window, so the change into its first close does not.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    rows = prices.withColumn("change", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))).withColumn("day", F.datediff("date", F.lit("1970-01-01")))
    span = Window.partitionBy("symbol").orderBy("day").rangeBetween(-days, 0)
    into = F.first("change").over(span)
    sums = rows.select(
        "symbol", "date", (F.count("*").over(span) - 1).alias("n"), (F.sum("change").over(span) - into).alias("s"), (F.sum(F.col("change") * F.col("change")).over(span) - into * into).alias("q")
    )
    spread = F.sqrt(F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1))
    return sums.select("symbol", "date", F.when(F.col("n") >= least, spread).alias("volatility"))


def trailing_return(rows: DataFrame, prices: DataFrame, at: str, days: int) -> DataFrame:
    """``rows`` with ``trailing_return``: the last close at or before ``at`` against the one ``days`` earlier."""
    rows, prices = rows.repartition("symbol"), prices.repartition("symbol")
    now = asof_join(rows, prices, ["symbol"], at, "date", ["close"], prefix="now_")
    both = asof_join(now.withColumn("_then", F.col(at) - F.expr(f"INTERVAL {days} DAYS")), prices, ["symbol"], "_then", "date", ["close"], prefix="then_")
    value = F.when(F.col("then_close") > 0, F.col("now_close") / F.col("then_close") - 1)
    return both.withColumn("trailing_return", value).drop("_then", "now_date", "now_close", "then_date", "then_close")


def primary_events(catalysts: DataFrame) -> DataFrame:
    """The leading upcoming event of each (symbol, as_of): timing, type priority, importance, date, crowdedness, then event_id."""
    rows = catalysts.where("expected_date >= as_of")
    order = [
        F.desc(timing_priority(F.col("status"), F.col("expected_date"), F.col("title"))), F.desc(type_priority(F.col("event_type"))), F.desc("importance"),
        F.asc("expected_date"), F.asc("crowdedness"), F.asc("event_id"),
    ]
    return latest(rows, ["symbol", "as_of"], order)


def exact_outcomes(events: DataFrame, outcomes: DataFrame, back: int = 2, ahead: int = 21) -> DataFrame:
    """``events`` (symbol, as_of, event_id, event_type, expected_date) with ``outcome``: what the best candidate's text tells.

    Candidates share symbol and bucket, lie from ``back`` days before to ``ahead`` days after the expected date and not
    before as_of, and have a labelled outcome; same type first, then timing priority, nearness and id.
    """
    days = lambda n: F.expr(f"INTERVAL {n} DAYS")
    stretch = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / ((back + ahead + 1) * 86400))
    e = events.withColumn("_bucket", type_bucket(F.col("event_type"))).where(F.col("_bucket").isin("clinical", "regulatory"))
    e = e.select("symbol", "as_of", F.col("event_id").alias("_id"), F.col("event_type").alias("_type"), "expected_date", "_bucket")
    at = F.col("expected_date")
    e = e.withColumn("_x", F.explode(F.sequence(stretch(at - days(back)), stretch(at + days(ahead)))))
    t = F.col("event_timestamp")
    told = outcomes.where("outcome_label is not null").select(F.col("symbol").alias("_s"), F.col("event_bucket").alias("_b"), stretch(t).alias("_y"), "event_timestamp", "event_type", "timing_priority", "event_id", "outcome_label")
    near = (t >= F.col("as_of")) & (t >= at - days(back)) & (t <= at + days(ahead))
    pairs = e.join(told, (F.col("symbol") == F.col("_s")) & (F.col("_bucket") == F.col("_b")) & (F.col("_x") == F.col("_y")) & near)
    best = F.struct(
        (-(F.col("event_type") == F.col("_type")).cast("int")).alias("a"), (-F.col("timing_priority")).alias("b"), F.abs(F.unix_seconds(t.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))).alias("c"),
        F.col("event_id").alias("d"), F.col("outcome_label").alias("outcome"),
    )
    found = pairs.groupBy("symbol", "as_of").agg(F.min(best)["outcome"].alias("outcome"))
    return events.join(found, ["symbol", "as_of"], "left")


def success_labels(snapshots: DataFrame, catalysts: DataFrame, outcomes: DataFrame, prices: DataFrame) -> DataFrame:
    """Per priced snapshot: forward returns, its primary event with reaction and outcome, and the success label with its source.

    An event succeeds by its outcome, else by a reaction above 5 %; without an event, by a 90 day return above 8 %.
    """
    returns = forward_returns(snapshots, prices)
    events = primary_events(catalysts).select("symbol", "as_of", "event_id", "event_type", "expected_date")
    events = event_window_return(exact_outcomes(events, outcomes), prices, "expected_date")
    events = events.select("symbol", F.col("as_of").cast("timestamp").alias("as_of"), "event_id", "event_type", "window_return", "outcome")
    rows = returns.withColumn("as_of", F.col("as_of").cast("timestamp")).join(events, ["symbol", "as_of"], "left")
    reaction = F.coalesce((F.col("window_return") > 0.05).cast("int"), F.lit(0))
    held = F.coalesce((F.col("return_90d") > 0.08).cast("int"), F.lit(0))
    has = F.col("event_id").isNotNull()
    source = F.when(~has, "return_90d_fallback").when(F.col("outcome").isNotNull(), "outcome").otherwise("event_price_reaction")
    return rows.withColumns({"success": F.when(has, F.coalesce("outcome", reaction)).otherwise(held), "success_source": source})


def drawdown(returns: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Deepest fall of the compounded curve below its running peak, per key."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.withColumn("curve", F.exp(F.sum(F.log1p(F.greatest(F.col(value), F.lit(-0.999999)))).over(w)))
    fall = curve.withColumn("fall", F.col("curve") / F.greatest(F.max("curve").over(w), F.lit(1.0)) - 1)
    return fall.groupBy(*by).agg(F.round(F.min("fall"), 6).alias("max_drawdown"), F.count("*").alias("n"))
