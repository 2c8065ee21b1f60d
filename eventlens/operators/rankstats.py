"""Rank statistics: average ranks, Spearman, quantile spreads, window bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(column: str, by: list[str]) -> Column:
    """Rank with ties sharing their mean; null where the value is null."""
    w = Window.partitionBy(*by, F.col(column).isNull()).orderBy(column)
    ties = Window.partitionBy(*by, column)
    return F.when(F.col(column).isNotNull(), F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)


def correlation(x: str, y: str) -> Column:
    """Pearson coefficient; 0 for fewer than 3 rows or without variation."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when((F.count("*") < 3) | r.isNull() | F.isnan(r), 0.0).otherwise(r)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Per key: n and rank_ic; 0 where fewer than 3 pairs or no variation."""
    ranked = df.withColumns({"_rx": average_rank(x, by), "_ry": average_rank(y, by)}).where("_rx is not null and _ry is not null")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("_rx", "_ry").alias("rank_ic"))


def window_summary(df: DataFrame, by: list[str], key: list[str], score: str = "score", gross: str = "gross_return", net: str = "cost_adjusted_return") -> DataFrame:
    """Per window: rows, rank_ic, hit_rate, spreads of the extreme fifths and the top fifth's net mean.

    ``key`` breaks ties of the score. Rows without score or returns are left out.
    """
    usable = df.where(f"{score} is not null and {gross} is not null and {net} is not null")
    w = Window.partitionBy(*by)
    k = F.greatest(F.floor(F.count("*").over(w) / 5), F.lit(1))
    rows = usable.withColumns(
        {
            "_top": F.row_number().over(w.orderBy(F.desc(score), *key)) <= k,
            "_low": F.row_number().over(w.orderBy(score, *key)) <= k,
            "_median": F.median(score).over(w),
            "_rx": average_rank(score, by),
            "_ry": average_rank(gross, by),
        }
    )
    over = lambda flag, x: F.avg(F.when(F.col(flag), F.col(x)))
    n = F.count("*")
    spread = lambda x: F.when(n > 1, over("_top", x) - over("_low", x)).otherwise(0.0)
    return rows.groupBy(*by).agg(
        n.alias("rows"),
        correlation("_rx", "_ry").alias("rank_ic"),
        F.avg(((F.col(score) >= F.col("_median")) == (F.col(net) > 0)).cast("double")).alias("hit_rate"),
        spread(gross).alias("spread"),
        spread(net).alias("net_spread"),
        over("_top", net).alias("top_net"),
    )


def aggregate_windows(windows: DataFrame, by: list[str]) -> DataFrame:
    """Totals and means over windows with the 10 and 90 percent points of the net spread (interpolated)."""
    return windows.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.count("*").alias("windows"),
        *[F.avg(c).alias(c) for c in ("rank_ic", "hit_rate", "spread", "net_spread", "top_net")],
        F.percentile("net_spread", 0.1).alias("ci_low"),
        F.percentile("net_spread", 0.9).alias("ci_high"),
    )


def peer_summary(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """Per row, over the other rows of its group: peers, peer_median of the value, share_below (at or below one's own).

    Windows over one sort per group: leaving a row out shifts the middle ranks by at most one, so no pair of rows is formed.
    Rows without peers or value are left out; ties of the value are ordered by ``key``.
    """
    return _among_peers(rows.where(F.col(value).isNotNull()), by, key, value).where("peers > 0")


def with_peers(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """All ``rows`` with the columns of ``peer_summary``, so that nobody has to join them back: null where a row has no peers.

    A row without its key, its group or a value has no peers and is none.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, key, value)])
    found = _among_peers(rows.withColumn("_whole", whole), [*by, "_whole"], key, value)
    some = F.col("_whole") & (F.col("peers") > 0)
    return found.withColumns({c: F.when(some, F.col(c)) for c in ("peers", "peer_median", "share_below")}).drop("_whole")


def _among_peers(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    w, sort = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(value, key)
    ranked = rows.withColumns({"_r": F.row_number().over(sort), "_n": F.count("*").over(w)})
    upto = F.count("*").over(Window.partitionBy(*by).orderBy(value))  # range frame: all ties count
    low, high = F.floor(F.col("_n") / 2), F.floor((F.col("_n") + 1) / 2)  # middle ranks of the n - 1 others
    at = {f"_v{i}": F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + i, F.col(value))).over(w) for i in (0, 1, 2)}
    ranked = ranked.withColumns(at).withColumn("_upto", upto)
    pick = lambda rank: F.get(F.array("_v0", "_v1", "_v2"), (rank + F.when(F.col("_r") <= rank, 1).otherwise(0) - F.floor(F.col("_n") / 2)).cast("int"))
    below = F.when(F.col("_n") > 1, (F.col("_upto") - 1) / (F.col("_n") - 1))
    out = ranked.withColumns({"peers": F.col("_n") - 1, "peer_median": (pick(low) + pick(high)) / 2, "share_below": below})
    return out.drop("_r", "_n", "_upto", *at)


def nearest_peers(rows: DataFrame, by: list[str], key: str, value: str, k: int = 3) -> DataFrame:
    """``rows`` with ``nearest``: keys of the ``k`` other rows of the group whose values are nearest, nearest first.

    Ties go to the row nearer in the order of (value, key), then to the earlier one. The k nearest of a row are among the k before
    and the k after it in that order, so one sort per group with lags and leads finds them, however large the group. Rows without
    value have no peers and are none.
    """
    w = Window.partitionBy(*by, F.col(value).isNull()).orderBy(value, key)
    near = []
    for gap in range(1, k + 1):
        for side, shifted in ((0, F.lag), (1, F.lead)):
            other = shifted(F.struct(F.col(value).alias("v"), F.col(key).alias("k")), gap).over(w)
            near.append(F.when(other.isNotNull() & F.col(value).isNotNull(), F.struct(F.abs(other["v"] - F.col(value)).alias("d"), F.lit(gap).alias("g"), F.lit(side).alias("s"), other["k"].alias("k"))))
    best = F.slice(F.array_sort(F.array_compact(F.array(*near))), 1, k)
    return rows.withColumn("nearest", F.transform(best, lambda x: x["k"]))


def posture(own: Column, median: Column, band: float = 0.15) -> Column:
    """rich, discounted or near peer median; unknown without a median."""
    return F.when(median.isNull(), "unknown").when(own > median * (1 + band), "rich").when(own < median * (1 - band), "discounted").otherwise("near peer median")
