"""As-of joins without inequality joins: one shuffle on the key, one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    values: list[str],
    direction: str = "backward",
    strict: bool = False,
    prefix: str = "",
) -> DataFrame:
    """Every left row with the ``values`` of the nearest right row at or before (or after) its time.

    ``strict`` excludes equal times. Both sides are stacked, sorted once per key, and the last right row seen is
    carried along; left rows with a null key or time match nothing. Right rows must be unique per key and time.
    """
    backward = direction == "backward"
    stamp = F.struct(F.col(right_on).alias("_at"), *[F.col(v) for v in values])
    # the left columns stay columns of their own, so that those nobody reads later are neither shuffled nor sorted
    one = left.select("*", F.col(left_on).cast("timestamp").alias("_asof_t"), F.lit(True).alias("_asof_is_left"))
    two = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).cast("timestamp").alias("_asof_t"), F.lit(False).alias("_asof_is_left"), stamp.alias("_asof_right"))
    both = one.unionByName(two, allowMissingColumns=True)
    # at equal times the right row comes first, unless strict; for forward joins time runs backwards
    time = F.col("_asof_t").asc() if backward else F.col("_asof_t").desc()
    tie = F.col("_asof_is_left").desc() if strict else F.col("_asof_is_left").asc()
    w = Window.partitionBy(*by).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_asof_seen", F.last("_asof_right", ignorenulls=True).over(w)).where("_asof_is_left")
    found = F.when(F.col("_asof_t").isNotNull(), F.col("_asof_seen"))
    for b in by:
        found = F.when(F.col(b).isNotNull(), found)
    return seen.select(*left.columns, found.alias("_asof_m")).select("*", F.col("_asof_m._at").alias(f"{prefix}{right_on}"), *[F.col(f"_asof_m.{v}").alias(f"{prefix}{v}") for v in values]).drop("_asof_m")


def asof_join_split(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], days: int, direction: str = "backward", strict: bool = False
) -> DataFrame:
    """``asof_join`` for keys of very many rows: each key is cut into stretches of ``days`` days, which are tasks of their own.

    A left row whose stretch holds no match takes the last right row of the stretches before (first of those after): one row per key and
    stretch, found as-of by the stretch's number.
    """
    stretch = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (days * 86_400_000_000))
    rows = left.withColumn("_s", stretch(left_on))
    points = right.where(F.col(right_on).isNotNull()).select(*by, right_on, *values).withColumn("_s", stretch(right_on))
    own = asof_join(rows, points, [*by, "_s"], left_on, right_on, values, direction, strict, prefix="_own_")
    pick = F.max_by if direction == "backward" else F.min_by
    ends = points.groupBy(*by, F.col("_s").alias("_e")).agg(pick(F.struct(right_on, *values), right_on).alias("_end"))
    # stretches are numbered, so equal numbers are left out and earlier (later) ones looked for
    before = asof_join(rows.select(*by, "_s").distinct(), ends, by, "_s", "_e", ["_end"], direction, strict=True).drop("_e")
    both = own.join(before, [*by, "_s"], "left")
    found = {c: F.when(F.col(f"_own_{right_on}").isNotNull(), F.col(f"_own_{c}")).otherwise(F.col(f"_end.{c}")) for c in (right_on, *values)}
    return both.select(*left.columns, *[c.alias(n) for n, c in found.items()])


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, value: str) -> DataFrame:
    """Every left row with the ``value`` of the right row nearest in time; ties to the smaller value.

    Of right rows at one time the smallest value counts. Two as-of passes, so no key meets all its rows.
    """
    points = right.groupBy(*by, right_on).agg(F.min(value).alias(value))
    both = asof_join(left, points, by, left_on, right_on, [value], prefix="_b_")
    both = asof_join(both, points, by, left_on, right_on, [value], "forward", prefix="_f_")
    gap = lambda p: F.abs(F.unix_micros(F.col(f"{p}{right_on}").cast("timestamp")) - F.unix_micros(F.col(left_on).cast("timestamp")))
    side = lambda p: F.when(F.col(f"{p}{value}").isNotNull(), F.struct(gap(p).alias("gap"), F.col(f"{p}{value}").alias("value")))
    return both.withColumn(value, F.least(side("_b_"), side("_f_"))["value"]).drop(*[f"{p}{c}" for p in ("_b_", "_f_") for c in (right_on, value)])


def carried_forward(rows: DataFrame, dates: DataFrame, by: list[str], at: str, date: str, days: int) -> DataFrame:
    """Per date and key the latest row at or before the date and at most ``days`` old: the columns of ``rows`` and ``date``.

    Rows and dates meet by stretches of ``days``, two for each row, so no pair of far-away ones is looked at.
    """
    stretch = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (days * 86400))
    near = (F.col(at) <= F.col(date)) & (F.col(at) >= F.col(date) - F.expr(f"INTERVAL {days} DAYS"))
    left = rows.select("*", F.explode(F.array(stretch(at), stretch(at) + 1)).alias("_x"))
    right = dates.select(date).distinct().withColumn("_x", stretch(date))
    pairs = left.join(right, "_x").where(near).drop("_x")
    return pairs.groupBy(date, *by).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c not in by]), F.col(at)).alias("_r")).select(date, *by, "_r.*")


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")
