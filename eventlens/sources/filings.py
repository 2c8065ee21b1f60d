"""Filings and facts: parallel arrays to rows, nested fact maps to rows, values as known at a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTS = T.MapType(
    T.StringType(),
    T.MapType(
        T.StringType(),
        T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("start", T.StringType()), ("end", T.StringType()), ("filed", T.StringType()), ("val", T.DoubleType()))]))))]),
    ),
)


def filing_rows(docs: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Rows of parallel arrays; shorter ones are filled with nulls."""
    return docs.select(key, F.inline(F.arrays_zip(*arrays)))


def fact_rows(docs: DataFrame, key: str, facts: str, names: list[str]) -> DataFrame:
    """One row per fact value of the named keys: key, name, rank of the name, unit, start, end, filed, val."""
    parsed = docs.select(key, F.from_json(facts, FACTS).alias("f"))
    spaces = parsed.select(key, F.explode("f").alias("ns", "entries"))
    entries = spaces.select(key, F.explode("entries").alias("name", "entry")).where(F.col("name").isin(*names))
    units = entries.select(key, "name", F.explode("entry.units").alias("unit", "values"))
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    rows = units.select(key, "name", rank.alias("rank"), "unit", F.inline("values"))
    return rows.withColumns({c: F.try_to_date(F.col(c)) if hasattr(F, "try_to_date") else F.to_date(c) for c in ("start", "end", "filed")})


def instant_value(facts: DataFrame, by: list[str], as_of: str) -> DataFrame:
    """Latest value by (end, filed) among facts ended and filed by ``as_of``, per key."""
    known = facts.where((F.col("end") <= F.col(as_of)) & (F.col("filed") <= F.col(as_of)))
    return known.groupBy(*by).agg(F.max_by("val", F.struct("end", "filed")).alias("value"))


def trailing_value(facts: DataFrame, by: list[str], as_of: str) -> DataFrame:
    """Trailing-year value of duration facts ended and filed by ``as_of``, per key.

    The latest annual fact (300 to 380 days) by (end, filed); else the last up to four quarters (60 to 120 days), scaled to
    365 days; else the latest fact, scaled. Of facts for one quarter end, in order of filing, a later one replaces an
    earlier one where its span is shorter or its absolute value smaller.
    """
    known = facts.where((F.col("end") <= F.col(as_of)) & (F.col("filed") <= F.col(as_of)) & F.col("start").isNotNull() & F.col("val").isNotNull())
    known = known.withColumn("days", F.greatest(F.datediff("end", "start"), F.lit(1)))
    entry = F.struct("filed", "days", "val")
    ends = known.where("days between 60 and 120").groupBy(*by, "end").agg(F.sort_array(F.collect_list(entry)).alias("e"))  # restatements of one quarter
    better = lambda old, new: F.when((new["days"] < old["days"]) | (F.abs(new["val"]) < F.abs(old["val"])), new).otherwise(old)
    chosen = ends.withColumn("q", F.aggregate(F.slice("e", 2, F.greatest(F.size("e") - 1, F.lit(0))), F.get("e", F.lit(0)), better))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("end")))
    quarters = chosen.withColumn("_p", place).where("_p <= 4").groupBy(*by).agg((F.sum("q.val") * (365.0 / F.sum("q.days"))).alias("quarters"))
    latest = known.groupBy(*by).agg(
        F.max_by(F.when(F.col("days").between(300, 380), F.col("val")), F.when(F.col("days").between(300, 380), F.struct("end", "filed", "val"))).alias("annual"),
        F.max_by(F.col("val") * (365.0 / F.col("days")), F.struct("end", "filed", "val")).alias("scaled"),
    )
    return latest.join(quarters, by, "left").select(*by, F.coalesce("annual", "quarters", "scaled").alias("value"))
