"""Books and reports: matched orders, deduplicated trades, listings, names, payload merges, overlays and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.taxonomy import has_any, looked_up
from eventlens.operators.asof import latest
from eventlens.plans.models import feature_columns

# Parts of company names in the field, and the legacy column that must not be a feature.
NAME_PARTS = (
    "biopharma", "biotherapeutics", "biotech", "biosciences", "genomics", "gene", "genetic", "medicine", "medicines", "oncology", "pharma", "pharmaceutical",
    "pharmaceuticals", "therapeutic", "therapeutics", "vaccine",
)
LEGACY_FEATURE = "market_flow_return_6mo_legacy"


def in_field(name: Column, security: Column) -> Column:
    """Whether a listing is a stock of a company whose name tells the field."""
    return has_any(F.lower(F.coalesce(name, F.lit(""))), NAME_PARTS) & F.lower(F.coalesce(security, F.lit(""))).rlike("stock|common|adr|ordinary")


def is_upcoming(expected: Column, now: Column) -> Column:
    """Whether a date text lies ahead; a bare date counts for its whole day."""
    at, bare = F.try_to_timestamp(expected), ~F.contains(expected, F.lit("T")) & (F.length(expected) <= 10)
    return F.coalesce(F.when(bare, F.to_date(at) >= F.to_date(now)).otherwise(at >= now), F.lit(False))


def matched_submissions(plans: DataFrame, submissions: DataFrame, by: str, planned: str, submitted: str, key: str, values: list[str]) -> DataFrame:
    """Every plan with the ``values`` of the submission nearest to it, from two minutes before to two days after; ties to the earlier.

    Plans and submissions meet by symbol and day (a plan meets four days), so no symbol's rows all meet.
    """
    day = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 86400)
    left = plans.select(by, key, planned, F.explode(F.sequence(day(planned) - 1, day(planned) + 2)).alias("_d"))
    right = submissions.select(F.col(by).alias("_by"), day(submitted).alias("_e"), submitted, *values)
    gap = F.unix_micros(F.col(submitted).cast("timestamp")) - F.unix_micros(F.col(planned).cast("timestamp"))
    near = (F.col(by) == F.col("_by")) & (F.col("_d") == F.col("_e")) & (gap >= -120_000_000) & (gap <= 2 * 86_400_000_000)
    best = left.join(right, near).groupBy(key).agg(F.min(F.struct(F.abs(gap).alias("g"), F.col(submitted), *values)).alias("m"))
    return plans.join(best.select(key, F.col(f"m.{submitted}").alias(submitted), *[F.col(f"m.{v}").alias(v) for v in values]), key, "left")


def latest_trades(rows: DataFrame, order: str, planned: str, tie: list[str]) -> DataFrame:
    """One row per order id, of the latest plan; rows without an id all stay."""
    return latest(rows.where(F.col(order).isNotNull()), [order], [F.desc(planned), *tie]).unionByName(rows.where(F.col(order).isNull()))


def best_listing(rows: DataFrame, by: str, source: str, ranks, at: str) -> DataFrame:
    """One listing row per key: of the best source, then the newest."""
    return latest(rows.withColumn("_rank", looked_up(F.coalesce(source, F.lit("")), ranks, 0)), [by], [F.desc("_rank"), F.desc(at)]).drop("_rank")


def resolved_names(symbols: DataFrame, snapshots: DataFrame, membership: DataFrame) -> DataFrame:
    """Name of each symbol: of its latest snapshot, else of its latest membership, else the symbol."""
    of = lambda rows, name: rows.where(F.trim("company_name") != "").groupBy("symbol").agg(F.max_by("company_name", "as_of").alias(name))
    rows = symbols.select("symbol").distinct().join(of(snapshots, "_a"), "symbol", "left").join(of(membership, "_b"), "symbol", "left")
    return rows.select("symbol", F.coalesce("_a", "_b", F.col("symbol").cast("string")).alias("company_name"))


def product_revenue(companies: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered products of each company, its revenue split evenly among them; product ids number them."""
    rows = companies.join(registry, "ticker")
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("position"))
    share = F.greatest(F.col("revenue"), F.lit(0.0)) / F.count("*").over(Window.partitionBy("ticker"))
    return rows.select("ticker", F.concat("ticker", F.lit(":approved:"), place).alias("product_id"), "name", share.alias("annual_revenue"))


def merged_payload(newer: Column, older: Column, fields: list[str]) -> Column:
    """A struct of the fields: the newer payload's, where missing the older one's."""
    return F.struct(*[F.coalesce(newer[f], older[f]).alias(f) for f in fields])


def last_success(runs: DataFrame, by: list[str], at: str, ok: Column, payload: str) -> DataFrame:
    """Payload of the latest successful run per key."""
    return runs.where(ok).groupBy(*by).agg(F.max_by(payload, at).alias(payload), F.max(at).alias(at))


def overlaid(rows: DataFrame, prefix: str = "latest_") -> DataFrame:
    """``rows`` with every ``latest_x`` put over x where it is present, and taken out."""
    names = [c[len(prefix) :] for c in rows.columns if c.startswith(prefix)]
    merged = rows.withColumns({n: F.coalesce(f"{prefix}{n}", n) if n in rows.columns else F.col(f"{prefix}{n}") for n in names})
    return merged.drop(*[f"{prefix}{n}" for n in names])


def leaked_columns(columns: list[str], ids: tuple[str, ...] = ("entity_id", "ticker", "as_of", "thesis_horizon", "evaluation_date")) -> list[str]:
    """Feature columns that must not be features; empty for a clean frame."""
    return [c for c in feature_columns(columns, ids) if c.startswith("target_") or c == LEGACY_FEATURE]


def exposure_medians(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Medians of exposures, missing values left out."""
    return rows.groupBy(*by).agg(*[F.median(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"median_{c}") for c in columns])
