"""Event calendars of unknown shape: CSV, or JSON whose rows are the root list or stand under a named root, with columns under many names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.landscape import text_family
from eventlens.functions.taxonomy import EVENT_FAMILIES, event_type
from eventlens.operators.rows import once

# Roots and the names of a column, in the order they are tried.
ROOTS = ("events", "rows", "data")
ALIASES = {
    "ticker": ("ticker", "symbol", "Ticker", "Symbol"),
    "expected_date": ("expected_date", "event_date", "date", "Date", "catalyst_date"),
    "title": ("title", "event", "name", "description"),
    "details": ("details", "notes", "summary"),
    "event_type": ("event_type", "family", "category", "type"),
    "event_id": ("event_id", "id"),
    "url": ("url", "source_url"),
    "status": ("status",),
    "importance": ("importance",),
    "crowdedness": ("crowdedness",),
    "known_as_of": ("known_as_of", "published_at", "updated_at"),
}
# What stands in for a missing status, importance and crowdedness.
STATUS, IMPORTANCE, CROWDEDNESS = "exact_calendar", 0.60, 0.35
_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "MMM d, yyyy", "MMMM d, yyyy")


def tolerant_timestamp(text: Column) -> Column:
    """A timestamp of ISO text or of one of some common date forms, in the session's zone; else null."""
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in _FORMATS])


def document_fields(docs: DataFrame, text: str) -> DataFrame:
    """One row per calendar row of the JSON documents: ``fields``, its values as text by name.

    The root list, or the first of the named roots that holds rows; other documents, broken ones and rows that are no objects are left out.
    """
    others = [c for c in docs.columns if c != text]
    docs = once(docs.select(*others, F.col(text).alias("_text")), {"_p": F.try_parse_json("_text")})
    lists = {f"_l{i}": F.try_variant_get("_p", path, "array<variant>") for i, path in enumerate(("$", *[f"$.{r}" for r in ROOTS]))}
    docs = once(docs, lists)
    found = F.coalesce(*[F.when(F.size(n) > 0, F.col(n)) for n in lists])
    rows = docs.select(*others, F.explode(found).alias("_v"))
    return once(rows, {"fields": F.try_variant_get("_v", "$", "map<string,string>")}).drop("_v").where("fields is not null")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """``fields`` of the rows of a calendar file or folder: CSV with a header by its suffix, else JSON documents."""
    if path.lower().endswith(".csv"):
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
        return rows.select(F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`"))]).alias("fields"))
    return document_fields(spark.read.text(path, wholetext=True), "value").select("fields")


def calendar_events(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """``rows`` with the columns of an event in place of ``fields``; rows without symbol or date, or of other families, are left out.

    Empty values count as missing. The family is the known type or what title and details tell. With ``as_of``, rows that became known
    later are left out too.
    """
    first = lambda name: F.coalesce(*[F.nullif(F.col("fields")[a], F.lit("")) for a in ALIASES[name]])
    others = [c for c in rows.columns if c != "fields"]
    plain = once(rows.select(*others, "fields"), {f"_{n}": first(n) for n in ALIASES}).select(*others, *[F.col(f"_{n}").alias(n) for n in ALIASES])
    title, details = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("details", F.lit("")))
    plain = plain.withColumns({"ticker": F.upper("ticker"), "expected_date": tolerant_timestamp(F.col("expected_date")), "known_as_of": tolerant_timestamp(F.col("known_as_of")), "title": title, "details": details})
    plain = plain.where("ticker is not null and expected_date is not null")
    if as_of is not None:
        plain = plain.where(F.col("known_as_of").isNull() | (F.col("known_as_of") <= as_of))
    kind = F.coalesce(event_type(F.col("event_type"), F.col("title"), F.col("details")), text_family(F.col("title"), F.col("details")))
    plain = plain.withColumn("event_type", kind).where(F.col("event_type").isin(*EVENT_FAMILIES))
    number = lambda c, default: F.coalesce(F.col(c).try_cast("double"), F.lit(default))
    return plain.withColumns(
        {
            "event_id": F.coalesce("event_id", F.concat_ws(":", F.lit("calendar"), "ticker", "event_type", F.date_format("expected_date", "yyyy-MM-dd"))),
            "title": F.coalesce(F.nullif("title", F.lit("")), F.concat("ticker", F.lit(" "), F.replace("event_type", F.lit("_"), F.lit(" ")))),
            "details": F.nullif("details", F.lit("")), "status": F.coalesce("status", F.lit(STATUS)), "importance": number("importance", IMPORTANCE), "crowdedness": number("crowdedness", CROWDEDNESS),
        }
    )
