"""Company snapshots as nested documents: archive scan and sink, rebuild from text, and their explosion into flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.taxonomy import is_exact_timing, is_synthetic
from eventlens.operators.rows import once


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.LongType(), T.ArrayType(T.StringType())
TRIAL = _struct(trial_id=_S, title=_S, phase=_S, status=_S, conditions=_L, interventions=_L, enrollment=_I, primary_outcomes=_L)
PROGRAM = _struct(program_id=_S, name=_S, modality=_S, phase=_S, conditions=_L, pos_prior=_D, tam_estimate=_D, trials=T.ArrayType(TRIAL))
PRODUCT = _struct(product_id=_S, name=_S, indication=_S, annual_revenue=_D)
CATALYST = _struct(program_id=_S, event_id=_S, event_type=_S, title=_S, expected_date=_S, horizon_days=_I, probability=_D, importance=_D, crowdedness=_D, status=_S)
FINANCING = _struct(event_id=_S, event_type=_S, probability=_D, horizon_days=_I, expected_dilution_pct=_D, summary=_S)
SNAPSHOT = _struct(
    ticker=_S, company_name=_S, as_of=_S, market_cap=_D, revenue=_D, cash=_D, debt=_D, programs=T.ArrayType(PROGRAM), approved_products=T.ArrayType(PRODUCT),
    catalyst_events=T.ArrayType(CATALYST), financing_events=T.ArrayType(FINANCING), metadata=T.MapType(_S, _S),
)


def scan_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All archived snapshot documents below a path; unreadable ones become rows of nulls and go."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("ticker is not null")


def write_documents(docs: DataFrame, path: str, namespace: str = "namespace") -> None:
    """Documents as JSON files, a folder per namespace; earlier ones stay."""
    docs.write.mode("append").partitionBy(namespace).json(path)


def rebuilt(text: Column) -> Column:
    """A snapshot from its JSON text; null where the text is none."""
    return F.from_json(text, SNAPSHOT)


def rebuilt_rows(documents: DataFrame, text: str, fields: tuple[str, ...]) -> DataFrame:
    """Snapshots from the JSON ``text`` of documents; only ``fields`` are parsed, the others are null. A text is parsed once, whatever is read of it."""
    some = T.StructType([f for f in SNAPSHOT.fields if f.name in fields])
    rows = once(documents, {"_d": F.from_json(text, some)})
    return rows.select(*[(F.col(f"_d.{f.name}") if f.name in fields else F.lit(None).cast(f.dataType)).alias(f.name) for f in SNAPSHOT.fields])


#: What the flat tables read of a document.
READ = {
    "company_snapshots": ("ticker", "company_name", "as_of", "market_cap", "revenue", "cash", "debt"), "programs": ("ticker", "as_of", "programs", "approved_products"), "trials": ("ticker", "as_of", "programs"),
    "catalysts": ("ticker", "as_of", "catalyst_events"), "event_tape": ("ticker", "as_of", "catalyst_events"), "financing_events": ("ticker", "as_of", "financing_events"),
    "universe_membership": ("ticker", "company_name", "as_of", "catalyst_events", "metadata"),
}


def snapshot_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of snapshot documents: company_snapshots, programs, trials, catalysts, event_tape, financing_events, universe_membership.

    Approved products become programs of the phase APPROVED. Catalysts count once per (event_id, expected_date) of a
    snapshot, the first in the document's order. Snapshots without children give no child rows.
    """
    key = ["ticker", "as_of"]
    programs = docs.select(*key, F.explode("programs").alias("p"))
    names = ("program_id", "name", "modality", "phase", "conditions", "pos_prior", "tam_estimate")
    line = lambda *values: F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])
    own = F.transform("programs", lambda p: line(p["program_id"], p["name"], p["modality"], p["phase"], F.to_json(p["conditions"]), p["pos_prior"], p["tam_estimate"]))
    sold = F.transform("approved_products", lambda p: line(p["product_id"], p["name"], F.lit("commercial"), F.lit("APPROVED"), F.to_json(F.array(p["indication"])), F.lit(1.0), p["annual_revenue"]))
    flat = docs.select(*key, F.inline(F.flatten(F.array_compact(F.array(own, sold)))))  # one pass over the documents for both
    trials = programs.select(*key, "p.program_id", F.explode("p.trials").alias("t")).select(
        *key, "program_id", "t.trial_id", "t.title", "t.phase", "t.status", F.to_json("t.conditions").alias("conditions"), F.to_json("t.interventions").alias("interventions"), "t.enrollment",
        F.to_json("t.primary_outcomes").alias("primary_outcomes"),
    )
    # sorted by (id, date, place), the first of each (id, date) is the one that differs from the one before: no shuffle, and no pair of events is compared
    placed = F.array_sort(F.transform("catalyst_events", lambda e, i: F.struct(F.struct(e["event_id"], e["expected_date"]).alias("k"), i.alias("i"), e.alias("e"))))
    before = lambda i: F.get("_placed", i - 1)["k"]
    first = F.transform(F.filter("_placed", lambda p, i: (i == 0) | (p["k"] != before(i))), lambda p: p["e"])
    catalysts = once(docs.select(*key, "catalyst_events"), {"_placed": placed}).select(*key, F.inline(first))
    day = F.try_to_timestamp("expected_date")
    tape = catalysts.select(
        *key, "event_id", "event_type", "title", F.col("expected_date").alias("event_timestamp"), "status", is_exact_timing(F.col("status"), day, F.col("title")).alias("timing_exact"),
        is_synthetic(F.col("status"), F.col("title")).alias("timing_synthetic"),
    )
    exact = F.exists("catalyst_events", lambda e: is_exact_timing(e["status"], F.try_to_timestamp(e["expected_date"]), e["title"]))
    source = F.coalesce(F.col("metadata")["history_source"], F.col("metadata")["data_source"], F.lit("snapshot_archive"))
    membership = docs.select(
        "ticker", "company_name", "as_of", source.alias("membership_source"), F.coalesce(F.lower(F.col("metadata")["is_delisted"]) == "true", F.lit(False)).alias("is_delisted"),
        F.coalesce(exact, F.lit(False)).alias("has_exact_event"),
    )
    return {
        "company_snapshots": docs.select("ticker", "company_name", "as_of", "market_cap", "revenue", "cash", "debt"),
        "programs": flat,
        "trials": trials,
        "catalysts": catalysts,
        "event_tape": tape,
        "financing_events": docs.select(*key, F.inline("financing_events")),
        "universe_membership": membership,
    }
