"""Study documents of a registry and abstracts in XML as rows, and companies rolled up from their studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.program import phase, phase_rank
from eventlens.functions.taxonomy import looked_up
from eventlens.functions.trials import ACTIVE_STATUSES, PHASE_SUCCESS
from eventlens.operators.rows import once

#: What is read of a study document, by module; everything may be missing.
STUDY = {
    "identificationModule": "struct<nctId: string, briefTitle: string>",
    "statusModule": "struct<overallStatus: string>",
    "designModule": "struct<phases: array<string>, enrollmentInfo: struct<count: bigint>>",
    "conditionsModule": "struct<conditions: array<string>>",
    "armsInterventionsModule": "struct<interventions: array<struct<name: string>>>",
    "outcomesModule": "struct<primaryOutcomes: array<struct<measure: string>>>",
    "contactsLocationsModule": "struct<locations: array<struct<facility: string, city: string, state: string, country: string>>>",
}
#: The module that each column of a study is read from.
MODULES = {
    "trial_id": "identificationModule", "title": "identificationModule", "status": "statusModule", "phases": "designModule", "conditions": "conditionsModule", "interventions": "armsInterventionsModule",
    "outcomes": "outcomesModule", "enrollment": "designModule", "locations": "contactsLocationsModule",
}


def _schema(columns: list[str]) -> str:
    """The modules of a document that the columns need; the parser passes over the others."""
    needed = {MODULES[c] for c in columns}
    return f"struct<protocolSection: struct<{', '.join(f'{m}: {fields}' for m, fields in STUDY.items() if m in needed)}>>"


def study_rows(documents: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """``documents`` with trial_id, title, status, phases, conditions, interventions, outcomes, enrollment and locations instead of the JSON ``text``.

    With ``columns``, only these are parsed and returned.
    Lists that a document lacks are empty, its other fields null; a text that is no document gives a row without a trial_id.
    """
    s = F.col("_study.protocolSection")
    none = F.array().cast("array<string>")
    place = lambda x: F.concat_ws(", ", x["facility"], x["city"], x["state"], x["country"])
    columns = list(MODULES) if columns is None else columns
    rows = once(documents, {"_study": F.from_json(text, _schema(columns))})
    read = {
        "trial_id": s["identificationModule"]["nctId"], "title": s["identificationModule"]["briefTitle"], "status": F.coalesce(s["statusModule"]["overallStatus"], F.lit("")),
        "phases": F.coalesce(s["designModule"]["phases"], none), "conditions": F.coalesce(s["conditionsModule"]["conditions"], none),
        "interventions": F.coalesce(s["armsInterventionsModule"]["interventions"]["name"], none), "outcomes": F.coalesce(s["outcomesModule"]["primaryOutcomes"]["measure"], none),
        "enrollment": s["designModule"]["enrollmentInfo"]["count"], "locations": F.coalesce(F.transform(s["contactsLocationsModule"]["locations"], place), none),
    }
    return rows.select(*[c for c in documents.columns if c != text], *[read[c].alias(c) for c in columns])


def abstract_rows(documents: DataFrame, text: str) -> DataFrame:
    """``documents`` of one article each (XML ``text``) with pmid, title and abstract (its parts joined by spaces); articles without a title or an abstract leave."""
    path = lambda p: F.filter(F.xpath(F.col(text), F.lit(p)), lambda x: x != "")
    rows = documents.withColumns({"pmid": F.get(path("//PMID/text()"), F.lit(0)), "title": F.get(path("//ArticleTitle/text()"), F.lit(0)), "abstract": F.array_join(path("//AbstractText/text()"), " ")})
    return rows.where("title is not null and abstract <> ''").drop(text)


def is_active(status: Column) -> Column:
    """Studies that go on; an unknown status counts."""
    name = F.replace(F.upper(F.coalesce(status, F.lit(""))), F.lit(" "), F.lit("_"))
    return (name == "") | name.isin(*ACTIVE_STATUSES)


def company_roll_up(studies: DataFrame, by: list[str]) -> DataFrame:
    """Per company: counts of studies, enrollment in all and by phase, best phase with its likelihood, distinct drug names and conditions.

    Only active studies count, apart from n_total and n_inactive. A study is a row with its phase, and so is each of its names and conditions:
    one pass over the studies sums them up per phase, name and condition, so no company's studies meet in one task. Without active studies: zeros, PHASE1.
    """
    rows = studies.withColumns({"_active": is_active(F.col("status")), "_phase": phase(F.col("phases")), "_n": F.coalesce("enrollment", F.lit(0))})
    word = lambda x: F.get(F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != ""), F.lit(0))
    entry = lambda kind: lambda x: F.struct(F.lit(kind).alias("_kind"), x.alias("_x"))
    drugs = F.transform(F.filter(F.transform("interventions", word), lambda w: F.length(w) > 2), lambda w: F.regexp_replace(w, "[,.]", ""))
    names = F.concat(F.transform(drugs, entry(0)), F.transform(F.filter("conditions", lambda x: x.isNotNull()), entry(1)))
    study = F.array(entry(2)(F.col("_phase")))
    # a study without conditions (a null list) is still a row of its phase
    rows = rows.select(*by, "_active", "_n", F.inline(F.when(F.col("_active") & names.isNotNull(), F.concat(study, F.array_distinct(names))).otherwise(study)))
    per = rows.groupBy(*by, "_kind", "_x").agg(
        F.count("*").alias("_all"), F.count_if("_active").alias("_on"), F.coalesce(F.sum(F.when(F.col("_active"), F.col("_n"))), F.lit(0)).alias("_sum"), F.coalesce(F.max(F.when(F.col("_active"), F.col("_n"))), F.lit(0)).alias("_max"),
    )
    kind = lambda i, c: F.when(F.col("_kind") == i, c)
    per = per.withColumn("_phase", kind(2, F.col("_x"))).withColumns({c: kind(2, F.col(c)) for c in ("_all", "_on", "_sum", "_max")})
    on = F.col("_on") > 0
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(on, F.struct("_phase", c)))))
    best = F.max(F.when(on & (F.col("_phase") != "EARLY_PHASE1"), F.struct(phase_rank(F.col("_phase")).alias("rank"), F.col("_phase").alias("name"))))["name"]
    out = per.groupBy(*by).agg(
        F.sum("_on").alias("n_trials"), F.sum("_all").alias("n_total"), (F.sum("_all") - F.sum("_on")).alias("n_inactive"), F.sum("_sum").alias("total_enrollment"), F.max("_max").alias("max_enrollment"),
        entries("_sum").alias("phase_enrollment"), entries("_on").alias("phase_trials"), F.coalesce(best, F.lit("PHASE1")).alias("best_phase"),
        *[F.array_sort(F.collect_list(kind(i, F.col("_x")))).alias(c) for i, c in enumerate(("drug_names", "conditions"))],
    )
    return out.withColumn("base_pos", looked_up(F.col("best_phase"), PHASE_SUCCESS, 0.074))
