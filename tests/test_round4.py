"""Plans that read their studies once, and names that the faster tests judge as before."""

import re

from pyspark.sql import functions as F

from eventlens.functions import trials as tr
from eventlens.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _parsed(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"from_json\(StructField.*", plan)


def test_studies_are_parsed_once(spark):
    for name in ("program_graph", "graph_catalysts", "company_roll_ups", "registry_trials"):
        assert len(_parsed(spark, name)) == 1, name


def test_only_needed_modules_are_parsed(spark):
    from eventlens.sources.registry import study_rows

    rows = study_rows(spark.createDataFrame([('{"protocolSection": {"statusModule": {"overallStatus": "Odd"}}}',)], "text string"), "text", ["status", "phases"])
    assert rows.columns == ["status", "phases"] and [tuple(r) for r in rows.collect()] == [("Odd", [])]
    assert "contactsLocationsModule" not in _parsed(spark, "registry_trials")[0]


def test_names_are_cleaned_and_judged_as_by_their_rules(spark):
    names = ["Placebo for  x", "standard of care plus\ty", "placebo", "Usual\tcare", " observational ", "\tobservation", "observation\n", "a  b", "-a-", "a-", "\t", "", "gear", "no  intervention", "Standard  of\ncare x", "observation x", "AB-12"]
    text = F.trim("n")
    cleaned = F.btrim(F.regexp_replace(F.regexp_replace(text, tr.NOT_THE_DRUG, ""), r"\s+", " "), F.lit(" -"))
    single = F.lower(F.regexp_replace(text, r"\s+", " "))
    generic = (single == "") | single.isin(*tr.GENERIC) | single.contains("placebo") | single.contains("standard of care")
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", F.when(cleaned != "", cleaned).otherwise(text).alias("a"), tr.clean_intervention(F.col("n")).alias("b"), generic.alias("c"), tr.is_generic(F.col("n")).alias("d")
    )
    for r in rows.collect():
        assert (r.a, r.c) == (r.b, r.d), r


def test_models_read_their_frame_from_one_write(spark):
    for name in ("training_flow", "ablation_deltas", "ridge_walk_forward"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_shipdate" not in plan and "LogicalRDD" in plan, name


def test_program_features_read_the_events_once(spark):
    from eventlens import queries_features as qf
    from eventlens.plans import features as ft

    plan = QUERIES["program_features"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Relation" in line and "l_shipdate" in line]) == 2  # events and snapshots
    companies, events, sums, told = qf._inputs(spark, SF)
    events = events.withColumn("program_id", F.when(F.col("program_id") > 0, F.col("program_id")))  # programs without an id have no event of their own
    programs = qf._programs(events, sums, told)
    apart = ft.program_features(ft.snapshot_profiles(companies, programs, events), programs, events, ft.top_events(events, ft.COMPANY, "c_", typed=True))
    key = ["symbol", "as_of", "program_id"]
    summed = ft.summed_program_features(companies, events, sums, told)
    rows = lambda df: sorted(map(repr, df.select(*key, "catalyst_timing_importance", "program_quality_trial_count", "state_profile_launch_progress_pct", "catalyst_timing_company_event_priority").collect()))
    assert rows(summed) == rows(apart) and summed.columns == apart.columns


def test_anchors_are_spaced_once(spark):
    plan = QUERIES["rebuilt_history"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "LogicalRDD" in plan
