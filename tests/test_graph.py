"""Study documents, programs, profiles, overlay and promotion: awkward rows and plain Python."""

import datetime as dt
import itertools
import json

from pyspark.sql import functions as F

from eventlens.functions import trials as tr
from eventlens.plans import deployment as dp
from eventlens.plans import graph
from eventlens.sources.registry import abstract_rows, company_roll_up, study_rows

STUDY = "company string, trial_no long, trial_id string, title string, status string, phases array<string>, conditions array<string>, interventions array<string>, outcomes array<string>, enrollment long, locations array<string>"
RULE = "company string, rule_no int, markers array<string>, exclude boolean, name string, phase string, conditions array<string>"
COMPANY = "company string, as_of date, revenue double, cash double, debt double, n_trials int, product string, description string"
AT = dt.date(2026, 1, 1)


def test_study_documents(spark):
    whole = {"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "T"}, "statusModule": {"overallStatus": "RECRUITING"}, "designModule": {"phases": ["PHASE2"], "enrollmentInfo": {"count": 7}},
        "armsInterventionsModule": {"interventions": [{"name": "A"}, {"type": "x"}]}, "contactsLocationsModule": {"locations": [{"facility": "F", "country": "Norway"}]}}}
    rows = study_rows(spark.createDataFrame([(1, json.dumps(whole)), (2, "{}"), (3, "no document"), (4, None)], "title_no int, text string"), "text").orderBy("title_no").collect()
    assert (rows[0].trial_id, rows[0].phases, rows[0].interventions, rows[0].enrollment, rows[0].locations) == ("N1", ["PHASE2"], ["A", None], 7, ["F, Norway"])
    assert all(r.trial_id is None and r.conditions == [] and r.status == "" and r.enrollment is None for r in rows[1:])


def test_abstracts(spark):
    xml = "<PubmedArticle><PMID>5</PMID><ArticleTitle>T &amp; U</ArticleTitle><AbstractText>one</AbstractText><AbstractText/><AbstractText>two</AbstractText></PubmedArticle>"
    texts = [(xml,), ("<PubmedArticle><ArticleTitle>T</ArticleTitle></PubmedArticle>",), ("<a><AbstractText>x</AbstractText></a>",), (None,)]
    assert [tuple(r) for r in abstract_rows(spark.createDataFrame(texts, "x string"), "x").collect()] == [("5", "T & U", "one two")]


def test_names(spark):
    rows = [
        ("Trial of ab-12 tablets", ["Placebo for XY-7 mg"]), ("A", ["Placebo plus  Drugol ", "b"]), ("  T  ", ["placebo", "Usual  Care", None, " "]), ("Of ABC-1X", []), ("", None), (None, ["x" * 81]), ("B", ["No-digit", "standard of care"]),
    ]
    df = spark.createDataFrame(rows, "title string, names array<string>").withColumn("i", tr.interventions_of(F.col("names")))
    found = [r.n for r in df.select(tr.program_name(F.col("title"), F.col("i")).alias("n")).collect()]
    assert found == ["XY-7", "Drugol", "T", "ABC-1X", tr.UNMAPPED, tr.UNMAPPED, "No-digit"]


def test_graph(spark):
    study = lambda no, title, drugs, phases, company="c", conditions=("lymphoma",), status="RECRUITING", n=10, places=(): (company, no, f"t{no}", title, status, list(phases), list(conditions), list(drugs), ["Overall survival"], n, list(places))
    rows = [
        study(1, "Study one", ["Drugol"], ["PHASE2"], places=["Mayo Clinic, Rochester, MN", "Oslo"]), study(2, "Pivotal two", ["Drugol"], ["PHASE3"], n=None), study(3, "Pivotal three", ["Drugol"], ["PHASE3"], n=30), study(4, "Pivotal four", ["Drugol"], ["PHASE3"], n=30, conditions=[None, "obesity"]),
        study(5, "Awareness in school", ["Other"], ["PHASE1"]), study(6, "Registry", ["placebo"], []), study(7, "Six", ["Badname"], ["PHASE1"]), study(8, "Seven", ["Oldname"], ["PHASE4"], conditions=[]), ("c", 9, None, None, None, None, None, None, None, None, None),
        study(1, "Lone", ["Solo"], [], company="d"), study(1, "Nobody's", ["Drugol"], [], company=None),
    ]
    rules = spark.createDataFrame([("c", 1, ["badname"], True, None, None, None), ("c", 2, ["Oldname"], None, "Newname", "NDA_BLA", ["rare ataxia"])], RULE)
    companies = spark.createDataFrame([("c", AT, 2e7, 1e7, 0.0, 3, None, None), ("d", AT, None, None, None, None, "P", "an antibody"), ("e", AT, 5.0, 1e12, 0.0, 0, None, None)], COMPANY)
    out = graph.company_graph(companies, spark.createDataFrame(rows, STUDY), rules, "company")
    programs = {(r.company, r.program_name): r for r in out["programs"].collect()}
    assert set(programs) == {("c", "Drugol"), ("c", "Newname"), ("c", tr.UNMAPPED), ("d", "Solo")}
    drug = programs["c", "Drugol"]
    assert (drug.program_id, drug.phase, drug.trials, drug.enrollment, drug.lead.trial_id, drug.conditions, drug.market) == ("c:1", "PHASE3", 4, 70, "t3", ["lymphoma", "obesity"], max(6e9, drug.market))
    assert abs(drug.pos_prior - (0.57 + 0.12)) < 1e-12 and abs(drug.international_score - 0.5 * 10 / 71) < 1e-12 and abs(drug.amc_site_score - 2 / 8 * 10 / 71) < 1e-12
    new = programs["c", "Newname"]
    assert (new.phase, new.conditions, new.position, drug.position, new.canonical_name) == ("NDA_BLA", ["rare ataxia"], 1, 2, "Newname")
    assert programs["c", tr.UNMAPPED].low_signal and not drug.low_signal and programs["d", "Solo"].modality == "antibody"
    events = {r.event_id: r for r in out["catalysts"].collect()}
    assert events["c:1:phase3_readout:120"].title == "Drugol phase 3 readout in lymphoma" and events["c:1:phase3_readout:120"].expected_date == AT + dt.timedelta(days=120)
    assert events["company:commercial_update:45"].company == "c" and len(events) == 5
    assert {r.company: r.probability for r in out["financing_events"].collect()} == {"c": 0.80, "d": 0.80}
    none = graph.company_graph(companies, spark.createDataFrame([], STUDY), rules, "company")
    assert none["programs"].count() == 0 and none["catalysts"].count() == 1 and none["trials"].count() == 0


def test_roll_up(spark):
    rows = [("c", "Recruiting", ["PHASE2"], 5, ["Drug, one", "x"], ["a"]), ("c", "", ["PHASE3"], None, ["Drug two"], ["a", "b"]), ("c", "COMPLETED", ["PHASE4"], 90, ["Late"], ["z"]), ("d", "TERMINATED", [], 3, [], []), ("e", None, ["EARLY"], 4, None, None)]
    found = {r.company: r for r in company_roll_up(spark.createDataFrame(rows, "company string, status string, phases array<string>, enrollment long, interventions array<string>, conditions array<string>"), ["company"]).collect()}
    c, d, e = found["c"], found["d"], found["e"]
    assert (c.n_trials, c.n_total, c.n_inactive, c.total_enrollment, c.max_enrollment, c.best_phase, c.base_pos) == (2, 3, 1, 5, 5, "PHASE3", 0.590)
    assert (c.phase_enrollment, c.phase_trials, c.drug_names, c.conditions) == ({"PHASE2": 5, "PHASE3": 0}, {"PHASE2": 1, "PHASE3": 1}, ["Drug"], ["a", "b"])
    assert (d.n_trials, d.total_enrollment, d.best_phase, d.phase_trials, d.drug_names) == (0, 0, "PHASE1", {}, [])
    assert (e.n_trials, e.best_phase, e.phase_enrollment) == (1, "PHASE1", {"EARLY_PHASE1": 4})


def plain_profile(setup, held, confidence, upside, floor, state):
    """The rules for a long idea with an expected return of 0.1, a success of 0.6, a weight of 2 and little risk."""
    sold = state != "pre_commercial"
    if upside <= -0.12:
        return "negative_asymmetry", "block", 0.0
    if confidence < 0.5 and not held:
        return "low_confidence", "block", 0.0
    sure = held and confidence >= 0.5
    if setup == "hard_catalyst":
        return ("hard_catalyst", "auto", 4.0) if confidence >= 0.62 and upside >= -0.02 else ("hard_catalyst_hold", "hold", 2.5) if sure else ("hard_catalyst_blocked", "block", 0.0)
    if setup == "soft_catalyst":
        return ("soft_catalyst", "auto", 2.5) if confidence >= 0.68 and upside >= 0.06 and floor >= 0.08 else ("soft_catalyst_hold", "hold", 2.5) if sure and upside >= 0.08 else ("soft_catalyst_blocked", "block", 0.0)
    if setup == "launch_asymmetry":
        good = state == "commercial_launch" and confidence >= 0.58 and upside >= 0.06 and floor >= 0.1
        return ("launch_asymmetry", "auto", 3.0) if good else ("launch_hold", "hold", 3.0) if sure and floor >= 0.1 else ("launch_blocked", "block", 0.0)
    if setup == "capital_allocation":
        good = sold and confidence >= 0.56 and upside >= 0.04 and floor >= 0.1
        return (setup, "auto", 3.0) if good else (f"{setup}_hold", "hold", 3.0) if sure and floor >= 0.1 else (f"{setup}_blocked", "block", 0.0)
    if setup == "sentiment_floor":
        good = sold and confidence >= 0.56 and upside >= 0.03 and floor >= 0.15
        return (setup, "auto", 1.5) if good else (f"{setup}_hold", "hold", 1.5) if sure and floor >= 0.1 else (f"{setup}_blocked", "block", 0.0)
    if setup == "asymmetry_without_near_term_catalyst":
        if not sold and held and confidence >= 0.56 and upside >= 0.08 and floor >= 0.16:
            return "precommercial_asymmetry_hold", "hold", 1.5
        return ("franchise_asymmetry", "auto", 1.5) if sold and confidence >= 0.56 and upside >= 0.08 and floor >= 0.12 else ("no_near_term_catalyst", "block", 0.0)
    return ("default_hold", "hold", 1.5) if sure and upside > 0 and floor >= 0.1 else ("watchful", "block", 0.0)


def test_profiles(spark):
    setups = ("hard_catalyst", "soft_catalyst", "launch_asymmetry", "capital_allocation", "sentiment_floor", "asymmetry_without_near_term_catalyst", None)
    cases = list(itertools.product(setups, (True, False), (0.45, 0.57, 0.6, 0.7), (-0.2, -0.05, 0.05, 0.07, 0.2), (0.05, 0.11, 0.2), ("pre_commercial", "commercial_launch", "commercialized")))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, setup_type string, held boolean, confidence double, upside double, floor_support double, company_state string")
    df = df.withColumns({"special_situation": F.lit(None).cast("string"), "stance": F.lit("long"), "scenario": F.lit("pairs candidate"), "expected_return": F.lit(0.1), "success_prob": F.lit(0.6), "target_weight": F.lit(2.0), "financing_risk": F.lit(0.1), "crowding": F.lit(None).cast("double")})
    found = {r.i: (r.profile, r.mode, r.weight_cap) for r in dp.execution_profiles(df).collect()}
    assert found == {i: plain_profile(*c) for i, c in enumerate(cases)}
    blank = df.where("i = 0").select(*[F.lit(None).cast(t).alias(n) for n, t in df.dtypes])
    row = dp.execution_profiles(blank).first()
    assert (row.profile, row.mode) == ("not_long", "block")
    crowded = dp.execution_profiles(df.where("setup_type = 'soft_catalyst' and not held and confidence = 0.7 and upside = 0.2 and floor_support = 0.2").withColumn("crowding", F.lit(0.85))).first()
    assert (crowded.profile, crowded.weight_cap) == ("soft_catalyst", 1.5)


def test_overlay(spark):
    rows = [
        ("block", False, True, 99, None, None), ("auto", True, True, 8, None, None), ("hold", False, True, 8, None, None), ("auto", False, True, None, None, None), ("auto", False, False, 99, None, None),
        ("auto", False, True, 1, -0.1, 0.6), ("auto", True, True, 1, -0.1, 0.6), ("auto", False, True, 1, 0.2, 0.49), ("auto", False, True, 1, 0.2, 0.6), ("hold", False, True, 1, -0.1, 0.6),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, mode string, held boolean, validated boolean, validation_age int, v_spread double, v_hit_rate double")
    df = df.withColumns({"profile": F.lit("p"), "setup_type": F.lit("soft_catalyst"), "weight_cap": F.when(F.col("mode") == "block", 0.0).otherwise(4.0), "score": F.lit(1.0), "hard_gate": F.lit(False), "v_rows": F.when(F.col("v_spread").isNotNull(), 20), "v_windows": F.lit(5), "v_rank_ic": F.lit(0.1), "v_return": F.lit(0.1)})
    found = {r.i: (r.profile, r.mode, r.weight_cap, round(r.score, 6)) for r in dp.validation_overlay(df).collect()}
    same = lambda mode, cap=4.0: ("p", mode, cap, 1.0)
    assert [found[i] for i in range(10)] == [
        same("block", 0.0), ("p_stale_validation_hold", "hold", 1.5, 0.65), ("p_stale_validation_blocked", "block", 0.0, 0.0), same("auto"), same("auto"), ("p_validation_blocked", "block", 0.0, 0.0), ("p_validation_hold", "hold", 1.5, 0.65),
        ("p", "auto", 2.0, 0.85), same("auto"), same("hold"),
    ]
    gate = dp.validation_overlay(df.where("i = 8").withColumn("setup_type", F.lit("hard_catalyst"))).first()
    assert gate.profile == "p_validation_blocked"


def test_promotion(spark):
    good = dict(windows=30, rows=500, rank_ic=0.2, strict_rank_ic=0.1, spread=0.2, exact_rate=0.9, synthetic_rate=0.1, rank_ic_low=0.05, spread_low=0.05, leakage_passed=True, own_blockers=[])
    kinds = "windows int, rows int, rank_ic double, strict_rank_ic double, spread double, exact_rate double, synthetic_rate double, rank_ic_low double, spread_low double, leakage_passed boolean, own_blockers array<string>"
    rows = [good, {**good, "rank_ic": 0.12, "spread_low": None}, {**good, "own_blockers": [" ", "late"], "windows": 2}, dict.fromkeys(good)]
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "i int, " + kinds)
    found = [(r.decision, r.blockers) for r in dp.promotions(df).orderBy("i").collect()]
    assert found[:3] == [("promote", []), ("paper_trade_ready", ["rank_ic_15", "spread_low"]), ("do_not_promote", ["late", "windows"])]
    assert found[3] == ("do_not_promote", ["leakage", "windows", "rows", "rank_ic", "spread", "exact_events", "synthetic_events"])
