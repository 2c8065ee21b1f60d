"""Rows that are shuffled once: peers beside their rows, events and filings in one stream."""

import random
import re
from datetime import datetime, timedelta

from eventlens.operators.rankstats import peer_summary, with_peers
from eventlens.plans.matching import stale_events
from eventlens.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_peers_stay_beside_all_rows(spark):
    pick = random.Random(4)
    rows = [(i, pick.choice(["a", "b", None]), pick.choice([1.0, 2.0, 2.5, None])) for i in range(60)] + [(None, "a", 2.0), (99, "alone", 1.0)]
    whole = spark.createDataFrame([r for r in rows if None not in r[:2]], "id int, g string, x double")
    expect = {r.id: tuple(r) for r in peer_summary(whole, ["g"], "id", "x").collect()}
    got = with_peers(spark.createDataFrame(rows, "id int, g string, x double"), ["g"], "id", "x").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r) == expect.get(r.id, (r.id, r.g, r.x, None, None, None))


def test_expectation_lens_reads_lines_twice_and_orders_once(spark):
    plan = _plan(spark, "expectation_lens")
    assert len(re.findall(r"Relation \[[^\]]*l_suppkey", plan)) == 2 and len(re.findall(r"Relation \[[^\]]*o_orderkey", plan)) == 1


def test_stale_flags_reads_lines_once_and_joins_only_orders(spark):
    plan = _plan(spark, "stale_flags")
    assert len(re.findall(r"Relation \[[^\]]*l_suppkey", plan)) == 1 and len(re.findall(r"\bJoin ", plan)) == 1


def test_stale_events_equal_brute_force(spark):
    pick = random.Random(7)
    parts = ["phase", "data", "xdata", "datapoint", "metformin", "trial", "(trial)", "results", "Resultsof", "met", "ab", "unmet-need", "Übung", "übungsplatz"]
    text = lambda: pick.choice([None, "", *[" ".join(pick.choice(parts) for _ in range(pick.randint(1, 4))) for _ in range(8)]])
    day = lambda: pick.choice([None, *[datetime(2024, 1, 1) + timedelta(days=pick.randint(0, 500), hours=12 * pick.randint(0, 1)) for _ in range(12)]])
    events = [(pick.choice([1, 2, None, 3, 3]), i, day(), text(), text(), pick.choice([None, "inferred", "exact_press_release"]), pick.choice([None, 20, 30, 31, 90])) for i in range(400)]
    filings = [(pick.choice([1, 2, None, 3]), day(), text()) for _ in range(90)]
    one = spark.createDataFrame(events, "company int, event_id int, as_of timestamp, title string, names string, status string, horizon_days int")
    two = spark.createDataFrame(filings, "company int, filed timestamp, text string")
    words = ("results", "data", "met", "failed", "discontinued", "topline", "top-line", "interim", "readout")
    expect = {}
    for company, i, at, title, names, status, horizon in events:
        tokens = [w for w in (x.strip("(),.-") for x in f"{title or ''} {names or ''}".lower().split()) if len(w) >= 4]
        told = [t.lower() for c, f, t in filings if t and c is not None and c == company and f and at and at - timedelta(days=180) <= f <= at and any(w in t.lower() for w in words)]
        stale = status != "exact_press_release" and (horizon or 0) > 30 and any(k in w for t in told for w in t.split() for k in tokens)
        expect[i] = (stale, "stale_synthetic" if stale else status, 365 if stale else horizon)
    assert {r.event_id: (r.stale, r.status, r.horizon_days) for r in stale_events(one, two).collect()} == expect
    assert 0 < sum(v[0] for v in expect.values()) < 400
    assert stale_events(one, two).columns == [*one.columns, "stale"]
