"""Newer kernels and plans against plain Python on small fixtures."""

import datetime as dt
import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from eventlens.functions.evidence import tokens
from eventlens.functions.numeric import round_trip_cost
from eventlens.functions.program import endpoint_score, phase
from eventlens.operators.asof import carried_forward, nearest_join
from eventlens.operators.greedy import greedy_intervals, greedy_spacing
from eventlens.operators.rankstats import peer_summary
from eventlens.operators.rows import once
from eventlens.plans.models import fit_ridge, walk_forward
from eventlens.plans.recommend import _smooth
from eventlens.sources.feeds import guided_date
from eventlens.sources.filings import trailing_value

START = dt.datetime(2026, 1, 1)


def at(day):
    return START + dt.timedelta(days=day)


def test_greedy_intervals_keep_null_keys_apart_and_columns(spark):
    rows = [(1, None, 0, 3), (2, None, 2, 4), (3, "a", 1, 2), (4, None, 5, 6)]
    df = spark.createDataFrame([(i, k, at(s), at(e), [i]) for i, k, s, e in rows], "id int, key string, s timestamp, e timestamp, more array<int>")
    out = greedy_intervals(df, ["key"], [F.col("s")], F.col("s"), F.col("e"), "id")
    assert out.columns == [*df.columns, "active", "blocked_by"]
    assert {r.id: (r.active, r.blocked_by, r.more) for r in out.collect()} == {1: (True, None, [1]), 2: (False, 1, [2]), 3: (True, None, [3]), 4: (True, None, [4])}
    assert greedy_intervals(df.limit(0), ["key"], [F.col("s")], F.col("s"), F.col("e"), "id").count() == 0


def test_greedy_spacing_with_and_without_the_last_and_limited(spark):
    df = spark.createDataFrame([(k, at(d)) for k in "ab" for d in (0, 0, 7, 14, 30, 31)], "k string, d timestamp")
    days = lambda out: sorted({(r.d - START.date()).days for r in out.collect()})
    assert days(greedy_spacing(df, ["k"], "d", 14)) == [0, 14, 30, 31]
    assert days(greedy_spacing(df, ["k"], "d", 14, keep_last=False)) == [0, 14, 30]
    assert days(greedy_spacing(df, ["k"], "d", 14, latest=2)) == [30, 31] and greedy_spacing(df, ["k"], "d", 14, latest=2).count() == 4


def test_long_key_takes_linear_time(spark):
    df = spark.range(40_000).select(F.lit("k").alias("key"), "id", (F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("s"))
    out = greedy_intervals(df, ["key"], [F.col("s")], F.col("s"), F.col("s") + F.expr("INTERVAL 90 MINUTES"), "id")
    assert out.where("active").count() == 20_000


def test_nearest_and_carried_rows(spark):
    pick = random.Random(1)
    left = [(i, pick.choice("ab"), at(pick.randint(0, 60))) for i in range(60)]
    right = [(pick.choice("ab"), at(pick.randint(0, 60)), i) for i in range(25)]
    one, two = spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, u timestamp, v int")
    got = {r.id: r.v for r in nearest_join(one, two, ["k"], "t", "u", "v").collect()}
    assert got == {i: min(((abs(u - t), v) for x, u, v in right if x == k), default=(None, None))[1] for i, k, t in left}
    dates = spark.createDataFrame([(at(d),) for d in range(0, 90, 9)], "day timestamp")
    base = two.groupBy("k", "u").agg(F.min("v").alias("v"))
    rows = [(r.k, r.u, r.v) for r in base.collect()]
    expect = {}
    for d in range(0, 90, 9):
        for k in "ab":
            known = [(u, v) for x, u, v in rows if x == k and at(d) - dt.timedelta(days=20) <= u <= at(d)]
            if known:
                expect[at(d), k] = max(known)
    assert {(r.day, r.k): (r.u, r.v) for r in carried_forward(base, dates, ["k"], "u", "day", 20).collect()} == expect


def test_peers_equal_brute_force(spark):
    pick = random.Random(2)
    rows = [(i, pick.choice("abc"), pick.choice([1.0, 2.0, 2.5, 4.0, None])) for i in range(50)] + [(99, "alone", 1.0)]
    got = {r.id: (r.peers, r.peer_median, round(r.share_below, 9)) for r in peer_summary(spark.createDataFrame(rows, "id int, g string, x double"), ["g"], "id", "x").collect()}
    expect = {}
    for i, g, x in rows:
        others = [y for j, h, y in rows if h == g and j != i and y is not None]
        if x is not None and others:
            expect[i] = (len(others), statistics.median(others), round(sum(y <= x for y in others) / len(others), 9))
    assert got == expect


def test_trailing_values(spark):
    d = dt.date
    facts = [
        ("annual", d(2025, 1, 1), d(2025, 12, 31), d(2026, 2, 1), 100.0), ("annual", d(2025, 10, 1), d(2025, 12, 31), d(2026, 2, 1), 40.0),
        ("quarters", d(2025, 1, 1), d(2025, 3, 31), d(2025, 5, 1), 10.0), ("quarters", d(2025, 1, 1), d(2025, 3, 31), d(2025, 6, 1), -30.0), ("quarters", d(2025, 1, 1), d(2025, 3, 31), d(2025, 7, 1), 8.0),
        ("quarters", d(2025, 4, 1), d(2025, 6, 30), d(2025, 8, 1), 12.0), ("other", d(2025, 1, 1), d(2025, 7, 19), d(2025, 8, 1), 50.0), ("late", d(2026, 1, 1), d(2026, 12, 31), d(2027, 2, 1), 5.0),
    ]
    df = spark.createDataFrame(facts, "k string, start date, end date, filed date, val double").withColumn("as_of", F.lit("2026-03-01").cast("date"))
    got = {r.k: round(r.value, 6) for r in trailing_value(df, ["k"], "as_of").collect()}
    assert got == {"annual": 100.0, "quarters": round(20.0 * 365 / (89 + 90), 6), "other": round(50.0 * 365 / 199, 6)}


def test_walk_forward_equals_single_fits(spark):
    pick = random.Random(4)
    rows = [(i, at(30 * (i % 8)), pick.random(), pick.choice([None, pick.random()]), pick.choice([None, pick.random()])) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, day timestamp, a double, b double, y double")
    got = {r.id: r.prediction for r in walk_forward(df, "day", ["a", "b"], "y").collect()}
    assert len(got) == 160
    for n in (0, 3, 7):
        model = fit_ridge(df.where(F.col("day") <= F.lit(at(30 * n - 90))), ["a", "b"], "y")
        for r in df.where(F.col("day") == F.lit(at(30 * n))).select("id", model.predict().alias("p")).collect():
            assert abs(got[r.id] - r.p) < 1e-9


def test_guided_dates(spark):
    texts = {
        "closing in Q3 2029": d(2029, 9, 30), "the third quarter of 31": d(2031, 9, 30), "by 2H-2030": d(2030, 12, 31), "in the first half of 2027": d(2027, 6, 30), "in Q1 2020 or 2H 2028": d(2028, 12, 31),
        "second half of 1996": None, "no period": None, "Q4'26": d(2026, 12, 31), "Q5 2029": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.g for r in df.select("t", guided_date(F.col("t"), F.lit("2026-02-01").cast("timestamp")).alias("g")).collect()} == texts


d = dt.date


def test_small_columns(spark):
    df = spark.createDataFrame([(1,)], "i int")
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    row = df.select(
        phase(names("Phase 1", "PHASE2")).alias("a"), phase(names("Early Phase")).alias("b"), phase(names("Phase 4")).alias("c"), phase(names()).alias("d"),
        endpoint_score(names("OS", "safety")).alias("e"), endpoint_score(names("", " ")).alias("f"), endpoint_score(names("Cosmetic gain")).alias("g"),
        F.round(round_trip_cost(F.lit(3e8), F.lit(0.05), F.lit(True)), 6).alias("h"), F.round(round_trip_cost(F.lit(None).cast("double"), F.lit(2.0), F.lit(False)), 6).alias("i"),
        F.array_sort(tokens(F.lit("The Biotech ABC-123- trial of x9 medicine phase"))).alias("j"),
    ).first()
    assert tuple(row)[:4] == ("PHASE2", "EARLY_PHASE1", "APPROVED", "PHASE1")
    assert abs(row.e - (0.65 * 0.25 + 0.35 * 0.90)) < 1e-12 and row.f == 0.40 and row.g == 0.40
    assert row.h == 0.0305 and row.i == 0.04 and row.j == ["abc-123", "phase", "trial", "x9"]


def test_weights_move_in_steps():
    step = lambda raw, prior, **k: _smooth(raw, "long", prior, k.get("held", "long"), k.get("edge", 0.1), k.get("before", 0.1), True, 0.6)
    assert step(3.1, None) == 3.0 and step(3.1, 1.0, held="short") == 3.0
    assert step(2.5, 2.0) == 2.25 and step(3.0, 1.0) == 2.5 and step(4.0, 2.0) == 3.5
    assert step(0.0, 2.0) == 0.75 and step(0.0, 2.0, before=0.01) == 0.0
    assert step(0.5, 3.0) == 1.75 and step(0.5, 3.0, edge=0.0) == 1.0


def test_columns_of_once_are_not_repeated_in_the_plan(spark):
    df = once(spark.range(3).withColumn("s", F.lit("x")), {"c": F.when(F.col("id") == 1, "one").when(F.col("id") == 2, "two")})
    used = df.where("c is not null").select("c", F.length("c").alias("n"), F.upper("c").alias("u"))
    assert used._jdf.queryExecution().optimizedPlan().toString().count("THEN one") == 1
    assert sorted((r.c, r.n, r.u) for r in used.collect()) == [("one", 3, "ONE"), ("two", 3, "TWO")]
    assert defaultdict(int, {r.id: 1 for r in df.collect()}) == {0: 1, 1: 1, 2: 1}


def test_leaks_overlays_and_names(spark):
    from eventlens.plans.books import in_field, leaked_columns, overlaid

    assert leaked_columns(["ticker", "target_x", "meta_y", "a"]) == [] and leaked_columns(["a", "market_flow_return_6mo_legacy"]) == ["market_flow_return_6mo_legacy"]
    df = spark.createDataFrame([(1, None, "x"), (2, 5, None)], "a int, latest_a int, latest_b string")
    assert [tuple(r) for r in overlaid(df).orderBy("a").collect()] == [(1, "x"), (5, None)]
    names = spark.createDataFrame([("Acme Therapeutics", "Common Stock", True), ("Acme Steel", "Common Stock", False), ("GenePharma", "Warrant", False), (None, None, False)], "n string, s string, ok boolean")
    assert all(r.got == r.ok for r in names.select("ok", in_field(F.col("n"), F.col("s")).alias("got")).collect())


def test_snapshot_archive_round_trip(spark, tmp_path):
    from eventlens.sources.snapshots import SNAPSHOT, scan_snapshots, snapshot_tables, write_documents

    event = ("p", "e1", "pdufa", "PDUFA date", "2026-05-01", 10, 0.5, 0.9, 0.2, "exact_sec_filing")
    doc = ("AB", "Ab Bio", "2026-01-01", 1.0, 2.0, 3.0, 4.0, [("p", "Prog", "antibody", "PHASE2", ["c"], 0.3, 1.0, [])], [("x", "Drug", "ind", 9.0)], [event, event, (*event[:1], "e2", *event[2:9], "phase_timing_estimate")], [], {"is_delisted": "True"})
    bare = ("CD", "Cd", "2026-01-01", *[None] * 9)
    docs = spark.createDataFrame([doc, bare], SNAPSHOT)
    write_documents(docs.withColumn("namespace", F.lit("snapshots")), str(tmp_path / "raw"))
    (tmp_path / "raw" / "namespace=snapshots" / "broken.json").write_text("{not json")
    back = scan_snapshots(spark, str(tmp_path / "raw"))
    tables = {k: v.collect() for k, v in snapshot_tables(back).items()}
    assert {k: len(v) for k, v in tables.items()} == {"company_snapshots": 2, "programs": 2, "trials": 0, "catalysts": 2, "event_tape": 2, "financing_events": 0, "universe_membership": 2}
    assert {(r.event_id, r.timing_exact, r.timing_synthetic) for r in tables["event_tape"]} == {("e1", True, False), ("e2", False, True)}
    assert {(r.ticker, r.is_delisted, r.has_exact_event) for r in tables["universe_membership"]} == {("AB", True, True), ("CD", False, False)}
