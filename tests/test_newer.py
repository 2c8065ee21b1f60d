"""Rules by marker, history, intervals, peers, matches, calibration, calendars, writers and state against plain Python."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.functions.landscape import categories, landscape, text_family
from eventlens.operators.asof import asof_join, asof_join_split
from eventlens.operators.intervals import active_interval
from eventlens.operators.isotonic import isotonic_blocks, isotonic_calibrator
from eventlens.operators.markers import first_rules, marker_bits
from eventlens.operators.rankstats import nearest_peers
from eventlens.plans.history import instants_asof, volatility_at
from eventlens.plans.matching import stale_events
from eventlens.plans.models import fit_ridge, train_ensemble, walk_forward
from eventlens.sources.calendars import calendar_events, read_calendar
from eventlens.sources.tables import replace_table
from eventlens.streaming.state import running_values, running_values_at
from eventlens.streaming.windows import event_stream

DAY = dt.date(2026, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_marker_bits_are_substring_tests(spark):
    pick = random.Random(3)
    lists = [tuple("".join(pick.choice("abc") for _ in range(pick.randint(1, 4))) for _ in range(pick.randint(1, 4))) for _ in range(63)]
    texts = ["".join(pick.choice("abc ") for _ in range(pick.randint(0, 12))) for _ in range(300)] + ["", None, "é🙂a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    for r in df.select("t", marker_bits(F.col("t"), lists).alias("b")).collect():
        assert r.b == (None if r.t is None else sum(any(m in r.t for m in ms) << i for i, ms in enumerate(lists)))
    with pytest.raises(ValueError, match="63"):
        marker_bits(F.col("t"), lists + [("x",)])
    row = spark.createDataFrame([("Phase 2 in Hodgkin lymphoma, CAR-T", None)], "a string, b string")
    found = row.select(landscape(F.col("a"))["label"].alias("l"), F.array_join(categories(F.col("a")), ","), text_family(F.col("a"), F.col("b")), landscape(F.col("b"))["label"]).first()
    assert tuple(found) == ("oncology", "oncology,cell therapy", "phase2_readout", "general biotech")


def test_first_rules_keep_order_keys_and_null_texts(spark):
    rules = spark.createDataFrame([("A", 2, ["Beta", ""], "two"), ("A", 1, ["alpha beta"], "one"), ("B", 1, ["beta"], "b"), (None, 1, ["beta"], "n"), ("C", 1, [], "none")], "k string, rule_no int, markers array<string>, name string")
    rows = spark.createDataFrame([(1, "A", "xbetax"), (2, "A", "ALPHA beta"), (3, "B", "alphabet"), (4, "B", None), (5, None, "beta"), (6, "C", "beta"), (7, "A", "BETA")], "i int, k string, t string")
    assert {r.i: r.rule and r.rule.name for r in first_rules(rows, "k", F.col("t"), rules).collect()} == {1: "two", 2: "one", 3: None, 4: None, 5: None, 6: None, 7: "two"}
    assert first_rules(rows, "k", F.col("t"), rules.limit(0)).where("rule is not null").count() == 0
    with pytest.raises(ValueError, match="too many"):
        first_rules(rows, "k", F.col("t"), rules, most=1)


def test_intervals_that_overlap_and_stay_open(spark):
    pick = random.Random(5)
    spans = [(pick.choice("ab"), i, pick.choice([None, pick.randint(0, 30)]), pick.choice([None, pick.randint(5, 40)])) for i in range(60)]
    moments = [(i, pick.choice(["a", "b", None]), pick.choice([None, *range(40)])) for i in range(120)]
    stamp = lambda n: None if n is None else dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    intervals = spark.createDataFrame([(k, i, stamp(a), stamp(b)) for k, i, a, b in spans], "k string, no int, lo timestamp, hi timestamp")
    rows = spark.createDataFrame([(i, k, stamp(t)) for i, k, t in moments], "i int, k string, t timestamp")
    got = {r.i: r.active and r.active.no for r in active_interval(rows, intervals, ["k"], "t", "lo", "hi", "no").collect()}
    for i, k, t in moments:
        open_ = [(-(10**9) if a is None else a, no) for kk, no, a, b in spans if kk == k and t is not None and (a is None or a <= t) and (b is None or t <= b)]
        assert got[i] == (max(open_)[1] if open_ else None)
    assert active_interval(rows, intervals.limit(0), ["k"], "t", "lo", "hi", "no").where("active is null").count() == 120


def test_nearest_peers_equal_all_pairs(spark):
    pick = random.Random(6)
    rows = [(g, i, pick.choice([None, round(pick.random() * 8) / 2, pick.random()])) for g in "ab" for i in range(40)] + [("c", 0, 1.0)]
    got = {(r.g, r.i): r.nearest for r in nearest_peers(spark.createDataFrame(rows, "g string, i int, v double"), ["g"], "i", "v").collect()}
    for g, i, v in rows:
        order = sorted((x, j) for h, j, x in rows if h == g and x is not None)
        own = order.index((v, i)) if v is not None else None
        peers = sorted((abs(x - v), abs(n - own), n > own, j) for n, (x, j) in enumerate(order) if j != i) if v is not None else []
        assert got[g, i] == [p[-1] for p in peers[:3]]


def test_facts_count_from_their_filing_on(spark):
    facts = [("s", "cash", 0, 10, 1.0), ("s", "cash", 0, 40, 2.0), ("s", "cash", 5, 6, 3.0), ("s", "debt", 30, 20, 4.0), ("s", "cash", 20, 60, 5.0), ("s", "cash", None, 1, 9.0), ("t", "cash", 1, 1, 7.0)]
    df = spark.createDataFrame([(s, n, None if e is None else day(e), day(f), v) for s, n, e, f, v in facts], "symbol string, name string, end date, filed date, val double")
    rows = spark.createDataFrame([("s", day(d)) for d in (5, 6, 10, 29, 30, 41, 60)] + [("u", day(60)), ("s", None)], "symbol string, as_of date")
    got = {(r.symbol, r.as_of): (r.cash, r.debt) for r in instants_asof(rows, df, "symbol", "as_of", ["cash", "debt"]).collect()}
    expect = {5: (None, None), 6: (3.0, None), 10: (3.0, None), 29: (3.0, None), 30: (3.0, 4.0), 41: (3.0, 4.0), 60: (5.0, 4.0)}
    assert got == {**{("s", day(d)): v for d, v in expect.items()}, ("u", day(60)): (None, None), ("s", None): (None, None)}


def test_volatility_at_a_day_without_a_close(spark):
    pick = random.Random(7)
    closes = {d: 50 + pick.random() * 10 for d in range(0, 200, 4)}
    prices = spark.createDataFrame([("s", day(d), c) for d, c in closes.items()], "symbol string, date date, close double")
    rows = spark.createDataFrame([("s", day(d)) for d in (1, 30, 44, 63, 100, 199, 240)] + [("none", day(9))], "symbol string, as_of date")
    got = {(r.symbol, (r.as_of - DAY).days): r.volatility for r in volatility_at(rows, prices, "as_of").collect()}
    for d in (1, 30, 44, 63, 100, 199, 240):
        inside = [c for x, c in closes.items() if d - 63 <= x <= d]
        moves = [b / a - 1 for a, b in zip(inside, inside[1:], strict=False)]
        assert got["s", d] == (pytest.approx(float(np.std(moves, ddof=1))) if len(moves) >= 10 else None)
    assert got["none", 9] is None


def test_stale_events_by_parts_of_words(spark):
    filings = spark.createDataFrame([("c", day(0), "Topline RESULTS for abcdrug-1"), ("c", day(200), "nothing told"), ("c", day(300), "interim: xyzzymab"), ("d", day(0), "data on other")], "company string, filed date, text string")
    rows = [(1, "c", 10, "abcd update", "", "inferred", 90), (2, "c", 181, "abcd update", "", "inferred", 90), (3, "c", 10, "abcd", "", "exact_sec_filing", 90), (4, "c", 10, "abcd", "", "inferred", 30), (5, "c", 301, "(zzym),", None, None, 31), (6, "d", 10, "abc", "oth", "x", 90), (7, "d", 10, None, "other words", "x", 90)]
    events = spark.createDataFrame([(i, c, day(d), t, n, s, h) for i, c, d, t, n, s, h in rows], "event_id int, company string, as_of date, title string, names string, status string, horizon_days int")
    got = {r.event_id: (r.stale, r.status, r.horizon_days) for r in stale_events(events, filings).collect()}
    assert {i for i, v in got.items() if v[0]} == {1, 5, 7} and got[5][1:] == ("stale_synthetic", 365) and got[2][1:] == ("inferred", 90)


def pooled(points):
    blocks = []
    for x, total, n in points:
        blocks.append([x, x, total, n])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return [(a, b, t / n) for a, b, t, n in blocks]


def test_isotonic_fit_over_partitions(spark):
    pick = random.Random(8)
    rows = [(round(pick.random(), 2), float(pick.random() < 0.3 + 0.4 * i / 900)) for i in range(900)] + [(None, 1.0), (0.5, None)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(5)
    blocks = isotonic_blocks(df, "x", "y")
    sums = {}
    for x, y in rows[:900]:
        s = sums.setdefault(x, [0.0, 0])
        s[0] += y
        s[1] += 1
    expect = pooled([(x, *sums[x]) for x in sorted(sums)])
    assert [(r.low, r.high) for r in blocks.collect()] == [e[:2] for e in expect] and np.allclose([r.value for r in blocks.collect()], [e[2] for e in expect])
    ask = [-1.0, 0.0, 0.123, 0.555, 0.9, 2.0, None]
    got = [r.c for r in spark.createDataFrame([(i, a) for i, a in enumerate(ask)], "i int, a double").coalesce(1).select(isotonic_calibrator(blocks)(F.col("a")).alias("c")).collect()]
    at, value = [v for e in expect for v in e[:2]], [e[2] for e in expect for _ in range(2)]
    assert got[-1] is None and np.allclose(got[:-1], np.interp(ask[:-1], at, value))
    assert isotonic_blocks(df.limit(0), "x", "y").count() == 0


def test_ablated_models_come_from_sub_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(day(30 * int(i % 8)), i, *map(float, x), float(x @ [1.0, -2.0, 0.5] + e)) for i, (x, e) in enumerate(zip(rng.normal(size=(240, 3)), rng.normal(size=240), strict=True))]
    df = spark.createDataFrame(rows, "d date, i int, a double, b double, c double, y double")
    refit = walk_forward(df, "d", ["a", "b", "c"], "y", families={"b": ["b"], "ac": ["a", "c"]}, refit=True)
    zero = {r.i: r for r in walk_forward(df, "d", ["a", "b", "c"], "y", families={"b": ["b"]}).collect()}
    test = day(210)
    known = df.where(F.col("d") <= F.lit(test - dt.timedelta(days=90)))
    model, full = fit_ridge(known, ["a", "c"], "y"), fit_ridge(known, ["a", "b", "c"], "y")
    for r in refit.where(F.col("d") == test).withColumns({"m": model.predict(), "f": full.predict()}).withColumn("b", F.lit(0.0)).withColumn("z", full.predict()).collect():
        assert np.isclose(r.prediction, r.f) and np.isclose(r.prediction_b, r.m) and np.isclose(zero[r.i].prediction_b, r.z)
    with pytest.raises(ValueError, match="dates"):
        walk_forward(df, "d", ["a"], "y", most_dates=3)


def test_training_flow_limits(spark):
    rows = spark.range(40).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") / 40).alias("target_return_90d"), (F.col("id") % 2).cast("int").alias("target_catalyst_success"), F.when(F.col("id") < 20, 0.1).alias("target_alpha_90d"))
    model = train_ensemble(rows, ["a"], F.lit(0.5))
    assert not model.used_alpha and model.calibrate is not None
    assert train_ensemble(rows.limit(19), ["a"], F.lit(0.5)) is None
    assert train_ensemble(rows.withColumn("target_catalyst_success", F.lit(1)), ["a"], F.lit(0.5)).calibrate is None
    assert train_ensemble(rows.withColumn("target_alpha_90d", F.lit(0.1)), ["a"], F.lit(0.5)).used_alpha


def test_calendars_of_all_shapes_give_one_table(spark, tmp_path):
    rows = [{"ticker": "abc", "date": "2026-02-01", "title": "PDUFA date", "importance": "0.9"}, {"symbol": "abc", "catalyst_date": "02/03/2026", "name": "Phase 2 data", "notes": "x"}, {"ticker": "", "date": "2026-02-01", "title": "PDUFA"}, {"ticker": "abc", "date": "soon", "title": "PDUFA"}, {"ticker": "abc", "date": "2026-02-01", "title": "Dinner"}, {"ticker": "abc", "date": "2026-03-01", "title": "AdCom", "published_at": "2026-02-20"}]
    shapes = {"list.json": rows, "events.json": {"events": rows}, "data.json": {"events": [], "rows": None, "data": rows}}
    for name, shape in shapes.items():
        (tmp_path / name).write_text(json.dumps(shape))
    names = list(dict.fromkeys(k for r in rows for k in r))
    (tmp_path / "rows.csv").write_text("\n".join([",".join(names), *[",".join(r.get(n, "") for n in names) for r in rows]]))
    for name, own in (("bad.json", '{"events": [1'), ("odd.json", '{"other": 1}'), ("scalar.json", "3")):
        (tmp_path / name).write_text(own)
    found = {}
    for name in (*shapes, "rows.csv", "bad.json", "odd.json", "scalar.json"):
        events = calendar_events(read_calendar(spark, str(tmp_path / name)), F.lit("2026-02-10").cast("timestamp"))
        found[name] = sorted((r.event_id, r.title, str(r.expected_date), r.details, r.status, r.importance) for r in events.collect())
    assert found["list.json"] == found["events.json"] == found["data.json"] == found["rows.csv"]
    assert [x[0] for x in found["list.json"]] == ["calendar:ABC:pdufa:2026-02-01", "calendar:ABC:phase2_readout:2026-02-03"] and found["list.json"][0][5] == 0.9
    assert found["bad.json"] == found["odd.json"] == found["scalar.json"] == []


def test_replace_table_survives_a_failed_write_and_reads_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_table(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "v int, p string"), path, ["p"])
    read = lambda: sorted((r.v, r.p) for r in spark.read.parquet(path).collect())
    assert read() == [(1, "a"), (2, "b")]
    broken = spark.range(4).select(F.assert_true(F.col("id") < 3).alias("x"), F.col("id").cast("int").alias("v"), F.lit("a").alias("p")).drop("x")
    broken = spark.range(4).select((F.col("id") + F.coalesce(F.assert_true(F.col("id") < 3).cast("int"), F.lit(0))).cast("int").alias("v"), F.lit("a").alias("p"))
    with pytest.raises(Exception, match="assert|ASSERT|not true|USER_RAISED"):
        replace_table(broken, path, ["p"])
    assert read() == [(1, "a"), (2, "b")]
    replace_table(spark.createDataFrame([(7, "b")], "v int, p string"), path, ["p"])  # other partitions stay
    assert read() == [(1, "a"), (7, "b")]
    replace_table(spark.read.parquet(path).select((F.col("v") + 1).alias("v"), "p"), path)
    assert read() == [(2, "a"), (8, "b")]
    assert [p.name for p in tmp_path.iterdir() if "staged" in p.name and (p / "_SUCCESS").exists()] == []


def test_running_state_equals_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = event_stream(spark, str(tmp_path / "in"), events.schema)
    seen = running_values(stream, "user_id", "ts", "event_id", "value", "30 days", keep=5)
    job = seen.writeStream.outputMode("update").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    job.processAllAvailable()
    job.stop()
    last = spark.table("running").groupBy("key").agg(F.max_by("values", F.struct("at", ~F.col("active"))).alias("values"), F.max("at").alias("at"))
    got = {r.key: (r.at, r["values"]) for r in last.collect()}
    expect = running_values_at(events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "event_id", "value", F.lit("2024-02-01").cast("timestamp"), keep=5)
    assert got == {r.key: (r.at, r["values"]) for r in expect.collect()} and len(got) > 10


def test_quiet_keys_expire(spark, tmp_path):
    schema = "user_id int, ts timestamp, event_id bigint, value double"
    stamp = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    for n, rows in enumerate(([(1, stamp(0), 1, 1.0), (2, stamp(1), 2, 2.0)], [(2, stamp(100), 3, 3.0)], [(2, stamp(101), 4, 4.0), (None, stamp(101), 5, 5.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        job = running_values(event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), "user_id", "ts", "event_id", "value", "1 hour")
        job = job.writeStream.outputMode("update").format("memory").queryName(f"quiet{n}").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out"))).start()
        job.processAllAvailable()
        job.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.key, r.active) for r in rows} == {(1, True), (1, False), (2, True)}
    assert max((r.at, r["values"]) for r in rows if r.key == 2) == (stamp(101), [2.0, 3.0, 4.0])


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_split_asof_equals_the_whole_one(spark, direction, strict):
    pick = random.Random(9)
    stamp = lambda h: None if h is None else dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    left = spark.createDataFrame([(i, pick.choice(["a", "a", "b", "c", None]), stamp(pick.choice([None, *range(0, 2000, 7)]))) for i in range(400)], "i int, k string, t timestamp")
    times = sorted({(k, pick.randrange(0, 2000)) for k in "aab" for _ in range(40)})
    right = spark.createDataFrame([(k, stamp(h), float(h)) for k, h in times], "k string, at timestamp, v double")
    key = lambda df: sorted((r.i, str(r.at), str(r.v)) for r in df.collect())
    whole = asof_join(left, right, ["k"], "t", "at", ["v"], direction, strict)
    assert key(asof_join_split(left, right, ["k"], "t", "at", ["v"], 3, direction, strict)) == key(whole)
