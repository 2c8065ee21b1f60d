"""Kernels against plain Python on small fixtures, and the streaming jobs."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventlens.functions.outcomes import outcome
from eventlens.functions.taxonomy import event_type, is_exact_timing, timing_priority, type_bucket
from eventlens.operators.asof import asof_join
from eventlens.operators.greedy import greedy_intervals, greedy_spacing
from eventlens.plans.models import feature_columns, fit_ridge
from eventlens.operators.rankstats import spearman, window_summary
from eventlens.sources.tables import first_source, latest_document, new_rows, scan
from eventlens.streaming.windows import distinct_events, event_stream, tumbling, upsert

DAY = dt.timedelta(days=1)
START = dt.datetime(2026, 1, 1)


def brute_asof(left, right, backward, strict):
    out = {}
    for i, key, t in left:
        best = None
        for k, u, v in right:
            ok = k is not None and k == key and t is not None and ((u < t if strict else u <= t) if backward else (u > t if strict else u >= t))
            if ok and (best is None or (u > best[0]) == backward):
                best = (u, v)
        out[i] = best and best[1]
    return out


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, direction, strict):
    pick = random.Random(1)
    left = [(i, pick.choice(["a", "b", "c", None]), pick.choice([None, *[START + k * DAY for k in range(20)]])) for i in range(80)]
    right = [(k, START + n * DAY, f"{k}{n}") for k in ("a", "b") for n in pick.sample(range(20), 8)]
    one = spark.createDataFrame(left, "id int, key string, t timestamp")
    two = spark.createDataFrame(right, "key string, u timestamp, v string")
    got = {r.id: r.v for r in asof_join(one, two, ["key"], "t", "u", ["v"], direction, strict).collect()}
    assert got == brute_asof(left, right, direction == "backward", strict)


def test_greedy_intervals_and_blockers(spark):
    pick = random.Random(2)
    rows = []
    for i in range(120):
        s = pick.choice([None, *range(60)])
        rows.append((i, pick.choice("xy"), None if s is None else START + s * DAY, None if s is None else START + (s + pick.randint(0, 6)) * DAY))
    df = spark.createDataFrame(rows, "id int, key string, s timestamp, e timestamp")
    got = {r.id: (r.active, r.blocked_by) for r in greedy_intervals(df, ["key"], [F.col("s"), F.col("id")], F.col("s"), F.col("e"), "id").collect()}
    expect = {}
    for key in "xy":
        last = None
        for i, _, s, e in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or START, r[0])):
            if s is None:
                expect[i] = (False, None)
            elif last is None or s > last[1]:
                expect[i], last = (True, None), (i, e)
            else:
                expect[i] = (False, last[0])
    assert got == expect


def test_greedy_spacing_keeps_the_last_date(spark):
    days = [0, 7, 21, 40]
    df = spark.createDataFrame([("k", START + d * DAY) for d in days], "k string, d timestamp")
    assert sorted(r.d.day + 31 * (r.d.month - 1) - 1 for r in greedy_spacing(df, ["k"], "d", 14).collect()) == [0, 21, 40]


def test_spearman_equals_pandas(spark):
    pick = random.Random(3)
    rows = [(g, pick.choice([None, *range(6)]), pick.choice([None, *range(6)])) for g in "abcd" for _ in range(25)] + [("flat", 1, i) for i in range(5)] + [("few", 1, 2)]
    df = spark.createDataFrame([(g, None if x is None else float(x), None if y is None else float(y)) for g, x, y in rows], "g string, x double, y double")
    got = {r.g: r.rank_ic for r in spearman(df, ["g"], "x", "y").collect()}
    for g, part in pd.DataFrame(rows, columns=["g", "x", "y"]).astype({"x": float, "y": float}).groupby("g"):
        pair = pd.DataFrame({"x": part.x.rank(), "y": part.y.rank()}).dropna()
        expect = pair.x.corr(pair.y) if len(pair) >= 3 and pair.x.nunique() > 1 and pair.y.nunique() > 1 else 0.0
        assert abs(got.get(g, 0.0) - expect) < 1e-9


def test_window_summary_of_one_row(spark):
    df = spark.createDataFrame([("w", "k", 1.0, 0.2, 0.1)], "w string, k string, score double, gross_return double, cost_adjusted_return double")
    r = window_summary(df, ["w"], ["k"]).first()
    assert (r.rows, r.rank_ic, r.hit_rate, r.spread, r.net_spread, r.top_net) == (1, 0.0, 1.0, 0.0, 0.0, 0.1)


TEXTS = [
    ("earnings", "Positive topline phase 3 data", "phase3_readout", "clinical", 1),
    ("pdufa", "Phase 2 trial missed the primary endpoint", "pdufa", "regulatory", None),
    (None, "Phase 2 trial missed the primary endpoint", "phase2_readout", "clinical", 0),
    ("Phase2 Readout", "nothing here", "phase2_readout", "clinical", None),
    (None, "Agenda of the meeting", "regulatory_update", "regulatory", None),
    (None, "Quarterly results and business update", "earnings", "earnings", None),
    ("adcom", "Panel voted in favor", "adcom", "regulatory", 1),
    ("regulatory_update", "Filing accepted with priority review", "regulatory_update", "regulatory", 1),
    ("pdufa", "Clinical hold, then FDA approved", "pdufa", "regulatory", 0),
    ("unknown", "weather", None, "none", None),
]


def test_taxonomy_and_outcomes(spark):
    df = spark.createDataFrame([(i, k, t) for i, (k, t, *_) in enumerate(TEXTS)], "i int, kind string, title string")
    df = df.withColumn("family", event_type(F.col("kind"), F.col("title"))).withColumn("bucket", type_bucket(F.col("family")))
    df = df.withColumn("label", outcome(F.col("family"), F.col("bucket"), F.col("title"), F.lit("done")))
    assert [(r.family, r.bucket, r.label) for r in df.orderBy("i").collect()] == [t[2:] for t in TEXTS]


def test_timing_flags(spark):
    rows = [("exact_sec_filing", "2026-01-01", "Next milestone"), ("exact_sec_filing", None, "x"), ("calendar_estimate", "2026-01-01", "x"), (None, "2026-01-01", None), ("done", "2026-01-01", "Next milestone")]
    df = spark.createDataFrame(rows, "status string, expected string, title string")
    c = [F.col(x) for x in ("status", "expected", "title")]
    got = [(r[0], r[1]) for r in df.select(is_exact_timing(*c), timing_priority(*c)).collect()]
    assert got == [(True, 2), (False, -1), (False, 0), (True, 2), (False, 0)]


def test_sources(spark, tmp_path):
    empty = scan(spark, str(tmp_path / "none"), spark.createDataFrame([], "a int, b string").schema)
    assert empty.count() == 0 and empty.columns == ["a", "b"]
    held = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    more = spark.createDataFrame([("x", 1), (None, 2), (None, 3), (None, 3)], "b string, a int")
    assert [tuple(r) for r in new_rows(held, more).collect()] == [(3, None)]
    a, b = spark.createDataFrame([(1, 5)], "k int, v int"), spark.createDataFrame([(1, 6), (2, 7)], "k int, v int")
    assert sorted(tuple(r) for r in first_source([a, b], "k").collect()) == [(1, 5), (2, 7)]
    docs = spark.createDataFrame([("k", "2026-01-02", 1, "old"), ("k", None, 10**9, "file"), ("k", "2026-02-02", 2, "new")], "k string, as_of string, m bigint, v string")
    docs = docs.withColumn("m", F.timestamp_seconds("m"))
    assert latest_document(docs, "k", ["as_of"], "m").first().v == "new"


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = event_stream(spark, str(tmp_path / "in"), events.schema)
    job = tumbling(stream, "1 hour", "40 days").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    job.processAllAvailable()
    job.stop()
    key = lambda rows: sorted((r.start, r.event_type, r.n) for r in rows)
    assert key(spark.table("hours").collect()) == key(tumbling(events, "1 hour").collect())
    twice = distinct_events(event_stream(spark, str(tmp_path / "in"), events.schema), ["event_id"], "40 days")
    job = twice.writeStream.foreachBatch(upsert(str(tmp_path / "out"), ["user_id"], ["ts", "event_id"])).option("checkpointLocation", str(tmp_path / "c")).start()
    job.processAllAvailable()
    job.stop()
    last = max(int(p.name[1:]) for p in (tmp_path / "out").iterdir())
    got = {r.user_id: r.event_id for r in spark.read.parquet(str(tmp_path / "out" / f"v{last}")).collect()}
    expect = {r.user_id: r.event_id for r in events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).collect()}
    assert got == expect


def test_ridge_equals_normal_equations(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(3, 2, (200, 3))
    x[:, 2] = 1.0
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, target_y double")
    assert feature_columns([*df.columns, "id", "meta_k"], ("id",)) == ["a", "b", "c"]
    model = fit_ridge(df, ["a", "b", "c"], "target_y", 1.5)
    scale = x.std(axis=0)
    scale[scale < 1e-12] = 1.0
    z = (x - x.mean(axis=0)) / scale
    weights = np.linalg.solve(z.T @ z + 1.5 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(model.weights, weights) and abs(model.bias - y.mean()) < 1e-9
    got = [r.p for r in df.select(model.predict().alias("p")).collect()]
    assert np.allclose(got, z @ weights + y.mean())
    assert fit_ridge(df.limit(0), ["a"], "target_y").bias == 0.0
