"""Event stack: canonical event instances, outcomes, matches, trades and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.numeric import borrow_cost, company_state, financing_risk, floor_support, horizon_bucket, knowledge_bucket, round_trip_cost, whole_days
from eventlens.functions.outcomes import outcome
from eventlens.functions.scores import FAMILY_PRIOR, SCHEDULE_SOURCES, SOURCE_PRIORITY, event_scores, source_label
from eventlens.functions.taxonomy import DATED_PRIORITIES, EVENT_FAMILIES, event_type, is_exact_timing, looked_up, timing_priority, type_bucket
from eventlens.operators.asof import asof_join, latest
from eventlens.operators.greedy import greedy_intervals
from eventlens.operators.rows import once
from eventlens.session import Thresholds

#: Days before the event at which the long-before-event variants enter.
ENTRY_DAYS = {"pre_20d_plus1d": 20, "pre_10d_plus1d": 10, "pre_5d_plus1d": 5}


def classified(events: DataFrame, at: str) -> DataFrame:
    """Events with family, bucket and timing flags; ``at`` is the time column."""
    rows = once(events, {"event_family": event_type(F.col("event_type"), F.col("title")), "timing_exact": is_exact_timing(F.col("status"), F.col(at), F.col("title"))})
    return rows.withColumn("event_bucket", type_bucket(F.col("event_family")))


def event_mentions(catalysts: DataFrame) -> DataFrame:
    """Mentions of clinical and regulatory events with their instance.

    One instance is a symbol's program, family and date, whatever the source calls it.
    """
    rows = classified(catalysts.where("as_of is not null and expected_date is not null"), "expected_date")
    rows = rows.where(F.col("event_bucket").isin("clinical", "regulatory") & F.col("event_family").isin(*EVENT_FAMILIES)).repartition("symbol")
    rows = rows.withColumns(
        {
            "source_priority": looked_up(F.coalesce("source", F.lit("")), SOURCE_PRIORITY, 0),
            "event_instance_id": F.concat_ws("|", "symbol", "program_id", "event_family", F.date_format("expected_date", "yyyy-MM-dd")),
        }
    )
    return rows


#: What an instance's latest mention tells, beside its first.
LATEST = ("as_of", "event_id", "source", "status", "title", "importance", "timing_exact")


def canonical_events(catalysts: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """One row per event instance as first seen (what could be known then), with the latest view as ``latest_`` columns.

    Of several mentions at the same time the exact one comes first, then the better source, the more important, and
    the smaller event_id. Mentions lie by symbol, of which an instance has one, and so do the rows that come out: later steps by symbol do not
    shuffle them again. All is windows over one sort per instance, so columns that nobody reads later are not carried.
    """
    mentions = event_mentions(catalysts)
    order = [(~F.col("timing_exact")).cast("int"), -F.col("source_priority"), -F.col("importance"), F.col("event_id")]
    w = Window.partitionBy("symbol", "event_instance_id")
    rows = mentions.withColumn("_nth", F.row_number().over(w.orderBy("as_of", *order))).withColumns({"first_seen": F.min("as_of").over(w), "last_seen": F.max("as_of").over(w)})
    first = F.col("as_of") == F.col("first_seen")
    exact = F.col("timing_exact") & (F.coalesce("source", F.lit("")) != "")
    newest = F.when(F.col("as_of") == F.col("last_seen"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    rows = rows.withColumns(
        {
            "mentions": F.count("*").over(w),
            "first_mentions": F.count_if(first).over(w),
            "exact_sources": F.size(F.collect_set(F.when(exact, F.col("source"))).over(w)),
            "first_exact_sources": F.size(F.collect_set(F.when(exact & first, F.col("source"))).over(w)),
            **{f"latest_{c}": F.min_by(c, newest).over(w) for c in LATEST},
        }
    )
    rows = rows.where("_nth = 1").drop("_nth")
    strict = F.col("timing_exact") & F.col("source").isin(*SCHEDULE_SOURCES)
    many = F.col("first_exact_sources") >= limits.corroborating_sources
    some = (F.col("first_exact_sources") >= 1) & (F.col("first_mentions") >= 2) & (F.col("source") != "internal_inference")
    return rows.withColumns({"strict": strict, "corroborated": many | some, "days_until": whole_days(F.col("expected_date"), F.col("first_seen"))})


def scored_events(instances: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Event instances with the context of their first sight and scores.

    The context is the symbol's last snapshot at or before the first sight; symbols without one get
    defaults (no look-ahead).
    """
    values = ["market_cap", "revenue", "cash", "debt", "products"]
    rows = asof_join(instances, snapshots.withColumnRenamed("as_of", "snapshot_at").repartition("symbol"), ["symbol"], "first_seen", "snapshot_at", values)
    rows = rows.withColumns({v: F.coalesce(v, F.lit(0)).cast("double") for v in values})
    cap, cash, debt, revenue = (F.col(c) for c in ("market_cap", "cash", "debt", "revenue"))
    rows = once(
        rows,
        {
            "company_state": company_state(F.col("products"), revenue),
            "floor_support": floor_support(cap, cash, debt, revenue),
            "financing_risk": F.when(F.col("snapshot_at").isNull(), 0.65).otherwise(financing_risk(cap, cash, debt, revenue)),
        },
    )
    scores = event_scores(F.col("event_family"), F.col("company_state"), F.col("floor_support"), F.col("financing_risk"), F.col("crowdedness"), F.col("days_until"), F.col("source"), F.col("strict"), F.col("corroborated"))
    return once(rows, {k: F.round(v, 9) for k, v in scores.items()}).withColumns({"horizon_bucket": horizon_bucket(F.col("days_until")), "source_label": source_label(F.col("source"))})


def cluster_controls(matched: DataFrame, limits: Thresholds = Thresholds(), columns: tuple[str, ...] | None = None) -> DataFrame:
    """Events of which a symbol has no two active windows at a time: active, blocked_by, cluster_reason, deployable.

    A window runs from the first sight, or ``max_lookback_days`` before the date, to ``post_window_days`` after the matched
    outcome, or after the date where none is matched. ``columns`` are those of the events to keep (all by default): they pass through Python.
    """
    days = lambda n: F.expr(f"INTERVAL {n} DAYS")
    start = F.greatest(F.col("first_seen"), F.col("expected_date") - days(limits.max_lookback_days))
    end = F.coalesce("matched_at", "expected_date") + days(limits.post_window_days)
    order = [start, (~F.col("strict")).cast("int"), -F.col("source_priority"), -F.col("pre_event_score"), -F.col("importance"), F.col("expected_date"), F.col("event_instance_id")]
    kept = None if columns is None else [c for c in matched.columns if c in (*columns, "symbol", "event_instance_id", "strict", "days_until", "first_seen", "expected_date")]
    rows = greedy_intervals(matched, ["symbol"], order, start, end, "event_instance_id", kept)
    low, high = limits.deployable_days
    reason = F.when(F.col("first_seen").isNull() | F.col("expected_date").isNull(), "invalid_cluster_window").when(~F.col("active"), "overlapping_active_event_window")
    return rows.withColumns({"cluster_reason": reason, "deployable": F.col("strict") & F.col("days_until").between(low, high) & F.col("active")})


def event_master(catalysts: DataFrame, snapshots: DataFrame, tape: DataFrame, limits: Thresholds = Thresholds(), columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row per event instance: first and latest view, context, scores, matched outcome, cluster control; of the events' own columns only ``columns`` if given."""
    scored = scored_events(canonical_events(catalysts, limits), snapshots)
    return cluster_controls(match_outcomes(scored, outcome_master(tape)), limits, columns)


def outcome_master(tape: DataFrame) -> DataFrame:
    """Tape events with family, bucket, timing priority and the outcome their text tells, once per (symbol, id, time, source)."""
    rows = classified(tape.where("event_timestamp is not null"), "event_timestamp")
    status, at, title = F.col("status"), F.col("event_timestamp"), F.col("title")
    rows = once(rows, {"outcome_label": outcome(F.col("event_family"), F.col("event_bucket"), title, status), "timing_priority": timing_priority(status, at, title)})
    # by symbol once, behind the Python functions (which do not keep partitions): later steps by symbol stay where they are
    return latest(rows.repartition("symbol"), ["symbol", "event_id", "event_timestamp", "source"], [F.asc("title")])


def match_outcomes(master: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every event with its best labelled outcome, or nulls.

    Candidates share symbol and bucket and lie in a band around the expected date; the tight band comes before
    the standard one for exact events, the standard before the wide one for others. Within a band:
    same type first, then timing priority, then nearness. The bands lie within each other and nearness is the last to count, so of the outcomes of a
    type and priority only the last before and the first after an event can be its best: no pair of event and outcome is formed. Both
    sides are stacked and carried along in order of time, per bucket and per type, and stay with their symbol.
    """
    days = lambda n: F.expr(f"INTERVAL {n} DAYS")
    at, since = F.col("expected_date"), F.col("first_seen")
    inside = lambda t, back, ahead: (t >= F.greatest(since, at - days(back))) & (t <= at + days(ahead))
    labelled = outcomes.where("outcome_label is not null").select(
        "symbol", "event_bucket", F.col("event_type").alias("_type"), F.col("event_timestamp").cast("timestamp").alias("_time"), F.lit(False).alias("_event"), F.col("event_id").alias("_id"),
        F.struct(F.col("event_timestamp").alias("t"), F.col("timing_priority").alias("p"), F.col("event_type").alias("type"), F.col("event_id").alias("id"), F.col("outcome_label").alias("label")).alias("_o"),
    )
    events = master.select("*", F.col("event_family").alias("_type"), F.col("expected_date").cast("timestamp").alias("_time"), F.lit(True).alias("_event"))
    both = events.unionByName(labelled, allowMissingColumns=True)
    # an outcome that could not be known at first sight is none: events first seen after their date look ahead from there
    start = F.when(F.col("_event"), F.greatest("_time", F.col("first_seen").cast("timestamp"))).otherwise(F.col("_time"))
    found = []
    for kind, by in (("any", ["symbol", "event_bucket"]), ("same", ["symbol", "event_bucket", "_type"])):
        w = Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # of outcomes at one time the smallest id is the last that is seen, in either direction
        for side, order in (("before", [F.asc("_time"), F.asc("_event"), F.desc("_id")]), ("after", [start.desc(), F.asc("_event"), F.desc("_id")])):
            names = {f"_{kind}_{side}_{p}": F.last(F.when(F.col("_o.p") == p, F.col("_o")), ignorenulls=True).over(w.orderBy(*order)) for p in DATED_PRIORITIES}
            both = both.withColumns(names)
            found += names
    rows = both.where("_event")

    def candidate(o: Column) -> Column:
        t = o["t"]
        band = F.when(F.col("timing_exact"), F.when(inside(t, 2, 10), 0).when(inside(t, 5, 21), 1)).otherwise(F.when(inside(t, 5, 21), 1).when(inside(t, 14, 30), 2))
        same = (-F.coalesce(o["type"] == F.col("event_family"), F.lit(False)).cast("int")).alias("same")
        best = F.struct(band.alias("band"), same, (-o["p"]).alias("priority"), F.abs(F.unix_timestamp(t) - F.unix_timestamp(at)).alias("distance"), o["id"].alias("matched_id"), t.alias("matched_at"), o["label"].alias("matched_label"))
        return F.when(band.isNotNull(), best)

    found = once(rows, {"m": F.array_min(F.array(*[candidate(F.col(c)) for c in found]))})
    names = F.when(F.col("m.band") == 0, "tight").when(F.col("m.band") == 1, "standard").when(F.col("m.band") == 2, "wide")
    return found.select(*master.columns, "m.matched_id", "m.matched_at", "m.matched_label", names.alias("matched_window"))


def _priced(rows: DataFrame, prices: DataFrame, at: str, name: str, direction: str = "forward") -> DataFrame:
    return asof_join(rows, prices, ["symbol"], at, "date", ["close"], direction, prefix=f"{name}_").withColumnRenamed(f"{name}_close", name)


#: What trades read of an event, beside its expected date and whether its timing is strict.
TRADED = ("event_instance_id", "symbol", "event_family", "event_bucket", "market_cap", "financing_risk", "confidence_proxy", "pre_event_score", "horizon_bucket", "timing_exact", "first_seen", "matched_at", "matched_label")


def trades(matched: DataFrame, prices: DataFrame, volatility: float = 0.35) -> DataFrame:
    """Trade rows of the three sleeves for active events, then greedily non-overlapping per sleeve, variant and symbol.

    Costs follow market value, ``volatility`` (a default where events carry none) and, for shorts, the borrow.
    """
    events, prices = matched.where("active"), prices.repartition("symbol")
    day = lambda c, n: F.col(c) + F.expr(f"INTERVAL {n} DAYS")
    variants = F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(n).alias("days")) for k, n in ENTRY_DAYS.items()])
    pre = events.where("strict").select("*", F.inline(variants)).withColumn("entry_at", F.col("expected_date") - F.make_dt_interval(F.col("days")))
    pre = pre.where("first_seen <= entry_at").withColumns({"exit_at": day("expected_date", 1), "sleeve": F.lit("pre_event_long")})
    after = events.where("matched_label is not null").withColumns({"entry_at": day("matched_at", 1), "exit_at": day("matched_at", 6)})
    after = after.withColumns(
        {
            "sleeve": F.when(F.col("matched_label") == 1, "post_event_reaction_long").otherwise("event_short_or_pairs"),
            "variant": F.when(F.col("matched_label") == 1, "post_next_bar_plus5d").otherwise("short_next_bar_plus5d"),
        }
    )
    rows = pre.drop("days").unionByName(after)
    rows = rows.select(*TRADED, "sleeve", "variant", "entry_at", "exit_at")
    rows = _priced(_priced(_priced(rows, prices, "entry_at", "entry"), prices, "exit_at", "exit"), prices, "matched_at", "anchor", "backward")
    rows = rows.where("entry > 0 and exit is not null and (sleeve <> 'post_event_reaction_long' or anchor > 0)")
    short, post = F.col("sleeve") == "event_short_or_pairs", F.col("sleeve") == "post_event_reaction_long"
    gross = (F.col("exit") / F.col("entry") - 1) * F.when(short, -1).otherwise(1)
    cost = round_trip_cost(F.col("market_cap"), F.lit(volatility), F.col("event_bucket").isin("clinical", "regulatory"))
    cost = cost + F.when(short, borrow_cost(F.col("financing_risk"), F.lit(volatility))).otherwise(0.0)
    prior = looked_up(F.col("event_family"), FAMILY_PRIOR, 0.50)
    reaction = 0.12 * F.least(F.greatest(F.col("entry") / F.col("anchor") - 1, F.lit(0.0)), F.lit(0.6))
    score = (
        F.when(short, prior + 0.20 * F.col("confidence_proxy") - 0.15 * F.col("financing_risk"))
        .when(post, prior + 0.25 * F.col("confidence_proxy") - reaction)
        .otherwise(F.col("pre_event_score"))
    )
    rows = rows.withColumns({"gross_return": F.round(gross, 9), "cost_adjusted_return": F.round(gross - cost, 9), "score": F.round(score, 9)})
    rows = rows.withColumn("knowledge_bucket", knowledge_bucket(whole_days(F.col("entry_at"), F.col("first_seen"))))
    order = [F.col("entry_at"), (~F.col("timing_exact")).cast("int"), -F.col("score"), F.col("event_instance_id")]
    told = ["sleeve", "variant", "symbol", "event_instance_id", "event_family", "entry_at", "exit_at", "gross_return", "cost_adjusted_return", "score", "horizon_bucket", "knowledge_bucket", "timing_exact"]
    kept = greedy_intervals(rows, ["sleeve", "variant", "symbol"], order, F.col("entry_at"), F.col("exit_at"), "event_instance_id", told)
    return kept.where("active").select(*told)
