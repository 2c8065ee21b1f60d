"""Matches by shared words: ideas to programs in three tiers, and upcoming events that a filing has already told of."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.taxonomy import EXACT_STATUSES
from eventlens.operators.greedy import streamed
from eventlens.operators.markers import marker_bits

# Weights of a shared name word, a shared condition word and the same phase, and the least score of a match.
NAME_WEIGHT, CONDITION_WEIGHT, PHASE_WEIGHT, LEAST_SCORE = 3.0, 2.0, 1.5, 2.0
# Markers of a filing that reports a readout, and days.
READOUT_KEYWORDS = ("results", "data", "met", "failed", "discontinued", "topline", "top-line", "interim", "readout")
STALE_RECENCY_DAYS, STALE_MIN_HORIZON, STALE_HORIZON = 180, 30, 365


def match_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "")


def match_tokens(value: Column) -> Column:
    """Distinct words of letters and digits with at least three of them."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+")), lambda t: F.length(t) >= 3)


def _kept_apart(tokens: Column, kind: str) -> Column:
    return F.transform(tokens, lambda t: F.concat(F.lit(kind), t))


def matched_ideas(ideas: DataFrame, programs: DataFrame, company: str, salts: int = 8) -> DataFrame:
    """``ideas`` with ``matched`` (a program_id, else null) and ``tier``: 1 id, 2 exact name, 3 best score.

    ideas: company, idea_id (unique), entity_id, program_name, indication, phase. programs: company, program_id (unique per company), name,
    conditions (text), phase. Tier 1 needs the entity's program and, where the idea has a name, a word of it or the phase in common. Tier 3
    takes the program with the best score of at least ``LEAST_SCORE``, among those that share a word of the name or the phase; of equal
    ones, and of equal names in tier 2, the smallest program_id counts. An idea leaves at its first match, so only the rest meets the token
    index. There, ideas and programs that look alike count once, and ideas are salted, so that a frequent word is split over tasks.
    """
    ideas = ideas.withColumns({"_name": match_tokens(F.col("program_name")), "_named": F.coalesce("program_name", F.lit("")) != "", "_cond": match_tokens(F.col("indication")), "_ph": F.nullif(F.coalesce("phase", F.lit("")), F.lit(""))})
    programs = programs.select(company, "program_id", match_tokens(F.col("name")).alias("p_name"), match_key(F.col("name")).alias("p_key"), match_tokens(F.col("conditions")).alias("p_cond"), F.col("phase").alias("p_phase"))
    by_id = programs.select(company, F.col("program_id").cast("string").alias("entity_id"), F.col("program_id").alias("by_id"), F.col("p_name").alias("id_name"), F.col("p_phase").alias("id_phase"))
    found = ideas.withColumn("entity_id", F.col("entity_id").cast("string")).join(by_id, [company, "entity_id"], "left")
    alike = ~F.col("_named") | F.arrays_overlap("_name", "id_name") | F.coalesce(F.col("_ph") == F.col("id_phase"), F.lit(False))
    found = found.withColumn("by_id", F.when(alike, F.col("by_id"))).drop("id_name", "id_phase")
    by_name = programs.where("p_key <> ''").groupBy(company, F.col("p_key").alias("_key")).agg(F.min("program_id").alias("by_name"))
    found = found.withColumn("_key", F.when(F.col("by_id").isNull(), match_key(F.col("program_name")))).join(by_name, [company, "_key"], "left")
    rest = found.where("by_id is null and by_name is null")
    look = [company, "_name", "_cond", "_ph"]
    asked = rest.select(*look).distinct().withColumn("_look", F.xxhash64(*look)).withColumn("_salt", F.pmod("_look", F.lit(salts)).cast("int"))
    asked = asked.select("*", F.explode(F.concat(_kept_apart(F.col("_name"), "n:"), _kept_apart(F.col("_cond"), "c:"))).alias("_token"))
    offered = programs.groupBy(company, "p_name", "p_cond", "p_phase").agg(F.min("program_id").alias("program_id"))
    offered = offered.select("*", F.explode(F.concat(_kept_apart(F.col("p_name"), "n:"), _kept_apart(F.col("p_cond"), "c:"))).alias("_token"), F.lit(None).cast("int").alias("_none"))
    offered = offered.drop("_none").withColumn("_salt", F.explode(F.array(*[F.lit(s) for s in range(salts)])))
    pairs = asked.select(company, "_look", "_ph", "_token", "_salt").join(offered.select(company, "_token", "_salt", "program_id", "p_phase"), [company, "_token", "_salt"])
    shared = lambda kind: F.count_if(F.col("_token").startswith(kind))
    scored = pairs.groupBy(company, "_look", "_ph", "program_id", "p_phase").agg(shared("n:").alias("names"), shared("c:").alias("conditions"))
    same = F.coalesce(F.col("_ph") == F.col("p_phase"), F.lit(False))
    score = NAME_WEIGHT * F.col("names") + CONDITION_WEIGHT * F.col("conditions") + F.when(same, PHASE_WEIGHT).otherwise(0.0)
    scored = scored.withColumn("score", score).where(((F.col("names") > 0) | same) & (F.col("score") >= LEAST_SCORE))
    best = scored.groupBy(company, "_look").agg(F.min_by("program_id", F.struct(-F.col("score"), F.col("program_id"))).alias("by_score"))
    found = found.withColumn("_look", F.when(F.col("by_id").isNull() & F.col("by_name").isNull(), F.xxhash64(*look))).join(best, [company, "_look"], "left")
    tier = F.when(F.col("by_id").isNotNull(), 1).when(F.col("by_name").isNotNull(), 2).when(F.col("by_score").isNotNull(), 3)
    return found.select(*[c for c in ideas.columns if not c.startswith("_")], F.coalesce("by_id", "by_name", "by_score").alias("matched"), tier.alias("tier"))


def title_tokens(value: Column) -> Column:
    """Distinct words between spaces, without brackets, commas, dots and dashes at their ends, of at least four characters."""
    words = F.transform(F.split(F.lower(F.coalesce(value, F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit("(),.-")))
    return F.filter(F.array_distinct(words), lambda w: F.length(w) >= 4)


def stale_events(events: DataFrame, filings: DataFrame, days: int = STALE_RECENCY_DAYS) -> DataFrame:
    """``events`` with ``stale``, and status and horizon_days as they should be then.

    events: company, event_id, as_of, title, names (text of programs and conditions), status, horizon_days. filings: company, filed, text. See
    ``judged_stale``; where both come from the same rows, stack them as it wants them, so that those are read once.
    """
    one = events.withColumns({"_event": F.lit(True), "_at": F.to_timestamp("as_of")})
    two = filings.select("company", F.lit(False).alias("_event"), F.to_timestamp("filed").alias("_at"), F.col("text").alias("_text"))
    return judged_stale(one.unionByName(two, allowMissingColumns=True), events.columns, days)


def judged_stale(rows: DataFrame, columns: list[str], days: int = STALE_RECENCY_DAYS) -> DataFrame:
    """``columns`` of the events among ``rows`` with ``stale``, and status and horizon_days as they should be then.

    rows: events (``_event``) with company, ``_at``, title, names, status, horizon_days, and filings with company, ``_at`` and ``_text``. An
    event without exact timing and with a far horizon is stale where a readout filing of the ``days`` up to its time holds one of its tokens,
    also inside a longer word. Rows are shuffled once, to their company, and streamed in order of time (see ``_told_of``), so no event meets
    its filings one by one.
    """
    known = F.col("company").isNotNull() & F.col("_at").isNotNull()
    status = F.coalesce("status", F.lit(""))
    asked = known & F.col("_event") & ~status.isin(*EXACT_STATUSES) & (F.col("horizon_days") > STALE_MIN_HORIZON)
    rows = rows.withColumn("_bits", marker_bits(F.coalesce(F.lower("_text"), F.lit("")), [READOUT_KEYWORDS])).where(F.col("_event") | (known & (F.col("_bits") != 0)))
    rows = rows.withColumns({"_one": F.when(F.col("_event"), F.when(asked, F.col("title"))).otherwise(F.col("_text")), "_two": F.when(asked, F.col("names")), "_asked": asked})
    rows = streamed(rows.select(*columns, *[c for c in ("company",) if c not in columns], "_at", "_event", "_asked", "_one", "_two"), ["company"], [F.col("_at"), F.col("_event")])
    # words and tokens hold no white space
    words = F.array_join(F.array_distinct(F.split(F.lower("_one"), r"\s+")), "\n")
    tokens = F.array_join(F.array_union(title_tokens(F.col("_one")), title_tokens(F.col("_two"))), "\n")
    said = F.when(F.col("_asked"), tokens).when(~F.col("_event"), words)
    rows = rows.select(*columns, "_nth", "_event", F.unix_micros("_at").alias("_at"), said.alias("_said"))
    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField("stale", T.BooleanType())])
    out = rows.mapInArrow(_told_of(columns, days), schema)
    return out.withColumns({"status": F.when(F.col("stale"), "stale_synthetic").otherwise(F.col("status")), "horizon_days": F.when(F.col("stale"), STALE_HORIZON).otherwise(F.col("horizon_days"))})


def _told_of(columns: list[str], days: int):
    """For ``mapInArrow``: whether a filing of the last days holds a token of the event.

    Carried are a company's different words and tokens: per word its tokens and when it was told last, per token when one of its words was. Words and
    tokens meet by a token's first characters, once each; later filings and events cost a lookup per word or token.
    """
    span, gram = days * 86_400_000_000, 4

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told, last, by_gram, starting = {}, {}, {}, {}, {}

        def tell(words: list[str], at: int) -> None:
            for word in words:
                if word not in held:
                    grams = {word[i : i + gram] for i in range(max(len(word) - gram + 1, 1))}
                    held[word] = [t for g in grams for t in starting.get(g, ()) if t in word]
                    for g in grams:
                        by_gram.setdefault(g, []).append(word)
                told[word] = at
                for token in held[word]:
                    last[token] = at

        def since(tokens: list[str], at: int) -> bool:
            for token in tokens:
                if token not in last:
                    inside = [w for w in by_gram.get(token[:gram], ()) if token in w]
                    for word in inside:
                        held[word].append(token)
                    last[token] = max((told[w] for w in inside), default=None)
                    starting.setdefault(token[:gram], []).append(token)
            return any(last[t] is not None and last[t] >= at for t in tokens)

        for batch in batches:
            stale = []
            for nth, event, at, said in zip(*[batch.column(c).to_pylist() for c in ("_nth", "_event", "_at", "_said")], strict=True):
                if nth == 1:
                    for state in (held, told, last, by_gram, starting):
                        state.clear()
                if event:
                    stale.append(bool(said) and since(said.split("\n"), at - span))
                else:
                    tell(said.split("\n"), at)
            kept = batch.select(columns).filter(batch.column("_event"))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(stale, pa.bool_())], [*columns, "stale"])

    return judge
