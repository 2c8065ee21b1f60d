"""Many markers in one pass: which lists of substrings a text holds.

Rules by substring (event families, outcomes, landscapes, curation) name hundreds of markers in dozens of lists. One automaton over all
of them reads each distinct text of a batch once and gives a bit per list; the rules are then tests of bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lists that one column of bits can tell apart.
MOST = 63


@lru_cache(maxsize=64)
def _matcher(lists: tuple[tuple[str, ...], ...], application: str):
    """The function that finds the lists; one object per set of lists, so that a plan works a column out once."""
    bits: dict[str, int] = {}
    for i, markers in enumerate(lists):
        for m in markers:
            bits[m] = bits.get(m, 0) | 1 << i
    held: list = []

    def find(texts: pa.Array) -> pa.Array:
        if not held:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for marker, value in bits.items():
                automaton.add_word(marker, value)
            automaton.make_automaton()
            held.append(automaton)
        coded = pc.dictionary_encode(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
        found = []
        for text in coded.dictionary.to_pylist():
            value = 0
            for _, hit in held[0].iter(text):
                value |= hit
            found.append(value)
        return pa.array(found, pa.int64()).take(coded.indices)

    return F.arrow_udf(find, "bigint")


def marker_bits(text: Column, lists: Iterable[Sequence[str]]) -> Column:
    """Bit i is set where a marker of the i-th list occurs in the text; null for null. Matching is exact: lower-case both sides for any case."""
    lists = tuple(tuple(m) for m in lists)
    if len(lists) > MOST or not all(all(m) and m for m in lists):
        raise ValueError("up to 63 lists of markers that are not empty")
    return _matcher(lists, SparkContext._active_spark_context.applicationId)(text)


def has_bit(bits: Column, i: int) -> Column:
    return bits.bitwiseAND(F.lit(1 << i)) != 0


def first_of(bits: Column, values: Sequence, start: int = 0) -> Column:
    """The value of the first list found, else null; ``start`` is the bit of the first value."""
    return reduce(lambda chain, i: chain.when(has_bit(bits, start + i), values[i]), range(1, len(values)), F.when(has_bit(bits, start), values[0]))


def all_of(bits: Column, values: Sequence, start: int = 0) -> Column:
    """Array of the values of all lists found, in order."""
    return F.array_compact(F.array(*[F.when(has_bit(bits, start + i), F.lit(v)) for i, v in enumerate(values)]))


@lru_cache(maxsize=16)
def _finder(markers: tuple[str, ...], application: str):
    held: list = []

    def find(texts: pa.Array) -> pa.Array:
        if not held:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, marker in enumerate(markers):
                automaton.add_word(marker, i)
            if markers:
                automaton.make_automaton()
            held.append(automaton)
        coded = pc.dictionary_encode(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
        found = [sorted({i for _, i in held[0].iter(text)}) if markers else [] for text in coded.dictionary.to_pylist()]
        return pa.array(found, pa.list_(pa.int32())).take(coded.indices)

    return F.arrow_udf(find, "array<int>")


def first_rules(rows: DataFrame, by: str, text: str, rules: DataFrame, most: int = 100_000) -> DataFrame:
    """``rows`` with ``rule``: of the rules of their key, the first (by rule_no) with a marker in the text, else null.

    ``rules`` has the key ``by``, rule_no, markers (array of strings) and any further columns; rule_no is unique per key. Rule
    tables are small: more than ``most`` markers are an error. All markers are looked for in one pass over the lower-cased text; the rules of
    a key come along as an array, so no row meets another. Empty markers, and rules with a null key, match nothing.
    """
    pairs = rules.select(F.explode("markers").alias("m")).select(F.lower("m").alias("m")).where("m <> ''").distinct().limit(most + 1).collect()
    if len(pairs) > most:
        raise ValueError("too many markers for a rule table")
    markers = tuple(sorted(r.m for r in pairs))
    number = rules.sparkSession.createDataFrame(list(enumerate(markers)), "_i int, _m string")
    payload = F.struct("rule_no", *[F.col(c) for c in rules.columns if c not in (by, "rule_no", "markers")])
    each = rules.where(F.col(by).isNotNull()).select(by, payload.alias("rule"), F.explode("markers").alias("_m")).withColumn("_m", F.lower("_m")).join(F.broadcast(number), "_m")
    each = each.groupBy(by, "rule").agg(F.collect_set("_i").alias("found"))
    table = each.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rule", "found"))).alias("_rules"))
    hits = _finder(markers, SparkContext._active_spark_context.applicationId)(F.lower(F.coalesce(text, F.lit(""))))
    both = rows.withColumn("_hits", hits).join(F.broadcast(table), by, "left")
    return both.withColumn("rule", F.get(F.filter("_rules", lambda r: F.arrays_overlap(r["found"], "_hits")), F.lit(0))["rule"]).drop("_hits", "_rules")
