import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventlens.llm.automaton import SuffixAutomaton
from eventlens.llm.queries import QUERIES
from eventlens.llm.repeats import remove_repeats, repeat_digests, repeated_ranges

from .data import AWKWARD, SF, documents


def brute(rows, k=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    n = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - k + 1) if n[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def corpus(seed, n=120):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [[pick.choice(vocabulary) for _ in range(pick.randint(30, 90))] for _ in range(6)]
    out = []
    for _ in range(n):
        words = [pick.choice(vocabulary) for _ in range(pick.randint(0, 60))]
        for p in pick.sample(passages, pick.randint(0, 2)):
            part = list(p)
            if pick.random() < 0.5:
                part[pick.randrange(len(part))] = "edit"
            words += part + [pick.choice(vocabulary)]
        out.append(" ".join(words))
    return [*out, "loop " * 200, "loop " * 36, "loop " * 35, "", None, *AWKWARD, *out[:5]]


@pytest.mark.parametrize(("shard_segments", "heavy"), [(1024, 10_000), (2, 3), (20, 0.5)])
def test_matches_brute_force(spark, shard_segments, heavy):
    docs = documents(spark, corpus(shard_segments)).repartition(5)
    assert rows_of(repeat_digests(docs, filter_bits=1 << 16, shard_segments=shard_segments, heavy=heavy)) == brute(docs.collect())


def test_crowded_filter_gives_the_same_rows(spark):
    docs = documents(spark, corpus(5, 40))
    assert rows_of(repeat_digests(docs, filter_bits=8)) == brute(docs.collect())


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert rows_of(QUERIES["op8_suffix_automata"](spark, SF)) == brute(docs)


def test_removal_keeps_columns_rows_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(50))
    docs = documents(spark, [f"head one {text} tail", f"{text} other", "clean text", None])
    docs = docs.withColumns({"row": F.lit("clash"), "ranges": F.lit(1), "doc_id": F.when(F.col("doc_id") > 0, F.col("doc_id"))})
    out = remove_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r.text or "", r.n_chars) for r in out.collect()) == [("", None), ("clean text", 10), ("head one tail", 13), ("other", 5)]
    assert remove_repeats(docs.limit(0)).count() == 0 and repeat_digests(docs.limit(0)).count() == 0
    twins = documents(spark, [text]).union(documents(spark, [text]))
    assert [r.n_removed for r in repeat_digests(twins).collect()] == [50, 50]


def test_many_equal_rows_with_null_ids(spark):
    text = " ".join(f"w{i % 211} x{i}" for i in range(40))
    many = documents(spark, [text]).selectExpr("cast(null as bigint) as doc_id", "text", "explode(sequence(1, 20000)) as i").drop("i")
    ranges = repeated_ranges(many).selectExpr("size(ranges) as n").collect()
    assert len(ranges) == 1 and ranges[0].n < 80  # places of one row, not of all copies
    found = repeat_digests(many).groupBy("n_words", "n_removed").count().collect()
    assert [tuple(r) for r in found] == [(80, 80, 20000)]


def test_one_very_long_text(spark):
    pick = random.Random(8)
    words = [f"v{pick.randint(0, 10**6)}" for _ in range(120_000)]
    docs = documents(spark, [" ".join(words + words[500:560]), " ".join(words[70_000:70_050])])
    assert rows_of(repeat_digests(docs)) == brute(docs.collect())


def test_automaton_statistics():
    pick = random.Random(2)
    sequences = [([pick.randint(0, 3) for _ in range(pick.randint(0, 30))], pick.randint(1, 3)) for _ in range(12)]
    own = SuffixAutomaton()
    for s, w in sequences:
        own.add(s, w)
    own.finish()

    def times(part):
        return sum(w for s, w in sequences for i in range(len(s) - len(part) + 1) if s[i : i + len(part)] == part)

    for probe in [s for s, _ in sequences] + [[pick.randint(0, 4) for _ in range(40)]]:
        for i, (matched, count) in enumerate(own.statistics(probe, 6)):
            best = max(m for m in range(min(6, i + 1) + 1) if m == 0 or times(probe[i + 1 - m : i + 1]))
            assert matched == best
            if best:
                assert count == times(probe[i + 1 - best : i + 1])
