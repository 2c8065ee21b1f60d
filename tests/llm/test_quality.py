import re
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from eventlens.llm.quality import QualityRules, filter_quality, quality_report
from eventlens.llm.queries import QUERIES

from .data import AWKWARD, SF, documents


def brute(text, rules=QualityRules()):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    repeat = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
    raw = text.encode()
    press = zstandard.ZstdCompressor(level=3)
    ratio = len(press.compress(raw)) / len(raw) if raw else 0.0
    parts = [raw[i : i + 2048] for i in range(0, len(raw) - 2047, 2048)]
    parts += [raw[-2048:]] if parts and len(raw) % 2048 else []
    chunks = [len(press.compress(x)) / 2048 for x in parts]
    bad = sum(not rules.chunk_low <= c <= rules.chunk_high for c in chunks)
    low, high = next((lo, hi) for top, lo, hi in rules.bands if len(raw) <= top)
    kept = not failed and low <= ratio <= high and bad <= 0.2 * len(chunks)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), failed, kept)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_matches_brute_force(spark):
    docs = documents(spark, AWKWARD + ["word " * 500, "long " + "q w e r t " * 30000])
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in quality_report(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_query_matches_brute_force(spark):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op1_compression_bands"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == {r.doc_id: brute(r.text) for r in docs}


def test_filter_keeps_columns_ties_and_empty_tables(spark):
    text = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 900").first().text
    docs = documents(spark, [text, None]).withColumns({"n_words": F.lit("clash"), "kept": F.lit(7), "q": F.lit(None)})
    out = filter_quality(docs.union(docs))
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].n_words == "clash" and rows[0].kept == 7
    assert filter_quality(docs.limit(0)).count() == 0 and quality_report(docs.limit(0)).count() == 0


def test_long_documents_with_a_repetitive_half_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    rows = quality_report(docs).join(docs, "doc_id").orderBy("doc_id").collect()
    junk = [r.text for r in rows if not r.base_failed and not r.kept and len(r.text) > 6000]
    clean = [r.text for r in rows if r.kept and len(r.text) > 6000]
    mixed = [f"{c[: len(j)]}\n{j}" for j, c in zip(junk, clean, strict=False)]
    assert mixed and filter_quality(documents(spark, mixed)).count() == 0
    assert filter_quality(documents(spark, clean)).count() == len(clean)


def test_every_byte_of_a_long_text_lies_in_a_chunk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and n_chars > 9000").orderBy("doc_id")
    clean = [r.text for r in docs.collect() if brute(r.text)[-1]][0]
    junk = " ".join(f"{i} aa bb cc dd ee" for i in range(1000, 1100))
    cut = clean.encode()[:4096].decode(errors="ignore")
    rows = quality_report(documents(spark, [cut, f"{cut} {junk[:1900]}"])).orderBy("doc_id").collect()
    assert [(r.n_chunks, r.bad_chunks) for r in rows][1] == (3, 1) and rows[0].kept and not rows[1].kept
