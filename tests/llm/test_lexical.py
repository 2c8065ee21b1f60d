"""Ranked search against SQL over all documents, for many sizes of blocks, bundles and passes."""

import duckdb
import pyarrow as pa
import pytest

from eventlens.llm.lexical import ORACLE, Terms, Vocabulary, ranked_search

from .data import AWKWARD, SF, documents

ITEMS = "item_id bigint, text string"


def same(spark, docs, items, **limits):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    for name, df in (("documents", docs), ("benchmark", items)):
        rows = [tuple(r) for r in df.select("doc_id" if name == "documents" else "item_id", "text").collect()]
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    found = con.execute(ORACLE)
    columns = [d[0] for d in found.description]
    df = ranked_search(docs, items, **limits)
    assert sorted(df.columns) == sorted(columns)
    rows = sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))
    assert rows == sorted(map(str, found.fetchall()))
    return rows


def test_terms_and_vocabulary():
    texts = ["Ab-Cd éÀ1_x", "", "🙂 ÅB ab", "x" * 1000]
    column = pa.array(texts, pa.large_string())
    known = Vocabulary(["ab", "cd", "xy", "ÅB".replace("B", "b"), "éÀ1"])
    there = Terms.of(column, known.base)
    words = [bytes(there.data[a:b]).decode() for a, b in zip(there.start, there.end, strict=True)]
    assert words == ["ab", "cd", "éÀ1", "x", "🙂", "Åb", "ab", "x" * 1000]
    assert known.find(there).tolist() == [0, 1, 4, -1, -1, 3, 0, -1]
    there.hashes[:] = known.hashes[0]  # every hash hits: bytes decide
    assert all(i < 0 or known.terms[i] == w for i, w in zip(known.find(there).tolist(), words, strict=True))


@pytest.mark.parametrize("limits", [{}, {"block_docs": 7, "bundle": 3, "owners": 5}, {"owners": 1, "pass_terms": 40}])
def test_small_blocks_bundles_and_passes(spark, limits):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(8)
    assert same(spark, docs, items, **limits)


def test_awkward_rows(spark):
    docs = documents(spark, [*AWKWARD, *AWKWARD, "one " * 30_000 + "two", *["same copy of one text"] * 60])
    docs = docs.unionByName(docs.limit(6).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.selectExpr("*", "1 as rank", "'x' as terms", "2 as block", "3 as item")
    items = spark.createDataFrame([(1, "One two one"), (1, "one, TWO"), (1, "One two one"), (2, None), (3, ""), (4, "?!"), (5, "nowhere"), (6, "same text éàü 字符"), (None, "a b c"), (7, "中文字符 🙂🙂")], ITEMS)
    assert same(spark, docs, items.selectExpr("*", "5 as score", "'y' as item_sha256"), block_docs=16)


def test_empty_tables(spark):
    docs, items = documents(spark, []), spark.createDataFrame([], ITEMS)
    assert same(spark, docs, items) == []
    assert same(spark, documents(spark, ["a b"]), items) == []
    assert same(spark, docs, spark.createDataFrame([(1, "a")], ITEMS)) == []
    assert same(spark, documents(spark, [None, ""]), spark.createDataFrame([(1, "a")], ITEMS)) == []
