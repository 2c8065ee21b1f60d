from collections import Counter

import pytest
from pyspark.sql import functions as F

from .data import AWKWARD, SF, documents

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_neardup import brute as near_classes  # noqa: E402
from .test_quality import brute as quality_of  # noqa: E402
from .test_repeats import brute as repeats_of  # noqa: E402
from .test_token_operators import check_packing  # noqa: E402


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in docs.collect() if quality_of(r.text)[-1]}
    first = stages["quality"](spark, docs, SF).cache()
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == kept
    second = stages["language"](spark, first, SF).cache()
    assert second.columns == docs.columns and len(kept) - second.count() <= 2
    rows = second.collect()
    third = stages["near_duplicates"](spark, second, SF).cache()
    assert {r.doc_id for r in third.collect()} == {k for k, v in near_classes(rows).items() if k == v}
    fourth = stages["substrings"](spark, third, SF).cache()
    assert fourth.columns == docs.columns
    gone = Counter({i: n for i, _, n, _ in repeats_of(third.collect())})
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (third, fourth))
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert after[i] == text if not gone[i] else len(after[i].split()) == len(text.split()) - gone[i]
    check_packing(stages["packing"](spark, fourth, SF).collect(), fourth.collect())


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "substrings", "packing"]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, null and shared ids, and columns that clash with the operators' own."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint"))
    long = " ".join(r.text for r in rows.collect())
    more = documents(spark, [*AWKWARD, long * 3, long + " end"], 1000)
    odd = documents(spark, [long[:3000], long[1000:4000]]).select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    docs = rows.unionByName(rows.limit(5)).unionByName(more).unionByName(odd).unionByName(odd)
    return docs.withColumns({"row": F.lit("clash"), "kept": F.lit(7), "node": F.lit(None).cast("int"), "length": F.lit(1.5), "ranges": F.array(F.lit(1))})


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == docs.columns and 0 < len(rows) <= docs.count() and all(r.row == "clash" and r.kept == 7 for r in rows), name
        if name == "substrings":
            assert len(rows) == docs.count()
        if name == "near_duplicates":
            assert len({(r.doc_id, r.text) for r in rows}) == len(rows)
    rows = docs.collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len({(p.sequence_id, p.offset) for p in packed}) == len(packed)
    first = [p for p in packed if p.start == 0]
    assert len(first) == len(rows) and sum(p.doc_id is None for p in first) == sum(r.doc_id is None for r in rows)


def test_stages_and_run_on_empty_tables(spark, tmp_path):
    docs = awkward(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
