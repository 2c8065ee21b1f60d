"""Corpus pipeline over ``documents``: quality, language, near-dedup, substring dedup, packing.

Each stage reads what its predecessor wrote and, but for the last, returns the columns of ``documents``, and any further
ones, whatever their names. In all stages an empty table stays empty, a text is worked on whole whatever its length,
and rows with a null doc_id, or that share one, are rows like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventlens.llm.common import shared_dir, ship, table
from eventlens.llm.language import filter_language
from eventlens.llm.neardup import drop_near_duplicates
from eventlens.llm.packing import pack_documents
from eventlens.llm.quality import filter_quality
from eventlens.llm.repeats import remove_repeats
from eventlens.llm.tokens import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their compression bands. Null and empty texts fail; repeated rows stay or go together."""
    ship(spark)
    return filter_quality(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language. Texts without letters go; null languages are not learned from, repeated rows stay or go together."""
    ship(spark)
    return filter_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of the smallest doc_id (ties: by hash of the row). Texts without words all stay, rows equal in doc_id and text count once."""
    ship(spark)
    return drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur elsewhere too; repeated rows lose all their long passages."""
    ship(spark)
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts with their sequences and offsets; an empty or null text has one piece, its end id."""
    ship(spark)
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("packing", packing),
]

#: Compression ratios, the trained network and the sampling have no SQL; tests compare with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each is written to the shared folder and read again. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
