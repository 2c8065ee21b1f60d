"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlens.llm.chat import ORACLE as CHAT_SQL
from eventlens.llm.chat import chat_report
from eventlens.llm.common import ship, table
from eventlens.llm.language import predict_languages
from eventlens.llm.lexical import ORACLE as LEXICAL_SQL
from eventlens.llm.lexical import ranked_search
from eventlens.llm.licences import scan_licences
from eventlens.llm.neardup import near_duplicate_classes
from eventlens.llm.packing import pack_documents
from eventlens.llm.pieces import piece_digests
from eventlens.llm.quality import quality_report
from eventlens.llm.repair import repair_report
from eventlens.llm.repeats import ORACLE as REPEATS_SQL
from eventlens.llm.repeats import repeat_digests
from eventlens.llm.tokens import tokenizer_file
from eventlens.llm.topk import ORACLE, exact_top_k
from eventlens.llm.urls import filter_urls
from eventlens.llm.urls import oracle as urls_sql
from eventlens.llm.wavelet import stored_digests


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op2_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_merge_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), folded=True)


def op5_character_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op6_paragraph_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op8_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


def op9_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op10_impact_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op11_stack_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


def op12_offset_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_report(table(spark, sf_dir, "conversations"), tokenizer_file("byte_bpe_50k.json"))


def op13_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_compression_bands, op2_shortest_pack_first, op3_merge_agenda, op4_wavelet_shards, op5_character_ratio, op6_paragraph_classifier, op7_weighted_minhash, op8_suffix_automata, op9_byte_network, op10_impact_ordered, op11_stack_repair, op12_offset_masks, op13_term_pipeline)}
SQL: dict[str, str] = {"op5_character_ratio": urls_sql(), "op8_suffix_automata": REPEATS_SQL, "op10_impact_ordered": ORACLE, "op12_offset_masks": CHAT_SQL, "op13_term_pipeline": LEXICAL_SQL}
