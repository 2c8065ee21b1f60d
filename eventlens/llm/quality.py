"""Quality rules by compression bands.

A document's zstandard ratio (compressed / raw UTF-8 bytes) falls with its length, so one limit
cannot serve all lengths. ``BANDS`` gives the accepted ratio by document length; text below its band
repeats itself or is built from few parts, text above it hardly compresses (random or encoded
data). The same test runs over fixed-size chunks, where one chunk band holds for all chunks; a document
fails when too large a share of its chunks lies outside. The last chunk of a text ends with the text (and
overlaps the one before it), so every byte lies in a chunk; a text shorter than a chunk is judged by its length's band.

``chunk_low`` lies just below the lowest ratio of 2555 chunks of documents labelled clean (sf0.1, ``labels``
with quality 1): 0.467.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.textops import byte_slices, grams, mix64, text_column, words_of

#: Longest length in bytes of the band, lowest and highest accepted ratio.
BANDS: tuple[tuple[float, float, float], ...] = (
    (100, 0.55, 1.45),
    (200, 0.50, 1.20),
    (400, 0.52, 0.95),
    (800, 0.505, 0.82),
    (1600, 0.472, 0.72),
    (3200, 0.452, 0.65),
    (6400, 0.424, 0.60),
    (12800, 0.411, 0.57),
    (25600, 0.395, 0.55),
    (51200, 0.385, 0.55),
    (float("inf"), 0.375, 0.55),
)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the base rules and of the compression bands."""

    min_words: int = 10
    max_repeat_percent: int = 20
    repeat_window: int = 5
    level: int = 3
    chunk_bytes: int = 2048
    chunk_low: float = 0.465
    chunk_high: float = 0.75
    max_chunk_share: float = 0.20
    bands: tuple[tuple[float, float, float], ...] = BANDS
    symbols: str = "#*$%&|<>"


_TYPE = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "base_failed:boolean,ratio:double,n_chunks:bigint,bad_chunks:bigint,kept:boolean>"
)


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeat_words(words, k: int) -> np.ndarray:
    """Words per document that lie in a k-word window found twice or more in that document."""
    n_docs = len(words.offsets) - 1
    hashes, ok = grams(words, k)
    doc = np.repeat(np.arange(n_docs, dtype=np.uint64), np.diff(words.offsets))
    keys = hashes ^ mix64(doc + np.uint64(1))
    ordered = np.sort(keys[ok])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n_docs, np.int64)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    at = np.flatnonzero(ok & (twice[place] == keys))
    edge = np.zeros(len(keys) + k, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return _per_doc(np.cumsum(edge)[: len(keys)] > 0, words.offsets)


def _dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _chunk_starts(size: int, step: int) -> list[int]:
    """Where the chunks of a text begin: one after the other, the last one flush with the text's end."""
    starts = list(range(0, size - step + 1, step))
    if starts and size % step:
        starts.append(size - step)
    return starts


def _measure(texts: pa.Array, rules: QualityRules) -> pa.Array:
    words = words_of(texts)
    n_words = np.diff(words.offsets)
    symbol, blank = np.zeros(256, bool), np.zeros(256, bool)
    symbol[[ord(x) for x in rules.symbols]] = True
    blank[[9, 10, 11, 12, 13, 32]] = True
    n_symbols = _per_doc(symbol[words.data], words.doc_start)
    word_chars = _per_doc(((words.data & 0xC0) != 0x80) & ~blank[words.data], words.doc_start)
    repeat = _repeat_words(words, rules.repeat_window)
    failed = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)
    press = zstandard.ZstdCompressor(level=rules.level)
    uppers = [b[0] for b in rules.bands]
    dup, ratio, chunks, bad, kept = [], [], [], [], []
    for i, text in enumerate(texts.to_pylist()):
        raw = text.encode()
        dup.append(_dup_lines(text))
        size, step = len(raw), rules.chunk_bytes
        r = len(press.compress(raw)) / size if size else 0.0
        starts = _chunk_starts(size, step)
        wrong = 0
        for at in starts:
            c = len(press.compress(raw[at : at + step])) / step
            wrong += not rules.chunk_low <= c <= rules.chunk_high
        _, low, high = rules.bands[bisect_left(uppers, size)]
        ratio.append(r)
        chunks.append(len(starts))
        bad.append(wrong)
        kept.append(not failed[i] and low <= r <= high and wrong <= rules.max_chunk_share * len(starts))
    names = [x.split(":")[0] for x in _TYPE[7:-1].split(",")]
    columns = [n_words, word_chars, n_symbols, np.array(dup, np.int64), repeat, failed, ratio, chunks, bad, kept]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def quality_struct(text: Column, rules: QualityRules = QualityRules()) -> Column:
    """Struct column with the base counts, the ratios and the verdict of one text."""

    @F.arrow_udf(_TYPE)
    def measure(column: pa.Array) -> pa.Array:
        texts = text_column(column)
        parts = [_measure(texts.slice(lo, hi - lo), rules) for lo, hi in byte_slices(texts)]
        return pa.concat_arrays(parts) if parts else _measure(texts, rules)

    return measure(text)


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: doc_id, base counts, compression figures and ``kept``.

    Null and empty texts have no words, so they fail the base rules. Each row is judged alone: tied or
    repeated rows get the same verdict, other columns of ``docs`` are neither read nor returned, and
    an empty table gives no rows. Text length is only bounded by one task's memory for one text.
    """
    return docs.select("doc_id", quality_struct(F.col("text"), rules).alias("q")).select("doc_id", "q.*")


def filter_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their own columns, whatever those are named."""
    columns = docs.columns
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), quality_struct(F.col("text"), rules).alias("judged"))
    return judged.where("judged.kept").select("row.*")
