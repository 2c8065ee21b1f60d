"""Substring dedup: words covered by a long window that occurs anywhere else are removed.

The reference is the corpus itself, so its automata cannot be broadcast: that would stream every document
past every shard, work that grows with the square of the corpus. Instead the shards are cut so that
a window can only match inside one shard, and shard and documents' passages meet by a shuffle:

1. Every window of ``min_words`` words selects one anchor, the smallest hash among its ``gram``-word
   grams (rightmost of equals). Equal windows select equal anchors. Anchors are counted over all
   documents; those seen once cannot hold a repeated window.
2. A fixed-size bit filter of the repeated anchors (``filter_bits``, whatever the corpus) goes to all tasks;
   a false hit costs work, never a result. The maximal stretch of windows with one anchor is a
   segment. Equal segments are counted together, so copies do not multiply.
3. The distinct segments of an anchor form a reference shard: a suffix automaton with occurrence counts.
   Its segments stream through it for matching statistics; windows that match at full length with
   a count of two or more are repeated. An anchor with more than ``shard_segments`` segments is split: its windows,
   each summed up over its segments first, are dealt to parts by their hash, and each part is a shard of its own.
4. Repeated stretches return to their documents, whose other words are kept. Segments that hold more than one
   in ``heavy`` of all places return by a broadcast (so there are at most that many), the others by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.automaton import SuffixAutomaton
from eventlens.llm.common import cut
from eventlens.llm.textops import byte_slices, grams, mix64, power_tables, text_column, words_of

MIN_WORDS = 35
GRAM = 8
FILTER_BITS = 1 << 27
SHARD_SEGMENTS = 1024
_BLOCK = 1 << 15
HEAVY = 10_000
_SALTS = 16


def _anchors(texts: pa.Array, min_words: int, gram: int):
    """Words, and per stretch of windows with one anchor: document, first window, end, anchor hash."""
    words = words_of(texts)
    hashes, _ = grams(words, gram)
    wide = min_words - gram + 1
    n = len(hashes)
    ends = np.repeat(words.offsets[1:], np.diff(words.offsets))
    starts = np.flatnonzero(np.arange(n) + min_words <= ends)
    value, place, span = hashes, np.arange(n), 1
    parts, at, rest = [], 0, wide
    while rest:
        if rest & 1:
            parts.append((value, place, at))
            at += span
        rest >>= 1
        if rest:
            other, where = value[span:], place[span:]
            take = other <= value[: len(other)]
            value, place = np.where(take, other, value[: len(other)]), np.where(take, where, place[: len(where)])
            span *= 2
    best = where = None
    for v, p, shift in parts:
        v, p = v[starts + shift], p[starts + shift]
        if best is None:
            best, where = v, p
        else:
            take = v <= best
            best, where = np.where(take, v, best), np.where(take, p, where)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return words, none, none, none, np.zeros(0, np.uint64)
    new = np.ones(len(starts), bool)
    new[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    doc = np.searchsorted(words.offsets, starts[first], side="right") - 1
    return words, doc, starts[first], starts[last] + 1, best[first]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def _anchor_counts(min_words: int, gram: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch.column("text"))
            for lo, hi in byte_slices(texts):
                anchors, n = np.unique(_anchors(texts.slice(lo, hi - lo), min_words, gram)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(anchors), pa.array(n, pa.int64())], ["anchor", "n"])

    return count


def repeated_anchors(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """Anchors of two or more segments of all documents: anchor, n (its segments)."""
    counts = docs.select("text").mapInArrow(_anchor_counts(min_words, gram), "anchor bigint, n bigint")
    return counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


def anchor_filter(anchors: DataFrame, filter_bits: int) -> np.ndarray:
    """Bits of the anchors, as a byte array of filter_bits / 8 bytes."""
    bit = F.pmod(F.col("anchor"), F.lit(filter_bits))

    @F.arrow_udf("binary")
    def pack(column: pa.Array) -> pa.Array:
        out = []
        for positions in column.to_pylist():
            bits = np.zeros(_BLOCK, bool)
            bits[positions] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.array(out, pa.binary())

    blocks = (
        anchors.select(F.floor(bit / _BLOCK).alias("block"), (bit % _BLOCK).cast("int").alias("bit"))
        .groupBy("block")
        .agg(F.collect_set("bit").alias("bits"))
        .select("block", pack("bits").alias("bits"))
    )
    out = np.zeros(-(-filter_bits // _BLOCK) * (_BLOCK // 8), np.uint8)
    for row in blocks.collect():  # at most filter_bits / _BLOCK rows of _BLOCK / 8 bytes
        out[row.block * (_BLOCK // 8) : (row.block + 1) * (_BLOCK // 8)] = np.frombuffer(row.bits, np.uint8)
    return out


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _segments(docs: DataFrame, bits, filter_bits: int, min_words: int, gram: int) -> DataFrame:
    """Segments whose anchor may be repeated: row, first window, anchor, segment hash, word hashes (32 bits each)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            texts = text_column(batch.column("text"))
            rows = batch.column("row")
            for lo, hi in byte_slices(texts):
                words, doc, first, end, anchor = _anchors(texts.slice(lo, hi - lo), min_words, gram)
                at = (anchor.view(np.int64) % filter_bits).astype(np.int64)
                hit = (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                doc, first, end, anchor = doc[hit], first[hit], end[hit], anchor[hit]
                if not len(doc):
                    continue
                stop = end + min_words - 1
                short = (words.hashes >> np.uint64(32)).astype("<u4").tobytes()
                content = [short[4 * a : 4 * b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
                power = np.zeros(len(words.hashes) + 1, np.uint64)
                np.cumsum(mix64(words.hashes) * _up(len(words.hashes)), out=power[1:])
                digest = mix64((power[stop] - power[first]) * _down(len(words.hashes))[first] + (stop - first).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.slice(lo, hi - lo).take(pa.array(doc)),
                        pa.array((first - words.offsets[doc]).astype(np.int32), pa.int32()),
                        _signed(anchor),
                        _signed(digest),
                        pa.array(content, pa.binary()),
                    ],
                    ["row", "first", "anchor", "segment", "words"],
                )

    source = docs.select(_row_key().alias("row"), "text")
    return source.mapInArrow(find, "row bigint, first int, anchor bigint, segment bigint, words binary")


_SEGMENT_BASE = np.uint64(0xA24BAED4963EE407)


def _up(n: int) -> np.ndarray:
    return power_tables(_SEGMENT_BASE, n + 1)[0][:n]


def _down(n: int) -> np.ndarray:
    return power_tables(_SEGMENT_BASE, n + 1)[1][:n]


def _ranges(flags: list[bool]) -> list[dict[str, int]]:
    out, n = [], len(flags)
    at = 0
    while at < n:
        if flags[at]:
            to = at
            while to < n and flags[to]:
                to += 1
            out.append({"low": at, "high": to})
            at = to
        else:
            at += 1
    return out


def shard_repeats(segments: list[tuple[bytes, int]], min_words: int) -> list[list[bool]]:
    """Per distinct segment (32-bit words as bytes, times it occurs): which of its windows occur twice or more."""
    sequences = [np.frombuffer(w, "<u4").tolist() for w, _ in segments]
    automaton = SuffixAutomaton()
    for sequence, (_, times) in zip(sequences, segments, strict=True):
        automaton.add(sequence, times)
    automaton.finish()
    out = []
    for sequence in sequences:
        found = list(automaton.statistics(sequence, min_words))
        out.append([matched >= min_words and count > 1 for matched, count in found[min_words - 1 :]])
    return out


_FOUND = "anchor bigint, part int, segment bigint, times bigint, low int, high int"


def _shards(min_words: int):
    """Over rows sorted by (anchor, part): the repeated ranges of each segment of such a shard."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[tuple[int, int, bytes]] = []
        key = None

        def close() -> None:
            if len(held) == 1:  # one segment never holds a window twice: the anchor would move to the later one
                segment, times, content = held[0]
                if times > 1:
                    rows.append((*key, segment, times, 0, len(content) // 4 - min_words + 1))
            elif held:
                for (segment, times, _), flags in zip(held, shard_repeats([(c, t) for _, t, c in held], min_words), strict=True):
                    rows.extend((*key, segment, times, r["low"], r["high"]) for r in _ranges(flags))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])

        for batch in batches:
            for a, p, s, t, c in zip(*[batch.column(x).to_pylist() for x in ("anchor", "part", "segment", "times", "words")], strict=True):
                if (a, p) != key:
                    close()
                    key, held = (a, p), []
                held.append((s, t, c))
                if len(rows) > 20_000:
                    yield batch_of()
                    rows = []
        close()
        yield batch_of()

    return judge


_DEALT = "anchor bigint, part int, segment bigint, low int, window bigint, words binary, times bigint"


def _dealt(min_words: int):
    """Distinct segments as they are (part -1), those of anchors with ``parts`` as windows dealt to parts by their hash."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = [batch.column(x).slice(lo, 512).to_pylist() for x in ("anchor", "segment", "words", "times", "parts")]
                out: list[list] = [[] for _ in kinds]
                for anchor, segment, content, times, parts in zip(*rows, strict=True):
                    if parts is None:
                        values = [anchor], [-1], [segment], [0], [segment], [content], [times]
                    else:
                        x = np.frombuffer(content, "<u4").astype(np.uint64)
                        n = len(x) - min_words + 1
                        total = np.zeros(n, np.uint64)
                        for i in range(min_words):
                            total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + x[i : i + n] + np.uint64(1))
                        own = [content[4 * i : 4 * (i + min_words)] for i in range(n)]
                        values = [anchor] * n, (total % np.uint64(parts)).tolist(), [segment] * n, range(n), total.view(np.int64).tolist(), own, [times] * n
                    for column, value in zip(out, values, strict=True):
                        column.extend(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in _DEALT.split(", ")])

    return deal


def _repeated_segments(segments: DataFrame, anchors: DataFrame, min_words: int, gram: int, shard_segments: int) -> DataFrame:
    """Per distinct segment with repeated windows: anchor, segment, times and ranges of them."""
    distinct = segments.groupBy("anchor", "segment", "words").agg(F.count("*").alias("times"))
    parts = F.ceil(F.col("n") * (min_words - gram + 1) / shard_segments).cast("int")
    large = anchors.where(F.col("n") > shard_segments).select("anchor", parts.alias("parts"))
    columns = ["anchor", "segment", "words", "times", "parts"]
    dealt = cut(distinct.join(large, "anchor", "left").select(*columns).mapInArrow(_dealt(min_words), _DEALT))
    windows = dealt.where("part >= 0")
    summed = windows.groupBy("anchor", "part", F.col("window").alias("segment"), "words").agg(F.sum("times").alias("times"))
    shards = dealt.where("part = -1").select("anchor", "part", "segment", "words", "times").unionByName(summed)
    judged = cut(shards.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_shards(min_words), _FOUND))
    whole = judged.where("part = -1").select("anchor", "segment", "times", "low", "high")
    often = judged.where("part >= 0").select("anchor", F.col("segment").alias("window"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = windows.select("anchor", "segment", "times", "low", "window", F.pmod(F.xxhash64("segment"), F.lit(_SALTS)).cast("int").alias("salt"))
    split = salted.join(often, ["anchor", "window", "salt"]).select("anchor", "segment", "times", "low", (F.col("low") + 1).alias("high"))
    return whole.unionByName(split).groupBy("anchor", "segment", "times").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def repeated_ranges(
    docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, filter_bits: int = FILTER_BITS, shard_segments: int = SHARD_SEGMENTS, heavy: int = HEAVY
) -> DataFrame:
    """Per row key (xxhash64 of doc_id and text) with repeats: ranges [low, high) of repeated windows' first words."""
    anchors = cut(repeated_anchors(docs, min_words, gram))
    bits = docs.sparkSession.sparkContext.broadcast(anchor_filter(anchors, filter_bits))
    segments = _segments(docs, bits, filter_bits, min_words, gram)
    found = cut(_repeated_segments(segments, anchors, min_words, gram, shard_segments))
    total = anchors.agg(F.sum("n").alias("n")).first().n or 0
    often = F.col("times") > total / heavy
    places = segments.select("row", "first", "anchor", "segment")
    # segments of many places are at most ``heavy``, as all places together are at most ``total``
    places = places.join(F.broadcast(found.where(often).select("anchor", "segment", F.col("ranges").alias("common"))), ["anchor", "segment"], "left")
    places = places.withColumn("salt", F.when(F.col("common").isNull(), 0).otherwise(F.xxhash64("row", "first")))
    places = places.join(found.where(~often).select("anchor", "segment", "ranges", F.lit(0).cast("bigint").alias("salt")), ["anchor", "segment", "salt"], "left")
    places = places.select("row", "first", F.coalesce("common", "ranges").alias("ranges")).where("ranges is not null")
    shifted = F.transform("ranges", lambda r: F.struct((r["low"] + F.col("first")).alias("low"), (r["high"] + F.col("first")).alias("high")))
    # a set: rows equal in doc_id and text give the same ranges, which count once
    return places.select("row", shifted.alias("ranges")).groupBy("row").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))


def _kept_words(text: str, ranges: list[dict[str, int]] | None, min_words: int) -> tuple[list[bytes], int]:
    """Words of a text that no range covers, and how many words it has."""
    words = text.encode().split()
    if not ranges:
        return words, len(words)
    out, at = [], 0
    for low, high in sorted((r["low"], r["high"]) for r in ranges):
        out.extend(words[at:low])
        at = max(at, high + min_words - 1)
    out.extend(words[at:])
    return out, len(words)


def _with_ranges(docs: DataFrame, min_words: int, **limits) -> DataFrame:
    """``docs`` as a struct ``doc`` with the ranges of its repeated windows (null: none)."""
    keyed = docs.select(_row_key().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return keyed.join(repeated_ranges(docs, min_words, **limits), "row", "left")


def repeat_digests(docs: DataFrame, min_words: int = MIN_WORDS, **limits) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space).

    Null and empty texts have no words. Repeated rows repeat each other's windows like any other documents,
    also rows with equal or null doc_id. Columns other than doc_id and text are not read. An empty table gives no
    rows. Texts are worked on whole; one text's length is bounded only by one task's memory for it.
    """

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept_sha256:string>")
    def digest(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        total, gone, sha = [], [], []
        for text, own in zip(text_column(texts).to_pylist(), ranges.to_pylist(), strict=True):
            kept, n = _kept_words(text, own, min_words)
            total.append(n)
            gone.append(n - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["n_words", "n_removed", "kept_sha256"])

    rows = _with_ranges(docs.select("doc_id", "text"), min_words, **limits)
    return rows.select("doc.doc_id", digest("doc.text", "ranges").alias("d")).select("doc_id", "d.*")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, **limits) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text`` and ``n_chars`` set anew; all rows stay.

    A text with removals becomes its kept words joined by one space; any other text, null ones too, stays as it is.
    Repeated rows lose their windows alike, an empty table stays empty, and other columns come through whatever their names.
    """

    @F.arrow_udf("string")
    def kept(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
            out.append(text if text is None or not own else b" ".join(_kept_words(text, own, min_words)[0]).decode())
        return pa.array(out, pa.string())

    rows = _with_ranges(docs, min_words, **limits).withColumn("kept", kept("doc.text", "ranges"))
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("ranges").isNull(), F.col("doc.n_chars")).otherwise(F.length("kept").cast("bigint"))} if "n_chars" in docs.columns else {"text": F.col("kept")}
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


#: The same digests as SQL over ``documents``, for tables with unique ids.
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + {MIN_WORDS - 1} <= len(w) THEN md5(array_to_string(w[i:i + {MIN_WORDS - 1}], ' ')) END AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n AS (SELECT k FROM p WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
m AS (SELECT p.*, n.k IS NOT NULL AS hit FROM p LEFT JOIN n ON p.k = n.k),
c AS (SELECT doc_id, i, word, coalesce(max(CASE WHEN hit THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) > i - {MIN_WORDS}, false) AS gone FROM m),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)
"""
