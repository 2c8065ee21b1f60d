"""Packing of token pieces into fixed sequences, shortest pack first over the length histogram.

1. Documents become ids plus an end id and are cut into pieces of at most ``capacity`` tokens; the
   cuts follow from the lengths alone.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) is packed on the
   driver: lengths longest first, each into the open packing patterns with the most room, moving
   pattern counts instead of single pieces.
3. Pieces get a rank within their length and the patterns' slots cover rank ranges, so a join on
   length and rank gives every piece its sequence and offset.

The rank is taken in blocks: rows are numbered within (length, block) and the blocks' counts are summed
up, so that a length that holds a third of all pieces is spread over many tasks.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import cut
from eventlens.llm.textops import byte_slices, text_column
from eventlens.llm.tokens import encoder

CAPACITY = 1024
_BLOCK_ROWS = 20_000


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order, number of sequences) for a histogram {length: pieces}.

    Longest lengths first; pieces of a length go to the patterns with the most room left (the shortest
    packs), ties to the older pattern, and to new patterns when none has room. A pattern that
    would take more than one piece of the length takes as many as there are, evenly.
    """
    open_packs: dict[int, list[list]] = {}  # room -> patterns [lengths, count]
    rooms: list[int] = []  # heap of -room
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], count: int) -> None:
        room = capacity - sum(lengths)
        if room == 0:
            done.append((lengths, count))
        else:
            if not open_packs.get(room):
                heapq.heappush(rooms, -room)
            open_packs.setdefault(room, []).append([lengths, count])

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left = counts[length]
        moved: list[tuple[tuple[int, ...], int]] = []
        while left:
            while rooms and not open_packs.get(-rooms[0]):
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < length:
                moved.append(((length,), left))
                left = 0
                break
            room = -rooms[0]
            pattern = open_packs[room][0]
            take = min(left, pattern[1])
            pattern[1] -= take
            if not pattern[1]:
                open_packs[room].pop(0)
            left -= take
            put((*pattern[0], length), take)
        for lengths, count in moved:
            fit = capacity // length
            full, rest = divmod(count, fit)
            if full:
                put((length,) * fit, full)
            if rest:
                put((length,) * rest, 1)
    for patterns in open_packs.values():
        done.extend((tuple(p[0]), p[1]) for p in patterns if p[1])
    return sorted(done, key=lambda p: (tuple(-x for x in p[0]), p[1]))


def token_pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens (and ids, if asked for).

    A null text counts as empty: its only piece holds the end id.
    """
    fields = "start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint" + ",ids:binary" * with_ids

    @F.arrow_udf(f"array<struct<{fields}>>")
    def pieces(column: pa.Array) -> pa.Array:
        own = encoder(path, spaced=True)
        end = np.array([end_id], "<u4").tobytes()
        texts = text_column(column)
        bounds, start, length, crc, total, ids = [0], [], [], [], [], []
        for lo, hi in byte_slices(texts):
            for encoded in own.encode_array(texts.slice(lo, hi - lo)):
                encoded += end
                n = len(encoded) // 4
                for at in range(0, n, capacity):
                    part = encoded[4 * at : 4 * (at + capacity)]
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if with_ids:
                        ids.append(part)
                bounds.append(len(start))
        arrays = [pa.array(x, pa.int64()) for x in (start, length, crc, total)] + [pa.array(ids, pa.binary())] * with_ids
        rows = pa.StructArray.from_arrays(arrays, ["start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)

    return docs.select("doc_id", F.explode(pieces("text")).alias("p")).select("doc_id", "p.*")


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; lengths must be 1 to ``capacity``.

    Ties in (doc_id, start) fall back on the piece's other columns, so repeated rows each get a place of
    their own. An empty table gives an empty result. The input is read twice: cut() it first.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    slots, placed, sequence = [], dict.fromkeys(histogram, 0), 0
    for lengths, count in pack_histogram(histogram, capacity):
        offset = 0
        for x in lengths:
            slots.append((x, placed[x], placed[x] + count, sequence, offset))
            placed[x] += count
            offset += x
        sequence += count
    blocks = max(1, -(-total // _BLOCK_ROWS))
    keyed = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    before = (
        keyed.groupBy("length", "_block")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_block", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    order = [c for c in ("doc_id", "start", "ids_crc32", "doc_tokens") if c in pieces.columns]
    ranked = (
        keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_block").orderBy(*order)) - 1)
        .join(before, ["length", "_block"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    # slots: rank ranges of a few patterns per length, at most capacity lengths; bounded whatever the corpus
    plan = spark.createDataFrame(slots, "slot_length bigint, low bigint, high bigint, first_sequence bigint, offset bigint")
    fits = (F.col("length") == F.col("slot_length")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high"))
    return ranked.join(F.broadcast(plan), fits).select(
        *pieces.columns, (F.col("first_sequence") + F.col("_rank") - F.col("low")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` with its place: token_pieces, written once, then assign_sequences.

    A null text is empty and has only the end id; null ids take part, and repeated rows have pieces each. Columns other
    than doc_id and text are not read. A very long text has many pieces; an empty table gives no rows.
    """
    return assign_sequences(cut(token_pieces(docs, path, end_id, capacity, with_ids)), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences as id arrays with the pieces' (doc_id, offset, length); needs pieces with ids.

    A sequence is padded to ``capacity`` with the id 0 unless its length is a power of two; ``n_tokens``
    tells how many ids are real.
    """
    used = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("parts"), F.sum("length").alias("n_tokens")
    )

    @F.arrow_udf("array<bigint>")
    def joined(parts: pa.Array) -> pa.Array:
        out = []
        for one in parts.to_pylist():
            ids = np.frombuffer(b"".join(p["ids"] for p in one), "<u4").astype(np.int64)
            n = len(ids)
            out.append(ids if n & (n - 1) == 0 else np.concatenate([ids, np.zeros(capacity - n, np.int64)]))
        return pa.array(out, pa.list_(pa.int64()))

    documents = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["offset"].alias("offset"), p["length"].alias("length")))
    return used.select("sequence_id", "n_tokens", joined("parts").alias("ids"), documents.alias("documents"))
