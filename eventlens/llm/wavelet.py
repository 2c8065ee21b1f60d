"""Token-id shards as wavelet matrices: one compressed file per shard, readable without unpacking ids.

A shard's ids are stored as bit planes from the highest bit down; each plane keeps the ids stably sorted
by the bits above it. With rank and select on the planes, a token can be read, counted in a range or
located by its n-th occurrence. A shard's payload holds, each in a zstandard frame of its own, the documents' ids and
lengths, the rank directory (ones before every 512 bits, 32 bits each), and the planes in pages of 64 kbit; a
table of the pages' sizes stands in front. Reading inflates the pages that a query touches and no others.

``write_token_shards`` sorts documents by doc_id, so shards follow each other in that order, each in a file of its
own; ``read_token_shards`` returns every document's digest from the files alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm.common import shared_dir
from eventlens.llm.textops import byte_slices, text_column
from eventlens.llm.tokens import encoder

MAGIC = b"WVM2"
SHARD_TOKENS = 1 << 19
_HEAD = struct.Struct("<4sBQQII")  # magic, bits, tokens, documents, bytes of the documents' frame and of the directory's
_BLOCK = 8  # 64-bit words per entry of the rank directory
_PAGE = 1 << 10  # words per page of a plane


class WaveletMatrix:
    """Bit planes of one shard with rank and select.

    ``directory`` holds the ones before every block of a plane, and last the plane's ones. The planes are whole
    (``planes``: bits x words), or compressed ``pages`` (bits x pages) that are inflated when needed.
    """

    def __init__(self, n: int, bits: int, directory: np.ndarray, planes: np.ndarray | None = None, pages: list[list[bytes]] | None = None):
        self.n, self.bits, self.directory, self.pages = n, bits, directory, pages
        self.zeros = n - directory[:, -1].astype(np.int64)
        width = _BLOCK * (directory.shape[1] - 1)
        self._planes = np.empty((bits, width), "<u8") if planes is None else planes
        self._ready = np.full((bits, -(-width // _PAGE)), planes is not None)

    @property
    def inflated(self) -> int:
        """Pages that have been inflated."""
        return int(self._ready.sum())

    def _words(self, level: int, at: np.ndarray) -> np.ndarray:
        """Words of a plane at the positions; inflates the pages they lie in."""
        need = np.unique(at // _PAGE)
        for page in need[~self._ready[level, need]].tolist():
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.pages[level][page]), "<u8")
            self._planes[level, page * _PAGE : page * _PAGE + len(raw)] = raw
            self._ready[level, page] = True
        return self._planes[level, at]

    def _plane(self, level: int) -> np.ndarray:
        return self._words(level, np.arange(self._planes.shape[1]))

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n = len(ids)
        blocks = n // (64 * _BLOCK) + 1
        planes = np.zeros((bits, _BLOCK * blocks), "<u8")
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits):
            bit = (x & x.dtype.type(1 << (bits - 1 - level))) != 0
            packed = np.packbits(bit, bitorder="little")
            planes[level].view(np.uint8)[: len(packed)] = packed
            x = np.concatenate([x[~bit], x[bit]])
        directory = np.zeros((bits, blocks + 1), np.uint32)
        np.cumsum(np.bitwise_count(planes).reshape(bits, blocks, _BLOCK).sum(axis=2, dtype=np.uint32), axis=1, out=directory[:, 1:])
        return cls(n, bits, directory, planes)

    def bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self._words(level, at >> 6) >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at // (64 * _BLOCK)
        words = self._words(level, _BLOCK * block[:, None] + np.arange(_BLOCK))
        inside = np.clip((at - 64 * _BLOCK * block)[:, None] - 64 * np.arange(_BLOCK), 0, 64)  # bits of each word that count
        masks = np.where(inside == 64, ~np.uint64(0), (np.uint64(1) << (inside & 63).astype(np.uint64)) - np.uint64(1))
        return self.directory[level, block].astype(np.int64) + np.bitwise_count(words & masks).sum(axis=1, dtype=np.int64)

    def select(self, level: int, one: bool, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) one or zero of a plane."""
        before = self.directory[level, :-1].astype(np.int64)
        if not one:
            before = 64 * _BLOCK * np.arange(len(before)) - before
        block = np.searchsorted(before, k, side="right") - 1
        words = self._words(level, _BLOCK * block[:, None] + np.arange(_BLOCK))
        bits = np.unpackbits((words if one else ~words).view(np.uint8).reshape(len(k), -1), axis=1, bitorder="little")
        inside = np.cumsum(bits, axis=1, dtype=np.int32) > (k - before[block])[:, None]
        return 64 * _BLOCK * block + inside.argmax(axis=1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Tokens at the positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for level in range(self.bits):
            bit, rank = self.bit(level, at), self.rank1(level, at)
            out = (out << np.uint32(1)) | bit
            at = np.where(bit, self.zeros[level] + rank, at - rank)
        return out

    def tokens(self) -> np.ndarray:
        """All tokens in order."""
        at = here = np.arange(self.n, dtype=np.int32)
        out = np.zeros(self.n, np.uint32)
        for level in range(self.bits):
            plane = np.unpackbits(self._plane(level).view(np.uint8), bitorder="little")[: self.n]
            ones = np.cumsum(plane, dtype=np.int32)
            to = np.where(plane, np.int32(self.zeros[level] - 1) + ones, here - ones)
            out = (out << np.uint32(1)) | plane[at]
            at = to[at]
        return out

    def _down(self, token: int, low: int, high: int) -> tuple[int, int]:
        ends = np.array([low, high])
        for level in range(self.bits):
            rank = self.rank1(level, ends)
            ends = self.zeros[level] + rank if token >> (self.bits - 1 - level) & 1 else ends - rank
        return int(ends[0]), int(ends[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token in positions low (included) to high."""
        if token >> self.bits:
            return 0
        a, b = self._down(token, low, self.n if high is None else high)
        return b - a

    def occurrences(self, token: int) -> np.ndarray:
        """Positions of a token, ascending."""
        if token >> self.bits:
            return np.zeros(0, np.int64)
        return self._up(token, *self._down(token, 0, self.n))

    def _up(self, token: int, a: int, b: int) -> np.ndarray:
        out = []
        for low in range(a, b, 1 << 12):  # bounds the words that are looked at together
            at = np.arange(low, min(b, low + (1 << 12)))
            for level in reversed(range(self.bits)):
                one = bool(token >> (self.bits - 1 - level) & 1)
                at = self.select(level, one, at - self.zeros[level] if one else at)
            out.append(at)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def dump(self, doc_ids: list[int | None], lengths: list[int]) -> bytes:
        """The shard's payload, see the module's text."""
        press = zstandard.ZstdCompressor(level=1)
        null = np.array([x is None for x in doc_ids], np.uint8)
        documents = press.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + null.tobytes() + np.array(lengths, "<i8").tobytes())
        directory = press.compress(self.directory.astype("<u4").tobytes())
        pages = [press.compress(plane[at : at + _PAGE].tobytes()) for plane in map(self._plane, range(self.bits)) for at in range(0, len(plane), _PAGE)]
        sizes = np.array([len(p) for p in pages], "<u4").tobytes()
        return _HEAD.pack(MAGIC, self.bits, self.n, len(doc_ids), len(documents), len(directory)) + sizes + documents + directory + b"".join(pages)

    @classmethod
    def load(cls, data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
        """The matrix with its planes still compressed, the documents' ids and their lengths, from a payload."""
        magic, bits, n, docs, documents, directory = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        blocks = n // (64 * _BLOCK) + 1
        per_plane = -(-_BLOCK * blocks // _PAGE)
        at = _HEAD.size + 4 * bits * per_plane
        ends = at + documents + directory + np.cumsum(np.frombuffer(data, "<u4", bits * per_plane, _HEAD.size).astype(np.int64))
        starts = np.concatenate(([at + documents + directory], ends[:-1]))
        pages = [[data[starts[i] : ends[i]] for i in range(p * per_plane, (p + 1) * per_plane)] for p in range(bits)]
        body = zstandard.ZstdDecompressor().decompress(data[at : at + documents])
        ids, null, lengths = np.frombuffer(body, "<i8", docs), np.frombuffer(body, np.uint8, docs, 8 * docs), np.frombuffer(body, "<i8", docs, 9 * docs)
        ranks = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + documents : at + documents + directory]), "<u4").reshape(bits, blocks + 1)
        return cls(n, bits, ranks, pages=pages), [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)], lengths


_SHARD = "part int, shard int, n_tokens bigint, n_documents bigint, payload binary"


def write_token_shards(
    docs: DataFrame, path: str, out: str, end_id: int = 1, bits: int = 16, shard_tokens: int = SHARD_TOKENS, folded: bool = False
) -> None:
    """Encodes ``docs`` in ascending doc_id order (nulls first, ties by text) into shards below ``out``, one file each.

    A null text counts as empty; repeated rows are stored each; an empty table gives no shards; columns other than
    doc_id and text are not read. ``path`` is a vocabulary of the tokenizers library whose ids fit ``bits``.
    ``folded`` tells that the vocabulary lower-cases its input. A shard closes after ``shard_tokens`` tokens, so a
    very long document makes a shard of its own size.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, spaced=False, folded=folded)
        end = np.array([end_id], "<u4").tobytes()
        part = shard = held = 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []

        def flush() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(ids), "<u4")
            if len(tokens) and int(tokens.max()) >> bits:
                raise ValueError(f"an id does not fit {bits} bits")
            data = WaveletMatrix.build(tokens, bits).dump(doc_ids, [len(x) // 4 for x in ids])
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            values = [part, shard, len(tokens), len(doc_ids), data]
            names = ["part", "shard", "n_tokens", "n_documents", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            texts = text_column(batch.column("text"))
            keys = batch.column("doc_id").to_pylist()
            if len(keys):
                part = batch.column("part")[0].as_py()
            for lo, hi in byte_slices(texts):
                for key, encoded in zip(keys[lo:hi], own.encode_array(texts.slice(lo, hi - lo)), strict=True):
                    ids.append(encoded + end)
                    doc_ids.append(key)
                    held += len(encoded) // 4 + 1
                    if held >= shard_tokens:
                        yield flush()
                        ids, doc_ids, held, shard = [], [], 0, shard + 1
        if doc_ids:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(build, _SHARD).write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(out)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Documents that share a doc_id, or have none, have a row each.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, payload in zip(*[batch.column(c) for c in ("part", "shard", "payload")], strict=True):
                matrix, doc_ids, lengths = WaveletMatrix.load(payload.as_py())
                raw = matrix.tokens().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * n, pa.int32()),
                        pa.array([shard.as_py()] * n, pa.int32()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    stored = spark.read.schema(_SHARD).parquet(path)
    rows = stored.select("part", "shard", "payload").mapInArrow(digest, "part int, shard int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stored.select("part", "shard", F.col("n_tokens").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", earlier(Window.orderBy("part")).alias("before_part"))
    shards = sizes.select("part", "shard", earlier(Window.partitionBy("part").orderBy("shard")).alias("before_shard"))
    starts = shards.join(parts, "part").select("part", "shard", (F.col("before_part") + F.col("before_shard")).alias("first"))
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_lookup(shards: DataFrame, token: int) -> DataFrame:
    """Occurrences of one token in stored shards: part, shard, doc_id, position in the document.

    Runs on the wavelet matrices: nothing but the matching positions is unpacked.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, payload in zip(*[batch.column(c) for c in ("part", "shard", "payload")], strict=True):
                matrix, doc_ids, lengths = WaveletMatrix.load(payload.as_py())
                at = matrix.occurrences(token)
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, at, side="right")
                values = [[part.as_py()] * len(at), [shard.as_py()] * len(at), [doc_ids[d] for d in doc], at - (ends - lengths)[doc]]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "shard", "doc_id", "position"])

    return shards.select("part", "shard", "payload").mapInArrow(find, "part int, shard int, doc_id bigint, position bigint")


def stored_digests(docs: DataFrame, path: str, out: str | None = None, folded: bool = False) -> DataFrame:
    """Writes the shards (to a new folder of the shared directory unless told where) and reads them back.

    Nulls, repeated rows, long texts and empty tables are treated as in ``write_token_shards`` and ``read_token_shards``.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_token_shards(docs, path, out, folded=folded)
    return read_token_shards(spark, out)
