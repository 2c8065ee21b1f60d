"""Vectorised word splitting and hashing over Arrow string batches.

A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed and
carriage return; in UTF-8 that equals ``[^\\x20\\x09-\\x0D]+`` on characters. Every function here
works on one Arrow batch inside a task; nothing in this module touches Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_WORD_BASE = _U(0xD1B54A32D192ED03)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of text that are worked on at once; bounds the arrays of a task.
SLICE = 500_000

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; grown on demand and kept for the worker's life."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have[0]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        inverse = _U(pow(key, -1, 1 << 64))
        up, down = np.full(m, base, np.uint64), np.full(m, inverse, np.uint64)
        up[0] = down[0] = 1
        have = _powers[key] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """Words of a batch: 64-bit hash, byte span in ``data`` and, per document, the range of its words."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray  # len = documents + 1, into hashes
    data: np.ndarray  # bytes of all documents, back to back
    doc_start: np.ndarray  # len = documents + 1, into data


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array with 64-bit offsets, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def words_of(texts: pa.Array) -> Words:
    """Splits and hashes every text of a ``large_string`` array without nulls."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    doc_start = offsets - offsets[0]
    size = len(data)
    word = np.zeros(size + 1, bool)
    word[:size] = ~_SPACE[data]
    cut = np.zeros(size + 1, bool)
    cut[doc_start] = True
    first = word[:size].copy()
    first[1:] &= ~word[: size - 1] | cut[1:size]
    last = word[:size] & (~word[1:] | cut[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = power_tables(_BASE, size + 1)
    run = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:size], out=run[1:])
    hashes = mix64((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(hashes, start, end, np.searchsorted(start, doc_start), data, doc_start)


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether those k words lie in one document.

    Both arrays are as long as ``words.hashes``; hashes without k words in the document are 0.
    """
    n = len(words.hashes)
    ok = np.zeros(n, bool)
    out = np.zeros(n, np.uint64)
    if n < k:
        return out, ok
    up, down = power_tables(_WORD_BASE, n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hashes * up[:n], out=run[1:])
    out[: n - k + 1] = mix64((run[k:] - run[: n - k + 1]) * down[: n - k + 1] + _U(k))
    ends = np.repeat(words.offsets[1:], np.diff(words.offsets))
    ok = np.arange(n) + k <= ends
    out[~ok] = 0
    return out, ok


def byte_slices(texts: pa.Array, limit: int = SLICE) -> list[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each (a longer text stands alone), to bound working memory."""
    n = len(texts)
    if not n:
        return []
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    out, lo = [], 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        out.append((lo, hi))
        lo = hi
    return out
