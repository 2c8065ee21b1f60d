"""Vectorised encoding of plain texts: pre-token units by hash, ids from a table, new units from the library.

A plain text holds ASCII, the Latin letters of U+00C0 to U+00FF, single spaces and single line breaks, and none of the
things that make pre-token borders depend on context (apostrophes, runs of white space, special-token
openers). There, units are runs of letters, of digits or of signs (``digit_runs`` False: single digits), led by their
space where the model keeps it. Units are hashed in numpy and looked up in a sorted table; the library
encodes those not yet known. Other texts are left to the caller.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from eventlens.llm.textops import mix64, power_tables

_U = np.uint64
_BASE = _U(0xC2B2AE3D27D4EB4F)
_SPACE, _LETTER, _DIGIT, _SIGN, _BREAK, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
for _low, _high in ((65, 91), (97, 123), (128, 256)):
    _CLASS[_low:_high] = _LETTER
_CLASS[32], _CLASS[10], _CLASS[39] = _SPACE, _BREAK, _OTHER
_BYTE = np.random.default_rng(99).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LIMIT = 1_200_000


class UnitTable:
    """Ids of known units, as a sorted table of hashes into a pool; starts anew when it is full."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], spaced: bool, folded: bool, digit_runs: bool):
        self.encode, self.spaced, self.folded, self.digit_runs = encode, spaced, folded, digit_runs
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        encoded = self.encode(units)
        size = np.array([len(x) // 4 for x in encoded])
        new = np.frombuffer(b"".join(encoded), "<u4")
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(size) - size
        self.used += len(new)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def plain(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which texts are plain and not empty."""
        n = len(start) - 1
        kind = _CLASS[data]
        per_doc = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[start])
        blank = (kind == _SPACE) | (kind == _BREAK)
        bad = kind == _OTHER
        bad[:-1] |= blank[:-1] & blank[1:]
        bad[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        lead = data == 0xC3
        bad[1:] |= lead[:-1] & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        ok = (per_doc(bad) == 0) & (per_doc(data >= 0x80) == 2 * per_doc(lead)) & (np.diff(start) > 0)
        some = np.flatnonzero(ok)
        out = np.zeros(n, bool)
        out[some] = ~blank[start[some]] & ~blank[start[some + 1] - 1]
        return out

    def ids(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all plain texts, back to back (uint32), and the texts' bounds in them."""
        if self.folded:
            upper = (data >= 65) & (data <= 90)
            upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
            data = np.where(upper, data + 32, data).astype(np.uint8)
        n = len(data)
        kind = _CLASS[data]
        head = np.ones(n, bool)
        head[1:] = kind[1:] != kind[:-1]
        if not self.digit_runs:
            head |= kind == _DIGIT
        head[start[:-1]] = True
        border = np.flatnonzero(head)
        stop = np.append(border[1:], n)
        what = kind[border]
        keep = (what != _SPACE) if self.spaced else (what != _SPACE) & (what != _BREAK)
        first, stop = border[keep], stop[keep]
        texts_first = start[:-1]
        if self.spaced:
            led = first > 0
            led[led] = kind[first[led] - 1] == _SPACE
            first = first - led
        power, inverse = power_tables(_BASE, n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=run[1:])
        hashes = mix64((run[stop] - run[first]) * inverse[first] + (stop - first).astype(np.uint64))
        unique, index, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > _LIMIT:
            self._clear()
        place = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        fresh = self.keys[place] != unique if len(self.keys) else np.ones(len(unique), bool)
        if fresh.any():
            raw = data.tobytes()
            new = index[fresh]
            self._learn(unique[fresh], [raw[a:b].decode() for a, b in zip(first[new].tolist(), stop[new].tolist(), strict=True)])
            place = np.searchsorted(self.keys, unique)
        size = self.size[place][back]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat(self.at[place][back] - (ends - size), size) + np.arange(total)]
        bounds = np.concatenate(([0], ends))[np.searchsorted(first, np.append(texts_first, n))]
        return flat, bounds


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a large_string array without nulls."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]
