"""Whole-text encoding with the ``tokenizers`` library, through a cache of white-space separated pieces.

Most words of a corpus recur, so each worker keeps the ids of the pieces it has seen and asks the
library only for new ones. That is exact where a text may be cut at single spaces: the pre-tokenizers
used here never join a character before a space with one after it. A text with other runs of white
space around a space is handed to the library whole.

A new piece of plain letters and signs is cut further, where letters meet signs: the pre-tokenizers end a
token there too. So words stand in the cache once, whatever comma or line break follows them.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from eventlens.llm.units import UnitTable, buffers

#: A space that touches other white space, or stands at an end of the text.
_UNSAFE = re.compile(r" \s|\s |\A\s|\s\Z")
#: White space other than the space and the newline; rare, so a quick search for it spares most texts _UNSAFE.
_EXOTIC = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Pieces that may be cut between letters and signs: no digits, apostrophes or other scripts.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ.,\n#*$%&|<>?!;:()-]+")
_RUNS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|\x00| ?[^A-Za-zÀ-ÖØ-öø-ÿ\x00]+")
#: Stands between pieces while they are cut together; ids are below 2**16, so no ids hold these bytes.
_BREAK, _BREAK_ID = "\x00", b"\xff\xff\xff\xff"
_CACHED = 100_000


def _cuttable(text: str) -> bool:
    """Whether every space stands alone between characters that are not white space."""
    if "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace():
        return False
    return not _EXOTIC.search(text) or not _UNSAFE.search(text)


class PieceCache:
    """Two generations of piece -> ids (as bytes); the older one goes when the newer one is full."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], size: int = _CACHED):
        self.encode, self.size = encode, size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def prepare(self, pieces: set[str]) -> dict[str, bytes]:
        """Makes every piece of the set present; the dict that holds them."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        missing = pieces.difference(self.new)
        ask = []
        for p in missing:
            ids = self.old.get(p)
            if ids is None:
                ask.append(p)
            else:
                self.new[p] = ids
        if ask:
            self.new.update(zip(ask, self.encode(ask), strict=True))
        return self.new


class TextEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids with one tokenizer file.

    ``spaced``: a piece keeps the space before it (byte-level models), else spaces are dropped.
    ``folded``: the model lower-cases, so words may be looked up in lower case.
    """

    def __init__(self, path: str, spaced: bool, folded: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.folded = spaced, folded
        self.parts = PieceCache(self._library)
        self.first = PieceCache(lambda pieces: self._compose(pieces, ""))
        self.rest = PieceCache(lambda pieces: self._compose(pieces, " ")) if spaced else self.first
        # byte-level models take digits in runs, the word model one by one
        self.units = UnitTable(self._library, spaced, folded, digit_runs=spaced)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _compose(self, pieces: list[str], before: str) -> list[bytes]:
        """Ids of pieces from the ids of their runs; other pieces go to the library whole."""
        out: list[bytes | None] = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if _PLAIN.fullmatch(p) and "<|" not in p and "\n\n" not in p]
        whole = set(range(len(pieces))).difference(plain)
        joined = _BREAK.join([before + pieces[i] for i in plain])
        runs = _RUNS.findall(joined.lower() if self.folded else joined)
        wanted = set(runs)
        wanted.discard(_BREAK)
        wanted.update([before + pieces[i] for i in whole])
        held = self.parts.prepare(wanted)
        for i in whole:
            out[i] = held[before + pieces[i]]
        if plain:
            held[_BREAK] = _BREAK_ID
            for i, ids in zip(plain, b"".join(map(held.__getitem__, runs)).split(_BREAK_ID), strict=True):
                out[i] = ids
        return out

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a large_string array: plain texts through the unit table, others through the pieces."""
        data, start = buffers(texts)
        plain = self.units.plain(data, start)
        out: list[bytes | None] = [None] * len(texts)
        rest = np.flatnonzero(~plain).tolist()
        if rest:
            for i, ids in zip(rest, self.encode(texts.take(pa.array(rest)).to_pylist()), strict=True):
                out[i] = ids
        some = np.flatnonzero(plain)
        if len(some):
            length = np.diff(start)
            mask = np.repeat(plain, length)
            flat, bounds = self.units.ids(data[mask], np.concatenate(([0], np.cumsum(length[some]))))
            raw = flat.astype("<u4").tobytes()
            for i, a, b in zip(some.tolist(), (4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist(), strict=True):
                out[i] = raw[a:b]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as bytes."""
        out: list[bytes | None] = [None] * len(texts)
        split: list[tuple[int, list[str]]] = []
        whole = []
        heads: set[str] = set()
        tails: set[str] = set()
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif not _cuttable(text):
                whole.append(i)
            else:
                pieces = text.split(" ")
                split.append((i, pieces))
                if self.spaced:
                    heads.add(pieces[0])
                    tails.update(pieces[1:])
                else:
                    heads.update(pieces)
        if whole:
            for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
                out[i] = ids
        first = self.first.prepare(heads)
        rest = self.rest.prepare(tails) if self.spaced else first
        for i, pieces in split:
            if self.spaced:
                out[i] = first[pieces[0]] + b"".join(map(rest.__getitem__, pieces[1:]))
            else:
                out[i] = b"".join(map(first.__getitem__, pieces))
        return out


_encoders: dict[tuple, TextEncoder] = {}


def encoder(path: str, spaced: bool, folded: bool = False) -> TextEncoder:
    """The encoder of this Python worker; built once and kept between batches and tasks."""
    key = (path, spaced, folded)
    if key not in _encoders:
        _encoders[key] = TextEncoder(path, spaced, folded)
    return _encoders[key]


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
