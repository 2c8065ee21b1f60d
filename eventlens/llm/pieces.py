"""Merge-type (BPE) sentence-piece encoding by a score-ordered agenda of adjacent symbol pairs.

A text is prefixed with one space, spaces become U+2581 and the characters are the first symbols. The
agenda holds every adjacent pair whose concatenation is a piece; the pair of the best score (leftmost
of equals) is merged until none is left, then symbols outside the vocabulary fall back to bytes.

No piece of a usable vocabulary has U+2581 after another character (checked when a model is
loaded), so no merge crosses the start of a space run and the agenda may run on each
space-led segment alone. Segments recur, so a worker caches their ids. Arrow splits a batch and numbers its different segments,
and their ids lie in one numpy array with a range per segment, so no segment costs Python objects. New segments of a batch run
together: short ones in numpy, one agenda step of all segments at a time; long ones with a
heap. Every new segment is checked against the sentencepiece library, and decoded texts likewise.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.textops import byte_slices, text_column

MARK = "▁"
_NONE = np.int64(1 << 40)
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
_SHORT = 24
_CACHED = 300_000
_SLICE = 2_000_000


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(int(counts.sum()))


class Merges:
    """Vocabulary of one model as tables: piece ids, byte ids and the rank of every mergeable pair."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        n = self.size = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.ids = {self.names[i]: i for i in range(n) if usable[i]}
        if len(self.bytes) != 256 or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a model with byte fallback and without inner spaces in pieces is needed")
        self.ints = list(range(n))
        self.characters = np.arange(n, n + sys.maxunicode + 1)  # symbol of every code point
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.characters[ord(piece)] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        pairs: dict[int, int] = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol(piece[:cut]), self.symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 22 | right] = int(rank[i]) << 20 | i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def symbol(self, text: str) -> int | None:
        """Id of a piece; a single character outside the vocabulary has an id beyond all pieces."""
        i = self.ids.get(text)
        return i if i is not None else self.size + ord(text) if len(text) == 1 else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged id (rank << 20 | id) of each pair, or ``_NONE``; negative symbols never merge."""
        keys = left << 22 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.values[at], _NONE)

    def final(self, symbols: list[int]) -> tuple[int, ...]:
        if max(symbols) < self.size:
            return tuple([self.ints[s] for s in symbols])
        out: list[int] = []
        for s in symbols:
            if s < self.size:
                out.append(self.ints[s])
            else:
                out.extend(self.bytes[b] for b in chr(s - self.size).encode())
        return tuple(out)

    def by_heap(self, segment: str) -> tuple[int, ...]:
        """The agenda as a heap, for one segment of any length."""
        symbols = [self.symbol(c) for c in segment]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (value := self.pairs.get(symbols[i] << 22 | symbols[j])) is not None:
                heapq.heappush(agenda, (value >> 20, i, symbols[i] << 22 | symbols[j], value & 0xFFFFF))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, pair, merged = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] < 0 or j < 0 or symbols[i] << 22 | symbols[j] != pair:
                continue
            symbols[i], symbols[j] = merged, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return self.final([s for s in symbols if s >= 0])

    def together(self, segments: list[str]) -> list[tuple[int, ...]]:
        """The agenda over many segments at once, as one tuple of ids per segment."""
        ids, starts, counts = self.flat(segments)
        return [tuple(ids[s : s + n].tolist()) for s, n in zip(starts, counts, strict=True)]

    def flat(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The agenda over many segments at once, each step merging the best pair of every segment: ids, first place and number of ids per segment."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        first = np.cumsum(lengths) - lengths
        symbols = self.characters[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        starts, counts = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        found, size = [np.zeros(0, np.int32)], 0
        for low, high in ((1, 6), (7, 9), (10, 12), (13, 16), (17, _SHORT)):
            rows = np.flatnonzero((lengths >= low) & (lengths <= high))
            if not len(rows):
                continue
            inside = np.arange(int(lengths[rows].max())) < lengths[rows][:, None]
            table = np.full(inside.shape, -1, np.int64)
            table[inside] = symbols[ragged(first[rows], lengths[rows])]
            self._steps(table)
            ids, n = self._final(table)
            counts[rows], starts[rows] = n, size + np.cumsum(n) - n
            found.append(ids)
            size += len(ids)
        for r in np.flatnonzero(lengths > _SHORT).tolist():
            ids = self.by_heap(segments[r])
            counts[r], starts[r] = len(ids), size
            found.append(np.array(ids, np.int32))
            size += len(ids)
        return np.concatenate(found), starts, counts

    def _final(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, symbols outside the vocabulary as bytes, and their number per row."""
        held = table >= 0
        flat, wide = table[held], np.ones(table.shape, np.int64) * held
        outside = np.flatnonzero(flat >= self.size)
        if not len(outside):
            return flat.astype(np.int32), wide.sum(axis=1)
        raw = [[self.bytes[b] for b in chr(s - self.size).encode()] for s in flat[outside].tolist()]
        times = np.ones(len(flat), np.int64)
        times[outside] = [len(x) for x in raw]
        wide[held] = times
        out = np.repeat(flat, times)
        ends = np.cumsum(times)
        out[ragged((ends - times)[outside], times[outside])] = list(chain.from_iterable(raw))
        return out.astype(np.int32), wide.sum(axis=1)

    def _steps(self, table: np.ndarray) -> None:
        width = table.shape[1]
        if width < 2:
            return
        live = np.arange(len(table))
        work = table.copy()
        agenda = self.ranks(work[:, :-1], work[:, 1:])
        columns = np.arange(width)
        while len(live):
            best = agenda.argmin(axis=1)
            row = np.arange(len(live))
            value = agenda[row, best]
            going = value < _NONE
            table[live[~going]] = work[~going]
            live, work, agenda, best, value = live[going], work[going], agenda[going], best[going], value[going]
            if not len(live):
                break
            row = np.arange(len(live))
            shift = np.minimum(columns + (columns > best[:, None]), width - 1)
            last = work[:, -1].copy()
            work = np.take_along_axis(work, shift, axis=1)
            work[:, -1] = np.where(best == width - 1, last, -1)
            work[row, best] = value & 0xFFFFF
            agenda = np.take_along_axis(agenda, np.minimum(shift[:, :-1], width - 2), axis=1)
            agenda[:, -1] = _NONE
            right = np.minimum(best + 1, width - 1)
            here = np.where(best + 1 < width, self.ranks(work[row, best], np.where(best + 1 < width, work[row, right], -1)), _NONE)
            inside = best < width - 1
            agenda[row[inside], best[inside]] = here[inside]
            inside = best > 0
            agenda[row[inside], best[inside] - 1] = self.ranks(work[row[inside], best[inside] - 1], work[row[inside], best[inside]])


class PieceCodec:
    """Encoder and decoder of one worker with its cache of segments: a row per segment, their ids in one array."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        m = self.merges
        of_byte = {i: bytes([b]) for b, i in m.bytes.items()}
        raw = [b"" if m.library.is_control(i) else of_byte.get(i, name.replace(MARK, " ").encode()) for i, name in enumerate(m.names)]
        self.raw, self.digits = _joined(raw), _joined([b"%d," % i for i in range(m.size)])
        self._keep([], np.zeros(0, np.int64))

    def _keep(self, keys: list[str], rows: np.ndarray) -> None:
        """Leaves only these rows, whose segments are ``keys``, in the cache."""
        if keys:
            counts, over = self.counts[rows], self.over[rows]
            self.ids, self.counts, self.over = self.ids[ragged(self.starts[rows], counts)], counts, over
        else:
            self.ids, self.counts, self.over = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts, self.again = np.cumsum(self.counts) - self.counts, np.zeros(len(keys), bool)
        self.rows = {s: i for i, s in enumerate(keys)}

    def _prepare(self, wanted: list[str]) -> np.ndarray:
        """The row of each of these different segments. A full cache keeps what was asked for again, unless that is most of it."""
        if len(self.rows) > _CACHED:
            again = np.flatnonzero(self.again)
            again = again if 2 * len(again) <= _CACHED else again[:0]
            keys = list(self.rows)
            self._keep([keys[i] for i in again.tolist()], again)
        found = np.fromiter(map(self.rows.get, wanted, repeat(-1)), np.int64, len(wanted))
        self.again[found[found >= 0]] = True
        new = np.flatnonzero(found < 0)
        if not len(new):
            return found
        ask = [wanted[i] for i in new.tolist()]
        ids, starts, counts = self.merges.flat([MARK + s for s in ask])
        theirs = self.merges.library.encode([s.replace(MARK, " ") for s in ask], num_threads=1)
        lengths = np.fromiter(map(len, theirs), np.int64, len(ask))
        check = np.fromiter(chain.from_iterable(theirs), np.int32, int(lengths.sum()))
        over = lengths != counts
        ours = ids[ragged(starts[~over], counts[~over])]
        firsts = np.cumsum(lengths) - lengths
        differ = ours != check[ragged(firsts[~over], lengths[~over])]
        if differ.any():
            over[np.repeat(np.flatnonzero(~over), counts[~over])[differ]] = True
        # the library puts its own prefix before every text, also before an empty one of only a prefix
        over &= np.fromiter(map(bool, ask), bool, len(ask))
        if over.any():
            starts, counts = np.where(over, len(ids) + firsts, starts), np.where(over, lengths, counts)
            ids = np.concatenate([ids, check])
        n = len(self.rows)
        self.starts = np.concatenate([self.starts, len(self.ids) + starts])
        self.counts, self.over, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.over, over.astype(np.int64)]), np.concatenate([self.ids, ids])
        self.again = np.concatenate([self.again, np.zeros(len(ask), bool)])
        self.rows.update(zip(ask, range(n, n + len(ask)), strict=True))
        found[new] = np.arange(n, n + len(ask))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts (``large_string`` without nulls); per text the first and the last place behind, and the segments where the library's ids replace the agenda's."""
        marked = pc.replace_substring(texts, MARK, " ")
        odd = pc.or_(pc.match_substring(marked, "  "), pc.or_(pc.starts_with(marked, " "), pc.ends_with(marked, " ")))
        odd = pc.or_(odd, pc.equal(pc.binary_length(marked), 0))
        plain = pc.split_pattern(marked.filter(pc.invert(odd)), " ")
        others = [[s[1:] for s in _SEGMENT.findall(MARK + t.replace(" ", MARK))] if t else [] for t in marked.filter(odd).to_pylist()]
        lists = pa.concat_arrays([plain, pa.array(others, plain.type)])
        segments = lists.flatten().dictionary_encode()
        rows = self._prepare(segments.dictionary.to_numpy(zero_copy_only=False).tolist())[segments.indices.to_numpy()]
        counts = self.counts[rows]
        text = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")  # whose segments stand where
        places, at = _sums(counts), lists.offsets.to_numpy()
        replaced, bounds = _sums(self.over[rows])[at], places[at]
        lo, hi, over = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        lo[text], hi[text], over[text] = bounds[:-1], bounds[1:], np.diff(replaced)
        return self.ids[ragged(self.starts[rows], counts)], lo, hi, over

    def decode(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        """Texts of ranges of ids: pieces joined, marks as spaces, byte runs as they are, without the first space."""
        found = _spelled(ids, lo, hi, self.raw)
        return [x[1:] if x[:1] == b" " else x for x in found]

    def digits_of(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        """Decimal ids of ranges, joined by commas."""
        return [x[:-1] for x in _spelled(ids, lo, hi, self.digits)]


def _sums(counts: np.ndarray) -> np.ndarray:
    """Running sums from 0."""
    return np.concatenate([[0], np.cumsum(counts)])


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all parts, and first place and length of each."""
    counts = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(counts) - counts, counts


def _spelled(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """The parts of the ids of each range, joined."""
    data, starts, counts = parts
    counts = counts[ids]
    whole, at = data[ragged(starts[ids], counts)].tobytes(), _sums(counts)
    return [whole[a:b] for a, b in zip(at[lo].tolist(), at[hi].tolist(), strict=True)]


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def piece_ids(path: str):
    """Arrow UDF: text -> array of ids (null and empty texts: none)."""

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        texts, own, out = text_column(column), codec(path), [pa.array([], pa.list_(pa.int32()))]
        for first, last in byte_slices(texts, _SLICE):
            found, lo, hi, _ = own.encode(texts.slice(first, last - first))
            out.append(pa.array([found[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.list_(pa.int32())))
        return pa.concat_arrays(out)

    return ids


def piece_texts(path: str):
    """Arrow UDF: array of ids -> decoded text (null: empty)."""

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        lists = [x or [] for x in column.to_pylist()]
        at = _sums(np.array([len(x) for x in lists], np.int64))
        return pa.array([x.decode("utf-8", "replace") for x in codec(path).decode(np.array(list(chain.from_iterable(lists)), np.int32), at[:-1], at[1:])], pa.string())

    return text


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, of its whole text, and n_overruled.

    Null and empty texts have no ids and decode to the empty text. Rows are encoded alone, so repeated
    rows give equal digests, null ids too; columns other than doc_id and text are not read. An empty table gives
    no rows; a text's length is bounded only by one task's memory for it. Where the library differs from the agenda or
    from our decoding, its result stands; ``n_overruled`` counts such segments and decoded texts.
    """

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,n_overruled:bigint>")
    def digest(column: pa.Array) -> pa.Array:
        own = codec(path)
        texts = text_column(column)
        counts, encoded, decoded, overruled = [], [], [], []
        for first, last in byte_slices(texts, _SLICE):
            ids, lo, hi, replaced = own.encode(texts.slice(first, last - first))
            whole = ids.tolist()
            theirs = own.merges.library.decode([whole[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], num_threads=1)
            for text, ours, n in zip(theirs, own.decode(ids, lo, hi), replaced.tolist(), strict=True):
                raw = text.encode()
                overruled.append(n + (raw != ours and text != ours.decode("utf-8", "replace")))
                decoded.append(hashlib.sha256(raw).hexdigest())
            counts.extend((hi - lo).tolist())
            encoded.extend([hashlib.sha256(x).hexdigest() for x in own.digits_of(ids, lo, hi)])
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string()), pa.array(overruled, pa.int64())], ["n_tokens", "ids_sha256", "decoded_sha256", "n_overruled"])

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
