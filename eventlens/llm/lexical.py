"""Ranked lexical search over a term-partitioned index, in pipelined stages.

1. Documents are read once. Each task cuts its own into blocks and writes, per block and term owner, the postings of
   the items' terms: an owner holds the terms whose hash falls to it, and its part of the index is a folder of its own.
2. Document frequencies and lengths are summed over the whole index, so weights are known before any score.
3. Bundles of items pass the owners one after the other. At each stage a bundle's accumulators for a block (document,
   score) meet that owner's postings of the same block by a cogroup, and integer contributions are added. A document whose
   score cannot reach the bundle's k-th best of the block any more, whatever later owners add, is left behind.
4. The last stage hands on the k best documents of each item and block; a window picks the k best of all.

A group holds one block (at most ``BLOCK_DOCS`` documents) and one bundle (at most ``BUNDLE`` items), however frequent a term is.
Items are taken in passes of about ``PASS_TERMS`` terms, so what tasks know of them has a bound too.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import shared_dir
from eventlens.llm.textops import byte_slices, mix64, power_tables, text_column

BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1 << 21
BUNDLE = 256
PASS_TERMS = 1 << 20
OWNERS = 4
UNIT = 10**6  # one occurrence adds less than this times the weight
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_U = np.uint64
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_VALUE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def terms_of(text: Column) -> Column:
    """All terms of a text, in order; only A-Z are lower-cased."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


@dataclass
class Terms:
    """Terms of a batch of texts: hash and byte span in ``data`` (folded), and per text the range of its terms."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, base: int) -> Terms:
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        data = _FOLD[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
        size, bounds = len(data), offsets - offsets[0]
        inside, cut = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        inside[:size], cut[bounds] = _IN_TERM[data], True
        first = inside[:size].copy()
        first[1:] &= ~inside[: size - 1] | cut[1:size]
        last = inside[:size] & (~inside[1:] | cut[1:])
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = power_tables(_U(base), size + 1)
        run = np.zeros(size + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[:size], out=run[1:])
        hashes = mix64((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
        return cls(hashes, start, end, np.searchsorted(start, bounds), data)


class Vocabulary:
    """Terms numbered in order; ``find`` gives their numbers (-1: not there) by hash and then by their bytes."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        column = pa.array(terms, pa.large_string())
        for base in range(0x9E3779B97F4A7C15, 0xFFFFFFFFFFFFFFFF, 0x1000):  # another one where two terms share a hash
            held = Terms.of(column, base)
            self.base, self.order = base, np.argsort(held.hashes)
            self.hashes = held.hashes[self.order]
            if len(np.unique(self.hashes)) == len(terms):
                break
        self.start, self.size, self.data = held.start, held.end - held.start, held.data

    def find(self, there: Terms) -> np.ndarray:
        if not len(self.terms):
            return np.full(len(there.hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, there.hashes), len(self.hashes) - 1)
        found = np.where(self.hashes[at] == there.hashes, self.order[at], -1)
        some = np.flatnonzero(found >= 0)
        size = there.end[some] - there.start[some]
        equal = size == self.size[found[some]]
        found[some[~equal]] = -1
        some, size = some[equal], size[equal]
        if len(some):
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            same = there.data[np.repeat(there.start[some], size) + step] == self.data[np.repeat(self.start[found[some]], size) + step]
            found[some[~np.logical_and.reduceat(same, np.cumsum(size) - size)]] = -1
        return found


_INDEX = "block bigint, n binary, terms binary, starts binary, docs binary, tf binary"


def _indexer(vocabulary: Vocabulary, owner_of: np.ndarray, owners: int, block_docs: int):
    """Postings of blocks of documents: a row per block and owner."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        found: list[np.ndarray] = []  # per slice: term, document in block, occurrences
        docs = postings = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, lengths, found, docs, postings, seq
            doc_ids, n = pa.concat_arrays(ids), np.concatenate(lengths)
            term, doc, tf = np.concatenate(found, axis=1)
            order = np.lexsort((doc, term, owner_of[term]))
            term, doc, tf = term[order], doc[order], tf[order]
            edges = np.searchsorted(owner_of[term], np.arange(owners + 1))
            rows = []
            for o in range(owners):
                own = slice(edges[o], edges[o + 1])
                terms, starts = np.unique(term[own], return_index=True)
                starts = np.append(starts, edges[o + 1] - edges[o])
                rows.append([n.astype("<u4"), terms.astype("<u4"), starts.astype("<u4"), doc[own].astype("<u2"), tf[own].astype("<u4")])
            columns = [pa.array([base + seq] * owners, pa.int64())] + [pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(5)]
            columns += [pa.array(range(owners), pa.int32()), pa.ListArray.from_arrays(np.arange(owners + 1, dtype=np.int32) * len(doc_ids), pa.concat_arrays([doc_ids] * owners))]
            ids, lengths, found, docs, postings, seq = [], [], [], 0, 0, seq + 1
            return pa.RecordBatch.from_arrays(columns, [*[x.split()[0] for x in _INDEX.split(", ")], "owner", "doc_ids"])

        for batch in batches:
            texts, own = text_column(batch.column("text")), batch.column("doc_id")
            for low, high in byte_slices(texts):
                while low < high:
                    stop = min(high, low + block_docs - docs)
                    there = Terms.of(texts.slice(low, stop - low), vocabulary.base)
                    term = vocabulary.find(there)
                    doc = np.repeat(np.arange(stop - low), np.diff(there.offsets))
                    keys, tf = np.unique(term[term >= 0] * block_docs + doc[term >= 0], return_counts=True)
                    ids.append(own.slice(low, stop - low))
                    lengths.append(np.diff(there.offsets))
                    found.append(np.stack([keys // block_docs, keys % block_docs + docs, tf]))
                    docs, postings, low = docs + stop - low, postings + len(keys), stop
                    if docs >= block_docs or postings >= BLOCK_POSTINGS:
                        yield close()
        if docs:
            yield close()

    return index


def _frequencies(n_terms: int):
    """Per task: documents holding each term, and as terms -1 and -2 the documents with terms and all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, words = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for owner, n, terms, starts in zip(*[batch.column(c).to_pylist() for c in ("owner", "n", "terms", "starts")], strict=True):
                df[np.frombuffer(terms, "<u4")] += np.diff(np.frombuffer(starts, "<u4").astype(np.int64))
                if owner == 0:
                    n = np.frombuffer(n, "<u4")
                    docs, words = docs + int((n > 0).sum()), words + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [docs, words]))], ["term", "df"])

    return count


_POSTINGS = "block bigint, bundle int, n binary, terms binary, starts binary, docs binary, tf binary"


def _dealt(bundle_terms: list[np.ndarray], with_ids: str | None):
    """The postings of a block and owner for each bundle: those of the bundle's terms."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, n, *rest = (batch.column(c)[i].as_py() for c in ("block", "n", "terms", "starts", "docs", "tf"))
                terms, starts, docs, tf = (np.frombuffer(x, t) for x, t in zip(rest, ("<u4", "<u4", "<u2", "<u4"), strict=True))
                size = np.diff(starts.astype(np.int64))
                rows = []
                for b, wanted in enumerate(bundle_terms):
                    keep = np.isin(terms, wanted, assume_unique=True)
                    flat = np.repeat(keep, size)
                    edges = np.concatenate(([0], np.cumsum(size[keep]))).astype("<u4")
                    rows.append((block, b, n, terms[keep].tobytes(), edges.tobytes(), docs[flat].tobytes(), tf[flat].tobytes()))
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = [x.split()[0] for x in _POSTINGS.split(", ")]
                if with_ids:
                    own = batch.column("doc_ids")[i].values
                    columns.append(pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(own), pa.concat_arrays([own] * len(rows))))
                    names.append("doc_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return deal


_BUNDLES = "block bigint, bundle int, item int, docs binary, scores binary"


@dataclass
class Query:
    """What the stages know of one pass: per item its (term, weight) pairs, the owner of each term, collection counts."""

    items: list[list[tuple[int, int]]]
    owner_of: np.ndarray
    docs: int
    words: int
    k: int
    bundle: int

    def users(self, bundle: int) -> dict[int, list[tuple[int, int]]]:
        """Per term of a bundle: (place of the item in it, weight)."""
        out: dict[int, list[tuple[int, int]]] = {}
        for place, item in enumerate(self.items[bundle * self.bundle : (bundle + 1) * self.bundle]):
            for term, weight in item:
                out.setdefault(term, []).append((place, weight))
        return out

    def left(self, item: int, owner: int) -> int:
        """The least bound of what owners after this one can add to an item's score."""
        return sum(w * UNIT for t, w in self.items[item] if self.owner_of[t] > owner)


def _added(query: Query, left: pa.Table, right: pa.Table):
    """(bundle, scores of its items by document) after adding the postings to the accumulators."""
    bundle = right["bundle"][0].as_py()
    n = np.frombuffer(right["n"][0].as_py(), "<u4").astype(np.int64)
    first = bundle * query.bundle
    total = np.zeros((min(query.bundle, len(query.items) - first), len(n)), np.int64)
    for item, docs, scores in zip(*[left[c].to_pylist() for c in ("item", "docs", "scores")], strict=True):
        if item >= 0:
            total[item - first, np.frombuffer(docs, "<u2")] = np.frombuffer(scores, "<i8")
    m = 50 + 50 * n * query.docs // max(query.words, 1)
    terms, starts, docs, tf = (np.frombuffer(right[c][0].as_py(), t) for c, t in (("terms", "<u4"), ("starts", "<u4"), ("docs", "<u2"), ("tf", "<u4")))
    tf = tf.astype(np.int64)
    unit = 10**9 * tf // (1000 * tf + 20 * m[docs])
    users = query.users(bundle)
    for i, term in enumerate(terms.tolist()):
        own = slice(starts[i], starts[i + 1])
        for place, weight in users.get(term, ()):
            total[place, docs[own]] += weight * unit[own]
    return bundle, total


def _stage(query: Query, owner: int):
    def stage(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return left
        bundle, total = _added(query, left, right)
        rows = [(-1, b"", b"")]  # keeps a bundle without accumulators going
        for place, scores in enumerate(total):
            item = bundle * query.bundle + place
            keep = scores > 0
            if len(scores) > query.k:
                keep &= scores + query.left(item, owner) >= np.partition(scores, len(scores) - query.k)[len(scores) - query.k]
            docs = np.flatnonzero(keep)
            if len(docs):
                rows.append((item, docs.astype("<u2").tobytes(), scores[docs].astype("<i8").tobytes()))
        head = [pa.array([right["block"][0].as_py()] * len(rows), pa.int64()), pa.array([bundle] * len(rows), pa.int32())]
        kinds = pa.int32(), pa.binary(), pa.binary()
        return pa.table(head + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _BUNDLES.split(", ")])

    return stage


def _last(query: Query):
    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        own = right["doc_ids"].combine_chunks().flatten() if right.num_rows else pa.nulls(0)
        items, places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if right.num_rows:
            bundle, total = _added(query, left, right)
            null = own.is_null().to_numpy(zero_copy_only=False)
            tie = np.argsort(np.argsort(np.where(null, np.iinfo(np.int64).min, own.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)), kind="stable"))
            for place, score in enumerate(total):
                best = np.flatnonzero(score > 0)
                best = best[np.lexsort((tie[best], -score[best]))[: query.k]]
                items.append(np.full(len(best), bundle * query.bundle + place))
                places.append(best)
                scores.append(score[best])
        columns = [pa.array(np.concatenate(items), pa.int32()), own.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))]
        return pa.table(columns, ["item", "doc_id", "score"])

    return last


def _one_pass(docs: DataFrame, items: list, k: int, owners: int, bundle: int, block_docs: int, path: str) -> DataFrame:
    """item (its number), doc_id, score: the k best documents of each item and block at most."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(sorted({t for x in items for t in x.terms}))
    number = {t: i for i, t in enumerate(vocabulary.terms)}
    owner_of = (mix64(np.arange(len(number), dtype=np.uint64) + _U(1)) % _U(owners)).astype(np.int64)
    kind = dict(docs.dtypes)["doc_id"]
    index = docs.select("doc_id", "text").mapInArrow(_indexer(vocabulary, owner_of, owners, block_docs), f"{_INDEX}, owner int, doc_ids array<{kind}>")
    index.write.partitionBy("owner").parquet(path)
    index = spark.read.schema(f"{_INDEX}, doc_ids array<{kind}>, owner int").parquet(path)
    counts = index.select("owner", "n", "terms", "starts").mapInArrow(_frequencies(len(number)), "term bigint, df bigint")
    sums = {r.term: r.df for r in counts.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row per term of the pass
    n = sums.get(-1, 0)
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * sums.get(i, 0) + 1))) for i in range(len(number))]
    query = Query([[(number[t], weight[number[t]]) for t in x.terms if weight[number[t]]] for x in items], owner_of, n, sums.get(-2, 0), k, bundle)
    bundles = range(-(-len(items) // bundle))
    used = [np.array(sorted(query.users(b)), np.int64) for b in bundles]
    on = ["block", "bundle"]
    moving = index.where("owner = 0").select("block", F.explode(F.array(*[F.lit(b) for b in bundles])).alias("bundle"))
    moving = moving.select(*on, F.lit(-1).alias("item"), F.lit(b"").alias("docs"), F.lit(b"").alias("scores"))
    for owner in range(owners):
        final = owner == owners - 1
        read = ["block", "n", "terms", "starts", "docs", "tf"] + ["doc_ids"] * final
        there = index.where(F.col("owner") == owner).select(*read)
        there = there.mapInArrow(_dealt(used, kind if final else None), _POSTINGS + (f", doc_ids array<{kind}>" if final else ""))
        stage = moving.groupBy(*on).cogroup(there.groupBy(*on))
        moving = stage.applyInArrow(_last(query), f"item int, doc_id {kind}, score bigint") if final else stage.applyInArrow(_stage(query, owner), _BUNDLES)
    return moving


def ranked_search(
    docs: DataFrame, benchmark: DataFrame, k: int = 50, owners: int = OWNERS, bundle: int = BUNDLE, block_docs: int = BLOCK_DOCS, pass_terms: int = PASS_TERMS
) -> DataFrame:
    """item_id, rank, doc_id, score, item_sha256: the k best documents of every item, equal scores by ascending doc_id (null first).

    Every row of ``docs`` is a document, repeated ones too; null and empty texts are documents without terms. An item
    is a distinct (item_id, text); item_sha256 of its text tells items of one item_id apart. Items without terms or without matches
    have no rows, empty tables give none. Texts of any length are read whole; other columns are not read.
    """
    spark = docs.sparkSession
    wanted = benchmark.select("item_id", "text").dropDuplicates().select("item_id", F.sha2("text", 256).alias("item_sha256"), F.array_sort(F.array_distinct(terms_of(F.col("text")))).alias("terms"))
    wanted = wanted.where(F.size("terms") > 0)
    passes = -(-(wanted.agg(F.sum(F.size("terms")).alias("n")).first().n or 0) // pass_terms) or 1
    kind = dict(docs.dtypes)["doc_id"]
    found = None
    for p in range(passes):
        # about pass_terms terms come to the driver and to the tasks at a time
        items = wanted.where(F.pmod(F.xxhash64("item_id", "item_sha256"), F.lit(passes)) == p).orderBy("item_id", "item_sha256").collect()
        if not items:
            continue
        path = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
        names = spark.createDataFrame([(i, x.item_id, x.item_sha256) for i, x in enumerate(items)], f"item int, item_id {dict(benchmark.dtypes)['item_id']}, item_sha256 string")
        own = _one_pass(docs, items, k, owners, bundle, block_docs, path).join(F.broadcast(names), "item").select("item_id", "item_sha256", "doc_id", "score")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], f"item_id {dict(benchmark.dtypes)['item_id']}, rank int, doc_id {kind}, score bigint, item_sha256 string")
    order = Window.partitionBy("item_id", "item_sha256").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score", "item_sha256")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}') AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
i AS (SELECT item_id, item_sha256, unnest(list_distinct(w)) AS term
  FROM (SELECT DISTINCT item_id, sha256(text) AS item_sha256, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}') AS w FROM benchmark WHERE text IS NOT NULL)),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term),
s AS (SELECT item_id, item_sha256, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN t USING (term) JOIN n USING (r), c GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, item_sha256 ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score, item_sha256 FROM o WHERE rank <= 50
"""
