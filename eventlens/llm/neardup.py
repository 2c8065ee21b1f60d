"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Every document becomes a weighted set of word shingles. Weight: times in the document x a damped
   inverse document frequency. The frequencies come from a count sketch over all documents (a fixed
   number of counters less their median), so what the tasks hold does not grow with the corpus. The idf is
   damped (``idf_strength``) because a large group of near copies makes its own shingles frequent: full
   idf would weigh only what its members do not share and break the group up.
2. Consistent weighted sampling draws ``bands * rows`` samples; two sets agree on a sample with the
   probability of their weighted Jaccard similarity. The random numbers of a shingle come from a table row
   picked by its hash; shingles of one document that share a row are told apart by hash.
3. Equal texts collapse to one node. Nodes that share a band are candidates. A node is first compared with two
   leaders of its buckets: the most central one (the one that shares buckets with most others) and the most
   copied one. Then, in every bucket that still holds several classes, all pairs of nodes of different classes are
   compared: the nodes outside the bucket's largest class with each other and with that class, in cells of bounded
   size. So a group that its leaders link costs as many pairs as it has nodes, and no candidate pair is left out.
4. Candidates are verified on their shingles: a link needs a weighted Jaccard similarity of ``threshold``, or that
   plain similarity (which two edited copies may reach although what they do not share is rare and so weighs
   more). Connected components of the verified links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import HEAVY, cut, join_heavy
from eventlens.llm.textops import byte_slices, grams, mix64, text_column, words_of

_COUNTERS = 1 << 16
_ROWS = 1 << 13
_U = np.uint64


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters of the near-duplicate search."""

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 16
    rows: int = 4
    idf_strength: float = 0.5
    part: int = 256
    seed: int = 7


def _shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: document, 32-bit hash (ascending per document), times; and each document's text hash.

    A text of fewer than k words has one shingle, all its words; one without words has none.
    """
    words = words_of(texts)
    n_docs = len(words.offsets) - 1
    counts = np.diff(words.offsets)
    hashes, ok = grams(words, k)
    doc = np.repeat(np.arange(n_docs, dtype=np.uint64), counts)
    total = np.concatenate(([_U(0)], np.cumsum(mix64(words.hashes + mix64(_order(words, doc))), dtype=np.uint64)))
    node = mix64(total[words.offsets[1:]] - total[words.offsets[:-1]] + counts.astype(np.uint64))
    short = np.flatnonzero((counts > 0) & (counts < k)).astype(np.uint64)
    keys = np.concatenate([doc[ok] << _U(32) | hashes[ok] >> _U(32), short << _U(32) | node[short.astype(np.int64)] >> _U(32)])
    keys.sort()
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.uint32), times, node


def _order(words, doc: np.ndarray) -> np.ndarray:
    """Position of each word in its document."""
    return (np.arange(len(words.hashes)) - words.offsets[doc.astype(np.int64)]).astype(np.uint64) + _U(1)


def _sketch_rows(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(_COUNTERS, np.int64)
        docs = 0
        for batch in batches:
            texts = text_column(batch.column("text"))
            docs += len(texts)
            for lo, hi in byte_slices(texts):
                hashes = _shingles(texts.slice(lo, hi - lo), k)[1]
                held += np.bincount(hashes >> np.uint32(16), minlength=_COUNTERS)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(held[some], docs), pa.int64())], ["counter", "n"])

    return count


def shingle_weights(docs: DataFrame, options: NearDuplicates = NearDuplicates()) -> np.ndarray:
    """Damped idf per counter (a fixed number of them), from the document frequencies of the whole table."""
    sketch = docs.select("text").mapInArrow(_sketch_rows(options.shingle), "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    rows = sketch.toArrow()  # at most _COUNTERS + 1 rows
    at, n = rows["counter"].to_numpy(), rows["n"].to_numpy()
    counts = np.zeros(_COUNTERS, np.int64)
    counts[at[at >= 0]] = n[at >= 0]
    total = int(n[at < 0].sum())
    base = float(np.median(counts))
    noise = 1.0 + 6.0 * np.sqrt(base + 1.0)
    seen = np.maximum(counts - base, noise)
    idf = np.log(np.maximum((total + 1.0) / seen, 1.0)) / np.log(total + 2.0)
    return 1.0 + options.idf_strength * idf


class _Sampler:
    """Consistent weighted samples of one worker; the most common weight uses precomputed tables."""

    def __init__(self, weights: np.ndarray, options: NearDuplicates):
        rng = np.random.default_rng(options.seed)
        shape = (_ROWS, options.bands * options.rows)
        self.rate = rng.gamma(2.0, 1.0, shape)
        self.log_c = np.log(rng.gamma(2.0, 1.0, shape))
        self.shift = rng.random(shape)
        values, n = np.unique(weights, return_counts=True)
        self.common = values[n.argmax()]
        self.key, self.step = self._keys(np.arange(_ROWS), np.full(_ROWS, np.log(self.common)))
        self.options = options

    def _keys(self, row: np.ndarray, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample values as sortable high halves, and the steps t, hashed, to mix into the low halves."""
        rate, shift = self.rate[row], self.shift[row]
        t = np.floor(log_weight[:, None] / rate + shift)
        value = (self.log_c[row] - rate * (t - shift) - rate).astype(np.float32)
        raw = value.view(np.uint32)
        sortable = np.where(raw >> 31 == 1, ~raw, raw | np.uint32(1 << 31)).astype(np.uint64)
        return sortable << _U(32), (t.astype(np.int64).astype(np.uint64) * _U(0x9E3779B1)) & _U(0xFFFFFFFF)

    def bands(self, doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
        """Band hashes per document; documents without shingles get zeros."""
        width = self.options.bands * self.options.rows
        best = np.full((n_docs, width), np.iinfo(np.uint64).max, np.uint64)
        row = (mix64(hashes.astype(np.uint64)) & _U(_ROWS - 1)).astype(np.int64)
        for lo in range(0, len(hashes), 8192):
            at = slice(lo, lo + 8192)
            keys, steps = self.key[row[at]], self.step[row[at]]
            rare = np.flatnonzero(weight[at] != self.common)
            if len(rare):
                keys[rare], steps[rare] = self._keys(row[at][rare], np.log(weight[at][rare]))
            keys |= (hashes[at].astype(np.uint64)[:, None] + steps) & _U(0xFFFFFFFF)
            own = doc[at]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            best[own[first]] = np.minimum(best[own[first]], np.minimum.reduceat(keys, first, axis=0))
        samples = mix64(best & _U(0xFFFFFFFF)).reshape(n_docs, self.options.bands, self.options.rows)
        out = np.zeros((n_docs, self.options.bands), np.uint64)
        for i in range(self.options.rows):
            out = mix64(out * _U(0x9E3779B97F4A7C15) + samples[:, :, i])
        return out


def _signatures(docs: DataFrame, weights, options: NearDuplicates) -> DataFrame:
    """Per row: row key, doc_id, node (hash of the words; null without words) and its band hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        own = _Sampler(table, options)
        for batch in batches:
            texts = text_column(batch.column("text"))
            for lo, hi in byte_slices(texts):
                doc, hashes, times, node = _shingles(texts.slice(lo, hi - lo), options.shingle)
                weight = times * table[hashes >> np.uint32(16)]
                bands = own.bands(doc, hashes, weight, hi - lo)
                some = np.zeros(hi - lo, bool)
                some[doc] = True
                flat = pa.array(bands.view(np.int64).ravel())
                offsets = pa.array(np.arange(hi - lo + 1) * options.bands, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(lo, hi - lo),
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(node.view(np.int64), pa.int64(), mask=~some),
                        pa.ListArray.from_arrays(offsets, flat),
                    ],
                    ["row", "doc_id", "node", "bands"],
                )

    source = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(sign, "row bigint, doc_id bigint, node bigint, bands array<bigint>")


def _shingle_sets(docs: DataFrame, options: NearDuplicates) -> DataFrame:
    """Per row with words: node and its shingles as bytes (32-bit hashes ascending, then times)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch.column("text"))
            for lo, hi in byte_slices(texts):
                doc, hashes, times, node = _shingles(texts.slice(lo, hi - lo), options.shingle)
                ends = np.searchsorted(doc, np.arange(hi - lo + 1))
                keep, content = [], []
                for i in range(hi - lo):
                    a, b = ends[i], ends[i + 1]
                    if b > a:
                        keep.append(i)
                        more = b"" if (times[a:b] == 1).all() else times[a:b].astype("<u4").tobytes()
                        content.append(np.uint32(b - a).tobytes() + hashes[a:b].astype("<u4").tobytes() + more)
                yield pa.RecordBatch.from_arrays([pa.array(node[keep].view(np.int64), pa.int64()), pa.array(content, pa.binary())], ["node", "shingles"])

    return docs.select("text").mapInArrow(find, "node bigint, shingles binary")


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u4", n, 4), np.frombuffer(raw, "<u4", n, 4 + 4 * n) if len(raw) > 4 + 4 * n else np.ones(n, np.uint32)


def weighted_similarity(a: bytes, b: bytes, weights: np.ndarray) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two shingle sets."""

    (ha, ta), (hb, tb) = _unpack(a), _unpack(b)
    wa, wb = ta * weights[ha >> np.uint32(16)], tb * weights[hb >> np.uint32(16)]
    place = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[place] == ha
    common = float(np.minimum(wa[both], wb[place[both]]).sum())
    n = int(both.sum())
    return common / (float(wa.sum() + wb.sum()) - common), n / (len(ha) + len(hb) - n)


def _verified(pairs: DataFrame, sets: DataFrame, weights, options: NearDuplicates) -> DataFrame:
    """Pairs (a, b) whose weighted Jaccard similarity, or plain one, reaches the threshold."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            keep = [
                max(weighted_similarity(x.as_py(), y.as_py(), table)) >= options.threshold
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(judge, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, component (its smallest node).

    Each round takes the smallest label among the neighbours and then the label's own label, until nothing
    changes; the labels are cut after each round.
    """
    links = links.select("a", "b").where("a <> b")
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    jump = False
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        if jump:  # stars need no jumps, so the first round goes without
            top = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
            step = step.join(top, "label", "left").select("node", "old", F.coalesce("up", "label").alias("label"))
        step = cut(step)
        if step.where("label <> old").limit(1).count() == 0:
            return step.select("node", F.col("label").alias("component"))
        labels, jump = step.select("node", "label"), True


def _first_pairs(members: DataFrame) -> DataFrame:
    """Each node with at most two leaders of its buckets: the most central one, and the most copied one."""
    weight = members.groupBy("node").agg(F.sum(F.col("n") * F.col("times")).alias("weight"))
    members = members.join(weight, "node")
    central, copied = F.struct(-F.col("weight"), F.col("rep"), F.col("node")), F.struct(-F.col("copies"), F.col("rep"), F.col("node"))
    leaders = members.groupBy("slot", "band").agg(F.min(central).alias("central"), F.min(copied).alias("many"))
    per_node = members.join(leaders, ["slot", "band"]).groupBy("node").agg(F.min("central").alias("central"), F.min("many").alias("many"))
    return per_node.select("node", F.explode(F.array("central.node", "many.node")).alias("other")).where("node <> other")


def _cells(members: DataFrame, classes: DataFrame, part: int) -> DataFrame:
    """Cells that compare all pairs of a bucket that lie in different classes: cell, is_row, is_column, node, class.

    A bucket's nodes outside its largest class are dealt into parts by hash, and so is the largest class. Every part
    outside it meets every such part and every part of the largest class, each meeting in a cell of its own.
    """
    own = members.select("slot", "band", "node").join(classes.select("node", "component"), "node", "left")
    own = own.select("slot", "band", "node", F.coalesce("component", "node").alias("class"))
    sizes = own.groupBy("slot", "band", "class").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("slot", "band").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("several")).where("several > 1")
    count = lambda n: F.when(F.col("n") <= part, F.lit(1)).otherwise(F.ceil(n / part)).cast("int")
    buckets = buckets.select("slot", "band", F.col("top.class").alias("main"), F.col("n") <= part, count(F.col("n") - F.col("top.n")).alias("p"), count(F.col("top.n")).alias("q"))
    buckets = buckets.toDF("slot", "band", "main", "single", "p", "q")
    rows = own.join(buckets, ["slot", "band"]).withColumn("in_main", F.col("class") == F.col("main"))
    at = F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("q")).otherwise(F.col("p"))).cast("int")
    rows = rows.withColumn("at", at)
    cell = lambda i, j, row, column: F.struct(i.alias("i"), j.alias("j"), row.alias("is_row"), column.alias("is_column"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    met = F.when(F.col("single"), F.array(cell(zero, zero, ~F.col("in_main"), yes)))
    met = met.when(F.col("in_main"), F.transform(F.sequence(zero, F.col("p") - 1), lambda i: cell(i, F.col("p") + F.col("at"), no, yes)))
    others = F.transform(
        F.sequence(zero, F.col("p") + F.col("q") - 1),
        lambda j: cell(F.least(j, F.col("at")), F.greatest(j, F.col("at")), j >= F.col("at"), j <= F.col("at")),
    )
    rows = rows.select("slot", "band", "node", "class", F.explode(met.otherwise(others)).alias("c"))
    return rows.select(F.xxhash64("slot", "band", "c.i", "c.j").alias("cell"), "c.is_row", "c.is_column", "node", "class")


def cell_links(cell: list[tuple[bool, bool, int, int, bytes]], table: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """Links between classes over all (row, column) pairs of a cell of (is_row, is_column, node, class, shingles).

    Links that join what other links of the cell join already are left out.
    """
    parent: dict[int, int] = {x[3]: x[3] for x in cell}
    left = len(parent)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    rows, columns = [x for x in cell if x[0]], [x for x in cell if x[1]]
    small = len(rows) * len(columns) <= 64
    if not small:
        sets = [_unpack(x[4]) for x in columns]
        doc = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
        hashes, times = np.concatenate([h for h, _ in sets]), np.concatenate([t for _, t in sets])
        order = np.argsort(hashes, kind="stable")
        doc, hashes, times = doc[order], hashes[order], times[order]
        size = np.bincount(doc, minlength=len(sets))
        whole = np.bincount(doc, times * table[hashes >> np.uint32(16)], len(sets))
        known, first = np.unique(hashes, return_index=True)
        ends = np.append(first[1:], len(hashes))
    for _, _, node, group, raw in rows:
        if left < 2:
            return
        if small:
            near = (x for x in columns if find(x[3]) != find(group) and max(weighted_similarity(raw, x[4], table)) >= threshold)
        else:
            own, n = _unpack(raw)
            weight = table[own >> np.uint32(16)]
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[place] == own
            start, long = first[place[hit]], (ends - first)[place[hit]]
            at = np.repeat(start - np.cumsum(long) + long, long) + np.arange(long.sum())
            both = np.bincount(doc[at], minlength=len(columns))
            common = np.bincount(doc[at], np.minimum(np.repeat(n[hit], long), times[at]) * np.repeat(weight[hit], long), len(columns))
            alike = np.maximum(both / (len(own) + size - both), common / (float((n * weight).sum()) + whole - common))
            near = (columns[i] for i in np.flatnonzero(alike >= threshold))
        for _, _, other, other_group, _ in near:
            a, b = find(group), find(other_group)
            if a != b:
                parent[a] = b
                left -= 1
                yield min(node, other), max(node, other)


def _links_of_cells(cells: DataFrame, weights, options: NearDuplicates) -> DataFrame:
    """Links (a, b) of all cells (cell, is_row, is_column, node, class, shingles); a task holds one cell at a time."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, key, held, found = weights.value, None, [], []
        for batch in batches:
            names = ("cell", "is_row", "is_column", "node", "class", "shingles")
            for cell, *rest in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if cell != key:
                    found.extend(cell_links(held, table, options.threshold))
                    key, held = cell, []
                held.append(rest)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
            found = []
        found.extend(cell_links(held, table, options.threshold))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(judge, "a bigint, b bigint")


def near_duplicate_rows(docs: DataFrame, options: NearDuplicates = NearDuplicates()) -> DataFrame:
    """Per row of ``docs``: row key (xxhash64 of doc_id and text), doc_id, node and component (null: no links)."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(shingle_weights(docs, options))
    rows = cut(_signatures(docs, weights, options))
    nodes = rows.where("node is not null").groupBy("node", "bands").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    members = nodes.select("node", "rep", "copies", F.posexplode("bands").alias("slot", "band"))
    alike = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"set{i}") for i in (0, 1)]
    buckets = members.groupBy("slot", "band").agg(F.count("*").alias("n"), *alike).where("n > 1")
    # buckets of the same nodes count once
    buckets = buckets.groupBy("n", "set0", "set1").agg(F.min(F.struct("slot", "band")).alias("of"), F.count("*").alias("times")).select("of.*", "n", "times")
    members = cut(members.join(buckets, ["slot", "band"]))
    sets = cut(_shingle_sets(docs, options).join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    pairs = _first_pairs(members).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = cut(_verified(pairs, sets, weights, options))
    cells = _cells(members, components(links), options.part).join(sets, "node")
    more = cut(_links_of_cells(cells, weights, options))
    classes = components(links.unionByName(more))
    frequent = F.col("copies") > rows.count() / HEAVY  # at most HEAVY nodes
    known = nodes.select("node", "copies").join(classes, "node")
    return join_heavy(rows.select("row", "doc_id", "node"), known, "node", "component", frequent)


def near_duplicate_classes(docs: DataFrame, options: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class) and class_size (rows of the class).

    Documents with equal words are one class from the start. A text without words (null, empty, blank) is
    a class of its own, also beside others like it. Null ids take part; a class of only null ids has
    a null class_id. Repeated rows count as documents. Columns other than doc_id and text are not read. An empty
    table gives no rows. Texts are worked on whole: a text's length is bounded only by one task's memory for it.
    """
    rows = near_duplicate_rows(docs, options).withColumn("own", F.coalesce("component", "node"))
    alone = rows.where("own is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    per_class = rows.where("own is not null").groupBy("own").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    per_class = cut(per_class.select("own", F.struct("class_id", "class_size").alias("found")))
    total = per_class.agg(F.sum("found.class_size").alias("n")).first().n or 0
    found = join_heavy(rows.where("own is not null").select("doc_id", "own"), per_class, "own", "found", F.col("found.class_size") > total / HEAVY)
    return found.select("doc_id", "found.class_id", "found.class_size").unionByName(alone)


def drop_near_duplicates(docs: DataFrame, options: NearDuplicates = NearDuplicates()) -> DataFrame:
    """``docs`` with one row per class, the one of the smallest doc_id (nulls first); texts without words all stay.

    Rows that are equal in doc_id and text count as one. Other columns come through whatever their names; an
    empty table stays empty.
    """
    rows = near_duplicate_rows(docs, options).withColumn("own", F.coalesce("component", "node"))
    chosen = rows.where("own is not null").groupBy("own").agg(F.min_by("row", F.struct("doc_id", "row")).alias("row")).select("row")
    blank = rows.where("own is null").select("row").distinct()
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return keyed.join(chosen.unionByName(blank), "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
