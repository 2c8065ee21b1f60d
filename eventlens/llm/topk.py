"""Exact top-k inner products over quantised vectors with an impact-ordered index, score at a time.

1. Components become integers (floor(scale * x)). Candidates are dealt to blocks by hash, and each block's index
   is built once and written to the shared folder: postings (vector, value) of the non-zero components, in
   ``segments`` of descending impact |value|, within a segment by dimension.
2. Queries meet every block in blocks of their own. Segment after segment is added to the scores of all queries
   that still run. What the unread postings can still add to a candidate is at most the next impact times the query's
   absolute sum, and at most the length of the query times the length of what is unread of the candidate. A
   query stops only when these bounds prove that candidates outside a small set cannot be among its k best.
3. That set is rescored exactly in integers; the blocks' best k are merged per query.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import shared_dir

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 4096
SEGMENTS = 6
_ASIDE = 512  # queries that are scored side by side
_PAIRS = 1 << 16


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or hold null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(F.forall(vector, finite), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _narrow(values: np.ndarray) -> np.ndarray:
    """The values in the smallest integer type that holds them."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    return values.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


@dataclass
class ImpactIndex:
    """Postings of one candidate block.

    ``vector`` and ``value`` hold the postings; those of dimension d in segment s are
    ``starts[s * dim + d]`` to ``starts[s * dim + d + 1]``. ``rest[s]`` is the largest impact after segment s.
    """

    ids: np.ndarray
    dim: int
    rest: np.ndarray
    starts: np.ndarray
    vector: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, segments: int = SEGMENTS) -> ImpactIndex:
        """Index of integer vectors (n, dim); segments hold equal shares of the postings, equal impacts stay together."""
        dim = vectors.shape[1]
        at, d = np.nonzero(vectors)
        value = vectors[at, d]
        size = np.abs(value)
        ordered = np.sort(size)[::-1]
        edges = np.unique(ordered[np.minimum(len(ordered) * np.arange(1, segments + 1) // segments, len(ordered)) - 1])[::-1] if len(ordered) else np.ones(1, np.int64)
        part = len(edges) - np.searchsorted(edges[::-1], size, side="right")
        order = np.lexsort((at, d, part))
        starts = np.searchsorted((part * dim + d)[order], np.arange(len(edges) * dim + 1))
        rest = np.append(ordered[np.minimum(starts[dim * np.arange(1, len(edges))], max(len(ordered) - 1, 0))], 0) if len(ordered) else np.zeros(1, np.int64)
        return cls(ids, dim, rest.astype(np.int64), starts.astype(np.int64), at[order].astype("<u4"), _narrow(value[order]))

    def row(self) -> dict[str, bytes]:
        parts = {"ids": self.ids.astype("<i8"), "rest": self.rest, "starts": self.starts, "vector": self.vector}
        return {k: v.tobytes() for k, v in parts.items()} | {"value": bytes([self.value.itemsize]) + self.value.tobytes()}

    @classmethod
    def load(cls, dim: int, row: dict[str, bytes]) -> ImpactIndex:
        ids, rest, starts = (np.frombuffer(row[k], "<i8") for k in ("ids", "rest", "starts"))
        return cls(ids, dim, rest, starts, np.frombuffer(row["vector"], "<u4"), np.frombuffer(row["value"], f"<i{row['value'][0]}", -1, 1))

    def vectors(self) -> np.ndarray:
        """The indexed vectors (n, dim), put together from the postings."""
        out = np.zeros((len(self.ids), self.dim), np.int64)
        out[self.vector, np.repeat(np.arange(len(self.starts) - 1) % self.dim, np.diff(self.starts))] = self.value
        return out

    def unread(self) -> np.ndarray:
        """Euclidean length of what of each vector lies after each segment (segments, n)."""
        square, out = np.zeros(len(self.ids)), []
        for s in reversed(range(len(self.rest))):
            out.append(np.sqrt(square))
            part = slice(self.starts[s * self.dim], self.starts[(s + 1) * self.dim])
            square = square + np.bincount(self.vector[part], self.value[part].astype(np.float64) ** 2, len(self.ids))
        return np.array(out[::-1]) * (1 + 1e-9)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query, candidate numbers and exact scores holding its k best; ``own`` are vec_ids to leave out, one a query."""
        n, vectors, unread = len(self.ids), self.vectors(), self.unread()
        top, reach = float(np.abs(self.value.astype(np.float64)).max(initial=1)), np.abs(queries.astype(np.float64)).sum(axis=1)
        most = top * reach.max(initial=1)
        kind = np.float32 if most < 1 << 24 else np.float64
        slack = 0.0 if most < 1 << 52 else most * 2.0**-44  # scores that floats round; members are rescored in integers
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        out: list = [None] * len(queries)
        going, asked, few = np.arange(len(queries)), queries.T.astype(kind), max(4 * k, n // 64)
        total = np.zeros((n, len(queries)), kind)
        for s, rest in enumerate(self.rest):
            for d in range(self.dim):
                part = slice(self.starts[s * self.dim + d], self.starts[s * self.dim + d + 1])
                if part.start < part.stop:
                    total[self.vector[part]] += self.value[part].astype(kind)[:, None] * asked[d]
            bound = np.minimum(reach[going, None] * float(rest), length[going, None] * unread[s]) + slack
            scores = total.T.astype(np.float64)
            scores[self.ids == own[going, None]] = -np.inf
            possible = np.isfinite(scores)
            if n > k:
                possible &= scores + bound >= np.partition(scores - bound, n - k, axis=1)[:, n - k, None]
            stop = (possible.sum(axis=1) <= few) | (s == len(self.rest) - 1)
            for i in np.flatnonzero(stop):
                members = np.flatnonzero(possible[i])
                out[going[i]] = members, vectors[members] @ queries[going[i]]
            if stop.any():
                going, asked, total = going[~stop], asked[:, ~stop], total[:, ~stop]
            if not len(going):
                break
        return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.chunked_array([c.flatten() for c in column.chunks], pa.int64()).to_numpy() if column.num_chunks else np.zeros(0, np.int64)
    return flat.reshape(-1, dim)


_INDEX = "dim int, c int, ids binary, rest binary, starts binary, vector binary, value binary"
_BEST = "query_id bigint, query_key bigint, vec_id bigint, score bigint"


def _build(segments: int):
    def build(block: pa.Table) -> pa.Table:
        dim, c = block["dim"][0].as_py(), block["c"][0].as_py()
        row = ImpactIndex.build(block["vec_id"].to_numpy(), _matrix(block["vector"], dim), segments).row()
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.table([pa.array([v], k) for v, k in zip([dim, c, *row.values()], kinds, strict=True)], ["dim", "c", *row])

    return build


def _block_best(k: int):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            index = ImpactIndex.load(dim, {c: left[c][0].as_py() for c in ("ids", "rest", "starts", "vector", "value")})
            queries, asked, keys = _matrix(right["vector"], dim), right["vec_id"].to_numpy(), right["key"].to_numpy()
            for lo in range(0, len(asked), _ASIDE):
                found = index.search(queries[lo : lo + _ASIDE], asked[lo : lo + _ASIDE], k)
                for i, (members, scores) in enumerate(found, lo):
                    pick = np.lexsort((index.ids[members], -scores))[:k]
                    values = np.full(len(pick), asked[i]), np.full(len(pick), keys[i]), index.ids[members][pick], scores[pick]
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
        whole = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in columns]
        return pa.table([pa.array(c, pa.int64()) for c in whole], [x.split()[0] for x in _BEST.split(", ")])

    return best


def exact_top_k(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    scale: int = 256,
    candidate_block: int = CANDIDATE_BLOCK,
    query_block: int = QUERY_BLOCK,
    segments: int = SEGMENTS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose vec_id is divisible by ``every``.

    Ties go to the smaller vec_id. Vectors that are null, empty or hold null or non-finite components, and rows with
    a null vec_id, take no part; vectors meet those of their own length only. A query leaves out all rows of its own
    vec_id. Repeated rows are candidates each; a repeated query row is asked once, and query rows that share a vec_id
    but not the vector are asked each. Columns other than vec_id and embedding are not read. An empty table
    gives no rows. A task holds one block's index and one block of queries, however long the vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", quantised(F.col("embedding"), scale).alias("vector")).where("vec_id is not null and size(vector) > 0")
    rows = rows.select("vec_id", "vector", F.size("vector").alias("dim"), F.xxhash64("vec_id", "vector").alias("key"))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"])
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    n_left, n_right = max(1, -(-sizes.n // candidate_block)), max(1, -(-sizes.q // query_block))
    place = lambda n: F.pmod(F.col("key"), F.lit(n)).cast("int")
    path = f"{shared_dir(spark)}/impact-index-{uuid.uuid4().hex}"
    blocks = rows.select("dim", place(n_left).alias("c"), "vec_id", "vector").groupBy("dim", "c").applyInArrow(_build(segments), _INDEX)
    blocks.write.parquet(path)
    pairs = min(n_left * n_right, _PAIRS)
    meet = ["dim", "c", "q"]
    left = spark.read.schema(_INDEX).parquet(path).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right = asked.withColumn("q", place(n_right)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)))).select(*meet, "vec_id", "key", "vector")
    left, right = left.repartition(pairs, *meet), right.repartition(pairs, *meet)
    found = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInArrow(_block_best(k), _BEST)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
