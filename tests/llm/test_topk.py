import math

import duckdb
import numpy as np
import pytest

from eventlens.llm.queries import QUERIES, SQL
from eventlens.llm.topk import ImpactIndex, exact_top_k

from .data import SF

SCHEMA = "vec_id bigint, embedding array<float>, score string"


def brute(rows, every=50, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])}
    return out


def rows_of(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert rows_of(QUERIES["op10_impact_ordered"](spark, SF)) == set(con.execute(SQL["op10_impact_ordered"]).fetchall())


@pytest.mark.parametrize("blocks", [{}, {"candidate_block": 16, "query_block": 4}])
def test_ties_nulls_lengths_and_few_rows(spark, blocks):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)], "clash") for i in range(120)]
    rows += [(200 + i, rows[3][1], None) for i in range(20)] + [(250, rows[0][1], None)]
    rows += [(300, [0.5, 0.25], None), (301, [0.5, -0.25], None), (302, None, None), (303, [1.0, None], None), (304, [float("nan"), 1.0], None)]
    rows += [(305, [float("inf"), 1.0], None), (350, [], None), (None, [0.1] * 8, None), (400, [0.0] * 8, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(exact_top_k(df, **blocks)) == brute(rows)
    assert exact_top_k(df.limit(0)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [1e6 + i, -3e5, float(i)], "") for i in range(0, 100, 10)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    assert rows_of(exact_top_k(df)) == brute(rows)


def test_index_holds_every_posting_once_by_descending_impact():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-9, 9, (50, 6)) * (rng.random((50, 6)) < 0.4)
    index = ImpactIndex.load(6, ImpactIndex.build(np.arange(50), vectors).row())
    assert np.array_equal(index.vectors(), vectors) and len(index.value) == (vectors != 0).sum()
    bounds = index.starts[:: index.dim]
    for s in range(len(index.rest)):
        own, later = np.abs(index.value[bounds[s] : bounds[s + 1]]), np.abs(index.value[bounds[s + 1] :])
        assert len(own) and own.min() > (later.max() if len(later) else 0) and index.rest[s] == (later.max() if len(later) else 0)
    assert np.allclose(index.unread()[-1], 0)


def test_search_stops_on_proof_and_stays_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(-200, 200, (4, 16))
    vectors = np.concatenate([base[rng.integers(0, 4, 600)] + rng.integers(-3, 3, (600, 16)), np.zeros((1, 16), np.int64)])
    index, read = ImpactIndex.build(np.arange(601), vectors), []
    queries = base[:2]
    for i, (members, scores) in enumerate(index.search(queries, np.array([0, 1]), 3)):
        true = vectors @ queries[i]
        true[i] = -(1 << 62)
        best = set(np.lexsort((np.arange(601), -true))[:3].tolist())
        assert best <= set(members.tolist()) and np.array_equal(scores, vectors[members] @ queries[i])
        read.append(len(members))
    assert max(read) < 601


def test_one_vector_and_zero_vectors(spark):
    one = spark.createDataFrame([(0, [0.5, 0.1], None)], SCHEMA)
    assert exact_top_k(one).count() == 0
    rows = [(i, [0.0, 0.0], None) for i in range(120)]
    assert rows_of(exact_top_k(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
