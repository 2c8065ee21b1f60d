"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from eventlens.queries import QUERIES, SQL

SF = os.environ.get("EVENTLENS_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None).isoformat()
    return x if x is None or isinstance(x, (bool, int)) else str(x)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in SQL:
        found = duck.execute(SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert normal(rows, df.columns) == normal(found.fetchall(), columns)
