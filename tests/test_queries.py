"""Every base query with SQL against DuckDB at the smallest size."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

from waymark import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    sql = duck.sql(registry.ORACLE[name])
    assert sorted(sql.columns) == cols
    at = [sql.columns.index(c) for c in cols]
    assert Counter(tuple(norm(r[c]) for c in cols) for r in df.collect()) == Counter(tuple(norm(r[i]) for i in at) for r in sql.fetchall())
