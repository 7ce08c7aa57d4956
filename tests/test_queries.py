"""Every registered query against its SQL, on the smallest tables."""

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillon.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if sql))
def test_against_sql(spark, duck, name):
    query, sql = REGISTRY[name]
    df = query(spark, FOLDER)
    out = duck.execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(repr(tuple(norm(v) for v in r)) for r in out.fetchall())
    have = Counter(repr(tuple(norm(v) for v in r)) for r in df.select(*names).collect())
    assert have == want


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if not sql))
def test_without_sql(spark, name):
    df = REGISTRY[name][0](spark, FOLDER)
    assert df.count() > 0
