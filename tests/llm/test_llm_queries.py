"""The registered queries of this subpackage against their SQL, on the smallest tables (recall on more than a few pairs)."""

from pathlib import Path

import duckdb
import pytest

from quillon.llm import queries as Q

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    folder = LARGER if name == "p2_recall" else SMALL
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    out = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in out.description]
    df = Q.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, out.fetchall()))
