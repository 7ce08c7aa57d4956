"""Orphan references: rules, dirt, skew paths, agreement with SQL on the test tables."""

import json

import duckdb
import pytest

from quillon.operators.references import json_strings, orphan_counts, orphan_references
from quillon.schema import CHUNKS, COMPRESSION, DEPENDENCIES, ROUTING


def chunk(i, t, **more):
    return (i, "file", "code", "x", t, None, None, 1, None, "{}")


@pytest.fixture
def tables(spark, at):
    chunks = spark.createDataFrame([chunk("a", at(10)), chunk("a", at(20)), chunk("b", at(5)), chunk("t", None), chunk(None, at(1))], CHUNKS)
    edges = spark.createDataFrame([("a", "gone", "uses", 1.0), ("a", "gone", "uses", None), (" A ", "B", "uses", 0.5), ("a", "", "uses", 1.0), (None, "lost", None, 1.0), ("self", "self", "loop", 1.0)], DEPENDENCIES)
    cache = spark.createDataFrame([("c1", "t", "s", "[]", "[]", json.dumps(["a", " GONE ", None, "", "gone", "b"]), at(15)), ("c2", "t", "s", "[]", "[]", '["a", "cut', at(15)), ("c3", "t", "s", "[]", "[]", None, at(15)), ("c4", "t", "s", "[]", "[]", '{"a": 1}', at(15)), ("c5", "t", "s", "[]", "[]", "[]", at(15)), ("c6", "t", "s", "[]", "[]", '["a"]', None)], COMPRESSION)
    routing = spark.createDataFrame([(1, "a", "hot", 1.0, "[]", "q", at(9)), (1, "a", "hot", 1.0, "[]", "q", at(9)), (2, "a", "hot", 1.0, "[]", "q", at(10)), (3, "gone", "hot", 1.0, "[]", "q", at(40)), (4, None, "hot", 1.0, "[]", "q", at(1)), (5, "t", "hot", 1.0, "[]", "q", at(1)), (6, "b", "hot", 1.0, "[]", "q", None)], ROUTING)
    return chunks, edges, cache, routing


EXPECTED = {
    ("routing_history", "1", "chunkId", "a", "2025-01"),
    ("routing_history", "3", "chunkId", "gone", "2025-02"),
    ("compression_cache", "c1", "sourceChunkIds", "gone", "2025-01"),
    ("dependencies", "a>gone>uses", "toId", "gone", "2025-01"),
    ("dependencies", ">lost>", "toId", "lost", "unknown"),
    ("dependencies", "self>self>loop", "fromId", "self", "unknown"),
    ("dependencies", "self>self>loop", "toId", "self", "unknown"),
}


@pytest.mark.parametrize("heavy", [20_000, 4, 1])
def test_rules_on_every_path(tables, heavy):
    """With all ids heavy, some or none the same is found."""
    got = [tuple(r) for r in orphan_references(*tables, heavy).collect()]
    assert len(got) == len(set(got))
    assert set(got) == EXPECTED


def test_counts(tables, rows):
    counts = {(r.refTable, r.month): (r.n_references, r.n_ids) for r in orphan_counts(orphan_references(*tables)).collect()}
    assert counts[("dependencies", "unknown")] == (3, 2)
    assert counts[("routing_history", "2025-01")] == (1, 1)


def test_empty_tables_and_extra_columns(spark, tables):
    from pyspark.sql import functions as F

    empty = [spark.createDataFrame([], s) for s in (CHUNKS, DEPENDENCIES, COMPRESSION, ROUTING)]
    assert orphan_references(*empty).count() == 0
    clashing = [t.withColumn("chunk_id", F.lit("x")).withColumn("ref_table", F.lit("y")).withColumn("n", F.lit(0)).withColumn("first_ts", F.lit(1)) for t in tables]
    assert {tuple(r) for r in orphan_references(*clashing).collect()} == EXPECTED
    assert orphan_references(empty[0], *tables[1:]).where("chunkId = 'a'").count() > 0


def test_json_arrays(spark):
    cases = ['["a"]', ' ["a", null] ', '["a"', "['a']", '["a"] x', "[]", "", None, '"a"', "[1]", "[a]"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "c string").select(json_strings(__import__("pyspark.sql.functions", fromlist=["col"]).col("c"))).collect()]
    assert got[:2] == [["a"], ["a", None]] and got[5] == []
    assert [g for i, g in enumerate(got) if i in (2, 3, 4, 6, 7, 8, 10)] == [None] * 7


def test_hot_key(spark, at):
    """One id with most rows: found once per row, with any of the paths."""
    chunks = spark.createDataFrame([chunk("a", at(1))], CHUNKS)
    routing = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 7)) chunkId", "'hot' tier", "1.0D score", "'[]' reasons", "'q' taskText", "timestamp'2025-03-01' timestamp")
    none = [spark.createDataFrame([], s) for s in (DEPENDENCIES, COMPRESSION)]
    for heavy in (20_000, 5, 1):
        assert orphan_references(chunks, *none, routing, heavy).count() == 3000


def test_heavy_ids_are_few_and_not_shuffled(spark):
    from quillon.operators.references import heavy_ids

    groups = spark.createDataFrame([("hot", 40), ("hot", 20), *((f"k{i}", 1) for i in range(40))], "chunk_id string, n long")
    assert [r.h_id for r in heavy_ids(groups, 4).collect()] == ["hot"]
    assert heavy_ids(groups, 50).count() <= 50 and heavy_ids(groups.limit(0), 50).count() == 0


def test_against_sql(spark):
    from quillon.queries import REGISTRY

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("chunks", "dependencies", "compression_cache", "routing_history"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name in ("p4_found", "p4_counts"):
        query, sql = REGISTRY[name]
        df = query(spark, folder)
        out = con.execute(sql)
        names = [c[0] for c in out.description]
        assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, out.fetchall()))
