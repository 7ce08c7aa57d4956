"""Top n per group: rule, ties, dirt, histogram path."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.llm.topn import top_n

SCHEMA = "g string, i string, s double"


def brute(data, n):
    best = {}
    for g, i, s in data:
        if g is None or i is None or s is None or s != s:
            continue
        best[(g, i)] = max(best.get((g, i), s), s)
    out = set()
    for g in {g for g, _ in best}:
        order = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:n]
        out |= {(g, i, -s, r) for r, (s, i) in enumerate(order, 1)}
    return out


def got(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("n,sent", [(1, 1), (3, 1), (10, 250_000), (40, 2), (70, 1)])
def test_brute_force(spark, n, sent):
    rnd = random.Random(n)
    values = [0.0, 0.25, 0.5, 0.5, 1.0, 1.34, -2.0, float("inf"), float("-inf"), 1e300, None, float("nan")]
    data = [(rnd.choice(["a", "b", "", "ü", None]), rnd.choice([None, *map(str, range(150))]), rnd.choice([*values, rnd.random()])) for _ in range(4000)]
    assert got(top_n(spark.createDataFrame(data, SCHEMA), "g", "i", "s", n, sent)) == brute(data, n)


def test_hot_group_survivors_are_enough(spark):
    """One group with most rows, whose best item has most of its rows: the threshold counts items, not rows."""
    data = [("hot", "top", 0.99)] * 3000 + [("hot", f"i{k:04d}", k / 5000) for k in range(3000)] + [(f"g{k % 50}", str(k), k / 100) for k in range(500)]
    assert got(top_n(spark.createDataFrame(data, SCHEMA), "g", "i", "s", 10)) == brute(data, 10)


def test_empty_and_clashing_columns(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "g", "i", "s").count() == 0
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0)], "k1 string, rank string, at double").withColumn("g", F.lit(0)).withColumn("s", F.lit("t"))
    out = top_n(df, "k1", "rank", "at", 1)
    assert got(out) == {("a", "x", 1.0, 1)}
    with pytest.raises(ValueError):
        top_n(df, "k1", "rank", "at", 0)


def test_only_nulls(spark):
    assert top_n(spark.createDataFrame([(None, None, None), ("a", None, 1.0), ("a", "b", float("nan"))], SCHEMA), "g", "i", "s").count() == 0


def test_thresholds_of_all_groups(spark):
    """Small groups and scores of any size are cut down to little more than n before they are ranked."""
    data = [(f"g{k % 100}", f"i{k}", 1e9 + k / 7) for k in range(6000)] + [("big", f"b{k}", 1e-9 * k) for k in range(6000)]
    df = spark.createDataFrame(data, SCHEMA)
    out = top_n(df, "g", "i", "s", 10)
    assert got(out) == brute(data, 10)
    from quillon.llm import topn

    held = []
    plain = topn._attach
    topn._attach = lambda keyed, table, heavy, how: (lambda r: (held.append(r.where("at IS NULL OR s >= at").count()) if "at" in r.columns else None, r)[1])(plain(keyed, table, heavy, how))
    try:
        top_n(df, "g", "i", "s", 10)
    finally:
        topn._attach = plain
    assert 1010 <= held[0] <= 2000
