"""Packing: every text once, no limit exceeded, little room left."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm.packing import count_tokens, pack, pack_shard, pack_summary


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 50)), max_size=60), st.integers(1, 6))
def test_shard_limits(items, segments):
    demands = np.array([(t, 1, min(t, w)) for t, w in items], dtype=np.int64).reshape(-1, 3)
    limits = np.array([50, segments, 40])
    demands[:, 2] = np.minimum(demands[:, 2], 40)
    at = pack_shard(demands, limits)
    assert len(at) == len(items)
    for c in set(at.tolist()):
        assert (demands[at == c].sum(axis=0) <= limits).all()
    assert sorted(set(at.tolist())) == list(range(len(set(at.tolist()))))


def check(packed, counted, capacity, segments):
    by = {}
    for r in packed:
        by.setdefault(r.container, []).append(r)
    assert all(sum(r.tokens for r in rs) <= capacity and len(rs) <= segments for rs in by.values())
    placed = {}
    for r in packed:
        placed.setdefault(r.doc_id, []).append((r.piece, r.offset, r.tokens))
    want = {r.doc_id: r.tokens for r in counted if r.tokens}
    assert set(placed) == set(want)
    for d, parts in placed.items():
        parts.sort()
        assert [p for p, *_ in parts] == list(range(len(parts))) and sum(t for *_, t in parts) == want[d]
        assert all(o == sum(t for *_, t in parts[:i]) for i, (_, o, _) in enumerate(parts))
        assert len(parts) == 1 or want[d] > capacity


@pytest.mark.parametrize("shard", [20_000, 50])
def test_documents(spark, shard):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted = count_tokens(docs).cache()
    packed = pack(counted, shard_items=shard)
    check(packed.collect(), counted.collect(), 2048, 256)
    assert pack_summary(packed).first().unused_share < 0.03


def test_limits_and_dirt(spark):
    rows = [(i, int(t), int(l)) for i, (t, l) in enumerate([(1, 0), (10, 10), (10, 0), (0, 0), (100, 100), (205, 5), (99, 99), (1, 1)])] + [(50, None, None), (51, 7, None)]
    counted = spark.createDataFrame(rows, "doc_id int, tokens long, loss_tokens long").withColumn("container", F.lit("x")).withColumn("nr", F.lit(1)).withColumn("i", F.lit(2))
    packed = pack(counted, capacity=100, max_segments=2).collect()
    check(packed, [r for r in counted.collect() if r.tokens], 100, 2)
    assert pack(counted.limit(0)).count() == 0 and pack_summary(pack(counted.limit(0))).first().containers == 0
    tight = pack(counted, capacity=100, max_segments=3, max_loss=40).collect()
    by = {}
    for r in tight:
        by[r.container] = by.get(r.container, 0) + r.loss_tokens
    assert max(by.values()) <= 40


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "user: hello there\nbot: fine, thanks"), (2, None), (3, ""), (4, "<|endoftext|> é 日本 " + "x" * 5000)], "doc_id int, text string")
    out = {r.doc_id: (r.tokens, r.loss_tokens) for r in count_tokens(df).collect()}
    assert out[2] == out[3] == (0, 0) and 0 < out[1][1] < out[1][0] and out[4][0] > 10


def test_repeated_keys(spark):
    df = spark.createDataFrame([(1, 60, 60), (1, 60, 60)], "doc_id int, tokens long, loss_tokens long")
    assert len({r.container for r in pack(df, capacity=100).collect()}) == 2
