"""Nearest neighbours: recall against brute force, copies, ties, dirt, crowded buckets."""

import datetime

import numpy as np
import pytest

from quillon.llm.neighbours import nearest, neighbour_pairs

SCHEMA = "chunkId string, embedding array<float>, model string, dimensions int, timestamp timestamp"
T0 = datetime.datetime(2025, 1, 1)


def brute(data, k=5, least=0.85):
    latest = {}
    for i, v, m, d, t in data:
        if i is None or m is None or v is None or len(v) != d or not all(x is not None and np.isfinite(x) for x in v) or not any(v):
            continue
        if i not in latest or (t or T0.min) > latest[i][2]:
            latest[i] = (m, np.asarray(v, dtype=np.float32).astype(float), t or T0.min)
    out = set()
    for i, (m, v, _) in latest.items():
        near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), j) for j, (n, w, _) in latest.items() if j != i and n == m and len(w) == len(v))
        out |= {(min(i, j), max(i, j)) for s, j in near[:k] if -s >= least}
    return out


def pairs(spark, data, **kw):
    return {tuple(r) for r in neighbour_pairs(nearest(spark.createDataFrame(data, SCHEMA), **kw)).collect()}


def clusters(n, size, dim, spread, seed, model="m"):
    rnd = np.random.default_rng(seed)
    out = []
    for c in range(n):
        centre = rnd.standard_normal(dim)
        out += [(f"{model}{c:03d}-{k:03d}", (centre + spread * rnd.standard_normal(dim)).astype(np.float32).tolist(), model, dim, T0) for k in range(size)]
    return out


@pytest.mark.parametrize("spread", [0.05, 0.3])
def test_recall(spark, spread):
    data = clusters(25, 12, 64, spread, 1) + clusters(10, 8, 48, spread, 2, "n")
    want, have = brute(data), pairs(spark, data)
    assert len(want & have) / len(want) >= 0.95 and len(want & have) / max(1, len(have)) >= 0.95


def test_copies_and_ties(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    data = [(f"c{k:02d}", v, "m", 3, T0) for k in range(20)] + [("scaled", [2.0, 4.0, 6.0], "m", 3, T0), ("near", w, "m", 3, T0), ("alone", [-1.0, 0.0, 0.0], "m", 3, T0)]
    assert pairs(spark, data) == brute(data)


def test_dirt(spark):
    data = [("a", [1.0, 0.0], "m", 2, T0), ("b", [1.0, 0.1], "m", 2, T0), ("b", [0.0, 1.0], "m", 2, T0 - datetime.timedelta(1)), ("z", [0.0, 0.0], "m", 2, T0), ("n", None, "m", 2, T0), ("e", [], "m", 0, T0), ("s", [1.0], "m", 2, T0), ("inf", [float("inf"), 1.0], "m", 2, T0), ("nan", [float("nan"), 1.0], "m", 2, T0), (None, [1.0, 0.0], "m", 2, T0), ("x", [1.0, 0.0], None, 2, T0), ("hole", [None, 1.0], "m", 2, T0), ("other", [1.0, 0.0], "o", 2, T0), ("t", [1.0, 0.05], "m", 2, None), ("big", [3e38, 1e37], "m", 2, T0), ("tiny", [1e-38, 1e-39], "m", 2, T0)]
    assert pairs(spark, data) == brute(data)
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame(data[3:6], SCHEMA)).count() == 0


def test_crowded_buckets(spark):
    """A dense group is hashed again at half the width instead of being joined as a whole."""
    data = clusters(1, 300, 32, 0.02, 3) + clusters(20, 5, 32, 0.2, 4, "q")
    want, have = brute(data), pairs(spark, data, bucket_rows=60)
    assert len(want & have) / len(want) >= 0.9


def test_ranks_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(clusters(2, 4, 16, 0.1, 5), SCHEMA).withColumn("item", F.lit(1)).withColumn("cid", F.lit(2)).withColumn("v", F.lit(3))
    out = nearest(df).collect()
    assert {r["rank"] for r in out} == {1, 2, 3}
    for i in {r["item"] for r in out}:
        sims = [r["similarity"] for r in sorted((r for r in out if r["item"] == i), key=lambda r: r["rank"])]
        assert sims == sorted(sims, reverse=True)


def test_crowded_group_of_near_copies(spark):
    """A third of all vectors in one group, at cosines of about 0.87: its neighbours are found as elsewhere."""
    rnd = np.random.default_rng(6)
    centre = rnd.standard_normal(128)
    group = [(f"g{k:04d}", (centre + s * rnd.standard_normal(128)).astype(np.float32).tolist(), "m", 128, T0) for k, s in enumerate(rnd.uniform(0.36, 0.41, 600))]
    data = group + clusters(240, 5, 128, 0.3, 7, "q")
    want, have = brute(data), pairs(spark, data, bucket_rows=10)
    dense = {p for p in want if p[0][0] == "g"}
    assert len(dense & have) / len(dense) >= 0.97 and len(want & have) / len(have) >= 0.97


def test_more_hashes_lose_nothing(spark):
    """What is used from a million classes on finds as many pairs at cosine 0.86."""
    rnd, data = np.random.default_rng(8), []
    for n in range(300):
        x, y = np.linalg.qr(rnd.standard_normal((128, 2)))[0].T
        data += [(f"{n:03d}a", x.astype(np.float32).tolist(), "m", 128, T0), (f"{n:03d}b", (0.86 * x + (1 - 0.86**2) ** 0.5 * y).astype(np.float32).tolist(), "m", 128, T0)]
    assert len(pairs(spark, data, hashes=10)) / 300 >= 0.87
