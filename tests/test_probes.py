"""Robustness probes and generated tasks."""

from pyspark.sql import functions as F

from quillon.operators import probes as P
from quillon.schema import CHUNKS, SYMBOLS


def test_confusers(spark):
    tasks = spark.createDataFrame([(1, "where is parse", ["parse", "not a name"], "x.ts"), (2, None, None, None)], "query_id int, text string, keywords array<string>, elsewhere string")
    out = {(r.query_id, r.kind): r.text for r in P.confusers(tasks).collect()}
    assert len(out) == 2 * (len(P.CONFUSERS) + 1)
    assert "function parse(" in out[1, "structural-only"] and "where is parse" not in out[1, "structural-only"]
    assert "where is parse" in out[1, "fts-only"] and "function parse(" not in out[1, "fts-only"]
    assert "x.ts" in out[1, "adversarial-poison"] and "parse" not in out[1, "control"] and out[2, "structural+fts"]


def test_flips(spark):
    first = spark.createDataFrame([(1, None, "a"), (1, "fts-only", "c"), (1, "control", "a"), (2, None, "a"), (2, "fts-only", "a"), (2, "control", "b"), (3, "fts-only", "x"), (3, "control", "x")], "query_id int, kind string, path string")
    assert sorted((r.query_id, r.diff) for r in P.flip_differences(first).collect()) == [(1, 1.0), (2, -1.0)]


def test_predictor(spark):
    rows = [(i, f"c{i}", 0.01 * (i % 2), None, 0.01) for i in range(60)]
    candidates = spark.createDataFrame(rows, "query_id int, chunk_id string, structural double, vector double, fts double")
    inbound = spark.createDataFrame([(f"c{i}", 3) for i in range(0, 60, 2)], "chunk_id string, inbound long")
    chunks = spark.createDataFrame([(f"c{i}", "file", "code", "x" * i, None, "a.ts", None, 1, None, "{}") for i in range(60)], CHUNKS)
    made = P.candidate_features(candidates, inbound, chunks).withColumn("label", F.col("query_id") % 2)
    assert set(P.FEATURES) <= set(made.columns) and made.count() == 60
    _, auc = P.fit_flip_predictor(made)
    assert auc == 1.0


def test_heldout_tasks(spark):
    symbols = spark.createDataFrame([("c", f"f{i % 4}.ts", "typescript", f"parseThing{i}", f"parsething{i}", "function", "", 1, 2, True) for i in range(20)], SYMBOLS)
    one, two = (P.heldout_tasks(symbols, "s", 6).orderBy("task_id").collect() for _ in range(2))
    assert one == two and len(one) == 6 and one[0].task_id == "H001"
    per = [sum(r.path == f"f{i}.ts" for r in one) for i in range(4)]
    assert max(per) <= 2
    for r in one:
        assert r.keywords[0] in r.text and r.intent in P.TASK_INTENTS and r.path not in r.irrelevant and len(r.irrelevant) == 3
    assert P.heldout_tasks(symbols, "other", 6).orderBy("task_id").collect() != one
    assert P.heldout_tasks(symbols.limit(0), "s", 6).count() == 0
