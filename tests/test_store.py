"""The store, sources, streaming ingest, evaluation and the facade."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.engine import ContextEngine, validate
from quillon.operators import evaluate as E
from quillon.operators import store as T
from quillon.schema import CHUNKS, DEPENDENCIES, EMBEDDINGS, REFERENCES, ROUTING, SYMBOLS
from quillon.sources import files as S
from quillon.streaming import ingest as I


def chunk(i, text="", path=None, t=None, type_="code"):
    return (i, "file", type_, text, t, path, None, 1, None, "{}")


def test_filters(spark, at):
    chunks = spark.createDataFrame([chunk("a", "The TOKEN_limit", "p"), chunk("b", "none", None), chunk("c", None, "p")], CHUNKS)
    routing = spark.createDataFrame([(1, "a", "hot", 1.0, "[]", "q", at(1)), (2, "a", "cold", 1.0, "[]", "q", at(1)), (3, "b", "hot", 1.0, "[]", "q", at(0)), (4, None, "hot", 1.0, "[]", "q", at(9))], ROUTING)
    assert [r.id for r in T.query_chunks(chunks, contains="token_limit").collect()] == ["a"]
    assert [r.id for r in T.query_chunks(chunks, tier="hot", routing=routing).collect()] == ["b"]
    with pytest.raises(ValueError):
        T.query_chunks(chunks, tier="hot")
    assert T.memory_filter(chunks, contains="token").count() == 0 and T.memory_filter(chunks, path="p", type_="code").count() == 2


def test_reingest_and_upsert(spark):
    schema = "path string, ord int, id string, text string"
    before = spark.createDataFrame([("f", 1, "o1", "same"), ("f", 2, "o2", "same"), ("f", 3, "o3", "old"), ("f", 4, "o4", None)], schema)
    after = spark.createDataFrame([("f", 1, "n1", "same"), ("f", 2, "n2", "new"), ("f", 3, "n3", "")], schema)
    out = {(r.action, r.old_id, r.new_id) for r in T.reingest(before, after).collect()}
    assert out == {("reused", "o1", "n1"), ("deleted", "o2", None), ("deleted", "o3", None), ("created", None, "n2"), ("reused", "o4", "n3")}
    table = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, l string, v int")
    rows = spark.createDataFrame([("a", None, 5), ("a", None, 7), ("c", "y", 3)], "k string, l string, v int")
    assert sorted((r.k, r.v) for r in T.upsert(table, rows, ["k", "l"]).collect()) == [("a", 7), ("b", 2), ("c", 3)]
    incoming = spark.createDataFrame([("p", "t"), (None, "t"), ("p", "u"), ("p", "u")], "path string, text string")
    assert sorted((r.path or "", r.text) for r in T.new_by_hash(incoming, spark.createDataFrame([("p", "t")], "path string, text string")).collect()) == [("", "t"), ("p", "u")]


def test_delete_and_evict(spark, at):
    chunks = spark.createDataFrame([chunk("a", t=at(1)), chunk("b", t=at(2)), chunk("c", t=at(3)), chunk("d", t=at(0))], CHUNKS)
    edges = spark.createDataFrame([("d", "c", "t", 1.0), ("c", None, "t", 1.0)], DEPENDENCIES)
    assert sorted(r.id for r in T.eviction(chunks, edges, 3).collect()) == ["a"] and T.eviction(chunks, edges, 9).count() == 0
    left = T.delete_chunks(spark.createDataFrame([("d",), (None,)], "id string"), chunks, edges, spark.createDataFrame([], EMBEDDINGS), spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], REFERENCES))
    assert left["chunks"].count() == 3 and [r.fromId for r in left["dependencies"].collect()] == ["c"]


def test_exchange(spark, tmp_path, at):
    chunks = spark.createDataFrame([chunk("a", "x\ny", "p", at(1)), chunk("b", None, None, None)], CHUNKS)
    edges = spark.createDataFrame([("a", "b", "t", None)], DEPENDENCIES)
    from quillon.schema import COMPRESSION

    T.export_json(chunks, edges, spark.createDataFrame([], COMPRESSION), str(tmp_path))
    back = T.import_json(spark, str(tmp_path))
    assert sorted(back["chunks"].collect(), key=lambda r: r.id) == sorted(chunks.collect(), key=lambda r: r.id) and back["dependencies"].collect() == edges.collect()


def test_walks(spark, tmp_path):
    tree = {"src/a.ts": "export const a = 1", "src/a.test.ts": "x", "tests/b.py": "x", "node_modules/m/c.js": "x", "README.md": "# hi", "docs/d.md": "doc", "notes.txt": "n", "img.png": "b", "build/e.py": "x", "benchmarks/f.py": "x", "AGENTS.md": "# Rules\nNever do it\n", "package.json": "{}", "lib/.env.example": "A=1", "deep/x/g.go": "package g"}
    for name, text in tree.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    found = S.read_directory(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == set(tree) - {"node_modules/m/c.js", "img.png"}
    kinds = {r.path: r.context_kind for r in S.project_files(found).collect()}
    assert kinds == {"src/a.ts": None, "deep/x/g.go": None, "README.md": "documentation", "docs/d.md": "documentation", "AGENTS.md": "agent-instruction", "package.json": "configuration", "lib/.env.example": "environment"}
    assert S.count_project_files(found, tests=True, benchmarks=True, docs=False) == 8
    snapshot = tmp_path / "snap.json"
    snapshot.write_text(json.dumps({"files": [{"path": "a", "content": "b"}]}))
    assert [tuple(r) for r in S.read_snapshot(spark, str(snapshot)).collect()] == [("a", "b")]
    paths = spark.createDataFrame([("a/dist/x",), ("logs/a.log",), ("src/a.ts",), ("x.png",)], "p string")
    assert [r.i for r in paths.select(S.ignored(F.col("p"), ["*.log", "# note", ""]).alias("i")).collect()] == [True, True, False, True]
    assert S.within_roots(str(tmp_path / "src"), [str(tmp_path)]) and not S.within_roots("/etc", [str(tmp_path)])
    files = spark.createDataFrame([(f"f{i}",) for i in range(9)], "path string")
    capped = S.cap_corpus(files, spark.createDataFrame([("f7",), ("f8",), ("none",)], "path string"), 4).collect()
    assert {r.path for r in capped} == {"f7", "f8", "f0", "f1"}


def test_stream(spark, tmp_path):
    """Add, change, unlink and a re-delivery, over three runs that take what is there."""
    events, table, mark = (str(tmp_path / n) for n in ("events", "table", "mark"))
    (tmp_path / "events").mkdir()

    def push(n, *rows):
        (tmp_path / "events" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("path", "kind", "ts", "text"), r))) for r in rows))
        I.watch(spark, events, table, mark, once=True).awaitTermination(120)
        return {(r.path, r.text): r.id for r in I.read_current(spark, table).collect()}

    first = push(1, ("a.py", "add", "2025-01-01T00:00:00Z", "def a(): pass"), ("a.py", "change", "2025-01-01T00:00:01Z", "def b(): pass"), ("b.py", "add", "2025-01-01T00:00:00Z", "x = 1"))
    assert set(first) == {("a.py", "def b(): pass"), ("b.py", "x = 1")}
    second = push(2, ("a.py", "change", "2025-01-01T01:00:00Z", "def b(): pass"), ("c.py", "add", "2025-01-01T01:00:00Z", "z"))
    assert second["a.py", "def b(): pass"] == first["a.py", "def b(): pass"] and len(second) == 3
    assert set(push(3, ("b.py", "unlink", "2025-01-01T02:00:00Z", None), ("c.py", "change", "2025-01-01T02:00:00Z", "zz"))) == {("a.py", "def b(): pass"), ("c.py", "zz")}
    engine = ContextEngine.load(spark, table)
    commit = engine._base[1]
    ids = {r.id for r in engine.tables["chunks"].collect()}
    for name in ("chunk_embeddings", "text_lengths"):
        assert {r.chunkId for r in engine.tables[name].collect()} == ids
    assert {r.name for r in engine.tables["code_symbols"].collect()} == {"b"} and {r.term for r in engine.tables["postings"].collect()} == {"def", "b", "pass", "zz"}
    # delivered again: nothing to commit
    I.merge_batch(table)(spark.createDataFrame([("b.py", "unlink", None, None)], I.EVENTS), 9)
    assert ContextEngine.load(spark, table)._base[1] >= commit
    gone = I.vanished(engine.tables["chunks"], spark.createDataFrame([("a.py",)], "path string"))
    assert {r.path for r in gone.collect()} == {"c.py"}


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4)], "query_id int, path string, rank int")
    qrels = spark.createDataFrame([(1, "b"), (1, "c"), (1, "z"), (2, "a"), (3, None)], "query_id int, path string")
    out = {r.query_id: r for r in E.ir_metrics(ranking, qrels).collect()}
    assert out[1].recall_at_5 == round(2 / 3, 6) and out[1].precision_at_5 == 0.4 and out[1].mrr == 0.5 and out[1].hits_at_1 == 0.0 and out[1].hits_at_5 == 1.0
    ideal = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    assert out[1].ndcg_at_10 == round((1 / math.log2(3) + 1 / math.log2(5)) / ideal, 6)
    assert out[2].recall_at_10 == 0.0 and out[3].recall_at_10 == 0.0
    with pytest.raises(ValueError):
        E.average_metrics(E.ir_metrics(ranking, qrels).limit(0))


def test_bootstrap():
    def generator(text):
        h = 2166136261
        for c in text:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        a = h
        while True:
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ (a >> 15)) * (1 | a)) & 0xFFFFFFFF
            t = ((t + (((t ^ (t >> 7)) * (61 | t)) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
            yield ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    g = generator("seed")
    assert np.allclose(E.seeded_uniform("seed", 50), [next(g) for _ in range(50)], atol=0)
    values = [0.1, 0.5, 0.9, 0.3]
    mean, low, high = E.bootstrap_ci(values, "mean:m")
    g, means = generator("mean:m:" + ",".join(f"{v:.6f}" for v in values)), []
    for _ in range(10_000):
        s = 0.0
        for _ in values:
            s += values[int(next(g) * 4)]
        means.append(s / 4)
    means.sort()
    assert (mean, low, high) == (sum(values) / 4, means[math.floor(10_000 * 0.025000000000000022)], means[math.ceil(10_000 * 0.975) - 1])


def test_bootstrap_in_shares(spark, monkeypatch):
    """Many values take little memory, and shares of the resamples in several tasks give what one gives."""
    import tracemalloc

    x = np.round(np.random.default_rng(3).random(20_000), 6)
    tracemalloc.start()
    got = E.bootstrap_ci(x.tolist(), "mean:m", 300)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    draw = E.seeded_uniform("mean:m:" + ",".join(f"{v:.6f}" for v in x), 300 * 20_000)
    means = np.sort(np.cumsum(x[np.floor(draw * 20_000).astype(np.int64)].reshape(300, -1), axis=1)[:, -1] / 20_000)
    assert got[1:] == (means[7], means[292]) and peak < 30_000_000
    monkeypatch.setattr(E, "DRAWS", 40_000)
    rows = spark.createDataFrame([(s, i, float(x[i]) - 0.5 * (s == "b")) for s in "ab" for i in range(30)] + [("c", 1, None)], "strategy string, task_id int, v double")
    out = {r.strategy: tuple(r)[1:] for r in E.bootstrap(rows, ["strategy"], "m", "v").collect()}
    want = {s: E.bootstrap_ci([float(x[i]) - 0.5 * (s == "b") for i in range(30)], "mean:m") for s in "ab"}
    assert out == {s: (30, *w, w[1] > 0 or w[2] < 0) for s, w in want.items()}


def test_small_evaluators(spark):
    order = E.sanitize_order(spark.createDataFrame([(1, 0, 2), (1, 1, 9), (1, 2, 2), (1, 3, 0)], "query_id int, place int, index int"), spark.createDataFrame([(1, i) for i in range(4)], "query_id int, index int"))
    assert [r["index"] for r in order.orderBy("rank").collect()] == [2, 0, 1, 3]
    auc = E.roc_auc(spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, label int")).first().auc
    assert auc == 0.875 and E.roc_auc(spark.createDataFrame([(0.9, 1)], "score double, label int")).first().auc is None
    p = E.percentiles(spark.createDataFrame([(float(i),) for i in range(10)], "v double"), "v").first()
    assert (p.n, p.least, p.p50, p.p95, p.most, p["mean"]) == (10, 0.0, 4.0, 8.0, 9.0, 4.5)
    plain = spark.createDataFrame([(1, "g", 1), (2, "g", 1), (3, "x", 1)], "query_id int, path string, rank int")
    confused = spark.createDataFrame([(1, "x", 1), (2, "g", 1), (3, "x", 1)], "query_id int, path string, rank int")
    qrels = spark.createDataFrame([(i, "g") for i in (1, 2, 3)], "query_id int, path string")
    assert tuple(E.flip_rate(plain, confused, qrels).first()) == (2, 1, 0.5)
    assert E.composite_gate(-0.04, 0.01) and not E.composite_gate(-0.06, 0.01) and E.accepted(0.7, 0.25, 13_000) == {"recall": True, "precision": True, "tokens": True}
    assert len(E.sweep_grid([1, 2], [1], [1, 2], [0])) == 4


def test_engine(spark, at, tmp_path):
    engine = ContextEngine(spark)
    rows = [("file", "import { log } from './log';\nexport class QueryPlanner {\n  planQuery(text) {\n    return log(text);\n  }\n}\n", "src/planner.ts"), ("file", "export function log(x) {\n  return x;\n}\n", "src/log.ts"), ("file", "# Notes\nThe planner reads src/log.ts often.\n", "docs/notes.md"), ("conversation", "must keep the planner small", None)]
    made = engine.ingest(spark.createDataFrame(rows, "source string, text string, path string"), F.lit(at(1)))
    assert made.count() == 4 and engine.ingest(spark.createDataFrame(rows, "source string, text string, path string")).count() == 0
    assert {r.name for r in engine.symbols().collect()} >= {"QueryPlanner", "planQuery", "log"}
    assert engine.update_graph().where("type = 'references'").count() == 1
    queries = spark.createDataFrame([(1, "where is planQuery defined in QueryPlanner"), (2, "notes about log")], "query_id int, text string")
    paths = {r.id: r.path for r in engine.list_context().collect()}
    for strategy in ("structural", "hybrid"):
        out = engine.retrieve(queries, strategy).collect()
        assert len({(r.query_id, r.chunk_id) for r in out}) == len(out)
        if strategy == "structural":
            assert paths[next(r.chunk_id for r in out if r.query_id == 1 and r["rank"] == 1)] == "src/planner.ts"
    single = engine.retrieve(queries.where("query_id = 1"), "text").collect()
    assert sorted(map(repr, single)) == sorted(repr(r) for r in engine.retrieve(queries, "text").where("query_id = 1").collect())
    context = engine.context_for(queries, max_tokens=60, compress=True)
    assert all(r.total_tokens <= 60 for r in context["summary"].collect()) and context["pack"].count() == 2 and context["compressed"] is not None
    assert engine.iterative_retrieve(queries, rounds=1).where("round = 1").count() > 0
    routed = engine.score(queries.withColumnRenamed("query_id", "task_id"), F.lit(at(2)))
    assert {r.tier for r in routed.collect()} <= {"hot", "warm", "cold"}
    assert engine.record_routing(routed, queries.withColumnRenamed("query_id", "task_id"), F.lit(at(2))).count() == routed.count()
    assert engine.relevant_memory(queries, path="src").count() > 0 and engine.stats().count() == 4
    engine.save(str(tmp_path / "store"))
    again = ContextEngine.load(spark, str(tmp_path / "store"))
    assert again.tables["chunks"].count() == 4 and again.backfill_embeddings().count() == 0
    again.delete(again.list_context(type_="constraint").select("id"))
    assert again.tables["chunks"].count() == 3 and again.enforce_limit(2).count() <= 1
    with pytest.raises(ValueError):
        engine.ingest_directory("/etc")


@pytest.mark.parametrize("bad", [{"query": " "}, {"strategy": "best"}, {"max_tokens": 0}, {"max_tokens": True}, {"top_k": 5000}, {"path": ""}, {"rounds": 0}, {"nope": 1}])
def test_validation(bad):
    with pytest.raises(ValueError):
        validate(**bad)


def test_large_files_are_read_or_raise(spark, tmp_path):
    (tmp_path / "big.log").write_text("a" * ((64 << 20) + 1))
    (tmp_path / ".env.example").write_text("b" * ((1 << 20) + 1))
    (tmp_path / "small.py").write_text("x = 1")
    found = S.read_directory(spark, str(tmp_path))
    assert {r.path: r.n for r in found.selectExpr("path", "length(content) AS n").collect()} == {"big.log": (64 << 20) + 1, ".env.example": (1 << 20) + 1, "small.py": 5}
    with pytest.raises(ValueError, match="big.log"):
        S.read_directory(spark, str(tmp_path), max_bytes=1000)


def test_commits(spark, at, tmp_path):
    """What a commit adds and removes is there afterwards, older rows stay unwritten, and a half-done commit isn't seen."""
    folder = str(tmp_path / "store")
    engine = ContextEngine(spark)
    texts = lambda *rows: spark.createDataFrame(rows, "source string, text string, path string")
    engine.ingest(texts(("file", "def one(): return two()", "a.py"), ("file", "def two(): pass", "b.py")), F.lit(at(1)))
    assert engine.save(folder) == 1 and engine.save(folder) == 1
    second = ContextEngine.load(spark, folder)
    second.ingest(texts(("file", "x = 3", "c.py")), F.lit(at(2)))
    second.delete(second.list_context(path="b.py").select("id"))
    assert second.save(folder) == 2
    third = ContextEngine.load(spark, folder)
    assert {r.path for r in third.tables["chunks"].collect()} == {"a.py", "c.py"} and {r.name for r in third.tables["code_symbols"].collect()} == {"one"}
    assert third.tables["text_lengths"].count() == 2 and third.tables["chunk_embeddings"].count() == 2
    third.ingest(texts(("file", "def two(): pass", "b.py")), F.lit(at(3)))
    assert third.save(folder) == 3 and {r.path for r in ContextEngine.load(spark, folder).tables["chunks"].collect()} == {"a.py", "b.py", "c.py"}
    assert len(list((tmp_path / "store" / "chunks").iterdir())) == 3
    # an engine that wasn't loaded from the newest commit writes everything anew
    assert engine.save(folder) == 4 and ContextEngine.load(spark, folder).tables["chunks"].count() == 2
    from quillon.operators.segments import Folder

    with pytest.raises(RuntimeError):
        stale = Folder(spark, folder)
        stale.newest = lambda: (3, {})
        stale.commit({})
    assert ContextEngine.load(spark, str(tmp_path / "none")).tables["chunks"].count() == 0


def test_upsert_drops_what_was_derived(spark, at):
    engine = ContextEngine(spark)
    engine.ingest(spark.createDataFrame([("file", "def one(): pass", "a.py"), ("file", "def two(): pass", "b.py")], "source string, text string, path string"), F.lit(at(1)))
    rows = {r.path: r.asDict() for r in engine.tables["chunks"].collect()}
    a, b = {**rows["a.py"], "text": "def other(): pass"}, {**rows["b.py"], "source": "moved"}
    engine.upsert_chunks(spark.createDataFrame([a, b], CHUNKS))
    assert {(r.path, r.text, r.source) for r in engine.tables["chunks"].collect()} == {("a.py", "def other(): pass", "file"), ("b.py", "def two(): pass", "moved")}
    assert {r.name for r in engine.tables["code_symbols"].collect()} == {"other", "two"}
    assert engine.tables["chunk_embeddings"].count() == 2 and {r.term for r in engine.point("postings", [a["id"]]).collect()} == {"def", "other", "pass"}
    with pytest.raises(ValueError):
        engine.point("routing_history", ["x"])


def test_stored_index_gives_the_same(spark, at):
    from quillon.operators import arms as A
    from quillon.plans.planner import plan_queries

    rows = [("file", f"text number {i} about the cache and shard{i % 3} " + "token " * (i % 5), f"p{i}.md") for i in range(30)]
    engine = ContextEngine(spark)
    engine.ingest(spark.createDataFrame(rows, "source string, text string, path string"), F.lit(at(1)))
    q = plan_queries(spark.createDataFrame([(1, "cache token shard1"), (2, "nothing found zzz"), (3, "text shard2")], "query_id int, text string"))
    index = tuple(engine.tables[t].withColumnRenamed("chunkId", "doc") for t in ("postings", "text_lengths"))
    with_, without = (sorted(map(tuple, A.full_text(q, engine.tables["chunks"], 5, index=i).collect())) for i in (index, None))
    assert with_ == without and len(with_) == 10


def test_degraded_and_cached(spark, at):
    """A failing embedder leaves the other arms; summaries are kept and found again."""
    engine = ContextEngine(spark)
    engine.ingest(spark.createDataFrame([("file", "the cache holds tokens", "a.md"), ("file", "nothing of it", "b.md")], "source string, text string, path string"), F.lit(at(1)))

    def broken(rows, text, into):
        raise OSError("model not there")

    engine.embedder = broken
    q = spark.createDataFrame([(1, "cache tokens")], "query_id int, text string")
    assert engine.retrieve(q, "hybrid").count() == 1 and engine.warnings == ["vector search failed: model not there"]
    with pytest.raises(OSError):
        engine.retrieve(q, "vector")
    tasks, ids = spark.createDataFrame([(1, "cache tokens")], "task_id int, text string"), engine.tables["chunks"].select(F.lit(1).alias("task_id"), F.col("id").alias("chunk_id"))
    assert engine.cached_compression(tasks, ids).count() == 0
    made = spark.createDataFrame([(1, "short", ["f"], ["c"])], "task_id int, summary string, facts array<string>, constraints array<string>")
    engine.cache_compression(made, tasks, ids, F.lit(at(2)))
    assert [(r.task_id, r.summary, r.retainedFacts) for r in engine.cached_compression(tasks, ids).collect()] == [(1, "short", '["f"]')]
    assert engine.cached_compression(tasks, ids.limit(1)).count() == 0


def test_running_sums(spark):
    import random

    from quillon.operators.ordered import running

    rnd = random.Random(4)
    data = [(rnd.randint(0, 60), i, rnd.randint(0, 9)) for i in range(500)]
    got = {(r.a, r.b): (r.s, r.n) for r in running(running(spark.createDataFrame(data, "a int, b int, w long"), ["a", "b"], "s", F.col("w")), ["a", "b"], "n").collect()}
    total = 0
    for nr, (a, b, w) in enumerate(sorted(data), 1):
        total += w
        assert got[a, b] == (total, nr)
    assert running(spark.createDataFrame([], "a int"), ["a"], "n").count() == 0
