"""Listings, logs, tasks without symbols, and small measures."""

import math

import pytest

from quillon.operators import evaluate as E
from quillon.operators import history as H
from quillon.operators import structure as S
from quillon.schema import REFERENCES


def test_name_status(spark):
    rows = [("A\tsrc/new.ts\nM\tsrc/a.ts\r\nD  old.py\nR100\tx.ts\ty.ts\n\nbad\n",), (None,), ("",)]
    assert [tuple(r) for r in H.name_status(spark.createDataFrame(rows, "text string")).collect()] == [("src/new.ts", "added", 0), ("src/a.ts", "modified", 0), ("old.py", "deleted", 0), ("x.ts", "modified", 0)]


def test_commits(spark):
    log = "\x1eabc\x1fFix the cache\x1fLong\nbody \n\x1f\nsrc/a.ts\n src/b.ts\n\n\x1edef\x1fNo files\x1f\x1f\n\x1ebroken\x1fx\n\x1e \x1fno hash\x1f\x1f"
    out = [(r.hash, r.subject, r.body, list(r.files)) for r in H.commits(spark.createDataFrame([(log,), (None,)], "text string")).collect()]
    assert out == [("abc", "Fix the cache", "Long\nbody", ["src/a.ts", "src/b.ts"]), ("def", "No files", "", [])]


def test_without_symbols(spark):
    tasks = [(1, "Fix `parseQuery()` when Router.match  fails, see `some prose` and loadFile"), (2, ""), (3, None), (4, "Nothing here."), (5, "LIMIT and planner_total in planner.run")]
    symbols = [("parseQuery", "function"), ("Router", "class"), ("LIMIT", "constant"), ("planner", "variable"), (None, "class")]
    out = {r.task_id: (r.text, list(r.removed)) for r in H.without_symbols(spark.createDataFrame(tasks, "task_id int, text string"), spark.createDataFrame(symbols, "name string, kind string")).collect()}
    assert out == {
        1: ("Fix the relevant function when the relevant component fails, see some prose and the relevant code", ["parseQuery", "Router", "loadFile"]), 2: ("", []), 4: ("Nothing here.", []),
        5: ("the relevant value and the relevant code in the relevant code", ["LIMIT", "planner_total", "planner"]),
    }


def test_random_baseline(spark):
    """The lowest seeded hashes of query and path, against taking each by itself."""

    def fnv(text):
        h = 2166136261
        for i in range(0, len(text.encode("utf-16-le")), 2):
            h = ((h ^ int.from_bytes(text.encode("utf-16-le")[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
        return h

    paths = [f"src/f{i}.ts" for i in range(50)] + ["é/😀.py"]
    got = {(r.query_id, r["rank"]): r.path for r in E.random_baseline(spark.createDataFrame([("T1",), ("T2",), ("T1",), (None,)], "query_id string"), spark.createDataFrame([(str(i), p) for i, p in enumerate(paths)] + [("bare", None)], "id string, path string"), 20).collect()}
    for q in ("T1", "T2"):
        want = sorted([*paths, "bare"], key=lambda p: (fnv(f"{q}:{p}"), p))[:20]
        assert [got[q, r] for r in range(1, 21)] == want
    assert len(got) == 40


def test_small_measures(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 3.0), ("b", 1.0), ("b", 2.0), ("c", None)], "g string, v double")
    out = {r.g: r.median for r in E.median(df, "v", ["g"]).collect()}
    assert out["a"] == 2.5 and out["b"] == 2.0 and math.isnan(out["c"]) and math.isnan(E.median(df.limit(0), "v").first().median)
    ranking, qrels = spark.createDataFrame([(1, "a"), (1, "x"), (2, "q")], "query_id int, path string"), spark.createDataFrame([(1, "a"), (1, "b"), (3, "z"), (3, None)], "query_id int, path string")
    assert {r.query_id: (list(r.hits), list(r.misses)) for r in E.hits_and_misses(ranking, qrels).collect()} == {1: (["a"], ["b"]), 3: ([], ["z"])}
    draws = E.xorshift_uniform("seed", 1000)
    assert draws == E.xorshift_uniform("seed", 1000) and 0 <= min(draws) and max(draws) <= 1 and abs(sum(draws) / 1000 - 0.5) < 0.05


def test_merge_references(spark):
    row = lambda target, normal, line, kind="call": ("c", "p", "l", target, normal, kind, line, line)
    first, second = spark.createDataFrame([row("A.b", "a.b", 1), row("x", None, 2)], REFERENCES), spark.createDataFrame([row("a.B", "a.b", 1), row("A.b", "a.b", 3), row("x", "x", 2, "import")], REFERENCES)
    assert sorted((r.target, r.startLine, r.kind) for r in S.merge_references(first, second).collect()) == [("A.b", 1, "call"), ("A.b", 3, "call"), ("x", 2, "call"), ("x", 2, "import")]
