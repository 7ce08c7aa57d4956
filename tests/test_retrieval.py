"""Arms, fusion, selection, budget and routing on small hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import arms as A
from quillon.operators import evaluate as E
from quillon.operators import fuse as U
from quillon.operators import graph as G
from quillon.operators import route as R
from quillon.operators import select as S
from quillon.plans.planner import plan_queries
from quillon.schema import CHUNKS, DEPENDENCIES, REFERENCES, SYMBOLS


def chunk(i, text="", path=None, type_="code", parent=None, meta="{}", tokens=1, t=None):
    return (i, "file", type_, text, t, path, None, tokens, parent, meta)


def arm(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, score double")


def test_full_text(spark):
    docs = spark.createDataFrame([("a", "Parser reads tokens"), ("b", "the parser parser"), ("c", None), ("d", "nothing here")], "id string, text string")
    q = spark.createDataFrame([(1, "parser tokens"), (2, "absent"), (3, "the and"), (4, None)], "query_id int, text string")
    out = A.full_text(q, docs, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in out] == [(1, "a"), (1, "b")]
    assert A.full_text(q, docs.limit(0), 5).count() == 0 and A.full_text(q.limit(0), docs, 5).count() == 0


def test_lexical(spark):
    chunks = spark.createDataFrame([chunk("a", "uses the Planner", "src/x.ts"), chunk("b", "none", "src/planner.ts"), chunk("c", None, None)], CHUNKS)
    q = spark.createDataFrame([(1, "planner planner file")], "query_id int, text string")
    assert [(r.chunk_id, r.score) for r in A.lexical(q, chunks).orderBy("rank").collect()] == [("b", 5.0), ("a", 2.0)]


def test_substring_hits(spark):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("ab_/.c1") for _ in range(rnd.randint(0, 14))) for _ in range(60)] + ["x" * 200 + "abc" + "y" * 50]
    terms = ["".join(rnd.choice("ab_c1") for _ in range(rnd.randint(1, 4))) for _ in range(60)] + ["abc"]
    got = {tuple(r) for r in A.substring_hits(spark.createDataFrame([(n,) for n in names], "n string"), ["n"], "n", spark.createDataFrame([(t,) for t in terms], "term string"), 2).collect()}
    assert got == {(n, t) for n in names for t in terms if len(t) >= 2 and t in n}


WEIGHTS = [
    ("look at src/core/plan.ts", {"src/core/plan.ts": 3.2}), ("see core/plan please", {"src/core/plan.ts": 2.6}),
]


@pytest.mark.parametrize("text,least", WEIGHTS)
def test_structural_paths(spark, text, least):
    planned = plan_queries(spark.createDataFrame([(1, text)], "query_id int, text string"))
    chunks = spark.createDataFrame([chunk(p, "", p) for p in ("src/core/plan.ts", "lib/other.go")], CHUNKS)
    none = spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], REFERENCES)
    out = {r.chunk_id: r for r in A.structural(planned, chunks, *none).collect()}
    for path, points in least.items():
        assert out[path].structural_score >= points and out[path].path_exact == (points == 3.2)
    assert out.get("lib/other.go") is None or out["lib/other.go"].structural_score < 1


def test_structural_weights(spark):
    """Symbols and references add up by the table; references are capped."""
    planned = plan_queries(spark.createDataFrame([(1, "where is parseQuery used"), (2, 'the "Plan" thing')], "query_id int, text string"))
    symbol = lambda c, n, kind, out: (c, "p", "ts", n, n.lower(), kind, "", 1, 2, out)
    symbols = spark.createDataFrame([symbol("a", "parseQuery", "function", True), symbol("b", "parseQuery", "interface", False), symbol("c", "queryThing", "function", False), symbol("d", "Plan", "type", True)], SYMBOLS)
    ref = lambda c, t: (c, "p", "ts", t, t.lower(), "call", 1, 1)
    references = spark.createDataFrame([ref("e", "parseQuery"), ref("e", "x.parseQuery"), ref("f", "unrelated")], REFERENCES)
    out = {(r.query_id, r.chunk_id): r for r in A.structural(planned, spark.createDataFrame([], CHUNKS), symbols, references).collect()}
    assert out[1, "a"].structural_score == 5.9 and out[1, "b"].structural_score == 6.0
    assert out[1, "c"].structural_score == 0.25 + 0.4
    assert out[2, "d"].structural_score == 3.8 and out[2, "d"].symbol_exact
    # exact 1.4, partial .5, and the part "query" and "parse" within both targets .08 each
    assert out[1, "e"].structural_score == round(1.4 + 0.5 + 4 * 0.08, 6) and out[1, "e"].dependency_boost == 0.12
    assert (1, "f") not in out
    assert out[1, "a"].exact_symbols == ["parseQuery"] and out[1, "e"].exact_references == ["parseQuery"]


def test_vector(spark):
    e = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [1.0]), ("d", None)], "chunkId string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, embedding array<float>")
    assert [(r.query_id, r.chunk_id, r.score) for r in A.vector(q, e).orderBy("rank").collect()] == [(1, "a", 1.0), (1, "b", 0.707107)]


def test_vector_blocks(spark, monkeypatch):
    """Blocks of queries and of rows change nothing, and ties go to the smaller id: against all pairs."""
    import numpy as np

    rnd = np.random.default_rng(3)
    vectors = [rnd.integers(-2, 3, size=d).astype(float).tolist() for d in [4] * 150 + [3] * 50] + [[0.0] * 4, [float("nan")] * 4, []]
    e = spark.createDataFrame([(f"v{i:03d}", v) for i, v in enumerate(vectors)], "chunkId string, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, v) for i, v in enumerate(vectors) if i % 9 == 0], "query_id long, embedding array<float>")
    monkeypatch.setattr(A, "QUERY_BLOCK", 7)
    monkeypatch.setattr(A, "ROW_BLOCK", 11)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in A.vector(q, e, 5).collect()}

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        c = a @ b / n if n else 0.0
        return 0.0 if np.isnan(c) else round(float(c), 6)

    for i in range(0, len(vectors), 9):
        want = sorted((-cosine(vectors[i], v), f"v{j:03d}") for j, v in enumerate(vectors) if len(v) == len(vectors[i]) > 0)[:5]
        assert [(c, -s) for s, c in want] == [got[i, r] for r in range(1, len(want) + 1)]
    assert A.vector(q.limit(0), e).count() == 0 and A.vector(q, e.limit(0)).count() == 0


def test_fusion(spark):
    fts = arm(spark, [(1, "a", 9.0), (1, "b", 8.0), (1, "n", float("nan"))])
    vec = arm(spark, [(1, "b", 0.9), (1, "c", 0.1), (1, "d", 0.2)])
    out = {r.chunk_id: r for r in U.fuse({"fts": fts, "vector": vec}, {"fts": 0.4, "vector": 0.55}).collect()}
    assert set(out) == {"a", "b", "d"}
    assert out["b"].fused == pytest.approx(0.4 / 62 + 0.55 / 61) and out["d"].fused == pytest.approx(0.55 / 62) and out["b"].sources == ["fts", "vector"]
    with pytest.raises(ValueError):
        U.fuse({"fts": fts}, {"fts": 0})
    assert U.fusion_weights("hybrid")["vector"] == 0.55 and U.fusion_weights("vector", False)["vector"] == 1.0


def test_rerank(spark):
    ranked = spark.createDataFrame([(1, f"c{i:02d}", 1.0 - i / 1000) for i in range(25)], "query_id int, chunk_id string, fused double")
    chunks = spark.createDataFrame([chunk(f"c{i:02d}", "needle needle" if i in (5, 24) else "hay") for i in range(25)], CHUNKS)
    q = spark.createDataFrame([(1, "a needle")], "query_id int, text string")
    out = [r.chunk_id for r in U.rerank(ranked, q, chunks).orderBy("rank").collect()]
    assert out[0] == "c05" and out[-1] == "c24"


@pytest.fixture
def ranked(spark):
    rows = [(1, "a", 1.0, 1), (1, "p", 0.9, 2), (1, "b", 0.8, 3), (1, "x", 0.7, 4), (1, "c", 0.6, 5), (1, "d", 0.5, 6), (1, "e", 0.4, 7), (1, "low", 0.1, 8), (2, "low", 0.001, 1)]
    return spark.createDataFrame(rows, "query_id int, chunk_id string, score double, rank int")


def test_selection(spark, ranked):
    chunks = spark.createDataFrame([chunk("a", path="f"), chunk("b", path="f"), chunk("c", path="f"), chunk("d", path="f"), chunk("e", path="g"), chunk("low", path="h"), chunk("p", path="f", meta='{"split": true}')], CHUNKS)
    queries = spark.createDataFrame([(1, "narrow", 10), (2, "broad", 10)], "query_id int, complexity string, top_k int")
    out = {(r.query_id, r.chunk_id): (r.selected, r.dropped) for r in S.select_candidates(ranked, chunks, S.policy(queries)).collect()}
    assert out[1, "p"] == (False, "split parent metadata chunk") and out[1, "x"] == (False, "chunk not found")
    assert all(out[1, c] == (True, None) for c in "abce") and out[1, "d"] == (False, "per-path candidate cap")
    assert out[1, "low"] == (False, "below focused score threshold") and out[2, "low"] == (True, None)
    few = S.select_candidates(ranked, chunks, S.policy(queries.withColumn("top_k", F.lit(2))))
    assert {r.chunk_id for r in few.where("selected AND query_id = 1").collect()} == {"a", "b"}
    every = S.select_candidates(ranked, chunks, S.policy(queries, "exhaustive"))
    assert every.where("selected AND query_id = 1").count() == 6


def brute_fill(items, budget, collapse):
    total, inside, out = 0, set(), []
    for hot in (True, False):
        for i, tokens, is_hot, parent in items:
            if (hot and not is_hot) or i in inside:
                continue
            if collapse and not hot and parent in inside and parent is not None:
                out.append((i, None))
            elif total + tokens > budget:
                out.append((i, None))
            else:
                total += tokens
                inside.add(i)
                out.append((i, "hot" if is_hot else "warm"))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fill(spark, seed):
    rnd = random.Random(seed)
    items = [(f"c{i}", rnd.randint(0, 60), rnd.random() < 0.3, rnd.choice([None, "c0", "c1", "c2"])) for i in range(15)]
    df = spark.createDataFrame([(1, i, n, *rest) for n, (i, *rest) in enumerate(items, 1)], "query_id int, chunk_id string, rank int, tokens int, hot boolean, parent_id string")
    out = S.fill_budget(df, spark.createDataFrame([(1, 150)], "query_id int, budget int"), collapse_siblings=True).orderBy("position").collect()
    assert [(r.chunk_id, r.tier) for r in out] == brute_fill(items, 150, True)
    assert sum(r.tokens for r in out if r.tier) <= 150


def test_fill_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, "a", 1, 60, False), (1, "b", 2, 50, False), (1, "c", 3, 30, False)], "query_id int, chunk_id string, rank int, tokens int, hot boolean")
    budgets = spark.createDataFrame([(1, 100), (2, 10)], "query_id int, budget int")
    filled = S.fill_budget(df, budgets)
    assert {r.chunk_id for r in filled.where("tier IS NOT NULL").collect()} == {"a", "c"}
    assert {r.query_id: (r.n_selected, r.total_tokens, r.utilization) for r in S.budget_summary(filled, budgets).collect()} == {1: (2, 90, 0.9), 2: (0, 0, 0.0)}
    scores = spark.createDataFrame([(1, "b", 0.5)], "query_id int, chunk_id string, score double")
    summaries = spark.createDataFrame([("b", "short", 2)], "chunk_id string, summary string, tokens int")
    assert S.compress_omitted(filled, budgets, scores, summaries).count() == 0  # the estimate of 50 doesn't fit in 10
    wide = spark.createDataFrame([(1, 145)], "query_id int, budget int")
    filled = S.fill_budget(df.withColumn("tokens", F.when(F.col("chunk_id") == "b", 90).otherwise(F.col("tokens"))), wide)
    assert [tuple(r) for r in S.compress_omitted(filled, wide, scores, summaries).select("chunk_id", "tokens", "tier").collect()] == [("b__compressed", 2, "compressed")]


def test_pack(spark):
    chunks = spark.createDataFrame([chunk("a", "body a", "z.ts"), chunk("b", "body b", "y.ts")], CHUNKS)
    filled = spark.createDataFrame([(1, "a", 0, 5, "hot", None, 5), (1, "b", 1, 5, None, "exceeds remaining budget", 5)], "query_id int, chunk_id string, position int, tokens int, tier string, reason string, running int")
    packs = {r.query_id: r.pack for r in S.context_pack(filled, chunks, spark.createDataFrame([(1, "task"), (2, "none")], "query_id int, text string")).collect()}
    assert "## z.ts (code, hot)\n\nbody a" in packs[1] and "- b: exceeds remaining budget" in packs[1] and "body b" not in packs[1] and "Task: none" in packs[2]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "t", 1.0), ("c", "b", "t", 1.0), ("c", "c", "t", 1.0), ("c", "a", "t", 1.0), ("d", "c", "t", 1.0), ("d", None, "t", 1.0)], DEPENDENCIES)
    seeds = spark.createDataFrame([(1, "a"), (2, "zz")], "query_id int, chunk_id string")
    assert sorted((r.chunk_id, r.hop, r.score) for r in G.expand(seeds, edges, 3).collect()) == [("b", 1, 1.0), ("c", 1, 1.0), ("d", 2, 0.5)]
    assert [r.chunk_id for r in G.expand(seeds, edges, 3, 1).collect()] == ["b"] and G.expand(seeds, edges, 0).count() == 0
    with pytest.raises(ValueError):
        G.expand(seeds, edges, 99)


def test_found_edges(spark):
    rnd = random.Random(9)
    paths = ["src/a.ts", "src/core/plan.ts", "b", "x/y", "deep/er/path-with_name/file.test.ts", "ab.c", "src\\win.ts"]
    rows = [chunk(f"id-{n:03d}-q", " ".join(rnd.choice([*paths, "noise", "src/core/plan.tsx", "xsrc/a.ts", "id-001-q"]) + rnd.choice(["", ".", ")", "x"]) for _ in range(6)), rnd.choice([None, *paths]), rnd.choice(["code", "summary", "constraint"]), rnd.choice([None, "id-000-q", "gone"])) for n in range(30)]
    want = set()
    for a in rows:
        for b in rows:
            if a[0] != b[0]:
                if b[5] and b[5] in a[3]:
                    want |= {(a[0], b[0], "references")} | ({(a[0], b[0], "overrides")} if a[2] == "constraint" else set())
                if a[2] == "summary" and b[0] in a[3]:
                    want.add((a[0], b[0], "summarizes"))
        if a[8] == "id-000-q":
            want.add((a[8], a[0], "contains"))
    got = [tuple(r)[:3] for r in G.find_edges(spark.createDataFrame(rows, CHUNKS)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_routing(spark, at):
    rows = spark.createDataFrame([("t", "a", 1, "code", 0.95, at(6), 1.0, False, 100), ("t", "b", 2, "constraint", 0.1, at(6), 1.0, False, 50), ("t", "c", 3, "code", 0.6, at(0), 1.0, False, 10), ("t", "d", 4, "code", 0.0, at(0), 1.0, False, 5), ("t", "e", 5, "instruction", 0.9, at(7), 1.0, True, 5)], "task_id string, chunk_id string, ord int, type string, semantic double, timestamp timestamp, redundancy double, redundant boolean, tokens int")
    edges = spark.createDataFrame([("a", "c", "t", 1.0), ("a", "b", "t", 0.5), ("a", "gone", "t", 1.0)], DEPENDENCIES)
    scored = R.score_chunks(rows, edges, F.lit(at(7)))
    s = {r.chunk_id: r.score for r in scored.collect()}
    assert s["a"] == pytest.approx(0.285 + 0.05 + 0.2 * 6 / 7 + 0.1 + 0.15 * 0.45, abs=1e-6)
    tiers = {r.chunk_id: r.tier for r in R.assign_tiers(scored).collect()}
    assert tiers["b"] == "hot" and tiers["d"] == "cold" and tiers["e"] == "warm"
    routed = {r.chunk_id: (r.score, r.tier) for r in R.close_and_promote(scored, edges).collect()}
    assert routed["b"][1] == "hot" and routed["d"][1] == "cold"
    few = {r.chunk_id: r.tier for r in R.close_and_promote(scored, edges, max_tokens=60).collect()}
    assert sum({"a": 100, "b": 50, "c": 10, "d": 5, "e": 5}[c] for c, t in few.items() if t == "hot") <= 60


def test_promotion(spark, at):
    """Warm neighbours of hot chunks become hot until 60 % are; promotions count at once."""
    rows = spark.createDataFrame([("t", i, n, "code", s, False, 1) for n, (i, s) in enumerate([("h", 0.8), ("w1", 0.5), ("w2", 0.5), ("w3", 0.5), ("c", 0.1)])], "task_id string, chunk_id string, ord int, type string, score double, redundant boolean, tokens int")
    edges = spark.createDataFrame([("h", "w1", "t", 0.0), ("w1", "w2", "t", 0.0), ("w2", "w3", "t", 0.0), ("h", "c", "t", 0.0)], DEPENDENCIES)
    tiers = {r.chunk_id: r.tier for r in R.close_and_promote(rows, edges).collect()}
    assert tiers == {"h": "hot", "w1": "hot", "w2": "hot", "w3": "warm", "c": "cold"}


def test_contained(spark):
    import random

    rnd = random.Random(2)
    values = ["".join(rnd.choice("ab/.x") for _ in range(rnd.randint(0, 40))) for _ in range(60)] + ["k" * 500 + "needle", ""]
    terms = ["".join(rnd.choice("ab/.x") for _ in range(rnd.randint(1, 9))) for _ in range(80)] + ["needle", "kkkkkkkkk"]
    got = {tuple(r) for r in A.contained(spark.createDataFrame([(v,) for v in set(values)], "value string"), spark.createDataFrame([(t,) for t in set(terms)], "term string")).collect()}
    assert got == {(v, t) for v in values for t in terms if t in v}
    runs = spark.createDataFrame([("x" * 90 + "needle", 1), ("needle", 2)], "name string, n int")
    assert sorted(r.n for r in A.substring_hits(runs, ["n"], "name", spark.createDataFrame([("needle",), ("xx",)], "term string"), 3).collect()) == [1, 2]


def test_grep_rank(spark):
    """Against counting every term in every file; whole words for the first round, substrings for the others."""
    import math
    import re

    files = [("src/cart/total.ts", "function totalPrice(cart) { return cart.total_price + TAX }"), ("src/b.ts", "cartcart cart_total $cart totalprice"), ("docs/cart.md", None), ("e", "nothing here"), ("src/b.ts", "cart again")]
    rounds = [(1, "identifier", 3.0, "totalprice", True), (1, "part", 1.5, "cart", False), (1, "part", 1.5, "total", False), (2, "prose", 1.0, "again", False), (2, "prose", 1.0, "zzz", False)]
    got = {(r.query_id, r.path): r.score for r in E.grep_rank(spark.createDataFrame(rounds, "query_id int, round string, weight double, term string, whole_word boolean"), spark.createDataFrame(files, "path string, text string")).collect()}
    n = {}
    for q, rd, w, t, whole in rounds:
        for p, x in files:
            low = (x or "").lower()
            c = len(re.findall(rf"(?<![a-z0-9_]){t}(?![a-z0-9_])", low)) if whole else low.count(t)
            if c:
                n[q, p, rd, w, t] = n.get((q, p, rd, w, t), 0) + c
    want = {}
    for q in (1, 2):
        total = len({k[1] for k in n if k[0] == q})
        for p in {k[1] for k in n if k[0] == q}:
            score = 0.0
            for rd, w in {(k[2], k[3]) for k in n if k[:2] == (q, p)}:
                hits = {k[4]: c for k, c in n.items() if k[:3] == (q, p, rd)}
                df = {t: len({k[1] for k in n if k[0] == q and k[4] == t}) for t in hits}
                rarity = sum(max(0.0, math.log(1 + (total - d + 0.5) / (d + 0.5))) for d in df.values())
                score += w * rarity + E.GREP_COUNT_WEIGHT * math.log1p(sum(hits.values())) + (w * E.GREP_PATH_SHARE if any(t in p.lower() for t in hits) else 0)
            want[q, p] = round(score, 9)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mentions_of_any_name(spark):
    """Names of one, two and more pieces, short ones and such of signs alone are found where a text contains them."""
    names = ["src/core/plan.ts", "a/b", "ab", "x", "//", "plan.ts", "lib.rs", "longname"]
    texts = ["see src/core/plan.ts!", "xa/bc", "cab", "no such thing", "http://e", "myplan.tsx", "lib.rs", "the longnames", None, "see src/core/plan.ts!"]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)] + [("c0", "ab")], "id string, text string")
    got = {tuple(r) for r in G._mentions(chunks, spark.createDataFrame([(n,) for n in [*names, None, ""]], "path string"), "path").collect()}
    assert got == {(f"c{i}", n) for i, t in enumerate(texts) for n in names if t and n in t} | {("c0", "ab")}
    assert G._mentions(chunks, spark.createDataFrame([], "path string"), "path").count() == 0


def test_grep_rank_leaves_texts_where_they_are(spark):
    """Of files with many words of their own, only what the terms hit is kept."""
    import hashlib
    from pathlib import Path

    from quillon.plans.materialize import ensure_checkpoint_dir

    def size():
        return sum(p.stat().st_size for p in Path(ensure_checkpoint_dir(spark).removeprefix("file:")).rglob("part-*"))

    text = lambda n: " ".join(hashlib.md5(f"{n}:{i}".encode()).hexdigest() for i in range(300)) + " cart" * (n % 3)
    files = spark.createDataFrame([(f"src/{n}.ts", text(n)) for n in range(100)], "path string, text string")
    rounds = spark.createDataFrame([(1, "part", 1.5, "cart", False)], "query_id int, round string, weight double, term string, whole_word boolean")
    before = size()
    got = E.grep_rank(rounds, files, 5).orderBy("rank").collect()
    assert [r.path for r in got] == sorted(f"src/{n}.ts" for n in range(100) if n % 3 == 2)[:5]
    assert size() - before < 100_000


def test_grep_rank_asks_in_blocks(spark, monkeypatch):
    rounds = spark.createDataFrame([(q, rd, w, t, rd == "identifier") for q in range(6) for rd, w, t in (("identifier", 3.0, "cart"), ("prose", 1.0, "cart"), ("prose", 1.0, f"t{q}"))], "query_id int, round string, weight double, term string, whole_word boolean")
    files = spark.createDataFrame([("a/cart", "cart t1 " + "x" * 100 + "t2x cart$y"), ("b", "carts t3 t4"), ("c", "t0t0 t5")], "path string, text string")
    whole = {tuple(r) for r in E.grep_rank(rounds, files).collect()}
    monkeypatch.setattr(E, "QUERY_BLOCK", 2)
    monkeypatch.setattr(E, "CELLS", 8)
    assert len(whole) == 14 and {tuple(r) for r in E.grep_rank(rounds, files).collect()} == whole


def test_terms_held_or_joined(spark, monkeypatch):
    """Few terms are looked up where the texts are, and no word is shuffled; many meet the words by a join."""
    terms = spark.createDataFrame([("store",), ("needle",), ("a$b",), ("ts",), ("",), ("zzz",)], "term string")
    chunks = spark.createDataFrame([("1", "Store it in the userstore", "src/Needles.ts"), ("1", None, "src/store"), ("2", "a$b " + "x" * 90 + "needle", None), (None, "ts", "x")], "id string, text string, path string")
    want = {("1", "store", True), ("1", "needle", True), ("1", "ts", True), ("2", "a$b", False), ("2", "needle", False), (None, "ts", False)}
    hits = A.term_hits(terms, chunks)
    assert {tuple(r) for r in hits.collect()} == want
    assert "sequence(" not in hits._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(A, "TERMS_HELD", 2)
    assert {tuple(r) for r in A.term_hits(terms, chunks).collect()} == want
