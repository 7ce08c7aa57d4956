"""Ranking where vectors can't be trusted, by tasks that hold the queries, against the joins."""

from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import arms as A
from quillon.operators import fuse as U
from quillon.operators import held as H
from quillon.operators import structure as R
from quillon.operators.index import stem_index
from quillon.plans.planner import plan_queries


def test_held_queries_rank_as_joins(spark, monkeypatch):
    """Each chunk is scored once for all queries; repeated and missing ids, parents, ties and blocks come out as by joins."""
    queries = [(1, "where is parseConfig defined in src/store/index.ts, stores"), (2, "explain how RankStrict collects the nested outlines of `useLedger`"), (3, "find parse_config"), (4, None)]
    planned = plan_queries(spark.createDataFrame(queries, "query_id int, text string"), provider="deterministic").checkpoint()
    code = "export interface ParseConfig { outline: Ledger }\nexport function parseConfig(a) { return useLedger(a) }\nconst nested = useLedger(1)\n"
    rows = [
        ("a", code, "src/store/index.ts", None, "{}"), ("a", code, "src/store/index.ts", None, "{}"), ("a", "def rank_strict():\n  collect()\n", "lib/outlines.py", None, None), ("b", code, "src/parse/config.ts", None, '{"split": true}'),
        ("c", "def parse_config(x):\n    return nested(x)\n", "store/ParseConfig.py", "python", "{}"), (None, code, "src/stores/index.ts", None, "{}"), ("d", "parseConfig parseconfig parse_config: nested outlines", None, None, "{}"),
        ("e", None, "src/parseConfig.TS", "ts", "{}"), *((f"f{i}", "class Ledgers: pass", f"lib/m{i % 3}/ledgers.py", None, "{}") for i in range(9)), ("g", "", "", None, "{}"),
    ]
    chunks = spark.createDataFrame(rows, "id string, text string, path string, language string, metadata string")
    tagged = R.extract_rows(chunks).checkpoint()
    symbols, references = R.symbols_of(tagged), R.references_of(tagged)
    joined = U.deterministic_structural(planned, chunks, symbols, references, A.lexical(planned, chunks, 3), A.structural(planned, chunks, symbols, references, 3), stem_index(symbols), 4)
    # the terms are worked out once and not by every part that reads them
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Window") < 12
    tell = lambda df: sorted((r.query_id, r.rank, r.chunk_id or "", r.score, r.sources) for r in df.collect())
    want = tell(joined)
    assert {q for q, *_ in want} == {1, 2, 3} and len(want) == 12 and tell(H.deterministic(planned, chunks, 4, 3)) == want
    monkeypatch.setattr(H, "HELD_QUERIES", 1)
    monkeypatch.setattr(H, "CHUNK_BLOCK", 2)
    monkeypatch.setattr(H, "KEPT_NAMES", 1)
    assert tell(H.deterministic(planned, chunks, 4, 3)) == want
    monkeypatch.setattr(A, "TERMS_HELD", 2)
    assert H.deterministic(planned, chunks, 4, 3) is None


def test_held_text_functions(spark):
    names = ["parseConfigs", "HTTPServer_v2", "a/b.c:d-e", "stories", "Running", "classes", "bosses", "status", "x y z\tw", "İstanbul Kelvin", "", "$", "__x__", "aB1C\n", "src/My File.test.ts", "buses", "ties", "used"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    n = F.col("n")
    for r in df.select("n", X.normalize_symbol(n).alias("s"), X.normalize_identifier(n).alias("i"), X.split_identifier(n).alias("p"), X.field_tokens(n).alias("f"), X.stem(n).alias("t")).collect():
        assert (H.normalize_symbol(r.n), H.normalize_identifier(r.n), H.split_identifier(r.n), H.field_tokens(r.n), H.stem(r.n)) == (r.s, r.i, r.p, r.f, r.t), r.n
    assert sorted(H.finder(["store", "tore", "or", "zz", "store"], 2)("xstorey")) == ["or", "store", "tore"]
