"""Queries on retrieval: arms, fusion, selection and budget, for all evaluation items at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import arms as A
from quillon.operators import fuse as U
from quillon.operators import graph as G
from quillon.operators import held as H
from quillon.operators import select as S
from quillon.operators import structure as R
from quillon.operators.index import stem_index
from quillon.plans.materialize import materialize
from quillon.plans.planner import plan_queries
from quillon.queries.registry import register, sql_list, table

TOP = 10


def items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "source")


def bm25(spark: SparkSession, folder: str, k: int = TOP) -> DataFrame:
    return A.full_text(items(spark, folder), documents(spark, folder), k)


_MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
_FTS = rf"""words AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(translate(lower(coalesce(text, '')), '{_MARKED}', '{_PLAIN}'), '[\p{{L}}\p{{N}}\p{{Co}}]+')) AS term FROM documents),
  tf AS (SELECT chunk_id, term, count(*) AS tf FROM words GROUP BY ALL), dl AS (SELECT d.doc_id AS chunk_id, count(w.term) AS dl FROM documents d LEFT JOIN words w ON w.chunk_id = d.doc_id GROUP BY 1),
  corpus AS (SELECT count(*) AS total, avg(dl) AS mean_dl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  asked AS (SELECT item_id AS query_id, unnest(list_filter(str_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains({sql_list(X.FTS_STOP)}, w))) AS term FROM eval_items),
  fts_sum AS (SELECT query_id, chunk_id, round(sum(greatest(1e-6, ln((total - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_dl))), 9) AS score
    FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (chunk_id), corpus GROUP BY ALL)"""


def _top(source: str, name: str, k: int, columns: str = "query_id, chunk_id, score") -> str:
    return f"{name} AS (SELECT {columns}, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source} QUALIFY rank <= {k})"


@register("bm25_topk", f"WITH {_FTS}, {_top('fts_sum', 'best', TOP)} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM best")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return bm25(spark, folder).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_LEX = rf"""lex_terms AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(str_split_regex(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 3 AND NOT list_contains({sql_list(X.LEXICAL_STOP)}, w))) AS term FROM eval_items),
  bodies AS (SELECT doc_id AS chunk_id, lower(coalesce(text, '')) || ' ' || lower(source || '/' || doc_id) AS low, lower(source || '/' || doc_id) AS low_path FROM documents),
  points AS (SELECT chunk_id, term, 2 + CASE WHEN contains(low_path, term) THEN 3 ELSE 0 END AS p FROM (SELECT DISTINCT term FROM lex_terms), bodies WHERE contains(low, term)),
  lex_sum AS (SELECT query_id, chunk_id, CAST(sum(p) AS DOUBLE) AS score FROM lex_terms JOIN points USING (term) GROUP BY ALL)"""


@register("lexical_topk", f"WITH {_LEX}, {_top('lex_sum', 'best', TOP)} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM best")
def lexical_topk(spark: SparkSession, folder: str) -> DataFrame:
    return A.lexical(items(spark, folder), documents(spark, folder), TOP)


_MERGED = f"""{_FTS}, {_LEX}, {_top('fts_sum', 'fts50', 50)}, {_top('lex_sum', 'lex50', 50)},
  merged AS (SELECT query_id, chunk_id, sum(score) AS score FROM (SELECT query_id, chunk_id, score FROM fts50 UNION ALL SELECT query_id, chunk_id, score FROM lex50) GROUP BY ALL)"""


@register("text_merge", f"WITH {_MERGED}, {_top('merged', 'best', TOP)} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM best")
def text_merge(spark: SparkSession, folder: str) -> DataFrame:
    q, d = items(spark, folder), documents(spark, folder)
    return A.merged_text(A.full_text(q, d), A.lexical(q, d), TOP).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_VEC = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
  sims AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(q, CAST(embedding AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE len(embedding) = len(q))"""


@register("vector_topk", f"WITH {_VEC}, {_top('sims', 'best', TOP)} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM best")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return A.vector(asked, e, TOP, doc="vec_id")


_RRF = f"""{_FTS}, {_LEX}, {_top('fts_sum', 'fts50', 50)}, {_top('lex_sum', 'lex50', 50)},
  parts AS (SELECT query_id, chunk_id, 0.7 / (60 + rank) AS part, 'fts' AS source FROM fts50 UNION ALL SELECT query_id, chunk_id, 0.2 / (60 + rank), 'structural' FROM lex50),
  fused AS (SELECT query_id, chunk_id, round(sum(part), 12) AS score, list(source ORDER BY source) AS sources FROM parts GROUP BY ALL)"""


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    q, d = items(spark, folder), documents(spark, folder)
    return U.fuse({"fts": A.full_text(q, d), "structural": A.lexical(q, d)}, {"fts": 0.7, "structural": 0.2})


@register("rank_fusion", f"WITH {_RRF}, {_top('fused', 'best', TOP, 'query_id, chunk_id, score, sources')} SELECT query_id, chunk_id, round(score, 9) AS score, sources, CAST(rank AS INTEGER) AS rank FROM best")
def rank_fusion(spark: SparkSession, folder: str) -> DataFrame:
    best = A.ranked(_fused(spark, folder).withColumn("score", F.col("fused")), TOP)
    return best.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "sources", "rank")


@register(
    "rerank_overlap",
    rf"""WITH {_RRF}, {_top('fused', 'f', 30)}, w AS (SELECT item_id AS query_id, list_filter(str_split_regex(lower(text), '\s+'), lambda x: length(x) > 2) AS words FROM eval_items),
    o AS (SELECT query_id, chunk_id, score, rank, CASE WHEN rank <= 20 THEN list_sum(list_transform(words, lambda x: (length(b.low) - length(replace(b.low, x, ''))) / length(x))) / len(words) ELSE 0 END AS overlap FROM f JOIN w USING (query_id)
      JOIN (SELECT doc_id AS chunk_id, lower(source || '/' || doc_id || chr(10) || coalesce(text, '')) AS low FROM documents) b USING (chunk_id)),
    r AS (SELECT query_id, chunk_id, rank, round(CASE WHEN rank <= 20 THEN score + overlap * 3 / 61 ELSE score END, 12) AS final FROM o)
    SELECT query_id, chunk_id, round(final, 6) AS final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank > 20, final DESC, chunk_id) AS INTEGER) AS rank FROM r""",
)
def rerank_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return U.rerank(_fused(spark, folder), items(spark, folder), documents(spark, folder), 30).select("query_id", "chunk_id", F.round("final", 6).alias("final"), "rank")


def _policy(spark: SparkSession, folder: str) -> DataFrame:
    planned = plan_queries(items(spark, folder)).select("query_id", F.lit("narrow").alias("complexity"), F.lit(8).alias("top_k"))
    return S.policy(planned, "focused", 3000)


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    chunks = documents(spark, folder).select(F.col("id"), F.col("source").alias("path"), F.col("source"), F.lit("{}").alias("metadata"))
    return S.select_candidates(bm25(spark, folder, 20).select("query_id", "chunk_id", "score", "rank"), chunks, _policy(spark, folder))


_SELECT = f"""{_FTS}, {_top('fts_sum', 'r', 20)}, t AS (SELECT r.*, d.source AS path_key, max(score) OVER (PARTITION BY query_id) AS top FROM r JOIN documents d ON d.doc_id = r.chunk_id),
  p AS (SELECT *, rank <= 3 AS protected, rank <= 3 OR score >= greatest(top * 0.35, 1.0 / 260) AS passes FROM t),
  n AS (SELECT *, count(*) FILTER (WHERE passes) OVER (PARTITION BY query_id, path_key ORDER BY rank ROWS UNBOUNDED PRECEDING) AS on_path FROM p),
  f AS (SELECT *, passes AND (protected OR on_path <= 2) AS fits FROM n), m AS (SELECT *, count(*) FILTER (WHERE fits) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS nth FROM f),
  chosen AS (SELECT *, fits AND nth <= 8 AS selected, CASE WHEN fits AND nth <= 8 THEN NULL WHEN nth - CAST(fits AS INT) >= 8 THEN 'after candidate limit' WHEN NOT passes AND score < 1.0 / 260 THEN 'below absolute relevance floor' WHEN NOT passes THEN 'below focused score threshold' ELSE 'per-path candidate cap' END AS dropped FROM m)"""


@register("select_candidates", f"WITH {_SELECT} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, selected, dropped FROM chosen")
def select_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder).select("query_id", "chunk_id", "rank", "selected", "dropped")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(F.col("id").alias("chunk_id"), X.token_estimate(F.col("text")).alias("tokens"))


_BUDGET = f"""{_SELECT}, sized AS (SELECT c.query_id, c.chunk_id, c.rank, CAST(ceil(length(coalesce(d.text, '')) / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nr FROM chosen c JOIN documents d ON d.doc_id = c.chunk_id WHERE selected),
  budgets AS (SELECT item_id AS query_id, least(3000, greatest(3000, coalesce((SELECT sum(tokens) FROM sized s WHERE s.query_id = item_id AND nr <= 3), 0))) AS budget FROM eval_items)"""


@register("effective_budget", f"WITH {_BUDGET} SELECT query_id, CAST(budget AS BIGINT) AS budget FROM budgets")
def effective_budget(spark: SparkSession, folder: str) -> DataFrame:
    return _budgets(spark, folder, _candidates(spark, folder))


def _budgets(spark: SparkSession, folder: str, candidates: DataFrame) -> DataFrame:
    return S.effective_budget(candidates, _tokens(spark, folder), _policy(spark, folder))


@register(
    "fill_budget",
    "WITH RECURSIVE "
    + _BUDGET
    + """, steps AS (SELECT b.query_id, CAST(0 AS BIGINT) AS nr, CAST(0 AS BIGINT) AS total, CAST(NULL AS BIGINT) AS chunk_id, CAST(0 AS BIGINT) AS tokens, false AS taken, CAST(b.budget AS BIGINT) AS budget FROM budgets b
    UNION ALL SELECT s.query_id, z.nr, s.total + CASE WHEN s.total + z.tokens <= s.budget THEN z.tokens ELSE 0 END, z.chunk_id, z.tokens, s.total + z.tokens <= s.budget, s.budget FROM steps s JOIN sized z ON z.query_id = s.query_id AND z.nr = s.nr + 1)
    SELECT query_id, CAST(chunk_id AS VARCHAR) AS chunk_id, tokens, CASE WHEN taken THEN 'warm' END AS tier, CASE WHEN NOT taken THEN 'exceeds remaining budget' END AS reason, total AS running FROM steps WHERE nr > 0""",
)
def fill_budget(spark: SparkSession, folder: str) -> DataFrame:
    candidates = materialize(_candidates(spark, folder))
    chosen = candidates.where("selected").join(_tokens(spark, folder), "chunk_id").withColumn("hot", F.lit(False))
    return S.fill_budget(chosen, _budgets(spark, folder, candidates)).drop("position")


@register(
    "found_edges",
    """WITH p AS (SELECT DISTINCT path FROM chunks WHERE path IS NOT NULL AND path <> ''), t AS (SELECT DISTINCT id, type, text FROM chunks WHERE id IS NOT NULL),
    named AS (SELECT DISTINCT t.id AS fromId, t.type AS kind, c.id AS toId FROM t JOIN p ON contains(t.text, p.path) JOIN chunks c ON c.path = p.path WHERE c.id <> t.id),
    s AS (SELECT DISTINCT t.id AS fromId, c.id AS toId FROM t JOIN (SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL AND id <> '') c ON contains(t.text, c.id) WHERE t.type = 'summary' AND c.id <> t.id)
    SELECT DISTINCT fromId, toId, 'references' AS type, CAST(0.7 AS DOUBLE) AS weight FROM named UNION ALL SELECT DISTINCT fromId, toId, 'overrides', 0.6 FROM named WHERE kind = 'constraint'
    UNION ALL SELECT DISTINCT parentId, id, 'contains', 0.9 FROM chunks WHERE parentId IN (SELECT id FROM chunks) AND id IS NOT NULL UNION ALL SELECT fromId, toId, 'summarizes', 0.8 FROM s""",
)
def found_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.find_edges(table(spark, folder, "chunks"))


@register(
    "graph_hops",
    """WITH e AS (SELECT DISTINCT * FROM (SELECT fromId AS a, toId AS b FROM dependencies UNION ALL SELECT toId, fromId FROM dependencies) WHERE a IS NOT NULL AND b IS NOT NULL),
    s0 AS (SELECT DISTINCT reason AS query_id, chunkId AS chunk_id FROM chunk_deletions WHERE reason IS NOT NULL AND chunkId IS NOT NULL),
    s1 AS (SELECT DISTINCT query_id, b AS chunk_id FROM s0 JOIN e ON a = chunk_id EXCEPT SELECT * FROM s0),
    s2 AS (SELECT DISTINCT query_id, b AS chunk_id FROM s1 JOIN e ON a = chunk_id EXCEPT SELECT * FROM s0 EXCEPT SELECT * FROM s1)
    SELECT query_id, chunk_id, 1 AS hop, CAST(1.0 AS DOUBLE) AS score FROM s1 UNION ALL SELECT query_id, chunk_id, 2, 0.5 FROM s2""",
)
def graph_hops(spark: SparkSession, folder: str) -> DataFrame:
    seeds = table(spark, folder, "chunk_deletions").where("reason IS NOT NULL AND chunkId IS NOT NULL").select(F.col("reason").alias("query_id"), F.col("chunkId").alias("chunk_id"))
    return G.expand(seeds, table(spark, folder, "dependencies"), 2)


def _structure(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    chunks = table(spark, folder, "chunks")
    tagged = materialize(R.extract_rows(chunks))
    return materialize(plan_queries(items(spark, folder), provider="deterministic")), chunks, R.symbols_of(tagged), R.references_of(tagged)


@register("structural_topk")
def structural_topk(spark: SparkSession, folder: str) -> DataFrame:
    return A.structural(*_structure(spark, folder), TOP).select("query_id", "chunk_id", "score", "structural_score", "dependency_boost", "symbol_exact", "path_exact", "reasons", "rank")


@register("structural_without_vectors")
def structural_without_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = H.deterministic(materialize(plan_queries(items(spark, folder), provider="deterministic")), table(spark, folder, "chunks"), TOP)
    if found is not None:
        return found
    planned, chunks, symbols, references = _structure(spark, folder)
    lexical = A.lexical(planned, chunks)
    structural = A.structural(planned, chunks, symbols, references)
    return U.deterministic_structural(planned, chunks, symbols, references, lexical, structural, stem_index(symbols), TOP)


@register("legitimacy")
def legitimacy(spark: SparkSession, folder: str) -> DataFrame:
    tagged = materialize(R.extract_rows(table(spark, folder, "chunks")))
    return G.legitimacy(R.symbols_of(tagged), R.references_of(tagged))


@register("context_packs")
def context_packs(spark: SparkSession, folder: str) -> DataFrame:
    chosen = _candidates(spark, folder).where("selected").join(_tokens(spark, folder), "chunk_id").withColumn("hot", F.lit(False)).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    filled = S.fill_budget(chosen, effective_budget(spark, folder))
    chunks = documents(spark, folder).select(F.col("id").cast("string").alias("id"), "path", "source", F.lit("fact").alias("type"), "text")
    return S.context_pack(filled, chunks, items(spark, folder)).select("query_id", F.length("pack").alias("characters"), X.content_hash(F.col("pack")).alias("hash"))



_LOGGED = """best AS (SELECT taskText AS query_id, chunkId AS chunk_id, max(score) AS score FROM routing_history WHERE taskText IS NOT NULL AND chunkId IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best QUALIFY rank <= 20),
  meta AS (SELECT id AS chunk_id, min(coalesce(path, source, id)) AS path_key, coalesce(bool_or(regexp_matches(metadata, '"split": ?true')), false) AS parent, max(coalesce(tokensEstimate, 0)) AS tokens FROM chunks WHERE id IS NOT NULL GROUP BY id),
  asked AS (SELECT DISTINCT query_id, CASE length(query_id) % 3 WHEN 0 THEN 'focused' WHEN 1 THEN 'broad' ELSE 'exhaustive' END AS mode, 3 + length(query_id) % 6 AS most FROM r),
  p AS (SELECT *, CASE mode WHEN 'focused' THEN 3 WHEN 'broad' THEN 5 ELSE 0 END AS keep, CASE mode WHEN 'focused' THEN 0.35 WHEN 'broad' THEN 0.2 ELSE 0 END AS ratio, CASE mode WHEN 'exhaustive' THEN 0 ELSE 1.0 / 260 END AS floor,
    CASE mode WHEN 'focused' THEN 2 WHEN 'broad' THEN 3 END AS cap FROM asked),
  live AS (SELECT r.*, p.*, m.path_key, m.parent, m.chunk_id IS NOT NULL AS known, coalesce(NOT m.parent, false) AS live FROM r JOIN p USING (query_id) LEFT JOIN meta m USING (chunk_id)),
  placed AS (SELECT *, count(*) FILTER (WHERE live) OVER w - 1 AS place, max(score) FILTER (WHERE live) OVER (PARTITION BY query_id) AS top FROM live WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
  held AS (SELECT *, live AND place < keep AS protected, NOT (live AND place < keep) AND greatest(top * ratio, floor) > 0 AND score < greatest(top * ratio, floor) AS weak FROM placed),
  passing AS (SELECT *, count(*) FILTER (WHERE live AND NOT weak) OVER (PARTITION BY query_id, path_key ORDER BY rank ROWS UNBOUNDED PRECEDING) AS on_path FROM held),
  fitting AS (SELECT *, live AND NOT weak AND (protected OR cap IS NULL OR on_path <= cap) AS fits FROM passing),
  counted AS (SELECT *, count(*) FILTER (WHERE fits) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS nth FROM fitting),
  chosen AS (SELECT *, fits AND nth <= most OR NOT bool_or(fits AND nth <= most) OVER (PARTITION BY query_id) AND live AND place = 0 AS selected,
    CASE WHEN NOT known THEN 'chunk not found' WHEN parent THEN 'split parent metadata chunk' WHEN live AND nth - CAST(fits AS INT) >= most THEN 'after candidate limit' WHEN weak AND score < floor THEN 'below absolute relevance floor'
      WHEN weak THEN 'below ' || mode || ' score threshold' WHEN live AND NOT fits THEN 'per-path candidate cap' END AS why FROM counted)"""


def _logged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The best of every logged task, chunks by id (split parents marked), and policies of all modes by the task's length."""
    log = table(spark, folder, "routing_history").where("taskText IS NOT NULL AND chunkId IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    best = log.groupBy(F.col("taskText").alias("query_id"), F.col("chunkId").alias("chunk_id")).agg(F.max("score").alias("score"))
    ranked = materialize(A.ranked(best, 20))
    split = F.max(F.coalesce(F.col("metadata").rlike('"split": ?true'), F.lit(False)))
    chunks = table(spark, folder, "chunks").where("id IS NOT NULL").groupBy("id").agg(F.min(F.coalesce("path", "source", "id")).alias("path"), F.when(split, '{"split": true}').otherwise("{}").alias("metadata"), F.max(F.coalesce("tokensEstimate", F.lit(0))).alias("tokens"))
    n = F.length("query_id")
    tasks = ranked.select("query_id").distinct().select("query_id", F.when(n % 2 == 0, "narrow").otherwise("broad").alias("complexity"), (n % 6 + 3).alias("top_k"))
    mode = F.when(n % 3 == 0, "focused").when(n % 3 == 1, "broad").otherwise("exhaustive")
    return ranked, chunks.withColumn("source", F.lit(None).cast("string")), S.policy(tasks, mode, 4000)


@register("select_modes", f"WITH {_LOGGED} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, selected, CASE WHEN NOT selected THEN why END AS dropped FROM chosen")
def select_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Selection for every logged task, in all three modes, with split parents, dangling ids and caps."""
    return S.select_candidates(*_logged(spark, folder)).select("query_id", "chunk_id", "rank", "selected", "dropped")


@register(
    "fill_hot",
    "WITH RECURSIVE "
    + _LOGGED
    + """, links AS (SELECT id, count(*) AS n FROM (SELECT fromId AS id FROM dependencies UNION ALL SELECT toId FROM dependencies) WHERE id IS NOT NULL GROUP BY id),
    cand AS (SELECT c.query_id, c.chunk_id, c.rank, m.tokens, coalesce(l.n >= 12, false) AS hot FROM chosen c JOIN meta m USING (chunk_id) LEFT JOIN links l ON l.id = c.chunk_id WHERE c.selected),
    seq AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phase, rank) AS nr FROM (SELECT *, 1 AS phase FROM cand WHERE hot UNION ALL SELECT *, 2 FROM cand)),
    steps AS (SELECT query_id, CAST(0 AS BIGINT) AS nr, CAST(0 AS BIGINT) AS total, CAST([] AS VARCHAR[]) AS inside, CAST(NULL AS VARCHAR) AS chunk_id, CAST(0 AS BIGINT) AS tokens, CAST(NULL AS VARCHAR) AS tier, CAST(NULL AS VARCHAR) AS reason, false AS said FROM (SELECT DISTINCT query_id FROM seq)
    UNION ALL SELECT s.query_id, z.nr, s.total + CASE WHEN NOT list_contains(s.inside, z.chunk_id) AND s.total + z.tokens <= 4000 THEN z.tokens ELSE 0 END, CASE WHEN NOT list_contains(s.inside, z.chunk_id) AND s.total + z.tokens <= 4000 THEN list_append(s.inside, z.chunk_id) ELSE s.inside END, z.chunk_id, z.tokens,
      CASE WHEN s.total + z.tokens <= 4000 THEN CASE WHEN z.hot THEN 'hot' ELSE 'warm' END END, CASE WHEN s.total + z.tokens <= 4000 THEN NULL WHEN z.phase = 1 THEN 'hot but exceeds budget' ELSE 'exceeds remaining budget' END, NOT list_contains(s.inside, z.chunk_id)
      FROM steps s JOIN seq z ON z.query_id = s.query_id AND z.nr = s.nr + 1)
    SELECT query_id, chunk_id, tokens, tier, reason, total AS running FROM steps WHERE nr > 0 AND said""",
)
def fill_hot(spark: SparkSession, folder: str) -> DataFrame:
    """Budgets filled for every logged task: hot chunks (of at least 12 edge ends) first, skipped ones tried again."""
    ranked, chunks, policies = _logged(spark, folder)
    chosen = S.select_candidates(ranked, chunks, policies).where("selected").join(chunks.select(F.col("id").alias("chunk_id"), "tokens"), "chunk_id")
    links = table(spark, folder, "dependencies").select(F.explode(F.array("fromId", "toId")).alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n >= 12")
    hot = chosen.join(links.select(F.col("id").alias("chunk_id"), F.lit(True).alias("hot")), "chunk_id", "left")
    return S.fill_budget(hot, policies.select("query_id", F.lit(4000).alias("budget"))).drop("position")
