"""Queries on measuring retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import evaluate as E
from quillon.operators.references import json_strings, normal_id
from quillon.plans.planner import plan_queries
from quillon.queries.registry import register, sql_list, table
from quillon.queries.retrieval import documents, items
from quillon.sources.files import cap_corpus

TOP = 20


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks of files: a source's documents of a kind are one file."""
    return table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.concat_ws("/", "source", "kind").alias("path"))


_BM25F_TERMS = r"list_filter(str_split_regex(regexp_replace(lower({0}), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1)"
_BM25F = f"""WITH f AS (SELECT source || '/' || kind AS path, coalesce(text, '') AS body FROM documents), b AS (SELECT path, unnest({_BM25F_TERMS.format('body')}) AS term FROM f),
  tf AS (SELECT path, term, CAST(sum(bn) AS BIGINT) AS bn, CAST(sum(pn) AS BIGINT) AS pn FROM (SELECT path, term, 1 AS bn, 0 AS pn FROM b UNION ALL SELECT path, unnest({_BM25F_TERMS.format('path')}), 0, 1 FROM (SELECT DISTINCT path FROM f)) GROUP BY ALL),
  len AS (SELECT path, sum(bn) AS bl, sum(pn) AS pl FROM tf GROUP BY 1), corpus AS (SELECT count(*) AS total, avg(bl) AS mb, avg(pl) AS mp FROM len), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  asked AS (SELECT DISTINCT item_id AS query_id, unnest({_BM25F_TERMS.format('text')}) AS term FROM eval_items),
  m AS (SELECT path, term, bn / (0.25 + 0.75 * bl / mb) + 2 * pn / (0.25 + 0.75 * pl / mp) AS m, ln(1 + (total - df + 0.5) / (df + 0.5)) AS idf FROM tf JOIN len USING (path) JOIN df USING (term), corpus),
  s AS (SELECT query_id, path, round(sum(idf * m * 2.5 / (1.5 + m)), 9) AS score FROM asked JOIN m USING (term) WHERE m > 0 GROUP BY ALL)
SELECT query_id, path, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank FROM s QUALIFY rank <= {TOP}"""


@register("bm25f_files", _BM25F)
def bm25f_files(spark: SparkSession, folder: str) -> DataFrame:
    return E.bm25f(items(spark, folder), _files(spark, folder), TOP).select("query_id", "path", F.round("score", 6).alias("score"), "rank")


@register(
    "keyword_files",
    rf"""WITH t AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(str_split_regex(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 3 AND NOT list_contains({sql_list(X.LEXICAL_STOP)}, w))) AS term FROM eval_items) GROUP BY ALL),
    c AS (SELECT doc_id, source || '/' || kind AS path, lower(coalesce(text, '')) || ' ' || lower(source || '/' || kind) AS both_, lower(source || '/' || kind) AS low FROM documents),
    h AS (SELECT doc_id, path, term, 2 + CASE WHEN contains(low, term) THEN 3 ELSE 0 END AS p FROM (SELECT DISTINCT term FROM t), c WHERE contains(both_, term)),
    s AS (SELECT query_id, path, doc_id, sum(times * p) AS s FROM t JOIN h USING (term) GROUP BY ALL), f AS (SELECT query_id, path, CAST(max(s) AS DOUBLE) AS score FROM s GROUP BY ALL)
    SELECT query_id, path, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank FROM f QUALIFY rank <= {TOP}""",
)
def keyword_files(spark: SparkSession, folder: str) -> DataFrame:
    return E.keyword_baseline(items(spark, folder), _files(spark, folder), TOP)


@register(
    "path_match_files",
    rf"""WITH t AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(str_split_regex(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains({sql_list(X.QUERY_STOP)}, w))) AS term FROM eval_items),
    p AS (SELECT DISTINCT path FROM chunks WHERE path IS NOT NULL), h AS (SELECT path, term FROM (SELECT DISTINCT term FROM t), p WHERE contains(lower(path), term)), s AS (SELECT query_id, path, CAST(count(*) AS DOUBLE) AS score FROM t JOIN h USING (term) GROUP BY ALL)
    SELECT query_id, path, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank FROM s QUALIFY rank <= {TOP}""",
)
def path_match_files(spark: SparkSession, folder: str) -> DataFrame:
    return E.path_match_baseline(items(spark, folder), table(spark, folder, "chunks"), TOP)


@register("grep_files")
def grep_files(spark: SparkSession, folder: str) -> DataFrame:
    planned = plan_queries(items(spark, folder))
    return E.grep_rank(E.grep_rounds(planned), table(spark, folder, "chunks").where("path IS NOT NULL").select("path", "text"), TOP)


@register("random_files")
def random_files(spark: SparkSession, folder: str) -> DataFrame:
    return E.random_baseline(items(spark, folder), documents(spark, folder))


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Cached tasks as queries: their ranking by routing score, and the chunks they were made from as gold."""
    cache = table(spark, folder, "compression_cache").where("taskText IS NOT NULL")
    gold = cache.select(F.col("taskText").alias("query_id"), F.explode(json_strings(F.col("sourceChunkIds"))).alias("c")).select("query_id", normal_id(F.col("c")).alias("path")).where("path IS NOT NULL").distinct()
    scores = table(spark, folder, "routing_history").where("taskText IS NOT NULL AND chunkId IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").select(F.col("taskText").alias("query_id"), F.col("chunkId").alias("path"), "score").join(gold.select("query_id").distinct(), "query_id", "left_semi")
    best = scores.groupBy("query_id", "path").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return best.withColumn("rank", F.row_number().over(order)), gold


_JUDGED = r"""gold AS (SELECT DISTINCT query_id, nullif(lower(regexp_replace(c, '^\s+|\s+$', '', 'g')), '') AS path FROM (SELECT taskText AS query_id, unnest(CAST(CAST(sourceChunkIds AS JSON) AS VARCHAR[])) AS c FROM compression_cache
    WHERE taskText IS NOT NULL AND CASE WHEN json_valid(sourceChunkIds) THEN json_type(sourceChunkIds) = 'ARRAY' ELSE false END) WHERE nullif(regexp_replace(c, '^\s+|\s+$', '', 'g'), '') IS NOT NULL),
  best AS (SELECT taskText AS query_id, chunkId AS path, max(score) AS score FROM routing_history WHERE taskText IN (SELECT query_id FROM gold) AND chunkId IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
  ranking AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM best)"""


@register(
    "ir_metrics",
    f"""WITH {_JUDGED}, hits AS (SELECT query_id, rank FROM gold JOIN ranking USING (query_id, path)), n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1),
    a AS (SELECT n.query_id, n.n, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10, count(*) FILTER (WHERE rank <= 20) AS h20, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) AS d10, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 20), 0) AS d20, min(rank) AS first FROM n LEFT JOIN hits USING (query_id) GROUP BY ALL)
    SELECT query_id, round(h5 / n, 6) AS recall_at_5, round(h10 / n, 6) AS recall_at_10, round(h20 / n, 6) AS recall_at_20, CAST(round(h5 / 5, 6) AS DOUBLE) AS precision_at_5, CAST(round(h10 / 10, 6) AS DOUBLE) AS precision_at_10, CAST(round(h20 / 20, 6) AS DOUBLE) AS precision_at_20,
    round(d10 / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_at_10, round(d20 / list_sum(list_transform(range(1, least(n, 20) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_at_20,
    round(coalesce(1 / first, 0), 6) AS mrr, CAST(coalesce(CAST(first <= 1 AS INT), 0) AS DOUBLE) AS hits_at_1, CAST(coalesce(CAST(first <= 5 AS INT), 0) AS DOUBLE) AS hits_at_5 FROM a""",
)
def ir_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return E.ir_metrics(*_judged(spark, folder))


@register(
    "token_costs",
    f"""WITH {_JUDGED}, t AS (SELECT id AS path, max(coalesce(tokensEstimate, 0)) AS tokens FROM chunks WHERE id IS NOT NULL GROUP BY 1),
    c AS (SELECT query_id, rank, coalesce(tokens, 0) AS tokens, (query_id, path) IN (SELECT (query_id, path) FROM gold) AS relevant, sum(coalesce(tokens, 0)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cumulative FROM ranking LEFT JOIN t USING (path))
    SELECT query_id, CAST(sum(tokens) AS BIGINT) AS total_tokens, CAST(min(cumulative) FILTER (WHERE relevant) AS BIGINT) AS tokens_to_first_hit, CAST(min(rank) FILTER (WHERE relevant) AS INTEGER) AS first_hit_rank FROM c GROUP BY 1""",
)
def token_costs(spark: SparkSession, folder: str) -> DataFrame:
    ranking, gold = _judged(spark, folder)
    tokens = table(spark, folder, "chunks").where("id IS NOT NULL").groupBy(F.col("id").alias("path")).agg(F.max(F.coalesce("tokensEstimate", F.lit(0))).alias("tokens"))
    return E.token_costs(E.token_curve(ranking, tokens, gold))


@register(
    "score_percentiles",
    """WITH s AS (SELECT tier, score, row_number() OVER (PARTITION BY tier ORDER BY score) - 1 AS place, count(*) OVER (PARTITION BY tier) AS n FROM routing_history WHERE score IS NOT NULL AND NOT isnan(score))
    SELECT tier, n, min(score) AS least, min(score) FILTER (WHERE place = floor((n - 1) * 0.5)) AS p50, min(score) FILTER (WHERE place = floor((n - 1) * 0.95)) AS p95, max(score) AS most, round(avg(score), 6) AS mean FROM s GROUP BY tier, n""",
)
def score_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return E.percentiles(table(spark, folder, "routing_history").where("NOT isnan(score)"), "score", "tier")


@register(
    "score_auc",
    """WITH r AS (SELECT score, tier = 'hot' AS hot FROM routing_history WHERE score IS NOT NULL AND NOT isnan(score) AND tier IS NOT NULL), c AS (SELECT score, count(*) FILTER (WHERE hot) AS p, count(*) FILTER (WHERE NOT hot) AS n FROM r GROUP BY 1),
    b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM b""",
)
def score_auc(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "routing_history").where("score IS NOT NULL AND NOT isnan(score) AND tier IS NOT NULL").select("score", (F.col("tier") == "hot").cast("int").alias("label"))
    return E.roc_auc(rows)


@register(
    "corpus_cap",
    """WITH f AS (SELECT DISTINCT path FROM chunks WHERE path IS NOT NULL), g AS (SELECT DISTINCT path FROM chunks WHERE path IS NOT NULL AND type = 'reference'), m AS (SELECT path, path IN (SELECT path FROM g) AS is_gold FROM f),
    o AS (SELECT path, is_gold, row_number() OVER (PARTITION BY is_gold ORDER BY path) AS nr FROM m) SELECT path, is_gold FROM o WHERE is_gold OR nr <= greatest(0, 500 - (SELECT count(*) FROM g))""",
)
def corpus_cap(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").where("path IS NOT NULL")
    return cap_corpus(chunks.select("path").distinct(), chunks.where("type = 'reference'").select("path"), 500)


_GRID = "VALUES (0, 0.2, 0.7), (1, 0.5, 0.5), (2, 0.7, 0.2), (3, 0.0, 1.0)"


@register(
    "fusion_sweep",
    f"""WITH a AS (SELECT taskText AS query_id, chunkId AS chunk_id, tier AS source, max(score) AS score FROM routing_history WHERE taskText IS NOT NULL AND chunkId IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND tier IN ('warm', 'cold') GROUP BY ALL),
    g AS (SELECT * FROM ({_GRID}) t(config_id, warm, cold)), c AS (SELECT config_id, 'warm' AS source, warm AS weight FROM g UNION ALL SELECT config_id, 'cold', cold FROM g),
    p AS (SELECT config_id, query_id, chunk_id, weight / (60 + row_number() OVER (PARTITION BY config_id, query_id, source ORDER BY score DESC, chunk_id)) AS part FROM a JOIN c USING (source) WHERE weight > 0 AND score >= 0.2),
    s AS (SELECT config_id, query_id, chunk_id, round(sum(part), 12) AS score FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY config_id, query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
    SELECT config_id, query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def fusion_sweep(spark: SparkSession, folder: str) -> DataFrame:
    arms = table(spark, folder, "routing_history").where("taskText IS NOT NULL AND chunkId IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND tier IN ('warm', 'cold')").groupBy(F.col("taskText").alias("query_id"), F.col("chunkId").alias("chunk_id"), F.col("tier").alias("source")).agg(F.max("score").alias("score"))
    rows = [(i, s, float(w), 0.2) for i, warm, cold in ((0, 0.2, 0.7), (1, 0.5, 0.5), (2, 0.7, 0.2), (3, 0.0, 1.0)) for s, w in (("warm", warm), ("cold", cold))]
    configs = spark.createDataFrame(rows, "config_id int, source string, weight double, floor double")
    return E.sweep(arms, configs, 5).select("config_id", "query_id", "chunk_id", "rank")


@register("metric_bootstrap")
def metric_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    metrics = ir_metrics(spark, folder).select(F.lit("routing").alias("strategy"), F.col("query_id").alias("task_id"), "recall_at_10")
    return E.bootstrap(metrics, ["strategy"], "recallAt10", "recall_at_10")
