"""Queries on scoring and routing: link scores, redundancy, tiers, demotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import compress as C
from quillon.operators import route as R
from quillon.queries.registry import register, table

#: The clock of these queries.
NOW = "2025-09-01"


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks as one task per source, their best routing score as similarity to it."""
    best = table(spark, folder, "routing_history").where("chunkId IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").groupBy(F.col("chunkId").alias("chunk_id")).agg(F.least(F.lit(1.0), F.max("score")).alias("semantic"))
    chunks = table(spark, folder, "chunks").where("id IS NOT NULL").groupBy(F.col("id").alias("chunk_id")).agg(F.max("source").alias("task_id"), F.max("type").alias("type"), F.max("timestamp").alias("timestamp"), F.max(F.coalesce("tokensEstimate", F.lit(0))).alias("tokens"))
    rows = chunks.join(best, "chunk_id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0))).withColumn("redundancy", F.lit(1.0)).withColumn("redundant", F.lit(False))
    return R.score_chunks(rows, table(spark, folder, "dependencies"), F.lit(NOW).cast("timestamp"))


_SCORE = f"""best AS (SELECT chunkId AS chunk_id, least(1.0, max(score)) AS semantic FROM routing_history WHERE chunkId IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1),
  c AS (SELECT id AS chunk_id, max(source) AS task_id, max(type) AS type, max(timestamp) AS timestamp, max(coalesce(tokensEstimate, 0)) AS tokens FROM chunks WHERE id IS NOT NULL GROUP BY 1),
  l AS (SELECT id AS chunk_id, count(*) AS links FROM (SELECT fromId AS id FROM dependencies UNION ALL SELECT toId FROM dependencies) WHERE id IS NOT NULL GROUP BY 1),
  s AS (SELECT c.*, round(greatest(0, least(1, 0.3 * coalesce(semantic, 0) + 0.25 * CASE type WHEN 'constraint' THEN 1.0 WHEN 'instruction' THEN 0.5 ELSE 0.2 END
    + 0.2 * greatest(0, 1 - (epoch(TIMESTAMP '{NOW}') - epoch(timestamp)) / 604800.0) + 0.1 + 0.15 * least(0.5, coalesce(links, 0) * 0.15))), 9) AS score FROM c LEFT JOIN best USING (chunk_id) LEFT JOIN l USING (chunk_id))"""


@register("score_chunks", f"WITH {_SCORE} SELECT chunk_id, round(score, 5) AS score FROM s")
def score_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("chunk_id", F.round("score", 5).alias("score"))


_TIER = f"""{_SCORE}, b AS (SELECT *, CASE WHEN score >= 0.7 THEN 'hot' WHEN score >= 0.4 THEN 'warm' ELSE 'cold' END AS base FROM s),
  u AS (SELECT *, CASE WHEN base <> 'hot' AND ((type = 'constraint' AND score > 0.3) OR (type = 'instruction' AND score > 0.5)) THEN 'hot' ELSE base END AS up FROM b),
  t AS (SELECT *, CASE WHEN up = 'hot' AND row_number() OVER (PARTITION BY task_id, up = 'hot' ORDER BY score DESC, chunk_id DESC) > greatest(1, floor(count(*) OVER (PARTITION BY task_id) * 0.6)) THEN 'warm' ELSE up END AS tier FROM u)"""


@register("route_tiers", f"WITH {_TIER} SELECT chunk_id, tier FROM t")
def route_tiers(spark: SparkSession, folder: str) -> DataFrame:
    return R.assign_tiers(_scored(spark, folder)).select("chunk_id", "tier")


@register(
    "token_demotion",
    f"""WITH {_TIER}, d AS (SELECT *, sum(tokens) OVER (PARTITION BY task_id, tier = 'hot') AS total, coalesce(sum(tokens) OVER (PARTITION BY task_id, tier = 'hot' ORDER BY score, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
    SELECT chunk_id, CASE WHEN tier = 'hot' AND total - before > 500 THEN 'warm' ELSE tier END AS tier FROM d""",
)
def token_demotion(spark: SparkSession, folder: str) -> DataFrame:
    return R.token_demotion(R.assign_tiers(_scored(spark, folder)), 500).select("chunk_id", "tier")


@register(
    "redundancy",
    """WITH n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nr FROM embeddings),
    p AS (SELECT a.vec_id, a.label, count(b.vec_id) FILTER (WHERE list_cosine_similarity(a.v, b.v) > 0.8) AS n FROM n a LEFT JOIN n b ON a.label = b.label AND a.nr <> b.nr AND b.nr <= 21 AND (b.nr <= 20 OR a.nr <= 20) GROUP BY 1, 2)
    SELECT label AS task_id, vec_id AS chunk_id, CAST(round(greatest(0, 1 - least(1, n * 0.3)), 6) AS DOUBLE) AS redundancy FROM p""",
)
def redundancy(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("label").alias("task_id"), F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("ord"), "embedding", F.lit(0.0).alias("semantic"))
    return R.redundancy(rows).select("task_id", "chunk_id", "redundancy")


@register("link_counts", "SELECT id AS chunk_id, CAST(count(*) AS BIGINT) AS links FROM (SELECT fromId AS id FROM dependencies UNION ALL SELECT toId FROM dependencies) WHERE id IS NOT NULL GROUP BY 1")
def link_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.link_counts(table(spark, folder, "dependencies"))


@register("routed_tasks")
def routed_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Order-dependent routing of the chunks that each cached task was compressed from."""
    from quillon.operators.references import json_strings, normal_id

    cache = table(spark, folder, "compression_cache")
    own = cache.select(F.col("id").alias("task_id"), F.explode(json_strings(F.col("sourceChunkIds"))).alias("c")).select("task_id", normal_id(F.col("c")).alias("chunk_id")).where("chunk_id IS NOT NULL").distinct()
    scored = _scored(spark, folder).drop("task_id").join(own, "chunk_id").withColumn("ord", F.col("timestamp").cast("timestamp").cast("double").cast("long"))
    return R.close_and_promote(scored, table(spark, folder, "dependencies"), max_tokens=4000)


@register("task_summaries")
def task_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of the chunks that each cached task was compressed from."""
    from quillon.operators.references import json_strings, normal_id

    cache = table(spark, folder, "compression_cache").dropDuplicates(["id"])
    own = cache.select(F.col("id").alias("task_id"), F.posexplode(json_strings(F.col("sourceChunkIds"))).alias("rank", "c")).select("task_id", "rank", normal_id(F.col("c")).alias("id")).where("id IS NOT NULL")
    chunks = table(spark, folder, "chunks").select("id", "type", "text").dropDuplicates(["id"])
    return C.extractive_summary(own.join(chunks, "id")).select("task_id", F.size("facts").alias("n_facts"), F.size("constraints").alias("n_constraints"), "original_tokens", "tokens")
