"""Queries on references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.references import orphan_counts, orphan_references
from quillon.queries.registry import register, table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(*(table(spark, folder, t) for t in ("chunks", "dependencies", "compression_cache", "routing_history")))


_NORMAL = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
_ORPHANS = f"""WITH seen AS (SELECT {_NORMAL.format("id")} AS id, min(timestamp) AS first_ts FROM chunks WHERE id IS NOT NULL GROUP BY 1),
edges AS (SELECT {_NORMAL.format("fromId")} AS a, {_NORMAL.format("toId")} AS b, coalesce(type, '') AS t FROM dependencies),
keyed AS (SELECT a, b, coalesce(a, '') || '>' || coalesce(b, '') || '>' || t AS k FROM edges),
cached AS (SELECT id, timestamp, CASE WHEN json_valid(sourceChunkIds) AND json_type(sourceChunkIds) = 'ARRAY' THEN CAST(sourceChunkIds AS JSON) END AS j FROM compression_cache),
refs AS (
  SELECT 'dependencies' AS refTable, k AS refKey, 'fromId' AS refField, a AS chunkId, b AS other, NULL::TIMESTAMP AS ts FROM keyed
  UNION ALL SELECT 'dependencies', k, 'toId', b, a, NULL FROM keyed
  UNION ALL SELECT 'routing_history', CAST(id AS VARCHAR), 'chunkId', {_NORMAL.format("chunkId")}, NULL, timestamp FROM routing_history
  UNION ALL SELECT 'compression_cache', id, 'sourceChunkIds', {_NORMAL.format("c")}, NULL, timestamp FROM (SELECT id, timestamp, unnest(CAST(j AS VARCHAR[])) AS c FROM cached WHERE j IS NOT NULL)),
orphans AS (SELECT refTable, refKey, refField, chunkId, min(other) AS other, min(ts) AS ts FROM refs LEFT JOIN seen ON seen.id = chunkId
  WHERE chunkId IS NOT NULL AND (seen.id IS NULL OR ts < first_ts) GROUP BY ALL)"""


@register("p4_found", _ORPHANS + " SELECT refTable, refKey, refField, chunkId FROM orphans")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("refTable", "refKey", "refField", "chunkId").distinct()


@register(
    "p4_counts",
    _ORPHANS + """, dated AS (SELECT o.*, CASE WHEN refTable = 'dependencies' THEN s.first_ts ELSE ts END AS stamp FROM orphans o LEFT JOIN seen s ON s.id = o.other)
SELECT refTable, coalesce(strftime(stamp, '%Y-%m'), 'unknown') AS month, CAST(count(*) AS BIGINT) AS n_references, CAST(count(DISTINCT chunkId) AS BIGINT) AS n_ids FROM dated GROUP BY 1, 2""",
)
def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_counts(_orphans(spark, folder))
