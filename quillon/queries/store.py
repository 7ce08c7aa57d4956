"""Queries on the store: filters, lookups, statistics, merges, deletes, eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import store as T
from quillon.queries.registry import register, table

#: The tables are taken as they were before and after this time, where a query merges two states.
CUT = "2025-07-01"


@register(
    "store_stats",
    "SELECT coalesce(path, source) AS location, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(coalesce(tokensEstimate, 0)) AS BIGINT) AS tokens, min(timestamp) AS oldest, max(timestamp) AS newest FROM chunks GROUP BY 1",
)
def store_stats(spark: SparkSession, folder: str) -> DataFrame:
    return T.store_stats(table(spark, folder, "chunks"))


@register("filter_chunks", "SELECT id, path, timestamp FROM chunks WHERE source = 'file' AND type = 'code' AND text ILIKE '%token%limit%'")
def filter_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return T.query_chunks(table(spark, folder, "chunks"), source="file", type_="code", contains="token%limit").select("id", "path", "timestamp")


_LATEST = "latest AS (SELECT chunkId, tier FROM routing_history WHERE chunkId IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunkId ORDER BY timestamp DESC NULLS LAST, id DESC, tier DESC) = 1)"


@register("latest_tier", f"WITH {_LATEST} SELECT chunkId, tier FROM latest")
def latest_tier(spark: SparkSession, folder: str) -> DataFrame:
    return T.latest_tier(table(spark, folder, "routing_history"))


@register("chunks_in_tier", f"WITH {_LATEST} SELECT id, type, path FROM chunks WHERE id IN (SELECT chunkId FROM latest WHERE tier = 'hot')")
def chunks_in_tier(spark: SparkSession, folder: str) -> DataFrame:
    return T.query_chunks(table(spark, folder, "chunks"), tier="hot", routing=table(spark, folder, "routing_history")).select("id", "type", "path")


@register("memory_filter", "SELECT id, type, path FROM chunks WHERE source = 'file' AND contains(path, 'deploy') AND contains(text, 'token')")
def memory_filter(spark: SparkSession, folder: str) -> DataFrame:
    return T.memory_filter(table(spark, folder, "chunks"), source="file", path="deploy", contains="token").select("id", "type", "path")


@register("metadata_lookup", "SELECT id, text FROM chunks WHERE json_valid(metadata) AND json_extract_string(metadata, '$.role') = 'user' ORDER BY timestamp, id LIMIT 1")
def metadata_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return T.find_by_metadata(table(spark, folder, "chunks"), "role", "user").select("id", "text")


@register("missing_embeddings", "SELECT DISTINCT id FROM chunks c WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunk_embeddings e WHERE e.chunkId = c.id AND e.model = 'code-embed-128')")
def missing_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return T.missing_embeddings(table(spark, folder, "chunks"), table(spark, folder, "chunk_embeddings"), "code-embed-128")


@register(
    "new_by_hash",
    f"""SELECT DISTINCT path, left(sha256(text), 16) AS hash FROM chunks i WHERE timestamp >= '{CUT}'
    AND NOT EXISTS (SELECT 1 FROM chunks s WHERE s.timestamp < '{CUT}' AND s.path IS NOT DISTINCT FROM i.path AND sha256(s.text) = sha256(i.text))""",
)
def new_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks")
    return T.new_by_hash(chunks.where(F.col("timestamp") >= CUT), chunks.where(F.col("timestamp") < CUT)).select("path", "hash")


@register(
    "reingest_counts",
    f"""WITH rows AS (SELECT path, left(sha256(coalesce(text, '')), 16) AS hash, timestamp >= '{CUT}' AS late, timestamp, id FROM chunks WHERE path IS NOT NULL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY path, hash, late ORDER BY timestamp, id) AS nr FROM rows WHERE late IS NOT NULL),
    joined AS (SELECT b.id AS old_id, a.id AS new_id FROM (SELECT * FROM numbered WHERE NOT late) b FULL JOIN (SELECT * FROM numbered WHERE late) a ON a.path = b.path AND a.hash = b.hash AND a.nr = b.nr)
    SELECT CASE WHEN new_id IS NULL THEN 'deleted' WHEN old_id IS NULL THEN 'created' ELSE 'reused' END AS action, CAST(count(*) AS BIGINT) AS n FROM joined GROUP BY 1""",
)
def reingest_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").where("path IS NOT NULL AND timestamp IS NOT NULL").select("path", F.col("timestamp").alias("ord"), "id", "text")
    return T.reingest(rows.where(F.col("ord") < CUT), rows.where(F.col("ord") >= CUT)).groupBy("action").agg(F.count("*").alias("n"))


@register(
    "evict_unlinked",
    """WITH ids AS (SELECT id, min(timestamp) AS t FROM chunks WHERE id IS NOT NULL GROUP BY id),
    free AS (SELECT * FROM ids WHERE id NOT IN (SELECT fromId FROM dependencies WHERE fromId IS NOT NULL) AND id NOT IN (SELECT toId FROM dependencies WHERE toId IS NOT NULL)),
    placed AS (SELECT id, row_number() OVER (ORDER BY t, id) AS nr FROM free)
    SELECT id FROM placed WHERE nr <= greatest(0, (SELECT count(*) FROM ids) - 1000)""",
)
def evict_unlinked(spark: SparkSession, folder: str) -> DataFrame:
    return T.eviction(table(spark, folder, "chunks"), table(spark, folder, "dependencies"), 1000)


@register(
    "delete_cascade",
    """WITH gone AS (SELECT DISTINCT chunkId AS id FROM chunk_deletions)
    SELECT 'chunks' AS name, CAST(count(*) AS BIGINT) AS n FROM chunks WHERE id IS NULL OR id NOT IN (SELECT id FROM gone WHERE id IS NOT NULL)
    UNION ALL SELECT 'dependencies', count(*) FROM dependencies WHERE (fromId IS NULL OR fromId NOT IN (SELECT id FROM gone WHERE id IS NOT NULL)) AND (toId IS NULL OR toId NOT IN (SELECT id FROM gone WHERE id IS NOT NULL))
    UNION ALL SELECT 'chunk_embeddings', count(*) FROM chunk_embeddings WHERE chunkId IS NULL OR chunkId NOT IN (SELECT id FROM gone WHERE id IS NOT NULL)""",
)
def delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    from quillon.schema import REFERENCES, SYMBOLS

    gone = table(spark, folder, "chunk_deletions").select(F.col("chunkId").alias("id"))
    left = T.delete_chunks(gone, *(table(spark, folder, t) for t in ("chunks", "dependencies", "chunk_embeddings")), spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], REFERENCES))
    counts = [left[t].agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("chunks", "dependencies", "chunk_embeddings")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register(
    "upsert_edges",
    """WITH late AS (SELECT fromId, toId, type, max(weight) AS weight FROM dependencies WHERE weight >= 0.6 GROUP BY ALL)
    SELECT * FROM late UNION ALL SELECT fromId, toId, type, weight FROM dependencies d WHERE (weight < 0.6 OR weight IS NULL)
    AND NOT EXISTS (SELECT 1 FROM late l WHERE l.fromId IS NOT DISTINCT FROM d.fromId AND l.toId IS NOT DISTINCT FROM d.toId AND l.type IS NOT DISTINCT FROM d.type)""",
)
def upsert_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = table(spark, folder, "dependencies")
    return T.upsert(edges.where("weight < 0.6 OR weight IS NULL"), edges.where("weight >= 0.6"), ["fromId", "toId", "type"])


@register(
    "debounced_events",
    """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    bursts AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT * FROM marked))
    SELECT user_id, max(ts) AS ts, CAST(count(*) AS BIGINT) AS n_events FROM bursts GROUP BY user_id, burst""",
)
def debounced_events(spark: SparkSession, folder: str) -> DataFrame:
    from quillon.streaming.ingest import debounced

    events = table(spark, folder, "events").where("ts IS NOT NULL").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("kind"), "ts", F.col("props").alias("text"))
    return debounced(events, "1 hour").select(F.col("path").cast("long").alias("user_id"), "ts", "n_events")


@register("event_counts", "SELECT date_trunc('hour', ts) AS start, event_type AS kind, CAST(count(*) AS BIGINT) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    from quillon.streaming.ingest import event_counts as counts

    return counts(table(spark, folder, "events"))
