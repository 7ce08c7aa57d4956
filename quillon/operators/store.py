"""The store's table operations: filters, lookups, statistics, upserts, merges, deletes, eviction, exchange.

Tables are DataFrames; operations give the new table, and the caller writes it. None collects rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.schema import SCHEMA_VERSION

#: Fixed value: chunks kept by default.
MAX_CHUNKS = 10_000


def latest_tier(routing: DataFrame) -> DataFrame:
    """chunkId, tier of the newest routing row per chunk, by timestamp, then id."""
    newest = routing.where("chunkId IS NOT NULL").groupBy("chunkId").agg(F.max(F.struct(F.col("timestamp").alias("t"), "id", "tier")).alias("m"))
    return newest.select("chunkId", "m.tier")


def query_chunks(chunks: DataFrame, source: str | None = None, type_: str | None = None, path: str | None = None, contains: str | None = None, tier: str | None = None, routing: DataFrame | None = None) -> DataFrame:
    """Chunks that meet all filters given; `contains` is a LIKE pattern within the text, case-insensitive in ASCII."""
    out = chunks
    for column, value in (("source", source), ("type", type_), ("path", path)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if contains is not None:
        out = out.where(F.col("text").ilike(f"%{contains}%"))
    if tier is not None:
        if routing is None:
            raise ValueError("filtering by tier needs the routing history")
        out = out.join(latest_tier(routing).where(F.col("tier") == tier).select(F.col("chunkId").alias("id")), "id", "left_semi")
    return out


def memory_filter(results: DataFrame, type_: str | None = None, source: str | None = None, path: str | None = None, contains: str | None = None, tier: str | None = None) -> DataFrame:
    """Filter after retrieval: equality for type, source and tier; plain, case-sensitive substrings otherwise."""
    out = results
    for column, value in (("type", type_), ("source", source), ("tier", tier)):
        if value is not None:
            out = out.where(F.col(column) == value)
    for column, value in (("path", path), ("text", contains)):
        if value is not None:
            out = out.where(F.col(column).contains(value))
    return out


def find_by_metadata(chunks: DataFrame, key: str, value: str) -> DataFrame:
    return chunks.where(F.get_json_object("metadata", f"$.{key}") == value).orderBy("timestamp", "id").limit(1)


def find_by_hash(chunks: DataFrame, hash_: Column, path: Column) -> DataFrame:
    return chunks.where((F.get_json_object("metadata", "$.contentHash") == hash_) & F.col("path").eqNullSafe(path))


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Ids of chunks without an embedding of the model."""
    have = embeddings.where(F.col("model") == model).select(F.col("chunkId").alias("id")).distinct()
    return chunks.select("id").where("id IS NOT NULL").distinct().join(have, "id", "left_anti")


def store_stats(chunks: DataFrame) -> DataFrame:
    """Per path (or source): n_chunks, tokens, first and last timestamp."""
    where = F.coalesce("path", "source")
    return chunks.groupBy(where.alias("location")).agg(F.count("*").alias("n_chunks"), F.sum(F.coalesce("tokensEstimate", F.lit(0))).cast("long").alias("tokens"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with `rows` in place of those with equal keys; of rows with equal keys one counts (the greatest).

    Keys compare null-safely.
    """
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]) if rest else rows.distinct()
    new = one.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = None
    for k in keys:
        part = table[k].eqNullSafe(new[f"_{k}"])
        same = part if same is None else same & part
    return table.join(new, same, "left_anti").unionByName(one.select(table.columns))


def replace_structure(table: DataFrame, rows: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Symbols or references with those of the given chunks replaced; chunks may end up without any."""
    return table.join(chunk_ids.select(F.col("id").alias("chunkId")).distinct(), "chunkId", "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def delete_chunks(ids: DataFrame, chunks: DataFrame, dependencies: DataFrame, embeddings: DataFrame, symbols: DataFrame, references: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given chunks: rows, embeddings, structure, and edges at either end."""
    gone = ids.select(F.col("id").alias("gone")).distinct()

    def without(table: DataFrame, column: str) -> DataFrame:
        return table.join(gone, F.col(column) == F.col("gone"), "left_anti")

    edges = without(without(dependencies, "fromId"), "toId")
    return {"chunks": without(chunks, "id"), "dependencies": edges, "chunk_embeddings": without(embeddings, "chunkId"), "code_symbols": without(symbols, "chunkId"), "code_references": without(references, "chunkId")}


def eviction(chunks: DataFrame, dependencies: DataFrame, most: int = MAX_CHUNKS) -> DataFrame:
    """Ids to delete so that `most` chunks stay: the oldest (by timestamp, then id) among those without an edge.

    One number, the excess, is fetched; ordering with a limit is distributed.
    """
    ids = chunks.groupBy("id").agg(F.min("timestamp").alias("timestamp")).where("id IS NOT NULL")
    excess = max(0, ids.count() - most)
    linked = dependencies.select(F.explode(F.array("fromId", "toId")).alias("id")).where("id IS NOT NULL").distinct()
    return ids.join(linked, "id", "left_anti").orderBy("timestamp", "id").limit(excess).select("id")


def new_by_hash(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows (path, text) whose (path, content hash) isn't stored; hash is added; repeats come once."""
    hashed = incoming.withColumn("hash", X.content_hash(F.col("text"))).dropDuplicates(["path", "hash"])
    have = stored.select(F.col("path").alias("s_path"), X.content_hash(F.col("text")).alias("s_hash")).distinct()
    return hashed.join(have, F.col("path").eqNullSafe(F.col("s_path")) & (F.col("hash") == F.col("s_hash")), "left_anti")


def reingest(before: DataFrame, after: DataFrame) -> DataFrame:
    """How each piece of a file changes: path, hash, nr, action (reused, created, deleted), old_id, new_id.

    Pieces match by path and content hash as multisets, first by first in the order of ord; `before` and
    `after` have path, ord, id and text.
    """

    def numbered(rows: DataFrame, id_: str) -> DataFrame:
        hashed = rows.select("path", "ord", F.col("id").alias(id_), X.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))
        return hashed.withColumn("nr", F.row_number().over(Window.partitionBy("path", "hash").orderBy("ord", id_))).drop("ord")

    joined = numbered(before, "old_id").join(numbered(after, "new_id"), ["path", "hash", "nr"], "full")
    action = F.when(F.col("new_id").isNull(), "deleted").when(F.col("old_id").isNull(), "created").otherwise("reused")
    return joined.select("path", "hash", "nr", action.alias("action"), "old_id", "new_id")


def already_current(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming files (path, text) whose stored whole-file hash (path, hash) is the same: nothing to do."""
    return incoming.withColumn("hash", X.content_hash(F.col("text"))).join(stored.select("path", "hash").distinct(), ["path", "hash"], "left_semi")


def write_table(rows: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    """A table as Parquet with the schema's version in its metadata; existing readers keep the old files until commit."""
    marked = rows.select(*[F.col(c).alias(c, metadata={"schema_version": SCHEMA_VERSION}) for c in rows.columns])
    marked.write.mode(mode).parquet(f"{folder}/{name}.parquet")


def export_json(chunks: DataFrame, dependencies: DataFrame, compression: DataFrame, folder: str) -> None:
    """Chunks, edges and cached compressions as JSON lines; embeddings and structure are derived and stay out."""
    for name, rows in (("chunks", chunks), ("dependencies", dependencies), ("compression_cache", compression)):
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def import_json(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    from quillon.schema import CHUNKS, COMPRESSION, DEPENDENCIES

    return {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in (("chunks", CHUNKS), ("dependencies", DEPENDENCIES), ("compression_cache", COMPRESSION))}
