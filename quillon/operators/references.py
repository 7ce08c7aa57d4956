"""Orphan references: ids that point to no chunk, or to one that came only later.

A skew-aware split, whatever the size:

1. References are pre-aggregated per (table, field, referenced id, month), which collapses a hot id to a handful of
   rows on the map side.
2. Heavy ids are those with more than one in `HEAVY_IDS` of all references, so there are at most `HEAVY_IDS` of
   them. What the chunks say of them is broadcast, and their references, sound ones included, are checked where they
   lie: they are never shuffled.
3. The groups of all other ids, none of which is large, are checked by a shuffle anti-join against the chunks, and
   the rows of the bad groups are fetched by a shuffle join on the id.
4. Both kinds of orphans are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.materialize import materialize

#: Characters that count as white space around an id.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u2028\u2029\u3000\ufeff"
#: Most heavy ids, which are broadcast (about 150 bytes each): those with more than one in so many references.
HEAVY_IDS = 20_000


def normal_id(c: Column) -> Column:
    """An id without surrounding white space, in lower case; null where nothing is left."""
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def json_strings(c: Column) -> Column:
    """The elements of a JSON array as strings; null if the text isn't one whole, strict JSON array.

    Numbers and nested values count by their JSON text.
    """
    text = F.btrim(c, F.lit(BLANKS))
    opts = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false", "mode": "PERMISSIVE"}
    whole = F.json_array_length(text).isNotNull() & text.startswith("[") & text.endswith("]")
    return F.when(whole, F.from_json(text, "array<string>", opts))


def month(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("unknown"))


def references(dependencies: DataFrame, cache: DataFrame, routing: DataFrame) -> DataFrame:
    """All references as rows: ref_table, ref_field, ref_key, chunk_id, ref_ts, other_id, period."""
    end = F.struct
    a, b = normal_id(F.col("fromId")), normal_id(F.col("toId"))
    key = F.concat_ws(">", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")), F.coalesce(F.col("type"), F.lit("")))
    none = F.lit(None).cast("timestamp")
    edges = dependencies.select(
        key.alias("k"),
        F.explode(
            F.array(
                end(F.lit("fromId").alias("f"), a.alias("c"), b.alias("o")),
                end(F.lit("toId").alias("f"), b.alias("c"), a.alias("o")),
            )
        ).alias("e"),
    ).select(F.lit("dependencies").alias("ref_table"), F.col("e.f").alias("ref_field"), F.col("k").alias("ref_key"), F.col("e.c").alias("chunk_id"), none.alias("ref_ts"), F.col("e.o").alias("other_id"))
    cached = cache.select(F.col("id").cast("string").alias("k"), F.col("timestamp").cast("timestamp").alias("t"), F.explode(json_strings(F.col("sourceChunkIds"))).alias("c")).select(
        F.lit("compression_cache").alias("ref_table"), F.lit("sourceChunkIds").alias("ref_field"), F.col("k").alias("ref_key"), normal_id(F.col("c")).alias("chunk_id"), F.col("t").alias("ref_ts"), F.lit(None).cast("string").alias("other_id")
    )
    routed = routing.select(
        F.lit("routing_history").alias("ref_table"),
        F.lit("chunkId").alias("ref_field"),
        F.col("id").cast("string").alias("ref_key"),
        normal_id(F.col("chunkId")).alias("chunk_id"),
        F.col("timestamp").cast("timestamp").alias("ref_ts"),
        F.lit(None).cast("string").alias("other_id"),
    )
    every = edges.unionByName(cached).unionByName(routed)
    return every.where("chunk_id IS NOT NULL").withColumn("period", F.coalesce(F.date_format("ref_ts", "yyyy-MM"), F.lit("")))


def first_seen(chunks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Per chunk id (of those in `only`, h_id) the time of its earliest row (null if no row has one)."""
    rows = chunks.select(normal_id(F.col("id")).alias("seen_id"), F.col("timestamp").cast("timestamp").alias("ts")).where("seen_id IS NOT NULL")
    if only is not None:
        rows = rows.join(only, F.col("seen_id") == F.col("h_id"), "left_semi")
    return rows.groupBy("seen_id").agg(F.min("ts").alias("first_ts"))


def heavy_ids(groups: DataFrame, heavy: int) -> DataFrame:
    """The ids (h_id) that hold more than one in `heavy` of the references counted in `groups`: at most `heavy` ids."""
    per_id = groups.groupBy("chunk_id").agg(F.sum("n").alias("n"))
    total = per_id.agg(F.sum("n").alias("total"))
    return per_id.join(F.broadcast(total)).where(F.col("n") * heavy > F.col("total")).select(F.col("chunk_id").alias("h_id"))


def orphan_references(chunks: DataFrame, dependencies: DataFrame, cache: DataFrame, routing: DataFrame, heavy: int = HEAVY_IDS) -> DataFrame:
    """Distinct orphan references: refTable, refKey, refField, chunkId, month.

    A reference is an orphan if its id (trimmed, lower case) has no row in `chunks`, or if it has a time
    and the id's earliest row is later. Null and blank ids are no references, nor is anything in a
    `sourceChunkIds` that isn't a valid JSON array. A missing time on either side is no lateness. `month`
    is that of the referring row; for edges that of the other end's earliest row, else "unknown". If a
    reference was delivered repeatedly with different times, its earliest orphan month is given. Empty
    tables give no rows; columns beyond those named are ignored. `heavy` changes no result.
    """
    refs = references(dependencies, cache, routing)
    groups = materialize(refs.groupBy("ref_table", "ref_field", "chunk_id", "period").agg(F.count("*").alias("n"), F.min("ref_ts").alias("min_ts")))
    hot = materialize(heavy_ids(groups, heavy))
    seen = first_seen(chunks).withColumn("known", F.lit(True))
    late = F.col("known").isNull() | (F.col("ref_ts") < F.col("first_ts"))
    # heavy ids: what is known of them goes to their references
    told = materialize(hot.join(first_seen(chunks, F.broadcast(hot)).withColumn("known", F.lit(True)), F.col("h_id") == F.col("seen_id"), "left").select("h_id", "known", "first_ts"))
    heavy_rows = refs.join(F.broadcast(told), F.col("chunk_id") == F.col("h_id")).where(late)
    # all others: bad groups by an anti-join, then their rows
    held = F.broadcast(hot)
    light = groups.join(held, F.col("chunk_id") == F.col("h_id"), "left_anti").join(seen, F.col("chunk_id") == F.col("seen_id"), "left")
    bad = light.where("known IS NULL OR min_ts < first_ts").select(F.col("ref_table").alias("b_table"), F.col("ref_field").alias("b_field"), F.col("chunk_id").alias("b_id"), F.col("period").alias("b_period"), "known", "first_ts")
    matches = (F.col("chunk_id") == F.col("b_id")) & (F.col("ref_table") == F.col("b_table")) & (F.col("ref_field") == F.col("b_field")) & (F.col("period") == F.col("b_period"))
    light_rows = refs.join(held, F.col("chunk_id") == F.col("h_id"), "left_anti").join(bad, matches).where(late)
    rows = heavy_rows.select(refs.columns).unionByName(light_rows.select(refs.columns))
    orphans = materialize(rows.groupBy("ref_table", "ref_key", "ref_field", "chunk_id").agg(F.min("ref_ts").alias("ts"), F.min("other_id").alias("other_id")))
    # edges take the month of their other end, which may be heavy too
    edge = F.col("ref_table") == "dependencies"
    plain = orphans.where(edge).drop("ts")
    near = plain.join(F.broadcast(told.select("h_id", F.col("first_ts").alias("ts"))), F.col("other_id") == F.col("h_id"))
    far = plain.join(held, F.col("other_id") == F.col("h_id"), "left_anti").join(seen.select("seen_id", F.col("first_ts").alias("ts")), F.col("other_id") == F.col("seen_id"), "left")
    dated = orphans.where(~edge).unionByName(near.select(orphans.columns)).unionByName(far.select(orphans.columns))
    return dated.select(F.col("ref_table").alias("refTable"), F.col("ref_key").alias("refKey"), F.col("ref_field").alias("refField"), F.col("chunk_id").alias("chunkId"), month(F.col("ts")).alias("month"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references per table and month: refTable, month, n_references, n_ids."""
    return orphans.groupBy("refTable", "month").agg(F.count("*").alias("n_references"), F.countDistinct("chunkId").alias("n_ids"))
